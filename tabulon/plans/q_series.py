"""Trend, seasonality and anomaly queries (end of SURVEY §2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import series as ts
from tabulon.plans.registry import query
from tabulon.sources.tables import read_table as T

# Whole currency units: sums of them are exact, so both engines add up the same trend.
_PARTS_SQL = """
m AS (SELECT p_brand, date_trunc('month', l_shipdate)::TIMESTAMP AS period,
             round(sum(l_extendedprice::DECIMAL(14,2) * (1 - l_discount::DECIMAL(4,2))), 0)::DOUBLE AS value
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate IS NOT NULL GROUP BY ALL),
span AS (SELECT p_brand, min(period) AS lo, max(period) AS hi FROM m GROUP BY 1),
grid AS (SELECT p_brand, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS period FROM span),
s AS (SELECT p_brand, period, coalesce(value, 0.0) AS value,
             row_number() OVER (PARTITION BY p_brand ORDER BY period) - 1 AS t
      FROM grid LEFT JOIN m USING (p_brand, period)),
tr AS (SELECT *, month(period) - 1 AS season_idx,
              CASE WHEN count(value) OVER f = 13
                   THEN (sum(value) OVER f - (lag(value, 6) OVER w + lead(value, 6) OVER w) / 2) / 12 END AS trend
       FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY period),
                     f AS (PARTITION BY p_brand ORDER BY period ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
place AS (SELECT p_brand, season_idx, avg(value - trend) AS raw FROM tr GROUP BY ALL),
idx AS (SELECT p_brand, season_idx, raw - avg(raw) OVER (PARTITION BY p_brand) AS seasonal FROM place),
parts AS (SELECT tr.*, seasonal, value - trend - seasonal AS remainder FROM tr JOIN idx USING (p_brand, season_idx))"""


def _monthly(spark, d):
    """Revenue per part and month, then per brand: a part with a third of all lines
    collapses before the join."""
    revenue = F.col("l_extendedprice").cast("decimal(14,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    per_part = (T(spark, d, "lineitem").filter(F.col("l_shipdate").isNotNull())
                .groupBy("l_partkey", F.date_trunc("month", "l_shipdate").alias("month")).agg(F.sum(revenue).alias("revenue")))
    part = T(spark, d, "part").select("p_partkey", "p_brand")
    return per_part.join(part, F.col("l_partkey") == F.col("p_partkey"))


def _parts(spark, d):
    return ts.seasonal_parts(_monthly(spark, d), ["p_brand"], "month", F.round(F.sum("revenue"), 0))


@query("seasonal_parts", f"""
WITH {_PARTS_SQL}
SELECT p_brand, period, t::INTEGER AS t, value, trend, season_idx::INTEGER AS season_idx,
       round(seasonal, 6) AS seasonal, round(remainder, 6) AS remainder FROM parts""")
def seasonal_parts(spark, d):
    """Monthly revenue of every brand as trend, seasonal part and remainder."""
    return _parts(spark, d).select("p_brand", "period", "t", "value", "trend", "season_idx",
                                   F.round("seasonal", 6).alias("seasonal"), F.round("remainder", 6).alias("remainder"))


@query("series_strength", f"""
WITH {_PARTS_SQL}
SELECT p_brand, count(*) AS n_periods, round(regr_slope(trend, t), 4) AS slope,
       round(greatest(0.0, 1 - var_pop(remainder) / var_pop(trend + remainder)), 6) AS trend_strength,
       round(greatest(0.0, 1 - var_pop(remainder) / var_pop(seasonal + remainder)), 6) AS seasonal_strength,
       arg_max(season_idx, seasonal)::INTEGER AS peak_idx FROM parts GROUP BY p_brand""")
def series_strength(spark, d):
    """How strongly each brand's revenue follows a trend and a season."""
    found = ts.series_strength(_parts(spark, d), ["p_brand"])
    return found.select("p_brand", "n_periods", F.round("slope", 4).alias("slope"),
                        F.round("trend_strength", 6).alias("trend_strength"),
                        F.round("seasonal_strength", 6).alias("seasonal_strength"), "peak_idx")


@query("series_anomalies", """
WITH h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS period, count(*)::DOUBLE AS value
           FROM events WHERE ts IS NOT NULL GROUP BY ALL),
span AS (SELECT event_type, min(period) AS lo, max(period) AS hi FROM h GROUP BY 1),
grid AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS period FROM span),
s AS (SELECT event_type, period, coalesce(value, 0.0) AS value FROM grid LEFT JOIN h USING (event_type, period)),
f AS (SELECT *, list_concat(list(value) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
                            list(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)) AS near
      FROM s WINDOW w AS (PARTITION BY event_type ORDER BY period)),
m AS (SELECT *, CASE WHEN len(near) >= 5 THEN list_median(near) END AS median FROM f),
a AS (SELECT *, list_transform(near, lambda x: abs(x - median)) AS far FROM m),
u AS (SELECT *, CASE WHEN median IS NOT NULL THEN list_median(far) END AS mad, list_sum(far) / len(far) AS mean_ad FROM a),
z AS (SELECT *, CASE WHEN mad > 0 THEN mad * 1.4826::DOUBLE ELSE mean_ad * 1.253314::DOUBLE END AS unit FROM u),
r AS (SELECT *, CASE WHEN median IS NOT NULL AND unit > 0 THEN (value - median) / unit END AS score FROM z),
k AS (SELECT *, coalesce(abs(score) > 3.5, false) OR coalesce(unit = 0 AND value <> median, false) AS is_anomaly FROM r)
SELECT event_type, period, value, median, mad, round(score, 6) AS score, is_anomaly,
       CASE WHEN is_anomaly THEN CASE WHEN value > median THEN 'high' ELSE 'low' END END AS direction FROM k""")
def series_anomalies(spark, d):
    """Hours with unusually many or few events of a type, against the day before and after."""
    found = ts.series_anomalies(T(spark, d, "events"), ["event_type"], "ts", F.count(F.lit(1)), "hour", 24, fill=0.0)
    return found.withColumn("score", F.round("score", 6))
