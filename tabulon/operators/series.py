"""Trend, seasonality and anomalies of many series at once.

A table becomes one value per key and period by a partial aggregation, so a key with a
third of all rows collapses before the shuffle.  What follows are keyed windows with
bounded frames over periods: the rows of a series are the periods of its time span, not
the rows of the table, and no series is collected.  Only the array of one frame (``window``
values) is ever held for a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import q

#: Periods a series may step by, and Spark's interval for one step.
PERIODS = {"hour": "INTERVAL '1' HOUR", "day": "INTERVAL '1' DAY", "week": "INTERVAL '7' DAY",
           "month": "INTERVAL '1' MONTH", "quarter": "INTERVAL '3' MONTH", "year": "INTERVAL '1' YEAR"}
#: Position of a period in its season, for the seasons that the calendar gives.
_SEASONS = {("hour", 24): lambda t: F.hour(t), ("day", 7): lambda t: F.weekday(t),
            ("month", 12): lambda t: F.month(t) - 1, ("quarter", 4): lambda t: F.quarter(t) - 1}
#: Scales a median absolute deviation, and a mean one, to a standard deviation of a normal law.
MAD_SCALE = 1.4826
MEAN_AD_SCALE = 1.253314


def period_series(df: DataFrame, keys: Sequence[str], time_col: str, value: Column, period: str,
                  fill: float | None = None) -> DataFrame:
    """One row per key and period: keys, period, t (number of the period within its key,
    from 0) and value.

    ``value`` is an aggregate of the period's rows.  Every period between the first and
    the last of a key is there; one without rows has the value ``fill`` (None: null).
    Rows without a time are left out; a null key is a key."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {list(PERIODS)}")
    start = F.date_trunc(period, q(time_col))
    found = (df.filter(q(time_col).isNotNull()).groupBy(*[q(k) for k in keys], start.alias("period"))
             .agg(value.cast("double").alias("value")))
    # Gaps are filled from each row to its successor: no grid is built and joined.
    own = Window.partitionBy(*[q(k) for k in keys]).orderBy("period")
    last = F.coalesce(F.lead("period").over(own) - F.expr("INTERVAL '1' SECOND"), F.col("period"))
    steps = F.sequence(F.col("period"), F.col("last"), F.expr(PERIODS[period]))
    filler = F.lit(fill).cast("double")
    out = (found.withColumn("last", last)
           .select(*[q(k) for k in keys], "value", F.posexplode(steps).alias("gap", "period"))
           .withColumn("value", F.when(F.col("gap") == 0, F.col("value")).otherwise(filler)))
    if fill is not None:
        out = out.withColumn("value", F.coalesce("value", filler))
    return out.select(*[q(k) for k in keys], "period", (F.row_number().over(own) - 1).alias("t"), "value")


def moving_average(values: Column, order: Window, season: int) -> Column:
    """Centred average of ``season`` periods; with an even number the two outer ones of
    ``season + 1`` count half.  Null where the frame reaches beyond the series or holds a null."""
    half = season // 2
    whole = order.rowsBetween(-half, half)
    full = F.count(values).over(whole) == 2 * half + 1
    total = F.sum(values).over(whole)
    if season % 2 == 0:
        total = total - (F.lag(values, half).over(order) + F.lead(values, half).over(order)) / 2
    return F.when(full, total / season)


def seasonal_parts(df: DataFrame, keys: Sequence[str], time_col: str, value: Column, period: str = "month",
                   season: int = 12, model: str = "additive", fill: float | None = 0.0) -> DataFrame:
    """Classical decomposition of every series: keys, period, t, value, trend, season_idx,
    seasonal, remainder.

    ``trend`` is the centred moving average over one season.  ``seasonal`` is the average of
    what the trend leaves at the same place of the season, shifted (``multiplicative``:
    scaled) so that a whole season adds nothing (averages to 1).  ``remainder`` is the
    rest: value - trend - seasonal, or value / (trend * seasonal).  ``season_idx`` is the
    calendar's (month of the year, day of the week, hour of the day, quarter) where the
    season is that, else t modulo the season.  The trend is null in the first and last half
    season; a series shorter than a season has no trend and no seasonal part.  A place of the
    season without any value has a null seasonal part, and the others are shifted by
    their own average.  Division by zero gives null."""
    if model not in ("additive", "multiplicative"):
        raise ValueError("model must be additive or multiplicative")
    if season < 2:
        raise ValueError("a season has two periods at least")
    by = [q(k) for k in keys]
    series = period_series(df, keys, time_col, value, period, fill)
    order = Window.partitionBy(*by).orderBy("t")
    place = _SEASONS.get((period, season), lambda t: F.pmod(F.col("t"), F.lit(season)))(F.col("period"))
    split = (lambda a, b: a - b) if model == "additive" else F.try_divide
    parts = series.withColumn("trend", moving_average(F.col("value"), order, season))
    parts = parts.withColumn("season_idx", place.cast("int")).withColumn("_left", split(F.col("value"), F.col("trend")))
    same = F.avg("_left").over(Window.partitionBy(*by, "season_idx"))
    parts = parts.withColumn("_raw", same)
    # One row of every place of the season stands for it in the average of the season.
    first = F.row_number().over(Window.partitionBy(*by, "season_idx").orderBy("t")) == 1
    mean = F.avg(F.when(F.col("_first"), F.col("_raw"))).over(Window.partitionBy(*by))
    parts = parts.withColumn("_first", first).withColumn("seasonal", split(F.col("_raw"), mean))
    rest = (F.col("value") - F.col("trend") - F.col("seasonal") if model == "additive"
            else F.try_divide(F.col("value"), F.col("trend") * F.col("seasonal")))
    return parts.select(*by, "period", "t", "value", "trend", "season_idx", "seasonal", rest.alias("remainder"))


def series_strength(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From additive :func:`seasonal_parts`, one row per series: keys, n_periods, slope (of the
    trend, per period), trend_strength, seasonal_strength and peak_idx.

    A strength is 1 - var(remainder) / var(part + remainder), 0 at least, over the periods
    that have a remainder; null where that variance is 0 or there are fewer than two.
    ``peak_idx``: the place of the season with the greatest seasonal part (the first on ties)."""
    rest = F.col("remainder")

    def strength(part: str) -> Column:
        both = F.when(rest.isNotNull(), F.col(part) + rest)
        return F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_pop(rest), F.var_pop(both)))

    enough = F.count(rest) >= 2
    peak = F.max_by("season_idx", F.struct(F.col("seasonal"), -F.col("season_idx")))
    return parts.groupBy(*[q(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n_periods"), F.regr_slope("trend", F.col("t").cast("double")).alias("slope"),
        F.when(enough & (F.var_pop(F.col("trend") + rest) > 0), strength("trend")).alias("trend_strength"),
        F.when(enough & (F.var_pop(F.col("seasonal") + rest) > 0), strength("seasonal")).alias("seasonal_strength"),
        F.when(F.count("seasonal") > 0, peak).alias("peak_idx"))


def _middle(values: Column) -> Column:
    """Median of an array of numbers without nulls; null when it is empty."""
    ordered, n = F.array_sort(values), F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (low + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def series_anomalies(df: DataFrame, keys: Sequence[str], time_col: str, value: Column, period: str = "hour",
                     window: int = 24, threshold: float = 3.5, fill: float | None = None,
                     centred: bool = True, min_values: int = 5) -> DataFrame:
    """Periods that stand out from their neighbours: keys, period, value, median, mad, score,
    is_anomaly, direction.

    The frame of a period is the ``window`` periods before it and, ``centred``, those
    after it, itself left out, so one outlier doesn't hide itself.  ``mad`` is the median
    absolute deviation of the frame from its median.  ``score`` is the distance from the
    median in units of 1.4826 * mad; where more than half of the frame is one value (mad 0) in
    units of 1.253314 times the mean absolute deviation; where all are one value it is null
    and any other value is an anomaly.  ``is_anomaly``: a score above ``threshold`` in
    either direction.  A period without a value, and one with fewer than ``min_values``
    values in its frame, has no median and is no anomaly.  A repeated time is one
    period; ``fill`` is the value of a period without rows (None: no value)."""
    if window < 1:
        raise ValueError("a window has one period at least")
    by = [q(k) for k in keys]
    series = period_series(df, keys, time_col, value, period, fill)
    order = Window.partitionBy(*by).orderBy("t")
    # collect_list leaves nulls out; a frame holds 2 * window values at most.
    near = F.collect_list("value").over(order.rowsBetween(-window, -1))
    if centred:
        near = F.concat(near, F.collect_list("value").over(order.rowsBetween(1, window)))
    found = series.withColumn("_near", near).withColumn("_n", F.size("_near"))
    found = found.withColumn("median", F.when(F.col("_n") >= min_values, _middle(F.col("_near"))))
    found = found.withColumn("_far", F.transform("_near", lambda x: F.abs(x - F.col("median"))))
    found = found.withColumn("mad", F.when(F.col("median").isNotNull(), _middle(F.col("_far"))))
    mean = F.aggregate("_far", F.lit(0.0), lambda a, x: a + x) / F.col("_n")
    unit = F.when(F.col("mad") > 0, F.col("mad") * MAD_SCALE).otherwise(mean * MEAN_AD_SCALE)
    away = F.col("value") - F.col("median")
    found = found.withColumn("score", F.when(F.col("median").isNotNull(), F.try_divide(away, unit)))
    flat = F.col("median").isNotNull() & (unit == 0) & (away != 0)
    hit = F.coalesce((F.abs("score") > threshold) | flat, flat, F.lit(False))
    found = found.withColumn("is_anomaly", F.coalesce(hit, F.lit(False)))
    way = F.when(F.col("is_anomaly"), F.when(away > 0, "high").otherwise("low"))
    return found.select(*by, "period", "value", "median", "mad", "score", "is_anomaly", way.alias("direction"))
