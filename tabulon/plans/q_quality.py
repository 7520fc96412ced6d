"""Quality and cleaning queries (Q1–Q15) over the derived ``dirty`` events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import quality as qa
from tabulon.plans.derived import DIRTY_CTE, dirty_events
from tabulon.plans.registry import query
from tabulon.sources.tables import read_table as T

_NUM = ["event_id", "user_id", "value"]
_COLS = ["event_id", "user_id", "event_type", "value", "ts"]


def _r(df, cols, k=6):
    return df.select(*[F.round(c, k).alias(c) if c in cols else F.col(c) for c in df.columns])


_MISSING_SQL = DIRTY_CTE + ", m AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS position, count(*) - count({c}) AS n_missing, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS percentage FROM dirty"
    for i, c in enumerate(_COLS)) + ") SELECT * FROM m WHERE n_missing > 0"


@query("missing_values", _MISSING_SQL)
def missing_values(spark, d):
    return _r(qa.missing_values(dirty_events(spark, d)), ["percentage"])


_BOUNDS_CTE = ", b AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dirty"
    for c in _NUM) + "), f AS (SELECT column_name, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM b)"
_HITS = ", h AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < lower_bound OR {c} > upper_bound) AS n_outliers, "
    f"(SELECT count(*) FROM dirty) AS n FROM dirty, f WHERE f.column_name = '{c}'" for c in _NUM) + ")"
_OUTLIERS_SQL = DIRTY_CTE + _BOUNDS_CTE + _HITS + """
SELECT h.column_name, n_outliers, round(n_outliers * 100.0 / n, 6) AS percentage,
       round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound
FROM h JOIN f USING (column_name) WHERE n_outliers > 0"""


@query("outliers_iqr", _OUTLIERS_SQL)
def outliers_iqr(spark, d):
    return _r(qa.outliers_iqr(dirty_events(spark, d), _NUM), ["percentage", "lower_bound", "upper_bound"])


_PART_TEXT = ["p_name", "p_brand", "p_type", "p_size_text"]
_NUMTXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _part_text(spark, d):
    p = T(spark, d, "part")
    return p.select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size_text"))


@query("numeric_as_string", "WITH pt AS (SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size_text FROM part)\n"
       + "\nUNION ALL ".join(
           f"SELECT '{c}' AS column_name, 'Column appears numeric but stored as string' AS issue, "
           f"'Convert to numeric type' AS recommendation FROM pt "
           f"HAVING count({c}) > 0 AND count({c}) = count(*) FILTER (WHERE regexp_full_match({c}, '{_NUMTXT}'))"
           for c in _PART_TEXT))
def numeric_as_string(spark, d):
    return qa.numeric_as_string(_part_text(spark, d))


@query("duplicate_rows", DIRTY_CTE + """
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS n_distinct,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS n_duplicates FROM dirty""")
def duplicate_rows(spark, d):
    return qa.duplicate_rows(dirty_events(spark, d))


_SCORE_CTE = (DIRTY_CTE + ", mv AS (" + _MISSING_SQL.split(", m AS (", 1)[1].rsplit(") SELECT", 1)[0] + ")"
              + ", mvf AS (SELECT * FROM mv WHERE n_missing > 0)"
              + _BOUNDS_CTE + _HITS
              + ", ov AS (SELECT column_name, n_outliers * 100.0 / n AS percentage FROM h WHERE n_outliers > 0)"
              + ", dp AS (SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS n_duplicates FROM dirty)"
              + """, sc AS (
SELECT greatest(100.0
   - coalesce(least(30.0, (SELECT avg(percentage) FROM mvf) * 0.5), 0)
   - coalesce(least(20.0, (SELECT avg(percentage) FROM ov) * 0.3), 0)
   - CASE WHEN n_duplicates > 0 THEN least(20.0, n_duplicates * 100.0 / n_rows * 0.5) ELSE 0 END, 0) AS quality_score,
   (SELECT avg(percentage) FROM mvf) AS avg_missing_pct, (SELECT count(*) FROM mvf) AS n_missing_cols,
   (SELECT avg(percentage) FROM ov) AS avg_outlier_pct, (SELECT count(*) FROM ov) AS n_outlier_cols,
   n_duplicates, n_rows FROM dp)""")


@query("quality_score", _SCORE_CTE + """
SELECT round(quality_score, 4) AS quality_score, round(avg_missing_pct, 6) AS avg_missing_pct, n_missing_cols,
       round(avg_outlier_pct, 6) AS avg_outlier_pct, n_outlier_cols, n_duplicates, n_rows FROM sc""")
def quality_score(spark, d):
    df = dirty_events(spark, d)
    s = qa.quality_score(qa.missing_values(df), qa.outliers_iqr(df, _NUM), qa.duplicate_rows(df))
    return s.select(F.round("quality_score", 4).alias("quality_score"),
                    F.round("avg_missing_pct", 6).alias("avg_missing_pct"), "n_missing_cols",
                    F.round("avg_outlier_pct", 6).alias("avg_outlier_pct"), "n_outlier_cols", "n_duplicates", "n_rows")


@query("quality_issue_table", _SCORE_CTE + """
SELECT column_name, 'Missing Values' AS issue_type, round(percentage, 6) AS percentage FROM mvf
UNION ALL SELECT column_name, 'Outliers', round(percentage, 6) FROM ov""")
def quality_issue_table(spark, d):
    df = dirty_events(spark, d)
    t = qa.quality_issue_table(qa.missing_values(df), qa.outliers_iqr(df, _NUM))
    return _r(t, ["percentage"])


@query("quality_report", _SCORE_CTE + """
SELECT round(quality_score, 4) AS quality_score,
       CASE WHEN quality_score >= 80 THEN 'green' WHEN quality_score >= 60 THEN 'yellow' ELSE 'red' END AS band,
       n_rows, n_missing_cols, n_outlier_cols, n_duplicates, CAST(0 AS BIGINT) AS n_type_issues,
       (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM mvf) AS missing_columns,
       (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM ov) AS outlier_columns
FROM sc""")
def quality_report(spark, d):
    r = qa.quality_report(dirty_events(spark, d))
    return r.select(F.round("quality_score", 4).alias("quality_score"), "band", "n_rows", "n_missing_cols",
                    "n_outlier_cols", "n_duplicates", "n_type_issues", "missing_columns", "outlier_columns")


@query("recommendation_text", _SCORE_CTE + """
SELECT printf('Basic recommendations:\n- Address missing values in %d columns\n- Review outliers in %d columns\n- Remove %d duplicate rows',
              n_missing_cols, n_outlier_cols, n_duplicates) AS recommendations FROM sc""")
def recommendation_text(spark, d):
    return qa.recommendation_text(qa.quality_report(dirty_events(spark, d)))


_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts"
_SPARSE = DIRTY_CTE + """, kept AS (
  SELECT * FROM dirty
  WHERE (CASE WHEN event_id IS NULL THEN 0 ELSE 1 END + CASE WHEN user_id IS NULL THEN 0 ELSE 1 END
       + CASE WHEN event_type IS NULL THEN 0 ELSE 1 END + CASE WHEN value IS NULL THEN 0 ELSE 1 END
       + CASE WHEN ts IS NULL THEN 0 ELSE 1 END) >= 3)"""


def _ts(df):
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("drop_sparse_rows", _SPARSE + f" SELECT event_id, user_id, event_type, value, {_TS} FROM kept")
def drop_sparse_rows(spark, d):
    return _ts(qa.drop_sparse_rows(dirty_events(spark, d)))


_FILLED = _SPARSE + """, med AS (SELECT quantile_cont(value, 0.5) AS mv FROM kept),
mode_t AS (SELECT event_type AS mt FROM kept WHERE event_type IS NOT NULL GROUP BY event_type
           ORDER BY count(*) DESC, event_type LIMIT 1),
filled AS (SELECT event_id, user_id, coalesce(event_type, (SELECT mt FROM mode_t)) AS event_type,
                  coalesce(value, (SELECT mv FROM med)) AS value, ts FROM kept)"""


@query("fill_median", _FILLED + f""" SELECT event_id, user_id, event_type, round(coalesce(value, (SELECT mv FROM med)), 6) AS value, {_TS}
FROM kept""".replace(", event_type, round(coalesce", ", kept.event_type AS event_type, round(coalesce"))
def fill_median(spark, d):
    kept = qa.drop_sparse_rows(dirty_events(spark, d))
    return _r(_ts(qa.fill_missing(kept, categorical=False)), ["value"])


@query("fill_mode", _FILLED + f" SELECT event_id, user_id, coalesce(event_type, (SELECT mt FROM mode_t)) AS event_type, value, {_TS} FROM kept")
def fill_mode(spark, d):
    kept = qa.drop_sparse_rows(dirty_events(spark, d))
    return _ts(qa.fill_missing(kept, numeric=False))


_CLIP = DIRTY_CTE + _BOUNDS_CTE + _HITS + """, hit AS (SELECT f.* FROM f JOIN h USING (column_name) WHERE n_outliers > 0)"""


def _clip_expr(c, src="t"):
    return (f"CASE WHEN (SELECT count(*) FROM hit WHERE column_name = '{c}') = 0 THEN {src}.{c} "
            f"WHEN {src}.{c} < (SELECT lower_bound FROM hit WHERE column_name = '{c}') THEN (SELECT lower_bound FROM hit WHERE column_name = '{c}') "
            f"WHEN {src}.{c} > (SELECT upper_bound FROM hit WHERE column_name = '{c}') THEN (SELECT upper_bound FROM hit WHERE column_name = '{c}') "
            f"ELSE {src}.{c} END")


@query("winsorize", _CLIP + f"""
SELECT CAST({_clip_expr('event_id')} AS BIGINT) AS event_id, CAST({_clip_expr('user_id')} AS BIGINT) AS user_id,
       event_type, round({_clip_expr('value')}, 6) AS value, {_TS} FROM dirty t""")
def winsorize(spark, d):
    df = dirty_events(spark, d)
    w = qa.winsorize(df, qa.outlier_bounds(df))
    return _r(_ts(w), ["value"])


@query("drop_duplicates", _CLIP + f"""
SELECT DISTINCT CAST({_clip_expr('event_id')} AS BIGINT) AS event_id, CAST({_clip_expr('user_id')} AS BIGINT) AS user_id,
       event_type, round({_clip_expr('value')}, 6) AS value, {_TS} FROM dirty t""")
def drop_duplicates(spark, d):
    df = dirty_events(spark, d)
    return _r(_ts(qa.winsorize(df, qa.outlier_bounds(df)).dropDuplicates()), ["value"])


_CLEAN = (_FILLED.replace(DIRTY_CTE, DIRTY_CTE + _BOUNDS_CTE.lstrip(",").join([", ", ""]) if False else DIRTY_CTE)
          + _BOUNDS_CTE + _HITS + """, hit AS (SELECT f.* FROM f JOIN h USING (column_name) WHERE n_outliers > 0),
cleaned AS (SELECT DISTINCT """ + f"""CAST({_clip_expr('event_id')} AS BIGINT) AS event_id,
  CAST({_clip_expr('user_id')} AS BIGINT) AS user_id, event_type, {_clip_expr('value')} AS value, ts FROM filled t)""")


@query("clean", _CLEAN + f" SELECT event_id, user_id, event_type, round(value, 6) AS value, {_TS} FROM cleaned")
def clean(spark, d):
    return _r(_ts(qa.clean(dirty_events(spark, d))), ["value"])


@query("rows_removed", _CLEAN + """
SELECT (SELECT count(*) FROM dirty) AS rows_before, count(*) AS rows_after,
       (SELECT count(*) FROM dirty) - count(*) AS rows_removed FROM cleaned""")
def rows_removed(spark, d):
    df = dirty_events(spark, d)
    return qa.rows_removed(df, qa.clean(df))


def _nan_events(spark, d):
    """The ``dirty`` events with NaN where ``value`` is missing: missing all the same."""
    return dirty_events(spark, d).withColumn("value", F.coalesce("value", F.lit(float("nan"))))


@query("missing_values_nan", _MISSING_SQL)
def missing_values_nan(spark, d):
    return _r(qa.missing_values(_nan_events(spark, d)), ["percentage"])


@query("outliers_iqr_nan", _OUTLIERS_SQL)
def outliers_iqr_nan(spark, d):
    return _r(qa.outliers_iqr(_nan_events(spark, d), _NUM), ["percentage", "lower_bound", "upper_bound"])


@query("quality_score_nan", _SCORE_CTE + """
SELECT round(quality_score, 4) AS quality_score, n_missing_cols, n_outlier_cols, n_duplicates, n_rows FROM sc""")
def quality_score_nan(spark, d):
    r = qa.quality_report(_nan_events(spark, d))
    return r.select(F.round("quality_score", 4).alias("quality_score"), "n_missing_cols", "n_outlier_cols",
                    "n_duplicates", "n_rows")


@query("clean_nan", _CLEAN + f" SELECT event_id, user_id, event_type, round(value, 6) AS value, {_TS} FROM cleaned")
def clean_nan(spark, d):
    return _r(_ts(qa.clean(_nan_events(spark, d))), ["value"])


@query("describe_nan", DIRTY_CTE + """
SELECT 'value' AS column_name, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) AS min, quantile_cont(value, 0.5) AS p50, max(value) AS max, count(*) AS row_count FROM dirty""")
def describe_nan(spark, d):
    from tabulon.operators.stats import describe
    out = describe(_nan_events(spark, d), ["value"])
    return _r(out.select("column_name", "count", "mean", "std", "min", "p50", "max", "row_count"), ["mean", "std"])
