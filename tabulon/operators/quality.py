"""Data quality checks and cleaning.

Every check is one or two aggregation jobs over the whole table; per-column
results come back as long rows.  Cleaning reads only bounded metadata on the
driver (one median / mode / bound pair per column) and applies it as literal
column expressions, so the cleaned table itself never leaves the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import NUMERIC_TEXT, is_numeric, normalise_nan, numeric_columns, q
from tabulon.operators.ranking import column_quantiles
from tabulon.session import local_frame, small_frame
from tabulon.sources.guards import require_rows


def column_count_aggs(df: DataFrame) -> dict:
    """The aggregates behind Q1 and Q3 (name → column): the row count, each
    column's null count and, for text columns, the non-null and the
    numeric-looking counts."""
    aggs = {"_n": F.count(F.lit(1))}
    for i, f in enumerate(df.schema.fields):
        c = q(f.name)
        aggs[f"_m{i}"] = F.count_if(c.isNull())
        if isinstance(f.dataType, T.StringType):
            aggs[f"_c{i}"] = F.count(c)
            aggs[f"_k{i}"] = F.count_if(c.rlike(NUMERIC_TEXT))
    return aggs


def column_counts(df: DataFrame) -> DataFrame:
    """:func:`column_count_aggs` as one aggregation (a single scan)."""
    return df.agg(*[e.alias(k) for k, e in column_count_aggs(df).items()])


def quality_pass(df: DataFrame, approx: bool = False, probs=(0.25, 0.75), extra: dict | None = None):
    """The quantiles of every numeric column at ``probs`` (which hold 0.25 and
    0.75), with the column counts of Q1/Q3 and the caller's ``extra``
    aggregates riding along in their counting pass; then the outlier hits.

    Returns (counts as a one-row frame, outliers, quantiles, extra values).  A table
    without rows raises."""
    df = normalise_nan(df)
    nums = numeric_columns(df)
    count_aggs = column_count_aggs(df)
    got: dict = {}
    qs = small_frame(column_quantiles(df, nums, list(probs), approx=approx,
                                      extra={**count_aggs, **(extra or {})}, extra_out=got))
    if not got["_n"]:
        raise ValueError("The table has no rows to check")
    outl = small_frame(outliers_iqr(df, nums, bounds=fences(qs)))
    counts = local_frame(df.sparkSession, [tuple(got[k] for k in count_aggs)],
                         ", ".join(f"{k} long" for k in count_aggs))
    return counts, outl, qs, {k: got[k] for k in (extra or {})}


def counts_with_outliers(df: DataFrame, approx: bool = False) -> tuple[DataFrame, DataFrame]:
    """Q1–Q3 inputs with one scan less (see :func:`quality_pass`).  Returns
    (counts as a one-row frame, outliers)."""
    counts, outl, _, _ = quality_pass(df, approx)
    return counts, outl


def missing_values(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Q1: columns with at least one null: count and percent of all rows.

    ``counts`` is :func:`column_counts` of ``df`` when the caller has it."""
    if counts is None:
        df = normalise_nan(df)
        counts = df.agg(F.count(F.lit(1)).alias("_n"),
                        *[F.count_if(q(c).isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    long = counts.select(F.col("_n"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col(f"_m{i}").alias("n_missing"))
        for i, c in enumerate(df.columns)])))
    return long.filter(F.col("n_missing") > 0).select(
        "column_name", "position", "n_missing",
        (F.col("n_missing") / F.col("_n") * 100).alias("percentage"))


def iqr_bounds(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
               extra: dict | None = None, extra_out: dict | None = None) -> DataFrame:
    """Q1/Q3 (linear interpolation) and the 1.5·IQR fences per numeric column.

    ``extra``/``extra_out``: aggregates computed in the same counting pass
    (see :func:`column_quantiles`)."""
    df = normalise_nan(df)
    cols = numeric_columns(df) if cols is None else cols
    return fences(column_quantiles(df, cols, [0.25, 0.75], approx=approx, extra=extra, extra_out=extra_out))


def fences(qs: DataFrame) -> DataFrame:
    """The 1.5·IQR fences from a quantile frame holding q0250 and q0750."""
    iqr = F.col("q0750") - F.col("q0250")
    return qs.select("column_name", F.col("q0250").alias("q1"), F.col("q0750").alias("q3"),
                     (F.col("q0250") - 1.5 * iqr).alias("lower_bound"),
                     (F.col("q0750") + 1.5 * iqr).alias("upper_bound"))


def outliers_iqr(df: DataFrame, cols: list[str] | None = None, bounds: DataFrame | None = None,
                 approx: bool = False, extra: dict | None = None, extra_out: dict | None = None) -> DataFrame:
    """Q2: values strictly outside the fences; percent over all rows (nulls too);
    only columns with at least one hit.

    The fences are one row per column; the hits of every column are counted
    in one wide aggregation with the fences as literals."""
    df = normalise_nan(df)
    cols = numeric_columns(df) if cols is None else cols
    schema = "column_name string, n_outliers long, percentage double, lower_bound double, upper_bound double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    bounds = iqr_bounds(df, cols, approx, extra, extra_out) if bounds is None else bounds
    fences = {r["column_name"]: (r["lower_bound"], r["upper_bound"]) for r in bounds.collect()
              if r["lower_bound"] is not None}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for k, c in enumerate(cols):
        if c in fences:
            lo, hi = fences[c]
            aggs.append(F.count_if((q(c) < F.lit(lo)) | (q(c) > F.lit(hi))).alias(f"_h{k}"))
    row = df.agg(*aggs).collect()[0]
    out = [(c, row[f"_h{k}"], row[f"_h{k}"] / row["_n"] * 100, *fences[c])
           for k, c in enumerate(cols) if c in fences and row[f"_h{k}"] > 0]
    return local_frame(df.sparkSession, out, schema)


def numeric_as_string(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Q3: text columns whose every non-null value reads as a number."""
    text = [(i, f.name) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    empty = "column_name string, issue string, recommendation string"
    if not text:
        return df.sparkSession.createDataFrame([], empty)
    if counts is None:
        aggs = []
        for i, c in text:
            aggs += [F.count(q(c)).alias(f"_c{i}"), F.count_if(q(c).rlike(NUMERIC_TEXT)).alias(f"_k{i}")]
        counts = df.agg(*aggs)
    long = counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                 F.col(f"_c{i}").alias("n"), F.col(f"_k{i}").alias("k")) for i, c in text])))
    # The two texts are part of the output.
    return long.filter((F.col("n") > 0) & (F.col("n") == F.col("k"))).select(
        "column_name",
        F.lit("Column appears numeric but stored as string").alias("issue"),
        F.lit("Convert to numeric type").alias("recommendation"))


def _row_fingerprint(df: DataFrame) -> list:
    """Two independent 64-bit hashes of a whole row.  Per-column null flags
    are hashed too, because Spark's row hashes skip null values."""
    cols = [q(c) for c in df.columns]
    flags = [c.isNull() for c in cols]
    return [F.xxhash64(*flags, *cols).alias("_f1"),
            F.xxhash64(F.lit("second seed"), *flags, *cols).alias("_f2")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q4: rows equal to an earlier row (nulls compare equal).

    Rows are counted per 128-bit row fingerprint, shuffling a few bytes per row
    instead of whole rows.  Equal rows share a fingerprint, so rows whose fingerprint
    is unique are distinct.  Only rows with a repeated fingerprint are grouped by all
    columns, which is exact even under a hash collision; copies of a hot row collapse
    map-side in both steps."""
    df = normalise_nan(df)
    spark = df.sparkSession
    tagged = df.select(*_row_fingerprint(df), *[q(c) for c in df.columns])
    fp = tagged.groupBy("_f1", "_f2").agg(F.count(F.lit(1)).alias("_k"))
    st = fp.agg(F.coalesce(F.sum("_k"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_fp"),
                F.count_if(F.col("_k") > 1).alias("n_repeated")).first()
    n_distinct = st["n_fp"]
    if st["n_repeated"]:
        rows = tagged.join(fp.filter(F.col("_k") > 1), ["_f1", "_f2"], "left_semi").drop("_f1", "_f2")
        n_distinct += rows.distinct().count() - st["n_repeated"]
    return local_frame(spark, [(st["n_rows"], n_distinct, st["n_rows"] - n_distinct)],
                       "n_rows long, n_distinct long, n_duplicates long")


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Q4 detail: each repeated row once, with its copy count."""
    g = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies"))
    return g.filter(F.col("copies") > 1)


def quality_score(missing: DataFrame, outliers: DataFrame, dups: DataFrame) -> DataFrame:
    """Q5: 100 − min(30, ½·avg missing %) − min(20, 0.3·avg outlier %) − min(20, ½·dup %), floor 0.

    Averages run over the affected columns only."""
    m = missing.agg(F.avg("percentage").alias("avg_missing_pct"), F.count(F.lit(1)).alias("n_missing_cols"))
    o = outliers.agg(F.avg("percentage").alias("avg_outlier_pct"), F.count(F.lit(1)).alias("n_outlier_cols"))
    d = dups.select("n_rows", "n_duplicates")
    # Three one-row frames: combine with scalar subqueries instead of a cross join.
    avg_m, n_m = m.select("avg_missing_pct").scalar(), m.select("n_missing_cols").scalar()
    avg_o, n_o = o.select("avg_outlier_pct").scalar(), o.select("n_outlier_cols").scalar()
    dup_pct = F.col("n_duplicates") / F.col("n_rows") * 100
    # least() skips nulls, so "no affected column" is spelled out with when().
    score = (F.lit(100.0)
             - F.when(avg_m.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(30.0), avg_m * 0.5))
             - F.when(avg_o.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(20.0), avg_o * 0.3))
             - F.when(F.col("n_duplicates") > 0, F.least(F.lit(20.0), dup_pct * 0.5)).otherwise(0.0))
    return d.select(F.greatest(score, F.lit(0.0)).alias("quality_score"),
                    avg_m.alias("avg_missing_pct"), n_m.alias("n_missing_cols"),
                    avg_o.alias("avg_outlier_pct"), n_o.alias("n_outlier_cols"),
                    "n_duplicates", "n_rows")


def score_band(score) -> F.Column:
    """Q14 colour band: ≥80 green, ≥60 yellow, else red."""
    return F.when(score >= 80, "green").when(score >= 60, "yellow").otherwise("red")


def quality_issue_table(missing: DataFrame, outliers: DataFrame) -> DataFrame:
    """Q13: long rows for the issue bar chart, largest first."""
    a = missing.select("column_name", F.lit("Missing Values").alias("issue_type"), "percentage")
    b = outliers.select("column_name", F.lit("Outliers").alias("issue_type"), "percentage")
    return a.unionByName(b).orderBy(F.desc("percentage"), "column_name", "issue_type")


def quality_report(df: DataFrame, approx: bool = False, outliers: DataFrame | None = None,
                   counts: DataFrame | None = None) -> DataFrame:
    """Q14: one row with score, band, affected-column counts and per-column maps.

    The per-column results (one row per column) are materialised once, so
    the several summaries below read them instead of re-scanning the table."""
    df = normalise_nan(df)
    if counts is None and outliers is None:
        counts, outliers = counts_with_outliers(df, approx)
    counts = small_frame(column_counts(df)) if counts is None else counts
    miss = small_frame(missing_values(df, counts))
    outl = small_frame(outliers_iqr(df, approx=approx)) if outliers is None else outliers
    dups = small_frame(duplicate_rows(df))
    types = small_frame(numeric_as_string(df, counts))
    score = quality_score(miss, outl, dups)
    miss_map = miss.agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("column_name", F.struct("n_missing", "percentage"))))).alias("m")).select("m").scalar()
    outl_map = outl.agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("column_name", F.struct("n_outliers", "percentage", "lower_bound", "upper_bound"))))).alias("o")
    ).select("o").scalar()
    n_types = types.select(F.count(F.lit(1))).scalar()
    miss_cols = miss.agg(F.array_join(F.array_sort(F.collect_list("column_name")), ",")).scalar()
    outl_cols = outl.agg(F.array_join(F.array_sort(F.collect_list("column_name")), ",")).scalar()
    return score.select(
        "quality_score", score_band(F.col("quality_score")).alias("band"), "n_rows",
        F.coalesce(F.col("n_missing_cols"), F.lit(0)).alias("n_missing_cols"),
        F.coalesce(F.col("n_outlier_cols"), F.lit(0)).alias("n_outlier_cols"),
        "n_duplicates", n_types.alias("n_type_issues"),
        miss_cols.alias("missing_columns"), outl_cols.alias("outlier_columns"),
        miss_map.alias("missing_values"), outl_map.alias("outliers"))


def recommendation_text(report: DataFrame) -> DataFrame:
    """Q15: template recommendations from the counts."""
    return report.select(F.format_string(
        "Basic recommendations:\n- Address missing values in %d columns\n"
        "- Review outliers in %d columns\n- Remove %d duplicate rows",
        F.col("n_missing_cols"), F.col("n_outlier_cols"), F.col("n_duplicates")).alias("recommendations"))


# ------------------------------------------------------------------ cleaning
def drop_sparse_rows(df: DataFrame) -> DataFrame:
    """Q6: keep rows whose non-null count is at least half the columns."""
    df = normalise_nan(df)
    need = math.ceil(len(df.columns) * 0.5)
    return df.na.drop(thresh=need) if need > 0 else df


def kept_row(df: DataFrame):
    """Q6's test as a column: at least half the columns hold a value (null
    and NaN count as missing, as in ``na.drop``)."""
    need = math.ceil(len(df.columns) * 0.5)
    present = [~(q(f.name).isNull() | F.isnan(q(f.name))) if isinstance(f.dataType, (T.FloatType, T.DoubleType))
               else q(f.name).isNotNull() for f in df.schema.fields]
    if not present:
        return F.lit(True)
    total = present[0].cast("int")
    for p_ in present[1:]:
        total = total + p_.cast("int")
    return total >= need


def column_medians(df: DataFrame, cols: list[str], approx: bool = False) -> dict[str, float]:
    """Exact medians per column — one bounded row per column on the driver."""
    if not cols:
        return {}
    rows = column_quantiles(df, cols, [0.5], approx=approx).collect()
    return {r["column_name"]: r["q0500"] for r in rows}


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Most frequent non-null value per column, ties to the smallest (as text).

    Value counts combine map-side; a per-column top-1 picks the winner, so a
    hot value costs nothing extra and no column is collected whole."""
    if not cols:
        return {}
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), q(c).cast("string").alias("v")) for c in cols])
    counts = (df.select(F.inline(items)).filter(F.col("v").isNotNull())
              .groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("k")))
    w = Window.partitionBy("column_name").orderBy(F.desc("k"), F.asc("v"))
    top = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return {r["column_name"]: r["v"] for r in top.collect()}


def fill_missing(df: DataFrame, approx: bool = False, numeric: bool = True,
                 categorical: bool = True, candidates: list[str] | None = None,
                 with_nulls: list[str] | None = None) -> DataFrame:
    """Q7/Q8: numeric nulls → column median (integers become double),
    other nulls → column mode; all-null columns stay as they are.

    ``candidates`` (when known) are the only columns that may hold nulls;
    with none, no pass over the data is needed.  ``with_nulls`` (when known
    exactly) are the columns that do hold nulls: no counting pass at all."""
    df = normalise_nan(df)
    if with_nulls is not None:
        todo = [c for c in df.columns if c in set(with_nulls)]
    else:
        check = df.columns if candidates is None else [c for c in df.columns if c in set(candidates)]
        if not check:
            return df
        nulls = df.agg(*[F.count_if(q(c).isNull()).alias(f"_m{i}") for i, c in enumerate(check)]).collect()[0]
        todo = [c for i, c in enumerate(check) if nulls[f"_m{i}"] > 0]
    if not todo:
        return df
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in todo if is_numeric(types[c])] if numeric else []
    cat = [c for c in todo if not is_numeric(types[c])] if categorical else []
    med = column_medians(df, num, approx)
    mode = column_modes(df, cat)
    out = []
    for c in df.columns:
        if c in med and med[c] is not None:
            out.append(F.coalesce(q(c).cast("double"), F.lit(float(med[c]))).alias(c))
        elif c in mode and mode[c] is not None:
            out.append(F.coalesce(q(c), F.lit(mode[c]).cast(types[c])).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def winsorize(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Q9: clip the listed columns to their bounds (nulls stay null)."""
    out = []
    for c in df.columns:
        if c in bounds:
            lo, hi = bounds[c]
            col = q(c)
            out.append(F.when(col < lo, F.lit(lo)).when(col > hi, F.lit(hi)).otherwise(col).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def outlier_bounds(df: DataFrame, approx: bool = False, extra: dict | None = None,
                   extra_out: dict | None = None) -> dict[str, tuple[float, float]]:
    """Fences of the columns that have outliers (bounded: one row per column)."""
    return {r["column_name"]: (r["lower_bound"], r["upper_bound"])
            for r in outliers_iqr(df, approx=approx, extra=extra, extra_out=extra_out).collect()}


def clean(df: DataFrame, approx: bool = False, bounds: dict | None = None,
          null_columns: list[str] | None = None) -> DataFrame:
    """Q11: drop sparse rows → fill → clip (fences of the uncleaned table) → distinct.

    ``null_columns``: the columns with nulls in ``df``, when already known.
    Without ``bounds``, the null counts of the rows that survive the sparse
    drop ride along in the fences' counting pass (no pass of their own).  A table
    without rows raises."""
    df = normalise_nan(df)
    with_nulls = None
    if bounds is None:
        keep = kept_row(df)
        extra = {"_n": F.count(F.lit(1))} | {f"_kn{i}": F.count_if(keep & q(c).isNull()) for i, c in enumerate(df.columns)}
        got: dict = {}
        bounds = outlier_bounds(df, approx, extra=extra, extra_out=got)
        if (got["_n"] if got else require_rows(df) and 1) == 0:
            raise ValueError("The table has no rows to check")
        if got:
            with_nulls = [c for i, c in enumerate(df.columns) if got[f"_kn{i}"] > 0]
    step = drop_sparse_rows(df)
    step = fill_missing(step, approx, candidates=null_columns, with_nulls=with_nulls)
    step = winsorize(step, bounds)
    return step.dropDuplicates()


def rows_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Q12: rows removed by cleaning."""
    b = before.select(F.count(F.lit(1))).scalar()
    return after.agg(F.count(F.lit(1)).alias("rows_after")).select(
        b.alias("rows_before"), "rows_after", (b - F.col("rows_after")).alias("rows_removed"))
