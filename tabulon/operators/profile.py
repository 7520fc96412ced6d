"""Profiling and schema inference (one aggregation for all columns, then unpivot)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import is_numeric, is_temporal, normalise_nan, q
from tabulon.session import local_frame

PROFILE_SCHEMA = ("column_name position dtype semantic_type n_rows n_null nullable n_unique "
                  "min_value max_value mean_value samples").split()


def semantic_class(dt: T.DataType) -> str:
    """Loader classes: quantitative, temporal or nominal (bool is nominal)."""
    if is_numeric(dt):
        return "quantitative"
    if is_temporal(dt):
        return "temporal"
    return "nominal"


#: A column whose distinct values are estimated at no more than this is counted by sets:
#: one wide aggregation, no value shuffled.
SMALL = 1000


def column_stats_aggs(df: DataFrame) -> dict:
    """The aggregates of the first pass of :func:`column_stats` (name → column), with a mergeable
    sketch of every column's distinct values."""
    aggs = {"_n": F.count(F.lit(1))}
    for i, f in enumerate(df.schema.fields):
        c = q(f.name)
        aggs[f"_c{i}"] = F.count(c)
        if not isinstance(f.dataType, (T.MapType, T.VariantType)):
            aggs[f"_d{i}"] = F.approx_count_distinct(c)
        if is_numeric(f.dataType):
            aggs.update({f"_lo{i}": F.min(c).cast("double"), f"_hi{i}": F.max(c).cast("double"),
                         f"_m{i}": F.avg(c).cast("double")})
    return aggs


def _distinct_set(f: T.StructField):
    # Adding zero makes the two zeros of floating point one value.
    return F.collect_set(q(f.name) + F.lit(0.0) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else q(f.name))


def _stats_rows(df: DataFrame, approx: bool, near: bool, samples: int = 0) -> tuple[list[dict], dict[str, list[str]]]:
    """One dict per column, and the smallest ``samples`` values as text of the nominal
    columns that were counted by sets."""
    fields = df.schema.fields
    first = df.agg(*[e.alias(k) for k, e in column_stats_aggs(df).items()]).first()
    counts = {i: first[f"_d{i}"] for i in range(len(fields)) if f"_d{i}" in first}
    found: dict[str, list[str]] = {}
    if not approx:
        small = [i for i, n in counts.items() if n <= SMALL]
        # Beyond the sets an exact count shuffles the column's values: on request, or where
        # the estimate can't tell a unique column from another.
        large = [i for i, n in counts.items() if n > SMALL
                 and (not near or (not is_temporal(fields[i].dataType) and n >= 0.8 * first[f"_c{i}"]))]
        wide = []
        for i in small:
            wide.append(F.size(_distinct_set(fields[i])).alias(f"_s{i}"))
            if samples and semantic_class(fields[i].dataType) == "nominal":
                text = F.array_sort(F.collect_set(q(fields[i].name).cast("string")))
                wide.append(F.slice(text, 1, samples).alias(f"_t{i}"))
        if wide or large:
            second = df.agg(*(wide or [F.lit(1).alias("_one")]))
            if large:
                second = second.select("*", *[df.agg(F.count_distinct(q(fields[i].name))).scalar().alias(f"_s{i}") for i in large])
            second = second.first()
            counts.update({i: second[f"_s{i}"] for i in small + large})
            found = {fields[i].name: list(second[f"_t{i}"]) for i in small if f"_t{i}" in second}
    rows = []
    for i, f in enumerate(fields):
        num = is_numeric(f.dataType)
        rows.append({"column_name": f.name, "position": i, "dtype": f.dataType.simpleString(),
                     "semantic_type": semantic_class(f.dataType), "n_rows": first["_n"],
                     "n_null": first["_n"] - first[f"_c{i}"], "n_unique": counts.get(i),
                     "min_value": first[f"_lo{i}"] if num else None, "max_value": first[f"_hi{i}"] if num else None,
                     "mean_value": first[f"_m{i}"] if num else None})
    return rows, found


STATS_SCHEMA = ("column_name string, position int, dtype string, semantic_type string, n_rows long, n_null long, "
                "n_unique long, min_value double, max_value double, mean_value double")


def column_stats(df: DataFrame, approx: bool = False, near: bool = False) -> DataFrame:
    """One row per column: counts, distinct count, numeric min/max/mean.

    One wide aggregation for all columns holds a sketch of each column's distinct values.
    Columns that it puts at ``SMALL`` values or fewer are counted exactly in a second one.
    For the others ``n_unique`` is exact too (a subquery that reads and shuffles that column
    alone), unless ``near`` (exact only where the estimate is close to the number of values,
    so that a unique column is known as one) or ``approx`` (estimates throughout)."""
    df = normalise_nan(df)
    rows, _ = _stats_rows(df, approx, near)
    return local_frame(df.sparkSession, [tuple(r.values()) for r in rows], STATS_SCHEMA)


def smallest_lists(df: DataFrame, cols: list[str], k: int) -> dict[str, list[str]]:
    """The ``k`` smallest distinct non-null values of each column, as text: k rounds of the
    minimum above the last one, all columns at once, with no value shuffled."""
    out: dict[str, list[str]] = {c: [] for c in cols}
    alive = list(cols)
    for _ in range(k):
        if not alive:
            break
        text = {c: q(c).cast("string") for c in alive}
        row = df.agg(*[F.min(F.when(text[c] > F.lit(out[c][-1]), text[c]) if out[c] else text[c]).alias(f"_{i}")
                       for i, c in enumerate(alive)]).first()
        got = {c: row[f"_{i}"] for i, c in enumerate(alive)}
        alive = [c for c in alive if got[c] is not None]
        for c in alive:
            out[c].append(got[c])
    return out


def smallest_values(df: DataFrame, cols: list[str], k: int = 3) -> DataFrame:
    """The ``k`` smallest distinct non-null values per column, as text (:func:`smallest_lists`);
    a column without a value has no row."""
    rows = [(c, ", ".join(v)) for c, v in smallest_lists(df, cols, k).items() if v]
    return local_frame(df.sparkSession, rows, "column_name string, samples string")


def unique_values(df: DataFrame, cols: list[str], limit: int = 10, as_list: bool = False) -> DataFrame:
    """Full sorted value list for columns with at most ``limit`` distinct values, as one
    text or (``as_list``) as an array; a column without a value has no row.

    At most ``limit`` values touch at most ``limit`` registers of a sketch, so a column with
    a greater estimate (twice over) has more.  Only the others' values are gathered, as sets."""
    kind = "array<string>" if as_list else "string"
    schema = f"column_name string, n_unique long, unique_values {kind}"
    rows = []
    if cols:
        guess = df.agg(*[F.approx_count_distinct(q(c).cast("string")).alias(f"_{i}") for i, c in enumerate(cols)]).first()
        few = [(i, c) for i, c in enumerate(cols) if guess[f"_{i}"] <= 2 * limit + 4]
        if few:
            sets = df.agg(*[F.array_sort(F.collect_set(q(c).cast("string"))).alias(f"_{i}") for i, c in few]).first()
            rows = [(c, len(sets[f"_{i}"]), list(sets[f"_{i}"])) for i, c in few if 0 < len(sets[f"_{i}"]) <= limit]
    if as_list:
        # One row per column of at most ``limit`` values.
        return df.sparkSession.createDataFrame(rows, schema)
    return local_frame(df.sparkSession, [(c, n, ", ".join(v)) for c, n, v in rows], schema)


def profile(df: DataFrame, approx: bool = False, near: bool = False) -> DataFrame:
    """One row per column with the unified profile schema (counts as in
    :func:`column_stats`)."""
    df = normalise_nan(df)
    rows, samples = _stats_rows(df, approx, near, 3)
    rest = [r["column_name"] for r in rows if r["semantic_type"] == "nominal" and r["column_name"] not in samples
            and r["n_unique"] is not None]
    samples |= smallest_lists(df, rest, 3)
    out = [(r["column_name"], r["position"], r["dtype"], r["semantic_type"], r["n_rows"], r["n_null"], r["n_null"] > 0,
            r["n_unique"], r["min_value"], r["max_value"], r["mean_value"],
            ", ".join(samples[r["column_name"]]) if samples.get(r["column_name"]) else None) for r in rows]
    return local_frame(df.sparkSession, out, "column_name string, position int, dtype string, semantic_type string, "
                       "n_rows long, n_null long, nullable boolean, n_unique long, min_value double, max_value double, "
                       "mean_value double, samples string")


def temporal_stats(df: DataFrame) -> DataFrame:
    """Min and max of temporal columns as text."""
    cols = [f.name for f in df.schema.fields if is_temporal(f.dataType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, min_value string, max_value string")
    fmt = "yyyy-MM-dd HH:mm:ss"
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.date_format(F.min(q(c)), fmt).alias(f"_lo{i}"), F.date_format(F.max(q(c)), fmt).alias(f"_hi{i}")]
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_lo{i}").alias("min_value"),
                 F.col(f"_hi{i}").alias("max_value")) for i, c in enumerate(cols)])))


def field_types(df: DataFrame, approx: bool = False, near: bool = False) -> DataFrame:
    """Quantitative / ordinal / temporal / nominal per column.

    Numeric columns are ordinal when n_unique < 20 and n_unique < half the rows.  With
    ``near`` the types are the exact ones still: a count below 20 is always exact."""
    stats = column_stats(df, approx, near)
    return stats.select(
        "column_name", "position",
        F.when(F.col("semantic_type") == "quantitative",
               F.when((F.col("n_unique") < 20) & (F.col("n_unique") < F.col("n_rows") * 0.5), "ordinal")
               .otherwise("quantitative"))
        .otherwise(F.col("semantic_type")).alias("field_type"),
        "n_unique", "n_rows")


def field_stats(df: DataFrame, given: DataFrame | None = None, approx: bool = False,
                as_list: bool = False) -> DataFrame:
    """Computed statistics, overridden by a given schema frame where present.

    ``given`` has (column_name, semantic_type, unique_count, stat_min, stat_max,
    stat_mean) with nulls where the schema says nothing."""
    stats = column_stats(df, approx)
    nominal = [f.name for f in df.schema.fields if semantic_class(f.dataType) == "nominal"]
    uv = unique_values(df, nominal, 10, as_list)
    base = stats.join(uv.select("column_name", "unique_values"), "column_name", "left")
    if given is not None:
        g = given.select(*[F.col(c).alias(f"g_{c}") if c != "column_name" else F.col(c) for c in given.columns])
        base = base.join(g, "column_name", "left")
        pick = lambda a, b: F.coalesce(F.col(f"g_{a}"), F.col(b))
    else:
        pick = lambda a, b: F.col(b)
    return base.select(
        "column_name", "position",
        pick("semantic_type", "semantic_type").alias("semantic_type"),
        pick("unique_count", "n_unique").alias("unique_count"),
        pick("stat_min", "min_value").alias("stat_min"),
        pick("stat_max", "max_value").alias("stat_max"),
        pick("stat_mean", "mean_value").alias("stat_mean"),
        "unique_values")


def _py_float_text(c):
    """Render a double like Python's str(): integral values keep '.0'."""
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.regexp_replace(F.regexp_replace(c.cast("string"), r"E", "e+"), r"e\+-", "e-"))


def field_lines(stats: DataFrame) -> DataFrame:
    """P10: ``- **col** (type) [n unique values] Range: a to b Mean: m.mm Values: …``.
    ``stats``: :func:`field_stats` with ``as_list``, since a value may hold a comma."""
    vals = F.col("unique_values")
    sample_txt = F.when(vals.isNull(), F.lit(None)).when(
        F.size(vals) <= 5, F.concat(F.lit("Values: "), F.array_join(vals, ", "))).otherwise(
        F.concat(F.lit("Sample values: "), F.array_join(F.slice(vals, 1, 5), ", "), F.lit(", ...")))
    rng = F.when(F.col("stat_min").isNotNull() & F.col("stat_max").isNotNull(),
                 F.concat(F.lit("Range: "), _py_float_text(F.col("stat_min")), F.lit(" to "),
                          _py_float_text(F.col("stat_max"))))
    mean = F.when(F.col("stat_mean").isNotNull(), F.format_string("Mean: %.2f", F.col("stat_mean")))
    line = F.concat_ws(" ", F.concat(F.lit("- **"), F.col("column_name"), F.lit("**")),
                       F.concat(F.lit("("), F.coalesce(F.col("semantic_type"), F.lit("unknown")), F.lit(")")),
                       F.concat(F.lit("["), F.col("unique_count").cast("string"), F.lit(" unique values]")),
                       rng, mean, sample_txt)
    return stats.select("column_name", "position", line.alias("line"))


def shape(df: DataFrame, name: str) -> DataFrame:
    """Rows × columns of one table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))


def preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """First ``n`` rows in a stated key order (Spark rows have no order)."""
    return df.orderBy(*[q(c) for c in order_by]).limit(n)


def schema_summary(df: DataFrame, approx: bool = False, near: bool = False, sample_rows: int = 0,
                   order_by: list[str] | None = None) -> DataFrame:
    """``Table shape: N rows x M columns``, then ``  - col (type): U unique values, K nulls``
    per column with its range (numbers: lowest to highest and mean; times: first to last) or
    its smallest values, then, with ``sample_rows``, that many rows in the order of
    ``order_by`` (default: the columns themselves) as ``  col = value, ..``."""
    df = normalise_nan(df)
    rows, samples = _stats_rows(df, approx, near, 3)
    times = {r["column_name"]: r for r in temporal_stats(df).collect()}
    rest = [r["column_name"] for r in rows if r["semantic_type"] == "nominal" and r["column_name"] not in samples
            and r["n_unique"] is not None]
    samples |= smallest_lists(df, rest, 3)
    lines = [f"Table shape: {rows[0]['n_rows'] if rows else df.count()} rows x {len(rows)} columns"]
    for r in rows:
        name = r["column_name"]
        text = f"  - {name} ({r['dtype']}): {r['n_unique']} unique values, {r['n_null']} nulls"
        if r["min_value"] is not None:
            text += f", range {r['min_value']:.2f} to {r['max_value']:.2f}, mean {r['mean_value']:.2f}"
        elif name in times and times[name]["min_value"] is not None:
            text += f", from {times[name]['min_value']} to {times[name]['max_value']}"
        elif samples.get(name):
            text += ", e.g. " + ", ".join(samples[name])
        lines.append(text)
    if sample_rows:
        lines.append("Sample rows:")
        shown = preview(df.select(*[q(c).cast("string").alias(c) if isinstance(f.dataType, (T.MapType, T.VariantType)) else q(c)
                                    for c, f in zip(df.columns, df.schema.fields, strict=True)]), sample_rows, order_by or df.columns)
        text = F.concat_ws(", ", *[F.concat(F.lit(f"{c} = "), F.coalesce(q(c).cast("string"), F.lit("null"))) for c in df.columns])
        lines += ["  " + r[0] for r in shown.select(text).collect()]
    return local_frame(df.sparkSession, list(enumerate(lines)), "line_no int, line string")
