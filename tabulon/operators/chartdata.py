"""Chart-ready aggregates (the numbers behind each mark) and chart specs.

Drawing is not built; every chart type reduces to a grouped aggregate or a
projection, computed where the data lives.  Chart specs and chart lists are
small metadata frames.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import q
from tabulon.operators.profile import field_types
from tabulon.session import local_frame
from tabulon.sources.guards import require_columns

CHART_TYPES = ("bar", "line", "scatter", "area", "pie", "heatmap")
_AGGS = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}


def chart_data(df: DataFrame, chart_type: str, x: str, y: str, color: str | None = None,
               size: str | None = None, agg: str = "sum", sample_fraction: float | None = None) -> DataFrame:
    """C1–C6 with the C7 checks (fields exist, x/y/type given, known type)."""
    if not chart_type or not x or not y:
        raise ValueError("chart_type, x_field and y_field are required")
    if chart_type not in CHART_TYPES:
        raise ValueError(f"No chart data for a chart of type {chart_type!r}")
    require_columns(df, x, y, color, size)
    f = _AGGS[agg]
    if chart_type == "bar":
        keys = [x] + ([color] if color else [])
        return df.groupBy(*[q(k) for k in keys]).agg(f(q(y)).alias(y))
    if chart_type == "line":
        keys = [x] + ([color] if color else [])
        return df.groupBy(*[q(k) for k in keys]).agg(f(q(y)).alias(y)).orderBy(*[q(k) for k in keys])
    if chart_type == "scatter":
        cols = [c for c in (x, y, color, size) if c]
        out = df.select(*[q(c) for c in dict.fromkeys(cols)])
        if sample_fraction is not None:
            # Deterministic: a row is kept by the hash of its values, so reruns agree.
            bucket = F.pmod(F.xxhash64(*[q(c) for c in dict.fromkeys(cols)]), F.lit(1_000_000))
            out = out.filter(bucket < int(sample_fraction * 1_000_000))
        return out
    if chart_type == "area":
        keys = [x] + ([color] if color else [])
        a = df.groupBy(*[q(k) for k in keys]).agg(f(q(y)).alias(y))
        if not color:
            return a.select(q(x), q(y), F.lit(0.0).alias("y0"), q(y).cast("double").alias("y1"))
        w = Window.partitionBy(q(x)).orderBy(q(color)).rowsBetween(Window.unboundedPreceding, 0)
        top = F.sum(q(y)).over(w)
        return a.select(q(x), q(color), q(y), (top - q(y)).alias("y0"), top.alias("y1"))
    if chart_type == "pie":
        a = df.groupBy(q(x)).agg(f(q(y)).alias(y))
        total = a.select(F.sum(q(y))).scalar()
        return a.select(q(x), q(y), (q(y) / total).alias("share"))
    # heatmap: colour defaults to y, aggregated per (x, y) cell
    value = color or y
    cell = F.count(F.lit(1)) if value == y else f(q(value))
    return df.groupBy(q(x), q(y)).agg(cell.alias("value"))


def value_counts(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Top ``k`` non-null values by count (ties by value)."""
    return (df.filter(q(col).isNotNull()).groupBy(q(col)).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), q(col)).limit(k))


def nice_bins(lo: float, hi: float, maxbins: int = 10, base: float = 10.0, divide=(5, 2)):
    """Step and extent of 'nice' bins (the public Vega binning rule)."""
    span = (hi - lo) or abs(lo) or 1.0
    level = math.ceil(math.log(maxbins) / math.log(base))
    # Round half up, as the published rule does (Python's round() is half-even).
    step = max(0.0, base ** (math.floor(math.log(span) / math.log(base) + 0.5) - level))
    while math.ceil(span / step) > maxbins:
        step *= base
    for dv in divide:
        v = step / dv
        if span / v <= maxbins:
            step = v
    v = math.log(step)
    precision = 0 if v >= 0 else int(-v / math.log(base)) + 1
    eps = base ** (-precision - 1)
    v = math.floor(lo / step + eps) * step
    start = v - step if lo < v else v
    stop = math.ceil(hi / step) * step
    if stop == start:
        stop = start + step
    return start, stop, step


def auto_histogram(df: DataFrame, col: str, maxbins: int = 10) -> DataFrame:
    """Counts per 'nice' bin of one numeric column (bounds: one small job)."""
    x = q(col).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).collect()[0]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin_start double, bin_end double, count long")
    start, stop, step = nice_bins(lo, hi, maxbins)
    idx = F.floor((x - F.lit(start)) / F.lit(step))
    return (df.filter(x.isNotNull()).groupBy(idx.alias("_b")).agg(F.count(F.lit(1)).alias("count"))
            .select((F.lit(start) + F.col("_b") * step).alias("bin_start"),
                    (F.lit(start) + (F.col("_b") + 1) * step).alias("bin_end"), "count"))


def auto_chart(df: DataFrame, order_by: list[str] | None = None) -> tuple[str, DataFrame]:
    """C11: pick a chart from the result's shape and field types.

    1 column → value counts (nominal/ordinal) or histogram; nominal/ordinal ×
    quantitative → bar of 20 rows; two quantitative → scatter of 100 rows;
    otherwise the first two columns as a 20-row bar.  Rows are taken in a
    stated order (default: the columns themselves)."""
    cols = df.columns
    if not cols:
        return "none", df
    # Only the first two columns decide.
    types = {r["column_name"]: r["field_type"]
             for r in field_types(df.select(*[q(c) for c in cols[:2]]), near=True).collect()}
    order = [q(c) for c in (order_by or cols)]
    if len(cols) == 1:
        c = cols[0]
        if types[c] in ("nominal", "ordinal"):
            return "bar", value_counts(df, c, 10)
        return "histogram", auto_histogram(df, c)
    c1, c2 = cols[0], cols[1]
    t1, t2 = types[c1], types[c2]
    if len(cols) == 2 and t1 in ("nominal", "ordinal") and t2 == "quantitative":
        return "bar", df.orderBy(*order).limit(20)
    if len(cols) == 2 and t1 == "quantitative" and t2 == "quantitative":
        return "scatter", df.orderBy(*order).limit(100)
    return "bar", df.select(q(c1), q(c2)).orderBy(*order).limit(20)


# ------------------------------------------------------------------ specs
SPEC_SCHEMA = ("chart_type string, x_field string, y_field string, color_field string, size_field string, "
               "reason string, priority int")


def recommend_charts(df: DataFrame, goal: str = "", max_specs: int = 3, approx: bool = False,
                     types: DataFrame | None = None) -> DataFrame:
    """2–3 ranked chart specs from field types and cardinality.

    Field typing is one Spark job (or ``types``, the field_types frame when
    the caller has it); the rules run over that per-column metadata (one row
    per column)."""
    meta = (field_types(df, approx=approx, near=True) if types is None else types).orderBy("position").collect()
    # Identifier-like numbers (…_id, …key, or one distinct value per row) are
    # not measures.
    integral = {f.name for f in df.schema.fields
                if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    ident = {r["column_name"] for r in meta
             if r["column_name"].lower().endswith(("_id", "key", "id"))
             or (r["column_name"] in integral and r["n_unique"] == r["n_rows"])}
    quant = [r["column_name"] for r in meta if r["field_type"] == "quantitative" and r["column_name"] not in ident]
    temporal = [r["column_name"] for r in meta if r["field_type"] == "temporal"]
    cats = [(r["column_name"], r["n_unique"]) for r in meta if r["field_type"] in ("nominal", "ordinal")]
    small = [c for c, n in sorted(cats, key=lambda t: (t[1], t[0])) if 1 < n <= 50]
    goal_l = (goal or "").lower()
    specs = []
    if temporal and quant:
        score = 90 + (10 if any(w in goal_l for w in ("trend", "time", "over")) else 0)
        specs.append((score, "line", temporal[0], quant[0], small[0] if small and small[0] != temporal[0] else None,
                      None, f"Shows how {quant[0]} changes over {temporal[0]}."))
    if small and quant:
        color = next((c for c in small[1:] if dict(cats)[c] <= 10), None)
        score = 85 + (10 if any(w in goal_l for w in ("compare", "rank", "top", "categor")) else 0)
        specs.append((score, "bar", small[0], quant[0], color, None,
                      f"Compares {quant[0]} across {small[0]} categories."))
    if len(quant) >= 2:
        score = 80 + (10 if any(w in goal_l for w in ("correl", "relationship", "versus", "vs")) else 0)
        specs.append((score, "scatter", quant[0], quant[1], small[0] if small else None,
                      quant[2] if len(quant) > 2 else None,
                      f"Shows the relationship between {quant[0]} and {quant[1]}."))
    pies = [c for c in small if dict(cats)[c] <= 7]
    if pies and quant:
        score = 70 + (10 if any(w in goal_l for w in ("share", "proportion", "part")) else 0)
        specs.append((score, "pie", pies[0], quant[0], None, None,
                      f"Shows each {pies[0]}'s share of total {quant[0]}."))
    if len(small) >= 2 and quant:
        specs.append((60, "heatmap", small[0], small[1], quant[0], None,
                      f"Shows {quant[0]} across {small[0]} and {small[1]}."))
    specs.sort(key=lambda s: (-s[0], s[1]))
    rows = [(t, x, y, c, s, reason, i + 1) for i, (_, t, x, y, c, s, reason) in enumerate(specs[:max_specs])]
    return local_frame(df.sparkSession, rows, SPEC_SCHEMA)


def chart_checks(recs: DataFrame) -> DataFrame:
    """Required fields present, blanks → null, default reason ('') and
    priority (1), ordered by priority."""
    blank = lambda c: F.when(F.trim(F.col(c)) == "", F.lit(None)).otherwise(F.col(c))
    bad = recs.filter((F.coalesce(F.trim("chart_type"), F.lit("")) == "") |
                      (F.coalesce(F.trim("x_field"), F.lit("")) == "") |
                      (F.coalesce(F.trim("y_field"), F.lit("")) == ""))
    if not bad.isEmpty():
        raise ValueError("Recommendation missing required fields")
    return recs.select("chart_type", "x_field", "y_field", blank("color_field").alias("color_field"),
                       blank("size_field").alias("size_field"),
                       F.coalesce(F.col("reason"), F.lit("")).alias("reason"),
                       F.coalesce(F.col("priority"), F.lit(1)).alias("priority")).orderBy("priority")


def spec_title(recs: DataFrame) -> DataFrame:
    """A title of at most 80 characters per spec."""
    t = F.concat(F.initcap("chart_type"), F.lit(" of "), F.col("y_field"), F.lit(" by "), F.col("x_field"))
    return recs.withColumn("title", F.substring(t, 1, 80))


def select_spec(recs: DataFrame, index: int) -> DataFrame:
    """The spec at ``index`` (0-based, in priority order), range-checked."""
    n = recs.count()
    if index < 0 or index >= n:
        raise ValueError(f"Chart index {index} out of range (0-{n - 1})")
    w = Window.orderBy("priority", "chart_type")
    return recs.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") == index).drop("_i")


CHART_SCHEMA = "idx int, title string, image string, description string"


def chart_list(charts: DataFrame) -> DataFrame:
    """C14: keep charts with an image; default title 'Chart i' (original
    1-based index) and empty description.  Raises if none is left."""
    out = charts.filter(F.coalesce(F.length("image"), F.lit(0)) > 0).select(
        "idx", F.coalesce(F.when(F.col("title") != "", F.col("title")),
                          F.concat(F.lit("Chart "), F.col("idx").cast("string"))).alias("title"),
        "image", F.coalesce(F.col("description"), F.lit("")).alias("description"))
    if out.isEmpty():
        raise ValueError("No chart has an image")
    return out


def one_chart_list(spark: SparkSession, image: str, chart_type: str = "chart", title: str = "Chart") -> DataFrame:
    """One chart → a one-element chart list."""
    return local_frame(spark, [(1, title, image, f"{chart_type.title()} visualization")], CHART_SCHEMA)
