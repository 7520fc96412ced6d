"""Global ranks and exact quantiles without a single-partition window.

Spark's exact ``percentile`` merges one value→count map per group in a single
task, which does not survive a billion distinct doubles.  Here values are
range-partitioned and sorted by (group keys, value); each partition counts its
rows per group, prefix sums over those counts (a table of at most
partitions + groups rows) give every partition its starting rank, and a row's
rank is that offset plus its position inside the partition.  The tagged data
is written once as Parquet to the shared checkpoint folder, so the partition
ids are fixed and a lost executor recomputes nothing upstream.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import q
from tabulon.session import ensure_checkpoint_dir, local_frame, shared_table


def long_form(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = (),
              value_type: str = "double", drop_nulls: bool = True) -> DataFrame:
    """Unpivot ``cols`` to rows (group..., column_name, value)."""
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), q(c).cast(value_type).alias("value"))
                      for c in cols])
    out = df.select(*[q(g) for g in group_cols], F.inline(items))
    return out.filter(F.col("value").isNotNull()) if drop_nulls else out


def rank_rows(long: DataFrame, keys: Sequence[str] = ("column_name",), value: str = "value",
              partitions: int | None = None) -> DataFrame:
    """Add ``rank`` (1-based position in value order inside ``keys``) and ``n``."""
    spark = long.sparkSession
    ensure_checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A row id breaks ties: tied rows may take their ranks in any order, and
    # with it the range partitioner can split a value held by a third of all
    # rows over many partitions instead of one.
    order = [*[F.col(k) for k in keys], F.col(value), F.col("_tie")]
    tagged = (long.select(*keys, value, F.monotonically_increasing_id().alias("_tie"))
              .repartitionByRange(parts, *order)
              .sortWithinPartitions(*order)
              .drop("_tie")
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = shared_table(tagged, "ranks")
    counts = tagged.groupBy("_pid", *keys).agg(F.count("*").alias("_c"), F.min("_mid").alias("_start"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", *keys, "_start",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    return (tagged.join(offsets, on=["_pid", *keys])
            .select(*keys, value, (F.col("_off") + F.col("_mid") - F.col("_start") + 1).alias("rank"),
                    "n"))


def running_sum(df: DataFrame, order: Sequence[str], value, name: str) -> DataFrame:
    """``df`` with the running sum of ``value`` in ``order`` (ties in any order), without a
    one-task window: range partitions are summed, and each starts from the sum of those
    before it (one row per partition)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in order]
    tagged = shared_table(df.withColumn("_v", value).repartitionByRange(parts, *by, F.monotonically_increasing_id())
                          .sortWithinPartitions(*by).withColumn("_pid", F.spark_partition_id())
                          .withColumn("_mid", F.monotonically_increasing_id()), "running")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("_pid").agg(F.sum("_v").alias("_s"))
               .select("_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off")))
    within = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    return (tagged.join(offsets, "_pid").withColumn(name, F.col("_off") + F.sum("_v").over(within))
            .select(*[q(c) for c in df.columns], q(name)))


def quantile_names(probs: Sequence[float]) -> list[str]:
    return [f"q{int(round(p * 1000)):04d}" for p in probs]


#: Relative error of the summaries (1 / ACCURACY of the rows).
ACCURACY = 1000
#: Equal-width slices that a bracket's values are ordered in.
SLICES = 1000
#: Distinct values of one bracket that a task may order.  A bracket with more rows is cut at
#: ranks of its own values, CUTS pieces a round, until the pieces that hold the target
#: ranks have no more.
ORDER_VALUES = 1_000_000
CUTS = 64


def _around(probs: Sequence[float]) -> list[float]:
    """Probabilities just below and above each target, four summary errors away."""
    margin = 4.0 / ACCURACY
    return [x for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))]


def exact_quantiles(long: DataFrame, probs: Sequence[float], keys: Sequence[str] = ("column_name",),
                    value: str = "value", approx: bool = False) -> DataFrame:
    """Linear-interpolated quantiles per key (pandas / ``quantile_cont`` rule).

    Returns keys..., n, and one column per probability named by
    :func:`quantile_names`.  ``approx=True`` is one summary pass.  Otherwise, at every
    size: summaries bracket each target rank, a counting pass checks that the bracket
    holds it (one that does not becomes the whole range), and the values inside the
    brackets are ordered on the cluster.  The state is one row per group and stays a
    distributed table."""
    names, probs, keys = quantile_names(probs), list(probs), list(keys)
    long = long.select(*keys, F.col(value).alias("value"))
    v = F.col("value")
    if approx:
        pa = F.percentile_approx(v, probs, ACCURACY)
        return (long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pa.alias("_qs"))
                .select(*keys, "n", *[F.col("_qs")[i].alias(nm) for i, nm in enumerate(names)]))
    s1 = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                 F.percentile_approx(v, _around(probs), ACCURACY).alias("_g"))
    state = shared_table(s1, "brackets")
    counted = []
    for i in range(len(probs)):
        lo, hi = F.col("_g")[2 * i], F.col("_g")[2 * i + 1]
        counted += [F.count_if(v < lo).alias(f"_b{i}"), F.count_if((v >= lo) & (v <= hi)).alias(f"_c{i}")]
    counts = long.join(state, keys).groupBy(*keys).agg(*counted)
    items = []
    for i, p in enumerate(probs):
        low = F.floor((F.col("n") - 1) * F.lit(p)) + 1
        high = F.least(low + 1, F.col("n"))
        ok = (F.col(f"_b{i}") < low) & (F.col(f"_b{i}") + F.col(f"_c{i}") >= high)
        items.append(F.struct(
            F.lit(i).alias("_i"), F.when(ok, F.col("_g")[2 * i]).otherwise(float("-inf")).alias("lo"),
            F.when(ok, F.col("_g")[2 * i + 1]).otherwise(float("inf")).alias("hi"),
            F.when(ok, F.col(f"_b{i}")).otherwise(0).alias("below"), F.col(f"_c{i}").alias("rows"),
            low.cast("long").alias("r1"), high.cast("long").alias("r2")))
    checked = shared_table(state.join(counts, keys).select(*keys, "n", F.array(*items).alias("_s")), "brackets")
    inside = (long.join(checked, keys)
              .select(*keys, "value", F.explode(F.filter(
                  "_s", lambda b: (v >= b["lo"]) & (v <= b["hi"]))).alias("b"))
              .select(*keys, "value", F.col("b._i").alias("_i")))
    meta = checked.select(*keys, F.inline("_s"))
    # One row per group.
    most = checked.select(F.explode("_s").alias("s"), "n").agg(F.max(F.when(
        F.col("s.lo") == float("-inf"), F.col("n")).otherwise(F.col("s.rows")))).first()[0] or 0
    picked = _ordered(inside, meta, keys, most)
    got = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.struct("_i", F.struct("v1", "v2").alias("v")))).alias("_m"))
    out = [F.col(k) for k in keys] + [F.col("n")]
    for i, (p, nm) in enumerate(zip(probs, names)):
        h = (F.col("n") - 1) * F.lit(p)
        pair = F.col("_m")[F.lit(i)]
        out.append((pair["v1"] + (pair["v2"] - pair["v1"]) * (h - F.floor(h))).alias(nm))
    return checked.select(*keys, "n").join(got, keys).select(*out)


def _narrowed(counts: DataFrame, meta: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The counted values around the target ranks, and the brackets shrunk to them, so that
    no bracket holds more than ``ORDER_VALUES`` distinct values.

    Each round cuts at quantiles of the distinct values themselves, so it shrinks a bracket
    CUTS / 2 times or nearly so whatever its values are: over many orders of magnitude,
    crowded at one point, or infinite."""
    counts, meta = shared_table(counts, "counts"), shared_table(meta, "brackets")
    by = list(by)
    while (counts.groupBy(*by).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d")).first()[0] or 0) > ORDER_VALUES:
        cuts = counts.groupBy(*by).agg(F.percentile_approx("value", [k / CUTS for k in range(1, CUTS)], ACCURACY).alias("_p"))
        tagged = counts.join(shared_table(cuts, "cuts"), by).withColumn("_s", F.size(F.filter("_p", lambda p: p < F.col("value"))))
        before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        pieces = (tagged.groupBy(*by, "_s").agg(F.sum("_c").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
                  .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(meta, by))
        start = F.col("below") + F.col("_before")
        holds = [(start < F.col(r)) & (start + F.col("_n") >= F.col(r)) for r in ("r1", "r2")]
        hits = shared_table(pieces.filter(holds[0] | holds[1]), "pieces")
        counts = shared_table(tagged.join(hits.select(*by, "_s"), [*by, "_s"], "left_semi").select(*by, "value", "_c"), "counts")
        meta = shared_table(hits.groupBy(*by, "r1", "r2").agg(
            F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.min(start).alias("below")), "brackets")
    return counts, meta


def _ordered(inside: DataFrame, meta: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """The values at ranks r1 and r2 of every bracket.

    ``inside``: keys, _i, value (rows within the brackets); ``meta``: keys, _i, lo, hi,
    below, r1, r2; ``most``: rows of the fullest bracket.  Values are counted first, so a
    repeated value is one row.  Brackets that may hold too many are narrowed.  Counts per
    equal-width slice find the one or two slices that hold the ranks, and only those are
    ordered value by value: no task orders a whole bracket."""
    by = [*keys, "_i"]
    counts = inside.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_c"))
    if most > ORDER_VALUES:
        counts, meta = _narrowed(counts, meta.select(*by, "lo", "hi", "below", "r1", "r2"), by)
    span = F.col("hi") - F.col("lo")
    wide = (span > 0) & (span < float("inf"))
    at = F.when(wide, F.least(F.floor((F.col("value") - F.col("lo")) / span * SLICES), F.lit(SLICES - 1))).otherwise(0)
    counts = counts.join(meta, by).withColumn("_slice", at.cast("int"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (counts.groupBy(*by, "_slice").agg(F.sum("_c").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    hit = slices.select(*[F.col(c).alias(f"_h_{c}") for c in (*by, "_slice")], "_before", "_n")
    same = [F.col(c) == F.col(f"_h_{c}") for c in (*by, "_slice")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    start = F.col("below") + F.col("_before")
    holds = [(start < F.col(r)) & (start + F.col("_n") >= F.col(r)) for r in ("r1", "r2")]
    within = Window.partitionBy(*by, "_slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cum = (counts.join(hit, cond).filter(holds[0] | holds[1])
           .withColumn("_cum", start + F.sum("_c").over(within)))
    return cum.groupBy(*by).agg(F.min(F.when(F.col("_cum") >= F.col("r1"), F.col("value"))).alias("v1"),
                                F.min(F.when(F.col("_cum") >= F.col("r2"), F.col("value"))).alias("v2"))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], approx: bool = False,
                     extra: dict | None = None, extra_out: dict | None = None) -> DataFrame:
    """Exact quantiles of several columns of one table (no unpivot of the data).

    The method of :func:`exact_quantiles`, with one wide aggregation for the summaries
    and one for the counts; only the rows inside a bracket are unpivoted.  Returns a
    small frame (column_name, n, q…), one row per column.

    ``extra`` (name → aggregate column) rides along in the summary pass, so a caller's
    own statistics cost no scan of their own; their values land in ``extra_out``."""
    names, probs, extra = quantile_names(probs), list(probs), extra or {}
    spark = df.sparkSession
    x = [q(c).cast("double") for c in cols]
    asked = probs if approx else _around(probs)
    aggs = [e.alias(f"_x_{name}") for name, e in extra.items()]
    for k, c in enumerate(x):
        aggs += [F.count(c).alias(f"n{k}"), F.percentile_approx(c, asked, ACCURACY).alias(f"a{k}")]
    schema = "column_name string, n long" + "".join(f", {nm} double" for nm in names)
    if not aggs:
        return spark.createDataFrame([], schema)
    first = df.agg(*aggs).first()
    if extra_out is not None:
        extra_out.update({name: first[f"_x_{name}"] for name in extra})
    none = [None] * len(probs)
    if approx:
        return local_frame(spark, [(c, first[f"n{k}"], *(first[f"a{k}"] or none)) for k, c in enumerate(cols)], schema)
    brackets = {(k, i): (first[f"a{k}"][2 * i], first[f"a{k}"][2 * i + 1])
                for k in range(len(cols)) for i in range(len(probs)) if first[f"n{k}"]}
    if not brackets:
        return local_frame(spark, [(c, 0, *none) for c in cols], schema)
    second = df.agg(*[e for (k, i), (lo, hi) in brackets.items() for e in (
        F.count_if(x[k] < F.lit(lo)).alias(f"b{k}_{i}"),
        F.count_if((x[k] >= F.lit(lo)) & (x[k] <= F.lit(hi))).alias(f"c{k}_{i}"))]).first()
    meta, most = [], 0
    for (k, i), (lo, hi) in brackets.items():
        low = math.floor((first[f"n{k}"] - 1) * probs[i]) + 1
        high = min(low + 1, first[f"n{k}"])
        below, rows = second[f"b{k}_{i}"], second[f"c{k}_{i}"]
        if not (below < low and below + rows >= high):
            lo, hi, below, rows = float("-inf"), float("inf"), 0, first[f"n{k}"]
        most = max(most, rows)
        meta.append((k, i, lo, hi, below, low, high))
    conds = [(x[k] >= F.lit(lo)) & (x[k] <= F.lit(hi)) for k, _, lo, hi, *_ in meta]
    inside = df.select(F.explode(F.array(*[
        F.when(c, F.struct(F.lit(m[0]).alias("_k"), F.lit(m[1]).alias("_i"), x[m[0]].alias("value")))
        for c, m in zip(conds, meta, strict=True)])).alias("t")).filter(F.col("t").isNotNull()).select("t.*")
    brackets_frame = local_frame(spark, meta, "_k int, _i int, lo double, hi double, below long, r1 long, r2 long")
    # One row per column and probability.
    got = {(r["_k"], r["_i"]): (r["v1"], r["v2"]) for r in _ordered(inside, brackets_frame, ["_k"], most).collect()}
    out = []
    for k, c in enumerate(cols):
        n = first[f"n{k}"]
        values = list(none)
        for i, p in enumerate(probs):
            if (k, i) in got:
                v1, v2 = got[(k, i)]
                h = (n - 1) * p
                values[i] = v1 + (v2 - v1) * (h - math.floor(h))
        out.append((c, n, *values))
    return local_frame(spark, out, schema)
