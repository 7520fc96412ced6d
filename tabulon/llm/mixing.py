"""Mixing sources to target weights.

Tokens (words) are summed per source, each source gets a target share, and
``rate = target / size`` says how often its documents are taken: every document
``floor(rate)`` times, plus once more when a draw seeded by a hash of its id and text
falls below the fractional part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.scratch import materialise, release

WORD = r"[^\x20\x09-\x0D]+"
#: Weights dealt to the sources in code point order, null last.
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = "mix-1"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col, text_col) -> F.Column:
    """Uniform in [0, 1): the first 52 bits of an MD5 of the seed, the id and the text's MD5, so
    rows without an id, and rows that share one, have draws of their own."""
    own = [F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
           F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))]
    digest = F.md5(F.concat(F.lit(SEED + ":"), own[0], F.lit(":"), own[1]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes``: one row per source (source, source_size).  Adds ``target``.

    Targets share the total by weight; one that exceeds ``max_repeat`` times its
    source is held there and the excess is dealt again by weight, until none is
    above.  Each round is one small aggregate over the sources.
    """
    spark = sizes.sparkSession
    n_weights = len(weights)
    # Position in code point order: ranks inside range partitions plus the
    # partitions' offsets, so no task needs all sources.
    ranged = (sizes.repartitionByRange(F.col("source").asc_nulls_last())
              .sortWithinPartitions(F.col("source").asc_nulls_last())
              .select("source", "source_size", F.monotonically_increasing_id().alias("at")))
    ranged = materialise(ranged, "mix-sources")
    part = F.shiftright("at", 33)
    offsets = (ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("before", F.coalesce(F.sum("n").over(
                   Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select("part", "before"))
    placed = (ranged.withColumn("part", part).join(offsets, "part")
              .withColumn("pos", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))))
    dealt = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                         (F.col("pos") % n_weights + 1).cast("int")).cast("long")
    table = materialise(placed.select(
        "source", "source_size", dealt.alias("weight"),
        (F.lit(max_repeat).cast("long") * F.col("source_size")).alias("most")), "mix-weights")
    release(ranged)
    total, weight_sum = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    level, known = total / weight_sum, -1
    while True:
        # Sources whose cap lies below the level are held at it.
        held = F.col("most") <= F.lit(level) * F.col("weight")
        n, capped, free = table.agg(
            F.sum(F.when(held, 1).otherwise(0)), F.sum(F.when(held, F.col("most")).otherwise(0)),
            F.sum(F.when(held, 0).otherwise(F.col("weight")))).first()
        if n == known or not free:
            break
        known, level = n, (total - capped) / free
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, rate, copies.

    Null text has size 0.  A null source is one source of its own, last in order.
    An empty text is taken like any other document of its source; with no words in
    the whole table all targets and copies are 0.  Rows that repeat an id and
    its text share a draw.  An empty table gives an empty result.  Other columns are ignored.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        word_count(F.col(text_col)).alias("size"), draw(id_col, text_col).alias("u"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat).withColumnRenamed("source", "src")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (sized.join(targets, F.col("source").eqNullSafe(F.col("src"))).drop("src")
            .withColumn("rate", rate)
            .withColumn("copies", (F.floor("rate") + extra).cast("long")).drop("u"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed corpus: every document as often as :func:`mix_plan` says, all columns kept,
    whatever their names."""
    sized = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat)
    rates = targets.select(
        F.col("source").alias("of"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))
    # The row travels as one value, so no column of its own meets those of the plan.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{source_col}`").alias("source"), draw(id_col, text_col).alias("u"))
    extra = F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (rows.join(rates, F.col("source").eqNullSafe(F.col("of")))
            .select("row", (F.floor("rate") + extra).cast("int").alias("copies")).filter(F.col("copies") > 0)
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*"))
