"""Cross-site line dedup (DataFrame functions only).

A line is boilerplate when it stands on at least ``min_sites`` distinct sites.
Per line hash the sites are gathered in a HyperLogLog sketch, merged by
aggregation.  Where the sketch's estimate is near the threshold the sites are
counted exactly, so sketch error never decides.  Boilerplate lines are removed
from every document that holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sites from which a line counts as boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers; 2 ** 10 give a relative error of about 2.6 %.
LG_K = 10
#: Estimates within this share of the threshold are counted exactly (over 7 sigma).
NEAR = 0.2
#: Parts of the documents that meet the boilerplate lines apart, so that a line of very many
#: documents is not one task's.
SALTS = 16


def line_key(line) -> F.Column:
    """128 bits of the line without surrounding white space; null for a blank line."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"),
                                       F.xxhash64(F.lit("line"), bare).alias("b")))


def line_keys(text) -> F.Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(lines, lambda x: line_key(x))


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source",
                min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """Keys (a, b) of lines that stand on at least ``min_sites`` distinct non-null sites."""
    site = F.col(site_col).cast("string")
    lines = (docs.filter(F.col(site_col).isNotNull() & F.col(text_col).isNotNull())
             .select(site.alias("site"),
                     F.explode(F.array_distinct(line_keys(F.col(text_col)))).alias("k"))
             .filter(F.col("k").isNotNull()).select(F.col("k.a").alias("a"), F.col("k.b").alias("b"), "site"))
    # Equal (line, site) rows collapse before anything is shuffled, so a line that
    # stands in a third of all documents is a few rows per task.
    pairs = lines.groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
    sketched = (pairs.groupBy("a", "b")
                .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")))
    low, high = min_sites * (1 - near), min_sites * (1 + near)
    sure = sketched.filter(F.col("sites") > high).select("a", "b")
    unsure = sketched.filter((F.col("sites") >= low) & (F.col("sites") <= high)).select("a", "b")
    exact = (pairs.join(unsure, ["a", "b"], "left_semi").groupBy("a", "b")
             .agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select("a", "b"))
    return sure.unionByName(exact)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K,
                near: float = NEAR) -> DataFrame:
    """All columns of ``docs`` with boilerplate lines cut from the text, plus
    ``n_lines`` and ``n_removed_lines`` (replacing input columns of these names).

    Lines are split at ``\\n`` and compared without surrounding white space; blank
    lines are never boilerplate.  A null text stays null with 0 lines; an empty text
    has one blank line.  A null site counts for no line, but its documents are
    cleaned too.  Rows that repeat an id are cleaned each on its own text.  An empty
    table gives an empty result.
    """
    bad = boilerplate(docs, text_col, site_col, min_sites, lg_k, near)
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # The row travels as one value, so no column of its own meets those made here.  Rows
    # meet their lines again by a key of the text itself, salted by the id so
    # that copies of one text spread over the partitions.
    text = F.col("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{text_col}`").alias("text"),
                       F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`")).alias("key"))
    held = (rows.filter(text.isNotNull())
            .select("key", F.explode(F.array_distinct(line_keys(text))).alias("k"))
            .filter(F.col("k").isNotNull())
            .select("key", F.col("k.a").alias("a"), F.col("k.b").alias("b"), F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))
            .join(bad, ["a", "b", "salt"], "left_semi")
            .groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("bad")))
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    kept = F.filter(lines, lambda x: F.coalesce(~F.array_contains(F.col("bad"), line_key(x)), F.lit(True)))
    out = rows.join(held, "key", "left").withColumn("lines", lines).withColumn(
        "kept", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(kept))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_removed = (F.size("lines") - F.size("kept")).cast("long")
    new_text = F.when(F.col("bad").isNull(), text).otherwise(F.array_join("kept", "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    return out.select(*[new_text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names],
                      n_lines.alias("n_lines"), n_removed.alias("n_removed_lines"))
