"""Connected components of a table of links (large-star / small-star rounds).

Every round is two groupings and two joins on node ids; the links shrink towards
stars around each component's smallest node.  Nothing is collected but one count
and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.scratch import materialise, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links``: pairs of long ids.  Returns (node, component) for every linked node
    that is not itself the smallest of its component; ``component`` is that smallest id."""
    edges = materialise(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col("u") != F.col("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # Large star: every larger neighbour is tied to the smallest of the neighbourhood.
        large = (both.join(low, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: every smaller neighbour, and the node itself, likewise.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter(F.col("u") != F.col("v")))
        after = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        new = _state(after)
        release(edges)
        edges = after
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
