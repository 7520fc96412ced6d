"""Corpus pipeline: language ID, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.language_id import MIN_LETTERS, UNDETERMINED, fit, identify, least_per_letter
from tabulon.llm.line_dedup import dedup_lines
from tabulon.llm.mixing import mix
from tabulon.llm.packing import pack
from tabulon.llm.scratch import TEXT_BATCHES, materialise
from tabulon.llm.simhash import dedup

#: A document whose best language has less than this posterior is rejected.
MIN_SCORE = 0.5
#: One that is this much less likely per letter (natural log) than 99 % of its language's
#: labelled texts is in another language, or in none.
MARGIN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages.  All but the text travels as one value, so no
    column of the documents meets those of the judgement."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", "lang", F.struct(*rest).alias("row"))
    # Scored once: the limits come from all labelled texts, then the texts are held against them.
    found = materialise(identify(rows, fit(docs), per_letter=True), "pipeline-identified", **TEXT_BATCHES)
    # One entry per learned language; without a labelled text of some length there is no limit.
    least = {r["lang"]: r["least"] for r in least_per_letter(found).collect()}
    limit = F.create_map(*[F.lit(x) for k, v in least.items() for x in (k, v - MARGIN)]) if least else None
    known = F.lit(True) if limit is None else F.coalesce(
        (F.col("n_letters") < MIN_LETTERS) | (F.col("per_letter") >= F.try_element_at(limit, F.col("lang_pred"))), F.lit(True))
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE) & known)
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; n_chars follows the text."""
    cut = dedup_lines(docs)
    return cut.select(*[F.when(F.col("n_removed_lines") > 0, F.char_length("text").cast("long"))
                        .otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else F.col(f"`{c}`")
                        for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the smallest id."""
    return dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length token sequences."""
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
          ("source_mixing", source_mixing), ("packing", packing)]

#: Language ID, fingerprints and packing are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
