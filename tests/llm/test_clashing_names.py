"""Columns of the caller under the names the stages work with; rows without ids of their own."""
import random

import pytest
from pyspark.sql import functions as F

from tabulon.llm import mixing
from tabulon.llm.line_dedup import dedup_lines
from tabulon.llm.simhash import dedup

NAMES = ["__bad", "__key", "__source", "__copies", "__copy", "__own", "__hash", "__at", "__id", "__rate", "__lines", "__kept",
         "row", "key", "bad", "salt", "a", "b", "k", "u", "of", "rate", "copies", "copy", "own", "hash", "at", "id", "best", "size"]


@pytest.mark.parametrize("stage", [dedup_lines, mixing.mix, dedup])
def test_columns_of_the_caller_come_back(frame, stage):
    rng = random.Random(1)
    rows = [(i, f"Home | About\n{' '.join(rng.choice('abcdefgh') * 3 for _ in range(30))}", "en", f"s{i % 12}") for i in range(40)]
    rows += [(None, None, None, None), (7, "", "en", None)]
    docs = frame(rows)
    want = stage(docs)
    clash = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(c) for c in NAMES])
    got = stage(clash)
    assert got.columns[:5 + len(NAMES)] == [*docs.columns, *NAMES]
    assert sorted(map(str, want.select(docs.columns).collect())) == sorted(map(str, got.select(docs.columns).collect()))
    for r in got.collect():
        assert all(r[c] == f"{c} of {-1 if r.doc_id is None else r.doc_id}" for c in NAMES)


@pytest.mark.parametrize("ids", [None, 5])
def test_rows_that_share_an_id_have_draws_of_their_own(frame, ids):
    rng = random.Random(2)
    rows = [(ids, " ".join(str(rng.random()) for _ in range(5)), "en", f"s{i % 3}") for i in range(3500)]
    plan = mixing.mix_plan(frame(rows))
    for r in plan.groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert abs(r.taken - r.t) <= 0.03 * r.t
