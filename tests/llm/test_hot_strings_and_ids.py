"""Strings of very many places, and rows whose ids repeat or are null."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm.substring_dedup import dedup_substrings
from tabulon.llm.suffix_dedup import dedup_suffixes


def hot_block(places, buckets=1):
    """One string of 100 bytes at ``places`` places of as many documents."""
    from tabulon.llm.superkmers import pack
    at = np.zeros(places, dtype=np.int64)
    return pack(b"x" * 100, at, at + 100, np.full(places, 7, dtype=np.uint64), np.arange(places),
                np.arange(places, dtype=np.int32), at, buckets)


def test_places_count_against_the_bound():
    """100 bytes of text with 50,000 places are a large bucket, not a small one."""
    from tabulon.llm.superkmers import buckets_of
    assert [whole for whole, _ in buckets_of([hot_block(50_000)], 1 << 20)] == [False]
    assert [whole for whole, _ in buckets_of([hot_block(500)], 1 << 20)] == [True]


def test_hot_strings_are_passed_on_in_few_rows():
    from tabulon.llm.superkmers import BLOCK_PLACES, PIECE_PLACES, Strings, piece_batches
    n = BLOCK_PLACES + 10
    batch = hot_block(n)
    blocks = [Strings.from_block(r, b.as_py()) for r, b in zip(batch["raw"].to_pylist(), batch["block"], strict=True)]
    assert [len(b.doc) for b in blocks] == [BLOCK_PLACES, 10]
    rows = [r for b in blocks for p in piece_batches(b) for r in p.to_pylist()]
    assert len(rows) == BLOCK_PLACES // PIECE_PLACES + 1 and sum(r["n"] for r in rows) == n
    assert sorted(np.concatenate([np.frombuffer(r["docs"], dtype=np.int64) for r in rows])) == list(range(n))


def test_hot_text_and_run_of_one_byte(frame):
    """Buckets beyond the bound by their places give the results of small ones."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text) for i in range(2000)] + [(5000, "a" * 6000), (5001, "a" * 500), (5002, "b " + text)]
    df = frame(rows)
    got = {r.doc_id: r.n_removed for r in dedup_substrings(df, bucket_bound=20_000).collect()}
    assert got == {i: 30 for i in range(1, 2000)} | {0: 0, 5000: 0, 5001: 0, 5002: 30}
    small = dedup_suffixes(df, length=60, gram=8, keep_first=True).collect()
    large = dedup_suffixes(df, length=60, gram=8, keep_first=True, bucket_bound=20_000).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, large))


@pytest.fixture(scope="module")
def clash(spark):
    """Two texts of ten words with one 32-bit hash."""
    text = F.regexp_replace(F.sha1(F.col("id").cast("string")), "(....)", "$1 ")
    pair = (spark.range(400_000).select(text.alias("t")).groupBy(F.hash("t")).agg(F.sort_array(F.collect_list("t")).alias("l"))
            .filter(F.size("l") == 2).orderBy("l").first().l)
    assert pair[0] != pair[1]
    return pair


def test_rows_of_one_id_keep_their_own_spans(frame, clash):
    a, b = clash
    got = dedup_substrings(frame([(1, a), (5, a), (5, b)]), window=5, gram=2).collect()
    assert sorted((r.doc_id, r.n_removed, r.text) for r in got) == [(1, 0, a.strip()), (5, 0, b.strip()), (5, 10, "")]
    got = dedup_suffixes(frame([(None, a), (None, b), (7, a)]), length=20, gram=5, keep_first=False).collect()
    assert sorted((r.doc_id or 0, r.n_removed, bytes(r.content)) for r in got) == [
        (0, 0, b.encode()), (0, len(a), b""), (7, len(a), b"")]


def test_dedup_keeps_components_whose_null_rows_clash(frame, clash):
    from tabulon.llm.simhash import dedup
    assert sorted(r.text for r in dedup(frame([(None, clash[0]), (None, clash[1])])).collect()) == sorted(clash)


def test_copies_under_one_id_do_not_multiply_spans(frame, clash):
    from tabulon.llm.substring_dedup import repeated_spans, with_spans
    from tabulon.llm.superkmers import keyed
    rows = keyed(frame([(1, clash[0])] + [(5, clash[0])] * 20), "doc_id", "text")
    got = with_spans(rows, repeated_spans(rows, window=5, gram=2)).collect()
    # Ten words are six windows, in at most six super-k-mers.
    assert len(got) == 21 and max(len(r.starts or ()) for r in got) <= 6
