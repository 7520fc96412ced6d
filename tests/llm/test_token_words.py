"""Token ids of words: remembered by the worker, new ones encoded many at a time."""
import random

import pyarrow as pa
import pytest

from tabulon.llm import packing


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    return t


class Counted:
    """A tokenizer that counts the strings it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, 0

    def encode_batch_fast(self, strings, **options):
        self.given += len(strings)
        return self.tokenizer.encode_batch_fast(strings, **options)


def check(encoder, plain, texts):
    ids, first = encoder.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[first[i]:first[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids + [1], text


def test_new_words_go_to_the_tokenizer_many_at_a_time(plain):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdeéßñ", k=rng.randrange(3, 14))) + rng.choice(["", ".", "***", "'.", "$$$"])
                      for _ in range(500)) for _ in range(20)]
    encoder = packing.Encoder(packing.default_tokenizer())
    encoder.tokenizer, encoder.model = counted = Counted(encoder.tokenizer), Counted(encoder.model)
    check(encoder, plain, texts)
    given = [c.given for c in counted]
    assert 0 < sum(given) < 500
    check(encoder, plain, texts[::-1])
    assert [c.given for c in counted] == given


def test_a_worker_loads_its_encoder_once(frame, spark):
    from pyspark.sql import functions as F
    path = packing.default_tokenizer()
    assert packing.worker_encoder(path) is packing.worker_encoder(path)
    rows = [(i, "the word " * i) for i in range(1, 9)]
    got = packing.pieces(frame(rows), "doc_id", "text", 2048, 64, path).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert sorted(map(tuple, got.collect())) == [(i, 2 * i + 1) for i in range(1, 9)]


def test_a_worker_forgets_rare_words_and_keeps_common_ones(plain, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    rng = random.Random(2)
    encoder = packing.Encoder(packing.default_tokenizer())
    common = ["".join(rng.choices("abcdeßñ", k=9)) for _ in range(20)]
    for i in range(12):
        rare = ["".join(rng.choices("fghijé", k=11)) for _ in range(25)]
        check(encoder, plain, [" ".join(common + rare), " ".join(rare[::-1]) + "."])
        assert len(encoder.known) <= 60 + 50 and set(common) <= set(encoder.known), i
        assert list(encoder.known.values()) == list(range(len(encoder.met))) == list(range(len(encoder.first) - 1))
    check(encoder, plain, ["other words"])
    assert len(encoder.known) <= 60


def test_text_batches_are_bounded_by_bytes(spark):
    from tabulon.llm.batches import SLICE_BYTES
    from tabulon.llm.scratch import TEXT_BATCHES, materialise
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    rows = spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 2000) AS text").mapInArrow(sizes, "rows long, size long")
    got = materialise(rows, "sizes", **TEXT_BATCHES).collect()
    assert sum(r["rows"] for r in got) == 9000 and max(r["size"] for r in got) < 1.1 * SLICE_BYTES
    assert spark.conf.get(key, None) == before


def test_odd_words_equal_whole_texts(plain):
    letters = ["i̇", "İ", "ŉ", "ǆ", "ς", "Σ", "ﬁ", "é", "́", "日", "ª", "ᵃ", "\U00010428", "ß", "ẞ", "’", " ", "\x1c"]
    marks = ["", "*" * 12, ".é.", "'", "''", "'s", "'s.", ".'t", "`", "<|endoftext|>", "</w>", "≠", "1", "$1", "_", "…"]
    words = [a + x + b + m for x in letters for a in ("", "a") for b in ("", "b") for m in marks]
    encoder = packing.Encoder(packing.default_tokenizer())
    check(encoder, plain, [" ".join(words[i:i + 9]) for i in range(0, len(words), 9)] + ["", " \n", "abc"])
    check(encoder, plain, ["", ""])


def test_words_that_end_more_than_once_are_encoded_one_by_one():
    encoder = packing.Encoder(packing.default_tokenizer())
    words = ["abc", "de-fg", "hijk"] * 150
    flat, sizes = encoder._joined(words, encoder.tokenizer)
    other, more = encoder._one_by_one(words)
    assert flat.tolist() == other.tolist() and sizes.tolist() == more.tolist()
    encoder.ends_word = None
    assert [x.tolist() for x in encoder._joined(words, encoder.tokenizer)] == [other.tolist(), more.tolist()]
