"""Neighbour votes: terms and votes against plain Python, the space against a full
decomposition, held-out accuracy, and what the model may not see."""
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tabulon.llm import quality_neighbours as Q
from tabulon.llm.quality_rules import gram_buckets
from tests.llm.test_texts import ODD, WORD


def brute_terms(text):
    """Term counts of one text, word by word and byte by byte."""
    out = Counter()
    kinds = [97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57
             else 32 if c in (9, 11, 12, 13) else c for c in text.encode()]
    for i in range(len(kinds) - 3):
        out[int(gram_buckets(np.array(kinds[i:i + 4], dtype=np.uint8), 4, Q.GRAM_TERMS)[0])] += 1
    words, last = WORD.findall(text), {}
    for i, w in enumerate(words):
        out[Q.GRAM_TERMS + xxhash.xxh64_intdigest(w.lower().encode()) % Q.WORD_TERMS] += 1
        back = min(i - last[w] - 1, Q.BACK) if w in last else Q.BACK + 1
        out[Q.GRAM_TERMS + Q.WORD_TERMS + back] += 1
        last[w] = i
    out[Q.TERMS - Q.LENGTH_TERMS + int(math.log2(len(words) + 1))] += 1
    return out


def test_terms_against_plain_python():
    rng = random.Random(5)
    texts = ["", "a", "abc", "A b\tC\n\n1 2 é日本 a A a a", "x " * 50, *(t or "" for _, t in ODD)]
    texts += ["".join(rng.choice("aA1 .\n\té$") for _ in range(rng.randrange(80))) for _ in range(40)]
    got = Q.term_counts(pa.array(texts, pa.string()))
    for row, text in zip(got, texts, strict=True):
        assert {int(i): int(row[i]) for i in np.flatnonzero(row)} == dict(brute_terms(text))
    sliced = Q.term_counts(pa.array(["zz zz", *texts], pa.string()).slice(1))
    assert (sliced == got).all()


def test_votes_against_plain_python():
    rng = np.random.default_rng(2)
    known, texts = rng.standard_normal((40, 6)), rng.standard_normal((15, 6))
    known, texts = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (known, texts))
    known[7] = known[6]
    good = (rng.random(40) < 0.7).astype(float)
    balance = np.where(good == 1, 1 / good.sum(), 1 / (1 - good).sum())
    got = Q.votes(texts, known, good, balance, 9, 3.0)
    for v, s in zip(texts, got, strict=True):
        near = [float(v @ k) for k in known]
        limit = sorted(near)[-9]
        w = [(max(c, 1e-6) ** 3 * b, g) for c, b, g in zip(near, balance, good, strict=True) if c >= limit]
        assert math.isclose(s, sum(a for a, g in w if g) / sum(a for a, _ in w), rel_tol=1e-9)
    assert Q.votes(texts, known, np.ones(40), np.ones(40), 99, 1.0).tolist() == [1.0] * 15


def junk(rng, i):
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(25, 120))]
    kind = rng.randrange(4)
    if i % 3:
        return " ".join(words) + ".", 1
    return [" ".join(w + "###" for w in words), " ".join(w.upper() + "!!" for w in words),
            " | ".join(words), " ".join(w for w in words[:12] for _ in range(8))][kind], 0


def table(n=420):
    rng = random.Random(11)
    made = [junk(rng, i) for i in range(n)]
    return [(i, t, "en", "s") for i, (t, _) in enumerate(made)], [(i, g, 0) for i, (_, g) in enumerate(made)]


LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_no_leak(frame, spark):
    from pyspark.sql import functions as F
    rows, labels = table()
    truth = {i: g for i, g, _ in labels}
    docs = frame(rows + [r for r in ODD if r[0] is None or r[0] > 900]).withColumn("score", F.lit("mine")).withColumn("quality", F.lit(9))
    docs = docs.withColumn("__id", F.lit(1)).withColumn("held_out", F.lit("x"))
    got = Q.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    assert len(got) == len(rows) + sum(r[0] is None or r[0] > 900 for r in ODD)
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 50 and sum(a == b for a, b in out) / len(out) >= 0.97
    for r in got:
        assert r.held_out == (r.doc_id is not None and held(r.doc_id)) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    # Labels of held-out documents change nothing, nor do those of unknown ids and other values.
    other = [(i, 1 - g, 0) if held(i) else (i, g, 0) for i, g, _ in labels] + [(10 ** 9, None, 0), (7, 5, 0), (None, 1, 0), labels[1]]
    again = Q.classify(docs, spark.createDataFrame(other, LABELS)).collect()
    assert sorted((str(r.doc_id), round(r.score, 4)) for r in got) == sorted((str(r.doc_id), round(r.score, 4)) for r in again)


def test_space_holds_what_a_full_decomposition_holds(frame, spark):
    rows, labels = table(160)
    sample = frame(rows).select("doc_id", "text")
    space = Q.fit_space(sample, 8)
    x = Q.weights(Q.term_counts(pa.array([r[1] for r in rows], pa.string())), space.idf).astype(float)
    full = np.linalg.svd(x, compute_uv=False)
    mine = np.linalg.norm(x @ space.axes, axis=0)
    assert np.allclose(space.axes.T @ space.axes, np.eye(8), atol=1e-4)
    assert (mine ** 2).sum() >= 0.98 * (full[:8] ** 2).sum() and (np.diff(mine) < 0.02 * mine[0]).all()


def test_scores_are_the_votes_of_the_model(frame, spark):
    rows, labels = table(90)
    docs, marks = frame(rows), spark.createDataFrame(labels, LABELS)
    space, known, good = Q.fit(docs, marks)
    assert len(known) == sum(not held(r[0]) for r in rows) == len(good)
    balance = np.where(good == 1, 1 / good.sum(), 1 / (1 - good).sum())
    for r in Q.classify(docs, marks, model=(space, known, good)).collect():
        terms = brute_terms(rows[r.doc_id][1])
        x = np.sqrt([terms[t] for t in range(Q.TERMS)]) * space.idf
        v = x / np.linalg.norm(x) @ space.axes
        near = known @ (v / np.linalg.norm(v))
        top = np.argsort(-near)[:Q.NEIGHBOURS]
        w = np.maximum(near[top], 1e-6) ** Q.SHARPNESS * balance[top]
        assert math.isclose(r.score, (w * good[top]).sum() / w.sum(), abs_tol=1e-3)


def test_sample_is_bounded(frame, spark):
    rows, labels = table(200)
    _, known, good = Q.fit(frame(rows), spark.createDataFrame(labels, LABELS), sample_docs=20)
    assert len(known) == 40 and good.sum() == 20


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1, 0)], 1.0), ([(1, 0, 0), (1, 0, 1)], 0.0)])
def test_little_to_learn_from(frame, spark, labels, score):
    docs = frame([(1, "a b c", "en", None), (2, "", "en", None), (2, None, "en", None)])
    assert not held(1)
    got = Q.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert [r.score for r in got] == [score] * 3
    assert Q.classify(frame([]), spark.createDataFrame(labels, LABELS)).count() == 0
