"""SimHash, window and suffix dedup against brute force."""
import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from tabulon.llm.simhash import dedup, near_duplicates
from tabulon.llm.substring_dedup import dedup_substrings
from tabulon.llm.suffix_dedup import dedup_suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocab = ["a", "bé", "Cat", "dog", "the", "of", "über", "x" * 30, "9", "İ", "ß"]
    shared = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(3)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) + str(rng.randrange(50)) for _ in range(rng.randrange(0, 80))]
        text = " ".join(words)
        if rng.random() < 0.4:
            text += rng.choice([" ", "\n", "\t\x0b "]) + rng.choice(shared) + " " + str(i)
        if rows and rng.random() < 0.2:
            text = rows[rng.randrange(len(rows))][1] or ""
        if rows and rng.random() < 0.2 and rows[-1][1]:
            text = rows[-1][1].replace("dog", "cow", 1)
        rows.append((i * 3, text))
    rows += [(500, None), (501, ""), (502, "  \n\t "), (None, shared[0]), (None, None), (503, "one two"),
             (504, "aaaa " * 400), (505, "z" * 1500), (506, "ab" * 700), (3, rows[1][1]), (507, shared[0] * 3),
             (508, "\x1c nbsp\xa0x y " * 30)]
    return rows


def brute_fp(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits=2):
    fps = [brute_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            best[r] = min(best.get(r, d), d)
    return sorted(((d, f"{fps[i]:016x}", best.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("long_list", [100_000, 1])
def test_simhash_components(frame, long_list):
    rows = corpus()
    got = near_duplicates(frame(rows), long_list=long_list).collect()
    assert sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got), key=str) == brute_components(rows)


@pytest.mark.parametrize("long_list", [100_000, 2])
def test_links_of_planted_fingerprints(spark, long_list):
    """Dense balls of fingerprints: every component of the 2-bit graph is found."""
    from tabulon.llm.components import components
    from tabulon.llm.simhash import links
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(120):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    tied = {r.node: r.component for r in components(
        links(spark.createDataFrame([(f,) for f in signed], "fp long"), long_list=long_list)).collect()}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    low = {}
    for i, f in enumerate(signed):
        low[find(i)] = min(low.get(find(i), f), f)
    assert [tied.get(f, f) for f in signed] == [low[find(i)] for i in range(len(fps))]


def test_simhash_dedup_keeps_one_row_per_component(frame):
    rows = corpus()
    df = frame(rows)
    kept = dedup(df)
    assert kept.columns == df.columns
    groups = {(r.root) for r in near_duplicates(df).collect()}
    assert kept.count() == len(groups)


def test_simhash_empty(frame):
    assert near_duplicates(frame([])).count() == 0
    assert dedup(frame([])).count() == 0


def brute_windows(rows, k):
    lists = [WORD.findall(t or "") for _, t in rows]
    low = {}
    for (d, _), ws in zip(rows, lists, strict=True):
        for i in range(len(ws) - k + 1):
            if d is not None:
                w = tuple(ws[i:i + k])
                low[w] = min(low.get(w, d), d)
    out = []
    for (d, _), ws in zip(rows, lists, strict=True):
        gone = [False] * len(ws)
        for i in range(len(ws) - k + 1):
            if d is not None and low[tuple(ws[i:i + k])] < d:
                gone[i:i + k] = [True] * k
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((d, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,gram,bucket,bound", [(13, 4, 8 << 20, 64 << 20), (13, 4, 2000, 64 << 20),
                                                      (13, 4, 4000, 100), (5, 2, 3000, 1500), (2, 1, 10_000, 1 << 30)])
def test_windows(frame, window, gram, bucket, bound):
    rows = corpus()
    got = dedup_substrings(frame(rows), window=window, gram=gram, bucket_bytes=bucket, bucket_bound=bound).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_windows(rows, window)


def brute_bytes(rows, k, keep_first):
    data = [(t or "").encode() for _, t in rows]
    places = {}
    for i, b in enumerate(data):
        d = rows[i][0]
        for j in range(len(b) - k + 1):
            places.setdefault(b[j:j + k], []).append(((d is not None, d or 0), j))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for j in range(len(b) - k + 1):
            p = places[b[j:j + k]]
            if len(p) >= 2 and not (keep_first and min(p) == ((d is not None, d or 0), j)):
                gone[j:j + k] = [True] * k
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,gram,bucket,bound,keep_first",
                         [(400, 24, 8 << 20, 64 << 20, False), (60, 8, 2000, 64 << 20, False), (60, 8, 2000, 64 << 20, True),
                          (60, 8, 5000, 300, False), (60, 8, 5000, 300, True), (7, 3, 5000, 1 << 30, True)])
def test_suffixes(frame, length, gram, bucket, bound, keep_first):
    rows = corpus()
    got = dedup_suffixes(frame(rows), length=length, gram=gram, bucket_bytes=bucket, bucket_bound=bound,
                         keep_first=keep_first).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got),
                  key=str) == brute_bytes(rows, length, keep_first)


def test_empty_tables(frame):
    assert dedup_substrings(frame([])).count() == 0
    assert dedup_suffixes(frame([])).count() == 0
    one = frame([(1, None), (2, "")])
    assert {(r.doc_id, r.n_words, r.n_removed) for r in dedup_substrings(one).collect()} == {(1, 0, 0), (2, 0, 0)}
    assert {(r.doc_id, r.n_bytes, r.n_spans) for r in dedup_suffixes(one).collect()} == {(1, 0, 0), (2, 0, 0)}


def test_long_text_is_read_in_stretches(frame, monkeypatch):
    from tabulon.llm import suffix_dedup
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 500)
    import pyarrow as pa
    import numpy as np
    rng = random.Random(1)
    text = "".join(rng.choice("abcd") for _ in range(5000))
    text += text[300:900]
    parts = [b for b in suffix_dedup.pack_slice(pa.array([text]), np.array([1]), np.array([0], dtype=np.int32), 60, 8, 3)]
    assert len(parts) > 5
    from tabulon.llm.superkmers import Strings
    blocks = [Strings.from_block(r, b.as_py()) for p in parts for r, b in zip(p["raw"].to_pylist(), p["block"], strict=True)]
    assert sum(int(((b.sizes - 59) * b.n_places).sum()) for b in blocks) == len(text) - 59


def test_clashing_extra_columns(frame):
    """Extra columns named like the operators' own change nothing."""
    from pyspark.sql import functions as F
    rows = corpus(n=20)
    df = frame(rows)
    odd = df
    for name in ("doc", "key", "text_key", "fp", "root", "starts", "stops", "window", "bucket", "n_words", "component_id",
                 "n_bytes", "kept_sha256", "k", "d", "a", "b"):
        odd = odd.withColumn(name, F.lit("mine"))
    same = lambda f: Counter(map(tuple, f(odd).collect())) == Counter(map(tuple, f(df).collect()))
    assert same(near_duplicates) and same(dedup_substrings) and same(dedup_suffixes)
    assert dedup(odd).columns == odd.columns and dedup(odd).count() == dedup(df).count()


def test_one_very_long_text_among_short_ones(frame):
    rng = random.Random(9)
    long = " ".join(str(rng.randrange(10 ** 6)) for _ in range(200_000))
    rows = [(1, long), (2, "tail " + long[-3000:]), (3, "short")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_substrings(frame(rows)).collect()}
    inside = len(WORD.findall(long[-3000:]))
    assert got[1] == (200_000, 0) and got[3] == (1, 0) and got[2][1] in (inside, inside - 1)
    kept = {r.doc_id: r.n_removed for r in dedup_suffixes(frame(rows)).collect()}
    assert kept == {1: 0, 2: 3000, 3: 0} or kept[2] == 3001
    assert len({r.fp for r in near_duplicates(frame(rows)).collect()}) == 3
