"""Phrase mining: the two-way index against counting, the operator against brute force."""
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tabulon.llm import phrases as P

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (WORD.findall(p) for p in PIECE.split(low)) if w]


def brute(rows, depth, least, cover, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for k in range(1, depth + 1):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            inside = [b for q, b in cand.items() if len(q) > len(p)
                      and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= cover * a for b in inside):
                continue
            score, k = min((int(Fraction(1000000 * a * a, counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], k))
        for rank, (s, a, p, left, right, k) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s, k))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["The", "the", "of", "a", "é", "New", "york", "city", "x-y", "日本", "\x1cq", "\x85", "1.5"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocab[:rng.randrange(3, 13)]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b", ",", "  "])
                       for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und", ""]), "s"))
    return rows


ODD = [(900, None, "en", None), (901, "", "de", None), (902, " ., \n", "de", None), (None, "the of the of", None, None),
       (903, "New York city " * 8000, "en", "s"), (903, "New York city " * 8000, "en", "s"), (904, "...!!" * 50, "x", None)]


def test_intervals_of_the_index_hold_every_occurrence():
    rng = random.Random(4)
    for _ in range(30):
        seqs = [[rng.randrange(1, 6) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 8))]
        t = np.array([0] + [x for s in seqs for x in [*s, 0]], dtype=np.int32)
        depth = rng.randrange(2, 6)
        fm = P.Index.build(t, depth)
        found = fm.words(np.unique(t[t > 0]).astype(np.int64))
        for size in range(2, depth + 1):
            found = fm.extend(found, left=rng.random() < 0.5)
            want = Counter(tuple(s[i:i + size]) for s in seqs for i in range(len(s) - size + 1))
            assert {tuple(r): int(c) for r, c in zip(found.ids.tolist(), found.size, strict=True)} == want


def test_frequent_table_misses_nothing(spark):
    rows = [("en" if i % 3 else "fr", f"w{i} v{i}", 10) for i in range(5000)]
    table = P.Frequent.of(P.hashes_of(spark.createDataFrame(rows, "lang string, phrase string, f long").repartition(4)), 5000)
    for lang in ("en", "fr"):
        own = [p.split() for g, p, _ in rows if g == lang]
        hashes = P.word_hashes(lang, [w for p in own for w in p]).reshape(-1, 2)
        assert table(P.phrase_hashes(hashes)).all()
        other = P.word_hashes("xx", [w for p in own for w in p]).reshape(-1, 2)
        assert table(P.phrase_hashes(other)).mean() < 0.2


def test_packed_hashes_sum_up():
    rng = np.random.default_rng(3)
    hashes = np.concatenate((rng.integers(0, 1 << 63, 400, dtype=np.uint64), rng.integers(0, 9, 300, dtype=np.uint64) << np.uint64(33)))
    counts, want = rng.integers(1, 300, 700), Counter()
    for h, c in zip(hashes.tolist(), counts.tolist(), strict=True):
        want[((h >> 32) % 5, h & 0xFFFFFFFF)] += c
    got = P._packed(hashes, counts, 5)
    rows = [(b, *P._unpacked(n, x)) for b, n, x in zip(*(got.column(c).to_pylist() for c in range(3)), strict=True)]
    assert {(b, int(v)): int(c) for b, low, n in rows for v, c in zip(low, n, strict=True)} == {k: min(c, 255) for k, c in want.items()}
    low, sums = P._summed([(np.array([3, 5], dtype=np.uint32), np.array([200, 1], dtype=np.uint8)), (np.array([3], dtype=np.uint32), np.array([200]))])
    assert low.tolist() == [3, 5] and sums.tolist() == [400, 1]


@pytest.mark.parametrize("depth,least,cover,top,shard", [(3, 10, 50, 2000, 2_000_000), (3, 3, 80, 7, 40), (4, 4, 50, None, 300), (2, 2, 50, 5, 10)])
def test_mine(frame, depth, least, cover, top, shard):
    from pyspark.sql import functions as F
    rows = corpus(depth + least, 200) + ODD
    docs = frame(rows).withColumn("rank", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("phrase", F.lit("x")).withColumn("words", F.lit(0))
    got = P.mine(docs, max_words=depth, min_count=least, cover_percent=cover, top=top, shard_words=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut", "left_most", "right_most"]
    assert sorted(tuple(r)[:9] for r in got.collect()) == brute(rows, depth, least, cover, top)


def test_counts_past_64_bits(spark):
    """The arithmetic of a score on counts whose products pass 64 bits."""
    a, left, right = 3_000_000_000, 7_000_000_001, 5_000_000_003
    got = spark.sql(f"SELECT (CAST(1000000 AS DECIMAL(7,0)) * CAST(CAST({a} AS DECIMAL(19,0)) * CAST({a} AS DECIMAL(19,0)) AS DECIMAL(31,0)))"
                    f" div (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0))) AS s").first().s
    assert got == 1000000 * a * a // (left * right)


def test_mine_without_phrases(frame):
    assert P.mine(frame([])).count() == 0
    assert P.mine(frame([(1, "a b c", "en", None)])).count() == 0
    with pytest.raises(ValueError):
        P.mine(frame([]), max_words=1)


def test_shards_are_read_one_by_one(spark, frame, monkeypatch):
    """A task's worker gets one shard at a time, read alone from a table with small row groups."""
    from tabulon.llm import phrases
    seen, write = [], phrases.materialise

    def noted(df, name, **settings):
        seen.append((name, settings))
        return write(df, name, **settings)

    monkeypatch.setattr(phrases, "materialise", noted)
    levels, _ = phrases.frequent_phrases(frame([(i, "a b c. d e f " * 4, "en", "s") for i in range(40)]), shard_words=50)
    assert levels[2].count() > 0
    by = dict(seen)
    assert int(by["phrase-index"]["parquet__block__size"]) <= 16 << 20
    for name in ("phrase-hashes-2", "phrase-hashes-3", "phrases"):
        assert {int(v) for v in by[name].values()} == {1}


def test_blocks_of_a_bucket_are_sorted_a_few_times(monkeypatch):
    """However many blocks a bucket has, each hash is sorted a few times."""
    rng = np.random.default_rng(5)
    hashes = [rng.integers(0, 1 << 40, 200, dtype=np.uint64) for _ in range(3000)]
    hashes[7], hashes[1234], hashes[2900] = (np.full(200, 77, dtype=np.uint64) for _ in range(3))
    blocks = [P._packed(h, np.ones(len(h), dtype=np.int64), 1) for h in hashes]
    work, add = [], P._summed

    def noted(held):
        work.append(sum(len(x) for x, _ in held))
        return add(held)

    monkeypatch.setattr(P, "_summed", noted)
    got = [x for b in P.hash_sums(blocks, 200) for x in b.column("hash").to_pylist()]
    assert got == [77]
    assert sum(work) < 8 * sum(map(len, hashes))


def test_text_blocks_sum_up(monkeypatch):
    monkeypatch.setattr(P, "HELD_TEXTS", 50)
    rng, want, blocks = random.Random(6), Counter(), []
    for _ in range(30):
        texts = [rng.choice(["en", "a\nb", ""]) + "\n" + " ".join(rng.choices(["é", "x" * 70, "the", "日本", "w"], k=rng.randrange(1, 4)))
                 for _ in range(40)]
        counts = np.array([rng.randrange(1, 1 << 33) for _ in texts])
        for t, c in zip(texts, counts.tolist(), strict=True):
            want[t] += c
        blocks.append(P._packed_texts(*P._added([P.pa.array(texts)], [counts]), 3))
    rows = sorted((r for b in blocks for r in b.to_pylist()), key=lambda r: r["bucket"])
    least = sorted(want.values())[len(want) // 2]
    got = [r for b in P.text_sums([P.pa.RecordBatch.from_pylist(rows, blocks[0].schema)], least) for r in b.to_pylist()]
    assert {r["lang"] + "\n" + r["phrase"]: r["f"] for r in got} == {t: c for t, c in want.items() if c >= least}
    assert len(got) == len({(r["lang"], r["phrase"]) for r in got}) and all(r["size"] == len(r["phrase"].split(" ")) for r in got)


def test_word_hashes_of_any_length_and_place():
    words = ["", "a", "b", "x" * 8, "x" * 9, "x" * 64, "x" * 65, "é日本", "y" * 5000, "z"]
    together = P.word_hashes("en", words)
    assert len(set(together.tolist())) == len(words)
    assert [int(P.word_hashes("en", [w])[0]) for w in words] == together.tolist()
    assert P.word_hashes("en", P.pa.array(["?", *words, "!"]).slice(1, len(words))).tolist() == together.tolist()
    assert not set(P.word_hashes("fr", words).tolist()) & set(together.tolist())


def test_counts_of_phrases_are_not_grouped_as_rows(spark, frame, monkeypatch):
    """Counts reach their bucket in blocks, not as a row for each text of each shard."""
    plans, write = {}, P.materialise

    def noted(df, name, **settings):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, **settings)

    monkeypatch.setattr(P, "materialise", noted)
    found = P.mine(frame([(i, "a b c. d e f " * 4, "en", "s") for i in range(40)]), shard_words=50)
    assert "Aggregate" not in plans["phrases-1"] + plans["phrases"]
    # The cuts and the longer candidates of a phrase are gathered at once.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
