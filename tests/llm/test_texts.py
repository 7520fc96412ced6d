"""License scan, packing, line dedup, quality rules, mixing and language ID."""
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import language_id as L
from tabulon.llm import license_scan as S
from tabulon.llm import mixing, packing
from tabulon.llm.line_dedup import dedup_lines
from tabulon.llm.quality_rules import COUNTS, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(900, None), (901, ""), (902, " \n\t\x0b"), (None, "one\ntwo\none"), (None, None), (903, "word " * 30000),
       (903, "word " * 30000), (904, "\x1cé\x85 İ ẞ <|endoftext|> 日本語 don't 1234 ###")]


def docs(frame, rows):
    """With an extra column that clashes with an output column."""
    from pyspark.sql import functions as F
    return frame(rows).withColumn("score", F.lit("mine")).withColumn("kept", F.lit(1)).withColumn("start", F.lit(2))


# --- license scan -----------------------------------------------------------------

def test_patience_matches_are_common_subsequences():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(25))]
        b = [rng.randrange(12) for _ in range(rng.randrange(25))]
        m = S.patience(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))
    assert S.patience(list("abcdef"), list("xbcdey")) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_longest_increasing_run():
    rng = random.Random(2)
    for _ in range(100):
        js = rng.sample(range(30), 8)
        pairs = list(enumerate(js))
        best = max(len(c) for n in range(9) for c in itertools.combinations(js, n) if list(c) == sorted(c))
        got = S.increasing(pairs)
        assert len(got) == best and got == sorted(got) and [j for _, j in got] == sorted(j for _, j in got)


def brute_licenses(text):
    """Every template aligned at every start, without the prefilter and sliding counts."""
    words = S.words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    lists = {k: S.words_of(t) for k, t in S.TEMPLATES.items()}
    return S.licenses(words, lists, S.MIN_COVERAGE)


def test_license_scan(frame):
    rng = random.Random(3)
    vocab = ["the", "of", "software", "version", "licensed", "under", "x", "copies", "and"]
    rows = []
    for i, (_, t) in enumerate(list(S.TEMPLATES.items()) * 3):
        own = t.split()
        if i % 3 == 1:
            own.insert(len(own) // 2, "EXTRA")
        if i % 3 == 2 and len(own) > 9:
            del own[3]
        noise = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randrange(20)))
        rows.append((i, f"{noise()}\n{' '.join(own).upper() if i % 2 else ' '.join(own)}.\t{noise()}"))
    rows += [(800, "Licensed under the Apache License, Version 2.0. " * 2), (801, " ".join(vocab * 20)),
             (802, "nothing here"), *ODD]
    got = S.scan(docs(frame, rows)).collect()
    assert Counter((r.doc_id, tuple(h.asDict().values() for h in []), str([h.asDict() for h in r.licenses])) for r in got) \
        == Counter((d, (), str(brute_licenses(t))) for d, t in rows)
    by_id = {r.doc_id: [h.license for h in r.licenses] for r in got}
    for i, name in enumerate(list(S.TEMPLATES) * 3):
        if i % 3 == 0:
            assert name in by_id[i]
    assert by_id[800] == ["Apache-2.0"] * 2 and by_id[802] == [] and by_id[900] == []
    assert S.scan(frame([])).count() == 0


# --- packing ----------------------------------------------------------------------

def tokens(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def check_packing(got, rows, sequence):
    whole = Counter((d, tuple(tokens(t))) for d, t in rows)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= sequence
    # Every (document, start, length, crc) as often as the document's rows.
    expected = Counter()
    for (d, ids), n in whole.items():
        start = 0
        for size in packing.cut(len(ids), sequence, min(packing.UNIT, sequence)):
            part = np.array(ids[start:start + size], dtype="<u4").tobytes()
            expected[(d, start, size, zlib.crc32(part), len(ids))] += n
            start += size
        assert start == len(ids)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    total = sum(len(ids) * n for (_, ids), n in whole.items())
    return len(by_sequence), total


def test_packing(frame):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["don't", "Été", "a", "naïve", "x9", "日本", "…", "big"]) + str(rng.randrange(99))
                         for _ in range(rng.randrange(700)))) for i in range(80)] + ODD
    n, total = check_packing(packing.pack(docs(frame, rows)).collect(), rows, 2048)
    assert n <= math.ceil(total / 2048) + 2
    check_packing(packing.pack(frame(rows), sequence=100, unit=64).collect(), rows, 100)
    assert packing.pack(frame([])).count() == 0
    one = packing.pack(frame([(1, None)])).collect()
    assert [(r.length, r.doc_tokens, r.offset, r.sequence_id) for r in one] == [(1, 1, 0, 0)]


def test_patterns_use_up_the_histogram_near_the_bound():
    rng = random.Random(5)
    for _ in range(6):
        h = {n: rng.randrange(1, 400) for n in rng.sample(range(1, 101), rng.randrange(1, 20))}
        plan = packing.plan_patterns(h, 100)
        used = Counter()
        for counts, times in plan:
            assert sum(n * c for n, c in counts.items()) <= 100
            for n, c in counts.items():
                used[n] += c * times
        assert used == Counter(h)
        lengths = np.array(sorted(h, reverse=True))
        basis, use = packing.generate_patterns(lengths, np.array([h[n] for n in lengths]), 100)
        assert sum(t for _, t in plan) <= use.sum() + len(h) + 1
    assert packing.plan_patterns({}, 100) == []


def test_knapsack():
    rng = random.Random(6)
    for _ in range(20):
        lengths = np.array(rng.sample(range(1, 15), 4))
        values = np.array([rng.random() for _ in lengths])
        got, counts = packing.knapsack(values, lengths, 20)
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1]] + [best[c - n] + v for n, v in zip(lengths, values, strict=True) if n <= c])
        assert abs(got - best[20]) < 1e-9 and (counts * lengths).sum() <= 20
        assert abs((counts * values).sum() - got) < 1e-9


# --- line dedup -------------------------------------------------------------------

@pytest.mark.parametrize("near", [0.2, 0.0])
def test_lines(frame, near):
    rng = random.Random(7)
    pool = ["menu", " home ", "a b", "", "  ", "unique"]
    rows = []
    for i in range(120):
        lines = [rng.choice(pool) if rng.random() < .5 else f"line {rng.randrange(400)}" for _ in range(rng.randrange(8))]
        rows.append((i, "\n".join(lines), "en", rng.choice(["s1", "s2", "s3", "s4", None])))
    rows += [(d, t, None, "s5") for d, t in ODD]
    sites = defaultdict(set)
    for _, t, _, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r") and s is not None:
                sites[line.strip(" \t\n\x0b\x0c\r")].add(s)
    bad = {k for k, v in sites.items() if len(v) >= 3}
    want = Counter()
    for d, t, _, s in rows:
        if t is None:
            want[(d, None, 0, 0, s)] += 1
            continue
        lines = t.split("\n")
        left = [x for x in lines if x.strip(" \t\n\x0b\x0c\r") not in bad]
        want[(d, "\n".join(left), len(lines), len(lines) - len(left), s)] += 1
    got = dedup_lines(docs(frame, rows), min_sites=3, near=near)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed_lines, r.source) for r in got.collect()) == want
    assert dedup_lines(frame([])).count() == 0


# --- quality rules ----------------------------------------------------------------

def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i:i + 3])] >= 2:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_quality(spark, frame):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "river", "of", "bread", "small"]) + rng.choice("aeiou") for _ in range(90))
    poor = lambda: " ".join(rng.choice(["XX", "YY", "ZZ"]) + "##|" + str(rng.randrange(99)) for _ in range(90))
    rows = [(i, good() + "\nsame line\nsame line") for i in range(60)] + [(100 + i, poor()) for i in range(20)]
    rows += ODD + [(700, "spam ham eggs " * 40)]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(10)] + [(0, 1), (None, 1)],
                                   "doc_id long, quality int")
    df = quality(docs(frame, rows), labels)
    got = df.collect()
    assert Counter((r.doc_id, *[r[c] for c in COUNTS]) for r in got) == Counter((d, *brute_base(t)) for d, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(60)) <= kept and not kept & set(range(100, 120)) and 700 not in kept
    none = quality(frame(rows), labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in none)
    assert quality(frame([]), labels).count() == 0


def test_quality_learns_from_every_label(frame, spark):
    """5,100 trusted texts: all of them are counted, and the threshold lies between all
    labelled scores of the two qualities."""
    from tabulon.llm import quality_rules as Q
    rows = [(i, f"w{i} " * 60 if i % 2 else " ".join(f"a{i}b{j}" for j in range(60))) for i in range(5100)]
    rows += [(6000 + i, " ".join(f"##{i}|{j}" for j in range(60))) for i in range(20)]
    labels = spark.createDataFrame([(d, int(d < 6000)) for d, _ in rows] * 2, "doc_id long, quality int")

    def counts(texts):
        out = np.zeros(Q.BUCKETS, dtype=np.int64)
        for t in texts:
            out += np.bincount(Q.gram_buckets(np.frombuffer(t.encode(), np.uint8), 4, Q.BUCKETS), minlength=Q.BUCKETS)
        return out
    ratio = Q.log_ratio(counts(t for d, t in rows if d < 6000), counts(t for _, t in rows))
    got = quality(frame(rows), labels).collect()
    assert len(got) == len(rows)
    for r, t in [(r, dict(rows)[r.doc_id]) for r in got[::200]]:
        want = ratio[Q.gram_buckets(np.frombuffer(t.encode(), np.uint8), 4, Q.BUCKETS)].mean()
        assert abs(r.score - want) < 1e-9
    assert all(r.kept == (r.doc_id < 6000 and not r.base_failed) for r in got)


def test_scores_against_plain_counts(frame, spark):
    from tabulon.llm import quality_rules as Q
    rows = [(i, t) for i, t in enumerate(["abcabcabc", "xyz é xyz", "", None, "ab", "aaaaaaa"])]
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    bucket = lambda g: int(((int.from_bytes(g, "big") * 0x9E3779B97F4A7C15) % (1 << 64)) >> 40) % Q.BUCKETS
    grams = lambda t: [bucket((t or "").encode()[i:i + 4]) for i in range(len((t or "").encode()) - 3)]
    raw = Counter(b for _, t in rows for b in grams(t))
    tgt = Counter(b for _, t in rows[:2] for b in grams(t))
    n, m = sum(raw.values()) + Q.BUCKETS, sum(tgt.values()) + Q.BUCKETS
    for r in quality(frame(rows), labels).collect():
        g = grams(rows[r.doc_id][1])
        want = sum(math.log((tgt[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in g) / max(len(g), 1)
        assert abs(r.score - want) < 1e-9


# --- mixing -----------------------------------------------------------------------

def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in held]
        if not free:
            return held
        level = (total - sum(held.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= most * sizes[s]]
        if not over:
            return held | {s: level * w[s] for s in free}
        held |= {s: most * sizes[s] for s in over}


def test_mixing(frame):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(40), None, rng.choice(["b", "a", "Z", "é", None, "big", "big", "big", "big"]))
            for i in range(3000)]
    rows += [(5000, "only one", None, "tiny"), *[(d, t, None, "odd") for d, t in ODD], (5001, None, None, "empty")]
    df = docs(frame, rows)
    plan = mixing.mix_plan(df).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in plan:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.copies <= 3 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
        taken[r.source] += r.copies * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.1 * t, 3 * max((r["size"] for r in plan if r.source == s), default=0))
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(
        {k: v for k, v in sum((Counter({r.doc_id: r.copies}) for r in plan), Counter()).items() if v})
    assert mixing.mix_plan(frame([])).count() == 0 and mixing.mix(frame([])).count() == 0
    nothing = mixing.mix_plan(frame([(1, None, None, "a"), (2, "", None, None)])).collect()
    assert all(r.copies == 0 and r.target == 0 for r in nothing)


# --- language ID ------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "bab", "é"]
    probs = rng.random((len(pieces) + 1, 2))
    probs[-1] = L.UNKNOWN
    scorer = L.Scorer(pieces, probs)
    table = {p: probs[i] for i, p in enumerate(pieces)}

    def brute(word):
        total = np.zeros(2)
        for cuts in range(1 << (len(word) - 1)):
            parts, start = [], 0
            for i in range(1, len(word)):
                if cuts >> (i - 1) & 1:
                    parts.append(word[start:i])
                    start = i
            parts.append(word[start:])
            if all(p in table or len(p) == 1 for p in parts):
                total += np.prod([table.get(p, probs[-1]) for p in parts], axis=0)
        return np.log(total)

    texts = ["ab", "babab é", "Ab! ba-ab 7", "", "12", "xyz ab"]
    total, letter = scorer.texts(pa.array(texts))
    for t, got, has in zip(texts, total, letter, strict=True):
        words = re.findall(r"[a-zé]+", t.lower())
        assert np.allclose(got, sum((brute("▁" + w) for w in words), np.zeros(2)))
        assert has == bool(words)
    # Again, from the remembered scores.
    assert np.allclose(scorer.texts(pa.array(texts))[0], total)


def test_language_id(frame):
    rng = random.Random(10)
    say = {"en": ["the", "with", "house", "think"], "de": ["der", "schön", "nicht", "haus"], "fr": ["été", "maison", "vous"]}
    rows = [(i, " ".join(rng.choice(say[g]) for _ in range(30)), g, "s") for i in range(200) for g in [rng.choice(list(say))]]
    rows += [(d, t, None, "s") for d, t in ODD] + [(905, "123 !!", "en", "s"), (906, "x" * 100_000, None, None)]
    df = docs(frame, rows)
    got = L.identify(df).collect()
    assert len(got) == len(rows) and got[0].__fields__[:2] == ["doc_id", "text"]
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.lang and r.doc_id < 300:
            assert r.lang_pred == r.lang
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert L.identify(frame([])).count() == 0
    unlabelled = L.identify(frame([(1, "hello", None, None)])).collect()
    assert (unlabelled[0].lang_pred, unlabelled[0].score) == ("und", 0.0)


def test_labels_of_held_out_documents_are_not_used(frame):
    rows = [(i, "the house" if i % 2 else "das haus", "en" if i % 2 else "de", "s") for i in range(60)]
    flipped = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 5 == 0 else g, s) for d, t, g, s in rows]
    a, b = L.identify(frame(rows)).collect(), L.identify(frame(flipped)).collect()
    key = lambda rs: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in rs)
    assert key(a) == key(b)


def test_language_model_learns_from_every_label(frame):
    """More than 500 labelled texts of a language: each one's word is counted, and the least
    score per letter is the exact quantile of them all."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} the house stood there all day long", "en", "s")
            for i in range(1200)]
    rows += [(2000 + i, "das haus steht nicht hier", "de", "s") for i in range(20)] + [(3000, None, "en", "s"), (None, "the", "en", "s")]
    known = [r for r in rows if r[0] is not None and r[1] and zlib.crc32(str(r[0]).encode()) % 5]
    pieces, langs, probs = model = L.fit(frame(rows))
    assert langs == ["de", "en"]
    table = L.Pieces(pieces)
    for i, lang in enumerate(langs):
        words, counts = zip(*Counter(w for _, t, g, _ in known if g == lang for w in t.split()).items(), strict=True)
        words, counts, p = ["▁" + w for w in words], np.array(counts, dtype=float), None
        for _ in range(1 + L.EM_ROUNDS):
            p = L._normalised(L.expected_counts(table, words, counts, p))
        assert np.allclose(probs[:, i], p, rtol=1e-9)
    found = L.identify(frame(rows), model, per_letter=True)
    scorer = L.Scorer(pieces, probs)
    for r in L.least_per_letter(found).collect():
        texts = [t for _, t, g, _ in known if g == r.lang]
        total, _, n = scorer.texts(pa.array(texts), True)
        assert (n >= 20).all() and abs(np.percentile(total[:, langs.index(r.lang)] / n, 1) - r.least) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).filter("held_out").select("lang", "lang_pred").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
