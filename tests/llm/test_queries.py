"""The registered queries and the pipeline over small tables on disk, against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tabulon.llm import language_id as L
from tabulon.llm.packing import cut
from tabulon.llm.queries import ORACLE, QUERIES
from tests.llm.test_pairs_and_spans import WORD, brute_bytes, brute_components, brute_fp, brute_windows
from tests.llm.test_texts import brute_base, brute_licenses, brute_targets, tokens
from tests.llm.test_vectors import brute as brute_vectors
from tests.llm.test_vectors import table as vector_table

SAY = {"en": ["the", "with", "house", "think", "of", "small"], "de": ["der", "schön", "nicht", "haus", "und"],
       "fr": ["été", "maison", "vous", "le", "très"]}


def corpus():
    rng = random.Random(21)
    rows = []
    for i in range(160):
        g = rng.choice(list(SAY))
        lines = [" ".join(rng.choice(SAY[g]) + rng.choice(["", "a", "e"]) for _ in range(rng.randrange(3, 40)))
                 for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.3:
            lines.insert(0, "Home | About | Contact")
        if rng.random() < 0.1:
            lines.append("Released under the MIT License.")
        rows.append((i, "\n".join(lines), g, f"s{rng.randrange(14)}", 1))
        if i > 20 and rng.random() < 0.25:
            _, twin, g, _, _ = rows[rng.randrange(len(rows))]
            rows[-1] = (i, twin.replace("house", "homes", 1) if rng.random() < 0.5 else twin, g, rows[-1][3], 1)
    rows += [(300, None, "en", "s1", None), (301, "", None, None, 0), (302, "123 ***", "en", "s2", 7), (303, "der " * 3000, "de", "s3", 9)]
    # Random consonants, and a language that is not learned.
    rows += [(306, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(30)), "en", "s1", 9),
             (308, "吾輩は猫である名前はまだ無い " * 9, "de", "s1", 9)]
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 9 != 0), 0) for i in range(0, 160, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vectors = [r[:3] for r in vector_table() if r[0] is not None]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def rows(spark, sf_dir, name):
    return [tuple(r) for r in QUERIES[name](spark, sf_dir).collect()]


PAIRS = [(r[0], r[1]) for r in corpus()]


def test_every_operator_has_one_query():
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in QUERIES) == 1
    assert "pipeline" in QUERIES and set(ORACLE) <= set(QUERIES)


def test_license_query(spark, sf_dir):
    got = {r[0]: r for r in rows(spark, sf_dir, "op1_license_scan")}
    for d, t in PAIRS:
        want = brute_licenses(t)
        best = max(((h["matched"], h["coverage"], h["license"]) for h in want), default=(None, None, None))
        places = ",".join(f"{h['license']}:{h['start']}:{h['stop']}" for h in want)
        assert got[d][2:] == (len(want), best[2], best[1], places)


def test_packing_query(spark, sf_dir):
    from tests.llm.test_texts import check_packing
    got = QUERIES["op2_packing"](spark, sf_dir).collect()
    assert got[0].__fields__ == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    n, total = check_packing(got, PAIRS, 2048)
    assert n <= math.ceil(total / 2048) + 2


def test_vector_query(spark, sf_dir):
    want = brute_vectors([r for r in vector_table() if r[0] is not None], 0.98)
    assert sorted(rows(spark, sf_dir, "op4_embedding_dedup"), key=str) == want


def test_simhash_query(spark, sf_dir):
    assert sorted(rows(spark, sf_dir, "op5_simhash_dedup"), key=str) == brute_components(PAIRS)


def test_quality_query(spark, sf_dir):
    got = QUERIES["op6_quality_rules"](spark, sf_dir).collect()
    assert got[0].__fields__[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                     "base_failed", "kept"]
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(PAIRS)
    for d, t in PAIRS:
        assert tuple(by_id[d][1:6]) == brute_base(t)


def test_substring_query(spark, sf_dir):
    assert sorted(rows(spark, sf_dir, "op7_substring_dedup"), key=str) == brute_windows(PAIRS, 13)


def test_suffix_query(spark, sf_dir):
    assert sorted(rows(spark, sf_dir, "op8_suffix_dedup"), key=str) == brute_bytes(PAIRS, 400, False)


def test_language_query(spark, sf_dir):
    got = QUERIES["op10_language_id"](spark, sf_dir).collect()
    assert [len(got), *got[0].__fields__] == [len(PAIRS), "doc_id", "held_out", "lang_pred", "score"]
    want = {r[0]: r[2] for r in corpus()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.doc_id in (306, 308) or r.lang_pred == (want[r.doc_id] if r.doc_id < 160 or r.doc_id == 303 else "und")


def test_neighbour_query(spark, sf_dir):
    got = QUERIES["op11_quality_neighbours"](spark, sf_dir).collect()
    assert [len(got), *got[0].__fields__] == [len(PAIRS), "doc_id", "held_out", "score", "predicted"]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_phrase_query(spark, sf_dir):
    from tests.llm.test_phrases import brute
    got = sorted(rows(spark, sf_dir, "op12_phrase_mining"))
    assert got and got == [r[:8] for r in brute(corpus(), 3, 10, 50, 2000)]


def test_audit_query(spark, sf_dir):
    from tests.llm.test_filter_audit import brute
    labels = [(i, int(i % 9 != 0), 0) for i in range(0, 160, 2)]
    assert sorted(rows(spark, sf_dir, "op13_filter_audit")) == brute(corpus(), labels)


def brute_pipeline(spark, docs):
    """Plain Python for every stage; language predictions come from the fitted model."""
    model = L.fit(docs)
    scorer = L.Scorer(model[0], model[2])
    import numpy as np
    import pyarrow as pa
    table = [tuple(r) for r in docs.collect()]
    total, letter = scorer.texts(pa.array([r[1] or "" for r in table]))
    post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    # Letters by Python's own classes, each word's start counted as one more.
    words = [re.findall(r"[^\W\d_]+", (r[1] or "").lower()) for r in table]
    letters = [sum(len(w) + 1 for w in ws) for ws in words]
    least = {}
    for r, row, n in zip(table, total, letters, strict=True):
        if r[1] is not None and r[2] in model[1] and n >= 20 and zlib.crc32(str(r[0]).encode()) % 5:
            least.setdefault(r[2], []).append(row[model[1].index(r[2])] / n)
    least = {k: np.percentile(v, 1) for k, v in least.items()}
    far = [n >= 20 and row.max() / n < least[model[1][row.argmax()]] - 0.5 for row, n in zip(total, letters, strict=True)]
    assert [r[0] for r, out in zip(table, far, strict=True) if out] == [306, 308]
    table = [r for r, p, has, out in zip(table, post, letter, far, strict=True) if has and p >= 0.5 and not out]
    # Line dedup.
    sites = defaultdict(set)
    bare = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for r in table:
        for line in r[1].split("\n"):
            if bare(line) and r[3] is not None:
                sites[bare(line)].add(r[3])
    out = []
    for r in table:
        left = [x for x in r[1].split("\n") if len(sites[bare(x)]) < 10]
        text = "\n".join(left)
        out.append((r[0], text, r[2], r[3], len(text) if text != r[1] else r[4]))
    # SimHash: the smallest id of each component.
    comp = {d: c for d, _, c in brute_components([r[:2] for r in out])}
    out = [r for r in out if comp[r[0]] == r[0]]
    assert len({brute_fp(r[1]) for r in out}) == len(out)
    # Mixing.
    sizes = defaultdict(int)
    for r in out:
        sizes[r[3]] += len(WORD.findall(r[1]))
    targets = brute_targets(dict(sizes))
    mixed = []
    for r in out:
        rate = targets[r[3]] / sizes[r[3]] if sizes[r[3]] else 0.0
        seed = f"mix-1:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}"
        u = int(hashlib.md5(seed.encode()).hexdigest()[:13], 16) / 2 ** 52
        mixed += [r] * (math.floor(rate) + (u < rate - math.floor(rate)))
    pieces = Counter()
    for r in mixed:
        ids, start = tokens(r[1]), 0
        for size in cut(len(ids), 2048, 64):
            part = np.array(ids[start:start + size], dtype="<u4").tobytes()
            pieces[(r[0], start, size, zlib.crc32(part), len(ids))] += 1
            start += size
    return pieces


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_pipeline(spark, docs)
    got = QUERIES["pipeline"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert 0 < len(got) and not {300, 306, 308} & {r.doc_id for r in got}


def test_stages_keep_columns_and_handle_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.limit(0)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "source_mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0
        if name != "packing":
            assert out.dtypes == docs.dtypes
