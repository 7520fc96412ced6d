"""Filter audit: sorted lists against sets, the operator against plain Python."""
import itertools
import random
import re

import numpy as np

from tabulon.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    ws = WORD.findall(text)
    return {x for x, bad in zip("ABCD", (
        len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text)), strict=True) if bad}


def brute(rows, labels):
    docs = []
    for d, text, part, *_ in rows:
        own = fails(text or "")
        if d is not None and any(e is not None and e < d and (t or "") == (text or "") for e, t, *_ in rows):
            own.add("E")
        marks = [x for x in labels if d is not None and x[0] == d]
        docs.append((part or "", own, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out = []
    for part in {p for p, *_ in docs}:
        mine = [x for x in docs if x[0] == part]
        shapley, steps = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                steps.append(("".join(order), step, f, len(left), len(gone), sum(f in x[1] for x in mine) - len(gone),
                              sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        out += [(part, o, s, *rest, shapley[f]) for o, s, f, *rest in steps]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        vocab = [f"w{k}" for k in range(rng.choice([20, 400]))] + ["BIG", "É", "日本"]
        words = [rng.choice(vocab) for _ in range(rng.choice([30, 99, 100, 150]))]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words.append(rng.choice(["a|b", "$5", "x*"]))
        text = rng.choice([" ", "\n", "\x0b"]).join(words)
        if i > 10 and rng.random() < 0.4:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text, rng.choice(["en", "en", "de", "fr"]), "s"))
    rows += [(900, None, "en", None), (901, "", "de", None), (902, "", None, None), (None, "", "en", None), (None, None, "", None),
             (903, "Word " * 30000, "en", "s"), (903, "Word " * 30000, "en", "s"), (904, "Word " * 30000, "en", "s"), (3, rows[5][1], "de", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.sample(range(130), 70)]
    return rows, labels + [labels[0], (3, 1, 1), (3, 0, 0), (None, 1, 1), (903, 1, 0)]


def test_sorted_lists_against_sets():
    rng = random.Random(3)
    for _ in range(200):
        a, b, c = (np.array(sorted(rng.sample(range(40), rng.choice([0, 1, 5, 30]))), dtype=np.int64) for _ in range(3))
        assert A.merge(a, b).tolist() == sorted({*a.tolist(), *b.tolist()})
        assert A.minus(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
        assert A.common(a, b) == len({*a.tolist()} & {*b.tolist()})
        assert A.unions([a, b, c])[7].tolist() == sorted({*a.tolist(), *b.tolist(), *c.tolist()})


def run(frame, spark, rows, labels):
    from pyspark.sql import functions as F
    docs = frame(rows).withColumnRenamed("lang", "x").withColumn("row", F.lit("mine")).withColumn("part", F.lit(1))
    docs = docs.withColumn("fails", F.lit(2)).withColumn("text_key", F.lit("k")).withColumn("salt", F.lit(3)).withColumnRenamed("x", "lang")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("g")).withColumn("id", F.lit(7))
    return A.audit(docs, marks)


def test_audit(frame, spark):
    rows, labels = corpus()
    got = run(frame, spark, rows, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, labels)


def test_many_ranges_give_the_same(frame, spark, monkeypatch):
    monkeypatch.setattr(A, "RANGE_BITS", 2)
    rows, labels = corpus()
    assert sorted(tuple(r) for r in run(frame, spark, rows, labels).collect()) == brute(rows, labels)


def test_audit_of_little(frame, spark):
    assert run(frame, spark, [], []).count() == 0
    clean = " ".join(f"word{i}" for i in range(120))
    got = run(frame, spark, [(1, clean, "en", None)], []).collect()
    assert len(got) == 600 and all((r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) == (1, 0, 0, 0, 0) for r in got)


def test_salted_tables_are_never_broadcast(frame, spark, tmp_path):
    # Read from files, so that Spark knows their sizes and finds them small enough.
    rows, labels = corpus()
    frame(rows).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    numbered = A.numbered(spark.read.parquet(f"{tmp_path}/documents"), "doc_id", "text", "lang")
    lists = A.postings(numbered, spark.read.parquet(f"{tmp_path}/labels"), "doc_id")
    lists.collect()
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
