"""Exact quantiles and global ranks against a single-node brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators.ranking import exact_quantiles, long_form, rank_rows


def brute(values, p):
    v = np.sort(np.asarray(values, dtype=float))
    h = (len(v) - 1) * p
    lo = int(np.floor(h))
    hi = min(lo + 1, len(v) - 1)
    return v[lo] + (v[hi] - v[lo]) * (h - lo)


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_match_bruteforce(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=3000).round(3)          # many ties after rounding
    b = rng.integers(0, 7, size=3000)           # few distinct values
    rows = [(float(x), int(y), "g%d" % (i % 3)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b long, g string").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["column_name"]: r for r in exact_quantiles(long_form(df, ["a", "b"]), probs).collect()}
    for col, vals in (("a", a), ("b", b)):
        for p, nm in zip(probs, ["q0000", "q0100", "q0250", "q0500", "q0750", "q0990", "q1000"]):
            assert got[col][nm] == pytest.approx(brute(vals, p), abs=1e-9)
    grouped = exact_quantiles(df.select("g", F.col("a").alias("value")), [0.5], keys=("g",)).collect()
    for r in grouped:
        sel = [x for (x, _, g) in rows if g == r["g"]]
        assert r["q0500"] == pytest.approx(brute(sel, 0.5))


def test_ranks_are_a_permutation(spark):
    df = spark.createDataFrame([(float(x % 17),) for x in range(500)], "value double").repartition(7)
    r = rank_rows(df.withColumn("column_name", F.lit("v"))).collect()
    ranks = sorted(x["rank"] for x in r)
    assert ranks == list(range(1, 501))
    by_rank = sorted(r, key=lambda x: x["rank"])
    vals = [x["value"] for x in by_rank]
    assert vals == sorted(vals)
    assert {x["n"] for x in r} == {500}


def test_single_value(spark):
    df = spark.createDataFrame([(5.0,)], "x double")
    r = exact_quantiles(long_form(df, ["x"]), [0.25, 0.5]).collect()[0]
    assert r["q0250"] == 5.0 and r["q0500"] == 5.0 and r["n"] == 1


@pytest.mark.parametrize("accuracy,slices", [(10_000, 1000), (3, 1000), (50, 2)])
def test_quantiles_are_exact_for_any_summary(spark, monkeypatch, accuracy, slices):
    """Coarse summaries give wide or failed brackets; the answer stays exact."""
    from tabulon.operators import ranking
    monkeypatch.setattr(ranking, "ACCURACY", accuracy)
    monkeypatch.setattr(ranking, "SLICES", slices)
    rng = np.random.default_rng(11)
    a = rng.exponential(size=2500).round(2)
    b = rng.integers(0, 4, size=2500)
    rows = [(float(x), int(y), None if i % 9 == 0 else float(x) * 2, None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b long, c double, e double").repartition(4)
    wide = {r["column_name"]: r for r in
            ranking.column_quantiles(df, ["a", "b", "c", "e"], [0.25, 0.5, 0.9]).collect()}
    long = {r["column_name"]: r for r in exact_quantiles(long_form(df, ["a", "b", "c"]), [0.25, 0.5, 0.9]).collect()}
    assert wide["e"]["n"] == 0 and wide["e"]["q0500"] is None
    cvals = [r[2] for r in rows if r[2] is not None]
    for col, vals in (("a", a), ("b", b), ("c", cvals)):
        for got in (wide, long):
            assert got[col]["n"] == len(vals)
            for p, nm in ((0.25, "q0250"), (0.5, "q0500"), (0.9, "q0900")):
                assert got[col][nm] == pytest.approx(brute(vals, p), abs=1e-9)


def test_describe_moments_on_every_quantile_path(spark):
    """The moments ride along in the quantile counting pass; when that pass
    does not run (approximate mode, empty table) they are still computed."""
    from tabulon.operators.stats import describe
    rng = np.random.default_rng(5)
    a = rng.normal(size=1200).round(3)
    df = spark.createDataFrame([(float(x), None) for x in a], "a double, e double")
    exact = {r["column_name"]: r for r in describe(df, ["a", "e"]).collect()}
    approx = {r["column_name"]: r for r in describe(df, ["a", "e"], approx=True).collect()}
    for r in (exact["a"], approx["a"]):
        assert r["count"] == 1200 and r["row_count"] == 1200
        assert r["mean"] == pytest.approx(a.mean()) and r["std"] == pytest.approx(a.std(ddof=1))
        assert r["min"] == a.min() and r["max"] == a.max()
    assert exact["a"]["p50"] == pytest.approx(brute(a, 0.5))
    assert exact["e"]["count"] == 0 and exact["e"]["mean"] is None and exact["e"]["p50"] is None
    empty = describe(df.limit(0), ["a"]).collect()[0]
    assert empty["count"] == 0 and empty["row_count"] == 0 and empty["p25"] is None


def test_ranks_split_a_hot_value(spark):
    """A value held by most rows is spread over several range partitions and
    the ranks stay a permutation in value order."""
    from pyspark.sql import functions as F
    vals = [5.0] * 3000 + [float(i) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "value double").repartition(6)
    ranked = rank_rows(df.withColumn("column_name", F.lit("v")), partitions=8)
    r = ranked.collect()
    assert sorted(x["rank"] for x in r) == list(range(1, 4001))
    assert [x["value"] for x in sorted(r, key=lambda x: x["rank"])] == sorted(vals)
    # The hot value spans more than one partition of the ranked data.
    hot_ranks = sorted(x["rank"] for x in r if x["value"] == 5.0)
    assert len(hot_ranks) == 3001 and hot_ranks == list(range(hot_ranks[0], hot_ranks[0] + 3001))
    tagged = (df.withColumn("column_name", F.lit("v"))
              .select("column_name", "value", F.monotonically_increasing_id().alias("_tie"))
              .repartitionByRange(8, "column_name", "value", "_tie")
              .select(F.spark_partition_id().alias("p"), "value").filter("value = 5.0")
              .select("p").distinct().count())
    assert tagged > 1


@pytest.mark.parametrize("approx", [False, True])
def test_column_quantiles_one_row_per_column(spark, approx):
    from tabulon.operators.ranking import column_quantiles
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None)], "a double, e double")
    got = {r["column_name"]: r for r in column_quantiles(df, ["a", "e"], [0.5], approx=approx).collect()}
    assert set(got) == {"a", "e"} and got["a"]["q0500"] == 2.0
    assert got["e"]["n"] == 0 and got["e"]["q0500"] is None
    empty = column_quantiles(df.limit(0), ["a"], [0.5], approx=approx).collect()
    assert [(r["column_name"], r["n"], r["q0500"]) for r in empty] == [("a", 0, None)]


def _wide_values(rng):
    out = [s * 10.0 ** e for e in range(-300, 301, 9) for s in (1, -1)]
    out += [float("inf"), float("-inf")] * 4 + [1 + 1e-15 * k for k in range(150)] + [2.0] * 60 + [0.0, -0.0, 5e-324]
    return [rng.choice(out) for _ in range(700)]


@pytest.mark.parametrize("most,cuts,failing", [(20, 8, True), (10, 8, False)])
def test_brackets_are_narrowed_whatever_their_values_are(spark, monkeypatch, most, cuts, failing):
    """Values over 600 orders of magnitude, crowded ones and infinities; brackets that fail."""
    import random

    from tabulon.operators import ranking as R
    monkeypatch.setattr(R, "ORDER_VALUES", most)
    monkeypatch.setattr(R, "CUTS", cuts)
    if failing:
        monkeypatch.setattr(R, "_around", lambda probs: [0.5, 0.5] * len(probs))
    seen = []
    real = R._narrowed

    def narrowed(counts, meta, by):
        counts, meta = real(counts, meta, by)
        seen.append(counts.groupBy(*by).count().agg(F.max("count")).first()[0])
        return counts, meta

    monkeypatch.setattr(R, "_narrowed", narrowed)
    rng = random.Random(most)
    groups = {"a": _wide_values(rng), "b": _wide_values(rng), "c": [7.0] * 30}
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]

    def brute(values, p):
        v = sorted(values)
        h = (len(v) - 1) * p
        lo = math.floor(h)
        a, b = v[lo], v[min(lo + 1, len(v) - 1)]
        return a + (b - a) * (h - lo)

    long = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, value double").repartition(4)
    for r in R.exact_quantiles(long, probs, ["g"]).collect():
        for p, name in zip(probs, R.quantile_names(probs), strict=True):
            want = brute(groups[r.g], p)
            assert r[name] == want or (math.isnan(want) and (r[name] is None or math.isnan(r[name]))), (r.g, p)
    wide = spark.createDataFrame([(float(v),) for v in groups["a"]], "x double").repartition(4)
    [r] = R.column_quantiles(wide, ["x"], probs).collect()
    for p, name in zip(probs, R.quantile_names(probs), strict=True):
        want = brute(groups["a"], p)
        assert r[name] == want or (math.isnan(want) and (r[name] is None or math.isnan(r[name])))
    assert len(seen) == 2 and max(seen) <= most
