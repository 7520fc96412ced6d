"""Property checks on generated frames: the clean table
keeps no null except in all-null columns, the score stays in [30, 100],
correlation is symmetric with a unit diagonal, histogram counts add up to the
non-null count, box quartiles are ordered, exact quantiles equal a
single-node brute force."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_

from tabulon.operators import quality as qa
from tabulon.operators import stats as st
from tabulon.operators.ranking import column_quantiles

SETTINGS = settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))

values = st_.lists(st_.one_of(st_.none(), st_.floats(-1e6, 1e6, allow_nan=False).map(lambda v: round(v, 3))),
                   min_size=4, max_size=60)
labels = st_.lists(st_.one_of(st_.none(), st_.sampled_from(["a", "b", "c"])), min_size=4, max_size=60)


def frame(spark, a, b, c):
    n = min(len(a), len(b), len(c))
    rows = [(a[i], b[i], c[i]) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c string"), rows


def brute(vals, p):
    v = np.sort(np.asarray(vals, dtype=float))
    h = (len(v) - 1) * p
    lo = int(math.floor(h))
    hi = min(lo + 1, len(v) - 1)
    return v[lo] + (v[hi] - v[lo]) * (h - lo)


@SETTINGS
@given(a=values, b=values, c=labels)
def test_clean_and_score(spark, a, b, c):
    df, rows = frame(spark, a, b, c)
    report = qa.quality_report(df).first()
    assert 30.0 <= report["quality_score"] <= 100.0
    cleaned = qa.clean(df)
    kept = [r for r in rows if sum(v is not None for v in r) >= 2]
    for i, name in enumerate(["a", "b", "c"]):
        if any(r[i] is not None for r in kept):
            assert cleaned.filter(f"{name} IS NULL").count() == 0


@SETTINGS
@given(a=values, b=values)
def test_correlation_symmetric_unit_diagonal(spark, a, b):
    df, _ = frame(spark, a, b, ["x"] * max(len(a), len(b)))
    r = {(x["var1"], x["var2"]): x["r"] for x in st.correlation(df, ["a", "b"]).collect()}
    assert r[("a", "b")] == r[("b", "a")]
    for v in ("a", "b"):
        if r[(v, v)] is not None:
            assert r[(v, v)] == pytest.approx(1.0)
    if r[("a", "b")] is not None:
        assert -1.0 <= r[("a", "b")] <= 1.0


@SETTINGS
@given(a=values)
def test_histogram_counts_add_up(spark, a):
    df, rows = frame(spark, a, a, ["x"] * len(a))
    nonnull = sum(r[0] is not None for r in rows)
    if nonnull == 0:
        return
    h = st.histogram(df, "a", 30).collect()
    assert sum(x["count"] for x in h) == nonnull
    assert all(0 <= x["bin"] < 30 for x in h)


@SETTINGS
@given(a=values, c=labels)
def test_box_quartiles_ordered_and_exact(spark, a, c):
    df, rows = frame(spark, a, a, c)
    for r in st.box_stats(df, "a", "c").collect():
        assert r["q1"] <= r["median"] <= r["q3"]
        assert r["whisker_low"] <= r["whisker_high"]
        grp = [x[0] for x in rows if x[2] == r["group"] and x[0] is not None]
        assert r["median"] == pytest.approx(brute(grp, 0.5))
        assert r["n"] == len(grp)


@SETTINGS
@given(a=values, b=values)
def test_column_quantiles_match_brute_force(spark, a, b):
    df, rows = frame(spark, a, b, ["x"] * max(len(a), len(b)))
    got = {r["column_name"]: r for r in column_quantiles(df, ["a", "b"], [0.1, 0.5, 0.9]).collect()}
    for i, name in enumerate(["a", "b"]):
        vals = [r[i] for r in rows if r[i] is not None]
        if not vals:
            assert got[name]["n"] == 0
            continue
        for p, nm in ((0.1, "q0100"), (0.5, "q0500"), (0.9, "q0900")):
            assert got[name][nm] == pytest.approx(brute(vals, p), rel=1e-12, abs=1e-9)


small_ints = st_.lists(st_.one_of(st_.none(), st_.integers(0, 3)), min_size=1, max_size=40)


@SETTINGS
@given(a=small_ints, b=small_ints)
def test_duplicate_rows_match_brute_force(spark, a, b):
    n = min(len(a), len(b))
    rows = [(a[i], b[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "a int, b int")
    r = qa.duplicate_rows(df).first()
    assert (r["n_rows"], r["n_distinct"], r["n_duplicates"]) == (n, len(set(rows)), n - len(set(rows)))


@SETTINGS
@given(a=values)
def test_outliers_match_brute_force(spark, a):
    df, rows = frame(spark, a, a, ["x"] * len(a))
    vals = [r[0] for r in rows if r[0] is not None]
    got = {r["column_name"]: r for r in qa.outliers_iqr(df, ["a"]).collect()}
    if not vals:
        assert not got
        return
    q1, q3 = brute(vals, 0.25), brute(vals, 0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    hits = sum(v < lo or v > hi for v in vals)
    if hits == 0:
        assert "a" not in got
    else:
        assert got["a"]["n_outliers"] == hits
        assert got["a"]["percentage"] == pytest.approx(hits / len(rows) * 100)
