"""Regression, ANOVA, chi-square and Spearman against hand-computed values."""

import numpy as np
import pytest

from tabulon.functions.distributions import chi2_sf, f_sf, t_two_sided_p
from tabulon.operators import stats as st


def test_distribution_tables():
    # Published 5 % critical values.
    assert chi2_sf(3.841, 1) == pytest.approx(0.05, abs=2e-4)
    assert f_sf(4.26, 2, 9) == pytest.approx(0.05, abs=5e-4)
    assert t_two_sided_p(2.228, 10) == pytest.approx(0.05, abs=2e-4)


def test_regression_and_anova(spark):
    rows = [("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", 3.0, 7.0), ("b", 4.0, 9.0), ("b", 5.0, 11.0), ("c", 6.0, 13.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    r = st.linear_regression(df, "y", "x").collect()[0]
    assert (r["slope"], r["intercept"], r["n"]) == (pytest.approx(2.0), pytest.approx(1.0), 6)
    a = st.with_tail_pvalue(st.anova(df, "y", "g"), "f", "f_statistic", "df_between", "df_within").collect()[0]
    ys = {"a": [3, 5, 7], "b": [9, 11], "c": [13]}
    allv = [v for vs in ys.values() for v in vs]
    grand = np.mean(allv)
    ssb = sum(len(v) * (np.mean(v) - grand) ** 2 for v in ys.values())
    ssw = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in ys.values())
    assert a["ss_between"] == pytest.approx(ssb) and a["ss_within"] == pytest.approx(ssw)
    assert a["f_statistic"] == pytest.approx((ssb / 2) / (ssw / 3))
    # F = 9 with (2, 3) df sits just under the 5 % critical value 9.55
    assert 0.05 < a["p_value"] < 0.06


def test_chi_square_with_absent_cells(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 5 + [("y", "p")] * 5   # (y, q) absent
    df = spark.createDataFrame(rows, "a string, b string")
    r = st.chi_square(df, "a", "b").collect()[0]
    obs = np.array([[10, 5], [5, 0]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    assert r["chi2"] == pytest.approx(((obs - exp) ** 2 / exp).sum())
    assert r["dof"] == 1 and r["n"] == 20


def test_spearman_ties(spark):
    x = [1, 2, 2, 3, 4, 5, 5, 5, 6]
    y = [2, 1, 4, 3, 7, 5, 6, 9, 8]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = st.spearman(df, "x", "y").collect()[0]["rho"]

    def avg_rank(v):
        order = sorted(v)
        return [np.mean([i + 1 for i, o in enumerate(order) if o == t]) for t in v]
    assert got == pytest.approx(np.corrcoef(avg_rank(x), avg_rank(y))[0, 1])


def test_correlation_in_column_blocks(spark, monkeypatch):
    """Blocks smaller than the table give the same pairs, with and without nulls."""
    import numpy as np
    from tabulon.operators import stats
    monkeypatch.setattr(stats, "PAIR_BLOCK", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    x[:, 1] += x[:, 0]
    x[:, 3] -= 2 * x[:, 4]
    rows = [tuple(None if (i % 7 == 0 and j in (1, 4)) else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = {(r.i, r.j): r.r for r in stats.correlation(df).collect()}
    m = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for i in range(5):
        for j in range(5):
            ok = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
            assert abs(got[(i, j)] - np.corrcoef(m[ok, i], m[ok, j])[0, 1]) < 1e-9
