"""Hand-made edge frames (FIXTURES.md §3) through the operators."""

import math

import pytest
from pyspark.sql import functions as F

from tabulon.functions.columns import normalise_nan
from tabulon.operators import extract as xt
from tabulon.operators import profile as pr
from tabulon.operators import quality as qa
from tabulon.operators import stats as st


def test_dirty_numeric_missing_and_outliers(spark):
    rows = [(i, float("nan") if i == 1 else (None if i == 2 else float(i)), float(i % 5)) for i in range(20)]
    rows.append((99, 1.0, 1000.0))
    df = normalise_nan(spark.createDataFrame(rows, "id long, a double, b double"))
    miss = {r["column_name"]: r for r in qa.missing_values(df).collect()}
    assert set(miss) == {"a"} and miss["a"]["n_missing"] == 2
    assert miss["a"]["percentage"] == pytest.approx(2 / 21 * 100)
    out = {r["column_name"]: r for r in qa.outliers_iqr(df).collect()}
    assert "b" in out and out["b"]["n_outliers"] == 1
    assert out["b"]["percentage"] == pytest.approx(100 / 21)


def test_sparse_rows_half_stay(spark):
    df = spark.createDataFrame([(1, 2, 3, None), (1, 2, None, None), (1, None, None, None), (None, None, None, None)],
                               "a int, b int, c int, d int")
    assert qa.drop_sparse_rows(df).count() == 2


def test_mode_ties_smallest_wins(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "k string")
    assert qa.column_modes(df, ["k"]) == {"k": "a"}
    filled = qa.fill_missing(df).collect()
    assert sorted(r["k"] for r in filled) == ["a", "a", "a", "b", "b", "c"]


def test_all_null_column_untouched(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, s string")
    assert [r["s"] for r in qa.fill_missing(df).collect()] == [None, None]


def test_numeric_text(spark):
    df = spark.createDataFrame([("5", "5", None), (" 5 ", "1e3", None), ("1e3", "-.5", None), ("1d", "7", None),
                                ("", "8", None), (None, None, None)], "mixed string, clean string, empty string")
    flagged = [r["column_name"] for r in qa.numeric_as_string(df).collect()]
    assert flagged == ["clean"]


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "x double, y double")
    r = {(a["var1"], a["var2"]): a["r"] for a in st.correlation(df).collect()}
    assert r[("x", "y")] is None and r[("x", "x")] is None
    assert r[("y", "y")] == pytest.approx(1.0)


def test_correlation_pairwise_complete(spark):
    rows = [(float(i), float(2 * i + 1) if i % 3 else None, float(-i)) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    r = {(x["var1"], x["var2"]): x["r"] for x in st.correlation(df).collect()}
    assert r[("a", "b")] == pytest.approx(1.0) and r[("a", "c")] == pytest.approx(-1.0)
    assert r[("b", "a")] == r[("a", "b")]


@pytest.mark.parametrize("n_distinct,n_rows,expected", [(10, 22, "ordinal"), (11, 22, "quantitative"),
                                                        (19, 40, "ordinal"), (20, 40, "quantitative")])
def test_cardinality_rule(spark, n_distinct, n_rows, expected):
    df = spark.createDataFrame([(i % n_distinct,) for i in range(n_rows)], "v int")
    got = pr.field_types(df).collect()[0]["field_type"]
    assert got == expected


def test_two_groups_t_test(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", float(v)) for v in (2, 4, 6, 8, 10)] + [(None, 100.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    r = st.with_t_pvalue(st.t_test(df, "v", "g")).collect()[0]
    assert (r["group1"], r["group2"]) == ("a", "b")
    # pooled sd = sqrt((4*2.5 + 4*10)/8) = 2.5, t = -3 / (2.5*sqrt(0.4))
    assert r["t_statistic"] == pytest.approx(-3 / (2.5 * math.sqrt(0.4)))
    assert r["cohens_d"] == pytest.approx(-3 / 2.5)
    # t = -1.897 with 8 df lies between the 0.10 (1.860) and 0.05 (2.306) two-sided points
    assert 0.05 < r["p_value"] < 0.10 and r["p_value"] == pytest.approx(0.0943, abs=1e-3)
    assert r["significant"] is False


@pytest.mark.parametrize("groups", [["a"], ["a", "b", "c"]])
def test_t_test_needs_two_groups(spark, groups):
    df = spark.createDataFrame([(g, float(i)) for i, g in enumerate(groups * 3)], "g string, v double")
    with pytest.raises(ValueError):
        st.t_test(df, "v", "g")


def test_zero_variance_cohens_d(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    r = st.t_test(df, "v", "g").collect()[0]
    assert r["cohens_d"] == 0.0 and r["t_statistic"] is None


def test_normality_needs_three(spark):
    for n in (1, 2):
        df = spark.createDataFrame([(float(i),) for i in range(n)], "v double")
        with pytest.raises(Exception):
            st.shapiro_wilk(df, "v").collect()
    r = st.shapiro_wilk(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double"), "v").collect()[0]
    assert 0.75 <= r["statistic"] <= 1.0 and 0.0 <= r["p_value"] <= 1.0 and r["sample_size"] == 3


def test_flags_are_nominal(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0), (True, 3.0)], "f boolean, x double")
    prof = {r["column_name"]: r for r in pr.profile(df).collect()}
    assert prof["f"]["semantic_type"] == "nominal"
    d = st.describe(df).collect()
    assert [r["column_name"] for r in d] == ["x"]


def test_html_tables(spark):
    html = ("<table><tr><td>x</td></tr></table>"
            "<TABLE class='t'><tr><th>Name</th><th>Price &amp; tax</th></tr>"
            "<tr><td>A&lt;1&gt;</td><td>10</td></tr><tr><td><b>B</b></td><td>20</td></tr></TABLE>")
    html2 = "<table><tr><td>h1</td><td>h2</td></tr><tr><td>1</td><td>2</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, html2)], "page_id long, html string")
    rows = sorted((r["page_id"], r["row_idx"], r["col_idx"], r["header"], r["value"])
                  for r in xt.html_tables(df).collect())
    assert rows == [(1, 1, 0, "Name", "A<1>"), (1, 1, 1, "Price & tax", "10"),
                    (1, 2, 0, "Name", "B"), (1, 2, 1, "Price & tax", "20"),
                    (2, 1, 0, "h1", "1"), (2, 1, 1, "h2", "2")]


def test_text_tables(spark):
    pipe = "Intro line.\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\nBye."
    tab = "x\ty\n5\t6"
    comma = "name,qty\napple,3\npear,4"
    prose = "This is prose, with commas, in it.\nAnother sentence, also prose."
    bullets = "- first\n- second\n* third"
    df = spark.createDataFrame([(1, pipe), (2, tab), (3, comma), (4, prose), (5, bullets)], "doc_id long, text string")
    got = {}
    for r in xt.text_tables(df).collect():
        got.setdefault(r["doc_id"], []).append((r["row_idx"], r["header"], r["value"]))
    assert sorted(got[1]) == [(1, "a", "1"), (1, "b", "2"), (2, "a", "3"), (2, "b", "4")]
    assert sorted(got[2]) == [(1, "x", "5"), (1, "y", "6")]
    assert sorted(got[3]) == [(1, "name", "apple"), (1, "qty", "3"), (2, "name", "pear"), (2, "qty", "4")]
    assert 4 not in got and 5 not in got
    items = [r["item"] for r in xt.text_lists(df).orderBy("doc_id", "line_idx").collect()]
    assert items == ["first", "second", "third"]


def test_fenced_json(spark):
    rows = [(1, '```json\n{"columns": ["a"], "rows": [[1]]}\n```'), (2, '{"columns": [], "rows": []}'),
            (3, 'Here it is: {"columns": ["x"], "rows": [[2]]} thanks'), (4, '{"columns": ['),
            (5, '[1, 2, 3]'), (6, '{"rows": []}')]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {r["id"]: r for r in xt.extract_json(df, "text", required=["columns", "rows"]).collect()}
    assert all(out[i]["json_ok"] for i in (1, 2, 3, 5, 6)) and not out[4]["json_ok"]
    assert out[1]["missing_keys"] == "" and out[3]["missing_keys"] == ""
    assert out[6]["missing_keys"] == "columns"


def test_duplicate_rows_nulls_in_different_places(spark):
    """(1, null) and (null, 1) are different rows even though Spark's row hash
    skips nulls; (null, 1) twice is one copy."""
    df = spark.createDataFrame([(1, None), (None, 1), (None, 1), (2, 2)], "a int, b int")
    r = qa.duplicate_rows(df).collect()[0]
    assert (r["n_rows"], r["n_distinct"], r["n_duplicates"]) == (4, 3, 1)
    clean = qa.duplicate_rows(df.distinct()).collect()[0]
    assert (clean["n_rows"], clean["n_distinct"], clean["n_duplicates"]) == (3, 3, 0)
    hot = spark.createDataFrame([(7, "x")] * 50 + [(i, "y") for i in range(50)], "a int, b string")
    h = qa.duplicate_rows(hot).collect()[0]
    assert (h["n_rows"], h["n_distinct"], h["n_duplicates"]) == (100, 51, 49)
    e = qa.duplicate_rows(df.limit(0)).collect()[0]
    assert e["n_rows"] == 0 and e["n_duplicates"] == 0


def test_duplicate_rows_collisions(spark, monkeypatch):
    """Every row given the same fingerprint (a forced collision): the count stays exact."""
    monkeypatch.setattr(qa, "_row_fingerprint", lambda df: [F.lit(1).cast("long").alias("_f1"),
                                                            F.lit(2).cast("long").alias("_f2")])
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (2, None), (3, "c")], "x int, y string")
    r = qa.duplicate_rows(df).collect()[0]
    assert (r["n_rows"], r["n_distinct"], r["n_duplicates"]) == (6, 3, 3)


def test_clean_shared_pass_equals_separate_passes(spark):
    """Null counts of kept rows taken in the fences' pass (NaN counts as
    missing, as in na.drop) give the same cleaned table as counting them in a
    pass of their own."""
    rows = [(1.0, None, "a"), (float("nan"), None, None), (2.0, 5.0, None), (None, 7.0, "b"),
            (100.0, 6.0, "a"), (3.0, None, "a"), (3.0, None, "a"), (4.0, 5.5, None)]
    df = spark.createDataFrame(rows, "x double, y double, s string")
    shared = qa.clean(df)
    bounds = qa.outlier_bounds(df)
    separate = qa.winsorize(qa.fill_missing(qa.drop_sparse_rows(df)), bounds).dropDuplicates()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(shared.collect(), key=key) == sorted(separate.collect(), key=key)
    assert shared.filter("y IS NULL OR s IS NULL").count() == 0
