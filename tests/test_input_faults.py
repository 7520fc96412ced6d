"""Inputs as people have them: quoting, null spellings, late parts, writes hidden in SQL."""
import os

import pytest

from tabulon.operators import extract as xt
from tabulon.operators import relational as rel
from tabulon.sources.files import load


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_quotes_breaks_and_null_spellings(spark, scratch):
    path = _write(f"{scratch}/a.csv", 'id,note,n,when\n1,"x ""q"", y",2,2024-01-05\n2,"two\nlines",NA,N/A\n3,,null,2024-02-01\n')
    df = load(spark, "csv", path)
    assert dict(df.dtypes) == {"id": "int", "note": "string", "n": "int", "when": "date"}
    assert [(r.id, r.note, r.n) for r in df.orderBy("id").collect()] == [
        (1, 'x "q", y', 2), (2, "two\nlines", None), (3, None, None)]


def test_csv_types_and_schema(spark, scratch):
    path = _write(f"{scratch}/b.csv", "a,b,c,d\n 1 ,true,1.5,x\n3000000000,false,NaN,\n")
    assert [t for _, t in load(spark, "csv", path).dtypes] == ["bigint", "boolean", "double", "string"]
    assert load(spark, "csv", path, schema="a long, b string, c double, d string").collect()[0].a == 1


def test_json_lines_and_array(spark, scratch):
    lines = _write(f"{scratch}/l.json", '{"a": 1}\n{"a": 2}\n\n{"a": 3}\n')
    assert sorted(r.a for r in load(spark, "json", lines).collect()) == [1, 2, 3]
    array = _write(f"{scratch}/a.json", '[\n {"a": 1},\n {"a": 2}\n]\n')
    assert sorted(r.a for r in load(spark, "json", array).collect()) == [1, 2]


def test_empty_table_raises(spark, scratch):
    with pytest.raises(ValueError):
        load(spark, "csv", _write(f"{scratch}/e.csv", "a,b\n"))


def test_writes_hidden_in_queries_are_refused(spark, scratch):
    df = spark.createDataFrame([(1,)], "a int")
    out = f"{scratch}/out"
    for bad in (f"FROM data INSERT OVERWRITE DIRECTORY '{out}' USING csv SELECT *",
                f"WITH t AS (SELECT 1) INSERT OVERWRITE DIRECTORY '{out}' USING csv SELECT * FROM t",
                "SELECT 1; SELECT 2", "DROP TABLE x", "SELECT 1) UNION (SELECT 2", ""):
        with pytest.raises(ValueError):
            rel.sql_transform(spark, df, bad)
    assert not os.path.exists(out)
    assert rel.sql_transform(spark, df, "SELECT ';' AS s, a FROM data -- note").collect()[0].s == ";"


def test_views_of_the_caller_stay(spark):
    spark.createDataFrame([(7,)], "mine int").createOrReplaceTempView("data")
    out = rel.sql_transform(spark, spark.createDataFrame([(1,)], "a int"), "SELECT a FROM data")
    other = rel.sql_transform(spark, spark.createDataFrame([(2,)], "a int"), "SELECT a FROM data")
    assert (out.collect()[0].a, other.collect()[0].a) == (1, 2)
    assert spark.table("data").collect()[0].mine == 7
    spark.catalog.dropTempView("data")


def test_links_in_any_quotes(spark):
    html = "<a href=\"/a\">A</a> <a class=x href='/b?x=1'>B</a><a href=/c>C <b>d</b></a>"
    got = xt.html_links(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("link_idx").collect()
    assert [(r.href, r.text) for r in got] == [("/a", "A"), ("/b?x=1", "B"), ("/c", "C d")]


def test_json_after_a_bracketed_note(spark):
    df = spark.createDataFrame([(1, 'Result [see note]: {"a": 1}'), (2, "```json\n[1, 2]\n```"), (3, "none {x")],
                               "id int, t string")
    got = {r.id: (r.json_ok, r.json_text) for r in xt.extract_json(df, "t").orderBy("id").collect()}
    assert got[1] == (True, '{"a": 1}') and got[2] == (True, "[1, 2]") and not got[3][0]


def test_long_cells_and_full_stops_are_tables(spark):
    long = "name,note\nx," + "w " * 40 + "\ny," + "v " * 40
    stops = "a,b\n1,2.\n3,4."
    df = spark.createDataFrame([(1, long), (2, stops)], "doc_id int, text string")
    rows = xt.text_tables(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {1: 4, 2: 4}


def test_value_with_a_comma_is_one_value(spark):
    from tabulon.operators import profile as pr
    df = spark.createDataFrame([("a, b",), ("c",)], "s string")
    line = pr.field_lines(pr.field_stats(df, as_list=True)).collect()[0].line
    assert "[2 unique values]" in line and line.endswith("Values: a, b, c")
    many = spark.createDataFrame([(f"v{i}, x",) for i in range(6)], "s string")
    line = pr.field_lines(pr.field_stats(many, as_list=True)).collect()[0].line
    assert line.endswith("Sample values: v0, x, v1, x, v2, x, v3, x, v4, x, ...")


def test_given_schema_overrides_statistics(spark):
    from tabulon.operators import profile as pr
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "v double, s string")
    given = spark.createDataFrame([("v", "ordinal", 99, None, None, 7.5)],
                                  "column_name string, semantic_type string, unique_count long, stat_min double, "
                                  "stat_max double, stat_mean double")
    got = {r.column_name: r for r in pr.field_stats(df, given).collect()}
    assert (got["v"].semantic_type, got["v"].unique_count, got["v"].stat_mean, got["v"].stat_min) == ("ordinal", 99, 7.5, 1.0)
    assert got["s"].unique_count == 2


def test_nan_is_missing(spark):
    from tabulon.operators import profile as pr
    from tabulon.operators import quality as qa
    from tabulon.operators import stats as st
    nan = float("nan")
    df = spark.createDataFrame([(1.0,), (2.0,), (nan,), (4.0,)], "v double")
    assert qa.missing_values(df).collect()[0].n_missing == 1
    row = pr.column_stats(df).collect()[0]
    assert (row.n_null, row.max_value, row.mean_value) == (1, 4.0, pytest.approx(7 / 3))
    d = st.describe(df).collect()[0]
    assert d["count"] == 3 and d["max"] == 4.0
    assert sorted(r.v for r in qa.clean(df).collect()) == [1.0, 2.0, 4.0]


def test_empty_tables_raise(spark):
    from tabulon.operators import quality as qa
    from tabulon.plans.flows import quick_analysis
    empty = spark.createDataFrame([], "a double, s string")
    for call in (qa.quality_report, qa.clean, quick_analysis):
        with pytest.raises(ValueError):
            call(empty)


def test_one_row_groups_have_no_effect_size(spark):
    from tabulon.operators import stats as st
    one = st.t_test(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double"), "v", "g").collect()[0]
    assert one.cohens_d is None and one.t_statistic is None
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert st.t_test(same, "v", "g").collect()[0].cohens_d == 0.0


def test_shapiro_wilk_published_example(spark):
    """Weights of eleven men (Shapiro and Wilk, 1965): W = 0.79."""
    from tabulon.operators import stats as st
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    r = st.shapiro_wilk(spark.createDataFrame([(float(x),) for x in men], "w double")).collect()[0]
    assert r.statistic == pytest.approx(0.789, abs=0.002) and r.p_value == pytest.approx(0.0067, abs=0.0005)
    assert r.is_normal is False
    big = st.shapiro_wilk(spark.range(6000).selectExpr("cast(id as double) v")).collect()[0]
    assert big.p_value is None and big.is_normal is None and 0.9 < big.statistic < 1


def test_findings_do_not_depend_on_partitions(spark):
    from tabulon.operators.explore import step_finding
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "k int, v double")
    assert len({step_finding(df.repartition(n)) for n in (1, 3, 7)}) == 1
    assert "k = 49" in step_finding(df.orderBy("k", ascending=False))


def test_other_masters_need_a_shared_folder():
    from tabulon.session import is_local
    assert is_local("local") and is_local("local[4]") and is_local("local[*]")
    assert not is_local("local-cluster[2,1,1024]") and not is_local("yarn") and not is_local("spark://h:7077")


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from tabulon import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
