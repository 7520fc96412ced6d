"""Sources, sinks, guards, the SQL surface, exploration and reports."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tabulon.operators import chartdata as cd
from tabulon.operators import explore as ex
from tabulon.operators import relational as rel
from tabulon.operators import report as rp
from tabulon.operators import udf
from tabulon.sources import jdbc
from tabulon.sources.files import load, parse_first_sheet
from tabulon.sources.guards import SourceError, require_rows


def _xlsx(rows):
    """A minimal workbook: first sheet, inline strings and numbers."""
    def cell(ref, v):
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = "".join(f'<row r="{i + 1}">' + "".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r)) + "</row>"
                    for i, r in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return buf.getvalue()


def test_csv_json_excel(spark, scratch):
    with open(f"{scratch}/t.csv", "w") as f:
        f.write("a,b\n1,x\n2,y\n")
    assert load(spark, "csv", f"{scratch}/t.csv").count() == 2
    with open(f"{scratch}/t.json", "w") as f:
        json.dump([{"a": 1, "b": "x"}, {"a": 2, "b": None}], f)
    j = load(spark, "json", f"{scratch}/t.json")
    assert sorted(r["a"] for r in j.collect()) == [1, 2]
    import os
    os.makedirs(f"{scratch}/books")
    for k in range(2):
        with open(f"{scratch}/books/b{k}.xlsx", "wb") as f:
            f.write(_xlsx([["name", "qty"], [f"n{k}", 3 + k], [f"m{k}", 5]]))
    assert parse_first_sheet(_xlsx([["h"], [1]])) == [["h"], ["1"]]
    x = load(spark, "excel", f"{scratch}/books")
    assert dict(x.dtypes) == {"name": "string", "qty": "double"}
    assert sorted(r["qty"] for r in x.collect()) == [3.0, 4.0, 5.0, 5.0]


def test_source_guards(spark, scratch):
    with pytest.raises(SourceError):
        load(spark, "xml", f"{scratch}/x")
    with pytest.raises(SourceError):
        load(spark, "csv", None)
    with pytest.raises(SourceError):
        load(spark, "csv", f"{scratch}/missing.csv")
    with pytest.raises(SourceError):
        jdbc.validate("mysql", {"query": "select 1", "database": "d"})       # user missing
    with pytest.raises(SourceError):
        jdbc.validate("postgresql", {"database": "d", "user": "u"})          # query missing
    assert jdbc.jdbc_url("mysql", {"database": "d", "user": "u"}) == "jdbc:mysql://localhost:3306/d"
    assert jdbc.jdbc_url("postgresql", {"database": "d", "host": "h"}) == "jdbc:postgresql://h:5432/d"
    assert jdbc.jdbc_url("sqlite", {}) == "jdbc:sqlite::memory:"
    with pytest.raises(ValueError):
        require_rows(spark.createDataFrame([], "a int"))


def test_jdbc_embedded_derby(spark, scratch):
    """The JDBC path end to end against an in-process (embedded) database."""
    url = f"jdbc:derby:{scratch}/db;create=true"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    df.write.format("jdbc").option("url", url).option("dbtable", "T1").option(
        "driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    out = jdbc.load_database(spark, "sqlite", {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver",
                                               "query": 'SELECT "id", "name" FROM T1 WHERE "id" > 1'})
    assert sorted(r["id"] for r in out.collect()) == [2, 3]


def test_jdbc_partitions_without_given_bounds(spark, scratch):
    cfg = {"url": f"jdbc:derby:{scratch}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).withColumnRenamed("id", "ID").write.format("jdbc").option("url", cfg["url"]).option(
        "dbtable", "T2").option("driver", cfg["driver"]).save()
    out = jdbc.load_database(spark, "sqlite", cfg | {"query": "SELECT ID FROM T2", "partition_column": "ID",
                                                     "num_partitions": 4})
    assert out.rdd.getNumPartitions() == 4 and sorted(r.ID for r in out.collect()) == list(range(100))


def test_sql_read_only_guard(spark):
    df = spark.createDataFrame([(1,)], "a int")
    for bad in ["DROP TABLE input_data", "select 1; select 2", "INSERT INTO x VALUES (1)", "  "]:
        with pytest.raises(ValueError):
            rel.sql_transform(spark, df, bad)
    assert rel.sql_transform(spark, df, "WITH t AS (SELECT a FROM input_data) SELECT * FROM t").count() == 1
    with pytest.raises(ValueError):
        rel.sql_transform(spark, df, "SELECT a FROM input_data WHERE a > 5", require_rows=True)


def test_function_transform_fallback(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    with pytest.raises(TypeError):
        udf.function_transform(df, lambda d: 5)
    with pytest.raises(ValueError):
        udf.function_transform(df, None)
    out = udf.function_transform(df, lambda d: d.select(F.col("missing")), fallback=lambda d: d.select("a"))
    assert out.count() == 2
    with pytest.raises(RuntimeError):
        udf.function_transform(df, lambda d: d.select("nope"), fallback=lambda d: d.select("nope2"))


def test_explore_fail_soft_skip_conclude(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "v int, g int")
    plan = [{"sql_query": "SELECT g, sum(v) AS s FROM data GROUP BY g", "explanation": "sum by g"},
            {"sql_query": "SELECT no_such_col FROM data", "explanation": "broken"},
            {"sql_query": "", "explanation": "skip me"},
            {"sql_query": "SELECT g, s FROM data ORDER BY s DESC LIMIT 1", "explanation": "top"},
            {"action": "conclude"},
            {"sql_query": "SELECT 1 AS never FROM data"}]
    e = ex.explore(spark, df, plan, max_iterations=10)
    steps = e.steps
    assert [s["step_number"] for s in steps] == [1, 2, 4]
    assert steps[1]["status"] == "failed" and steps[1]["insight"].startswith("Query failed")
    assert e.result.collect()[0]["g"] == 2
    rep = ex.fallback_report(e.step_log(spark), "goal").collect()[0][0]
    assert "## Goal\ngoal" in rep and "Completed 3 exploration steps." in rep


def test_chart_list_and_placeholders(spark):
    charts = spark.createDataFrame([(1, "", "img1", None), (2, "T2", "", "d2"), (3, "T3", None, "d3")],
                                   cd.CHART_SCHEMA)
    cl = cd.chart_list(charts).collect()
    assert [(r["idx"], r["title"], r["description"]) for r in cl] == [(1, "Chart 1", "")]
    with pytest.raises(ValueError):
        cd.chart_list(charts.filter("idx > 1"))
    rep = spark.createDataFrame([("A {{chart_1}} B {{chart_2}}",)], "report string")
    both = spark.createDataFrame([(1, "One", "p.png", ""), (2, "Two", "", "")], cd.CHART_SCHEMA)
    out = rp.fill_placeholders(rep, both).collect()[0][0]
    assert out == "A \n![One](p.png)\n B \n**Two**\n"
    none = rp.report_markdown(spark.createDataFrame([], cd.CHART_SCHEMA), "g").collect()[0][0]
    assert "No visualizations were generated" in none


def test_chart_data_checks(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "k string, c string, v double")
    with pytest.raises(ValueError):
        cd.chart_data(df, "donut", "k", "v")
    with pytest.raises(ValueError):
        cd.chart_data(df, "bar", "k", "nope")
    area = {(r["k"], r["c"]): (r["y0"], r["y1"]) for r in cd.chart_data(df, "area", "k", "v", "c").collect()}
    assert area[("a", "x")] == (0.0, 1.0) and area[("a", "y")] == (1.0, 3.0)
    pie = {r["k"]: r["share"] for r in cd.chart_data(df, "pie", "k", "v").collect()}
    assert pie["a"] == pytest.approx(0.5)
    assert cd.nice_bins(0.01, 490.02) == (0.0, 500.0, 50.0)


def test_select_spec_and_recommendations(spark):
    df = spark.createDataFrame([(f"c{i % 4}", float(i), float(i * i % 7), f"2024-01-{1 + i % 28:02d}") for i in range(40)],
                               "cat string, a double, b double, d string").withColumn("d", F.to_timestamp("d"))
    recs = cd.chart_checks(cd.recommend_charts(df, "trend over time"))
    rows = recs.collect()
    assert 2 <= len(rows) <= 3 and [r["priority"] for r in rows] == sorted(r["priority"] for r in rows)
    assert rows[0]["chart_type"] == "line" and rows[0]["x_field"] == "d"
    one = cd.select_spec(recs, 1).collect()
    assert len(one) == 1 and one[0]["priority"] == rows[1]["priority"]
    with pytest.raises(ValueError):
        cd.select_spec(recs, 5)


def test_one_hot_and_report_sink(spark, scratch):
    from tabulon.operators import ml
    from tabulon.sources.sinks import write_report
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "s string")
    idx = {r["s"]: r["s_index"] for r in ml.string_index(df, "s").collect()}
    assert idx == {"a": 0.0, "b": 1.0}
    assert "s_vec" in ml.one_hot(df, "s").columns
    rep = spark.createDataFrame([("# Title\n\nbody\n",)], "report string")
    path = write_report(rep, f"{scratch}/report")
    text = spark.read.text(path, wholetext=True).collect()[0][0]
    assert text.startswith("# Title")


def test_packed_grouped_function_bucket_count(spark):
    """Packed groups: as many buckets as the row count asks for, never fewer
    than four per shuffle partition; the result is the per-key one."""
    import pandas as pd
    from tabulon.operators import udf
    df = spark.range(3000).select((F.col("id") % 300).alias("k"), F.col("id").cast("double").alias("v"))

    def per_key(pdf):
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n": [len(pdf)], "s": [float(pdf["v"].sum())]})

    out = udf.grouped_function(df, ["k"], per_key, "k long, n long, s double", pack_rows=100)
    rows = out.collect()
    assert len(rows) == 300 and {r["n"] for r in rows} == {10}
    assert sum(r["s"] for r in rows) == float(sum(range(3000)))
    assert udf.pack_bucket_count(df, 100) == 32      # 30 by rows, at least 4 × 8 partitions
    assert udf.pack_bucket_count(df, 10) == 300      # by rows


def test_packed_function_is_called_per_frame(spark):
    """Orders of a packed frame are computed together: as many calls as buckets, not as keys;
    null prices, an order without net value and a null key as pandas has them per order."""
    import pandas as pd
    from tabulon.operators import udf
    from tabulon.plans.q_udf import per_order
    rows = [(k, float(v), 0.1 * (v % 3)) for k in range(2000) for v in range(k % 4 + 1)]
    rows += [(5000, None, 0.1), (5001, 0.0, 0.0), (5002, 8.0, None), (5002, 4.0, 0.5), (None, 3.0, 0.0), (None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_extendedprice double, l_discount double").repartition(5)
    calls = spark.sparkContext.accumulator(0)

    def counted(pdf):
        calls.add(1)
        return per_order(pdf)

    got = udf.grouped_function(df, ["l_orderkey"], counted, "l_orderkey long, n_lines long, order_net double, "
                               "max_line_share double", pack_rows=1000, many_groups=True).collect()
    assert calls.value <= 32
    pdf, want = pd.DataFrame(rows, columns=["k", "p", "d"]), {}
    for k, g in pdf.groupby("k", dropna=False):
        net = g["p"] * (1 - g["d"])
        want[None if pd.isna(k) else k] = (len(g), net.sum(), net.max() / net.sum() if net.sum() else None)
    assert len(got) == len(want)
    for r in got:
        n, total, share = want[r.l_orderkey]
        assert r.n_lines == n and r.order_net == pytest.approx(total)
        assert r.max_line_share == (None if share is None else pytest.approx(share))
    with pytest.raises(ValueError, match="many_groups"):
        udf.grouped_function(df, ["l_orderkey"], counted, "l_orderkey long", many_groups=True)


def test_csv_headers_are_found_without_sorting_the_lines(spark, scratch):
    """The pass over the lines keeps numbers only, so Spark does not sort them by file."""
    from tabulon.sources import files
    for i, head in enumerate(("a,b", "b,a", "a,b")):
        with open(f"{scratch}/{i}.csv", "w") as f:
            f.write("\n \n" * (i == 2) + head + "\n" + "".join(f"{j},{j}\n" for j in range(50)))
    heads, odd = files._headers(spark, scratch)
    assert [h for h, _ in heads] == [["a", "b"], ["b", "a"]] and not odd
    assert [len(f) for _, f in heads] == [2, 1]
    plan = files._file_heads(spark, scratch)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_quick_analysis_shapes(spark):
    """F1 on a clean table (describe reused from the quality pass), on a table
    that needs cleaning, and on a table without numbers (describe refuses)."""
    from tabulon.operators import stats as st
    from tabulon.plans.flows import quick_analysis
    clean = spark.createDataFrame([(i, float(i % 7), "abc"[i % 3]) for i in range(40)], "a long, b double, c string")
    qa_ = quick_analysis(clean)
    assert qa_.cleaned is clean
    got = {r["column_name"]: r for r in qa_.describe.collect()}
    want = {r["column_name"]: r for r in st.describe(clean, ["a", "b"]).collect()}
    assert got == want
    assert qa_.rows_removed.first()["rows_removed"] == 0
    dirty = clean.union(clean.limit(5)).union(spark.createDataFrame([(None, None, None), (99, 1e6, "a")], clean.schema))
    qd = quick_analysis(dirty)
    assert qd.cleaned is not dirty
    assert qd.rows_removed.first()["rows_removed"] == 6          # five copies and one all-null row
    assert qd.describe.filter("column_name = 'b'").first()["max"] < 1e6   # clipped
    with pytest.raises(ValueError):
        quick_analysis(spark.createDataFrame([("x",), ("y",)], "c string"))


def test_segment_vs_overall_from_partial_sums(spark):
    """Partial sums with their value counts give the same segment and overall
    means as the raw rows (nulls are not counted)."""
    rows = [("a", 1.0, 1), ("a", 3.0, 1), ("a", None, 2), ("b", 10.0, 2), ("b", 20.0, 3), ("c", 5.0, 3)]
    raw = spark.createDataFrame(rows, "seg string, v double, k int")
    part = raw.groupBy("seg", "k").agg(F.sum("v").alias("v"), F.count("v").alias("n"))
    want = {r["seg"]: r for r in rel.segment_vs_overall(raw, "seg", "v").collect()}
    got = {r["seg"]: r for r in rel.segment_vs_overall(part, "seg", "v", count_col="n").collect()}
    assert set(got) == set(want)
    for k in want:
        for c in ("segment_avg", "overall_avg", "diff"):
            assert got[k][c] == pytest.approx(want[k][c])
