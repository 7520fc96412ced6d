"""Runs that don't meet, dictionaries without the driver, parallel database reads."""
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tabulon.operators import explore as ex
from tabulon.operators import ml
from tabulon.operators import relational as rel
from tabulon.sources import jdbc

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_threads_with_the_same_names_get_their_own_rows(spark):
    def run(k):
        df = spark.createDataFrame([(k, i) for i in range(20)], "k int, i int")
        out = rel.sql_transform(spark, df, "SELECT max(k) AS k, sum(i) AS s, count(*) AS n FROM data")
        steps = [{"sql_query": "SELECT k, i FROM data WHERE i % 2 = 0"}, {"sql_query": "SELECT k, count(*) AS n FROM data GROUP BY k"}]
        last = ex.explore(spark, df, steps).result.first()
        return tuple(out.first()), tuple(last)

    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(run, range(12)))
    assert got == [((k, 190, 20), (k, 10)) for k in range(12)]


def test_views_of_the_caller_stay_as_they_are(spark):
    spark.createDataFrame([(7,)], "x int").createOrReplaceTempView("data")
    spark.createDataFrame([(8,)], "x int").createOrReplaceTempView("mine")
    before = {t.name for t in spark.catalog.listTables()}
    df = spark.createDataFrame([(1,), (3,), (2,)], "a int")
    cases = {
        "SELECT sum(a) AS s FROM data": [(6,)],
        "SELECT a, x FROM Data JOIN mine ON a < 2": [(1, 8)],
        "WITH t AS (SELECT a FROM input_data WHERE a > 1) SELECT max(a) AS m FROM t": [(3,)],
        "-- first\n/* with */ WITH data AS (SELECT 5 AS a) SELECT a FROM data;": [(5,)],
        "(SELECT a FROM data WHERE a = 1) UNION ALL (SELECT a FROM input_data WHERE a = 2)": [(1,), (2,)],
        "SELECT data.a FROM data ORDER BY data.a DESC LIMIT 2": [(3,), (2,)],
        "WITH t AS (SELECT a FROM data) SELECT a FROM t ORDER BY a": [(1,), (2,), (3,)],
    }
    for sql, want in cases.items():
        assert [tuple(r) for r in rel.sql_transform(spark, df, sql).collect()] == want, sql
    with pytest.raises(Exception, match="nope"):
        rel.sql_transform(spark, df, "SELECT nope FROM data")
    assert {t.name for t in spark.catalog.listTables()} == before and spark.table("data").first().x == 7
    # A result outlives its names.
    out = rel.run_query(spark, {"odd name": df}, "SELECT count(*) AS n FROM `odd name`")
    spark.catalog.dropTempView("data"), spark.catalog.dropTempView("mine")
    assert out.first().n == 3


def brute_index(values):
    order = sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))
    at = {v: float(i) for i, (v, _) in enumerate(order)}
    return [at.get(v, float(len(order))) for v in values]


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_index_of_a_column(spark, monkeypatch, hot):
    monkeypatch.setattr(ml, "HOT_SHARE", hot)
    values = ["b"] * 30 + ["a"] * 30 + [None] * 9 + ["é", "", "zz", "zz", "B"] + [f"v{i % 40}" for i in range(90)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string").repartition(4).withColumn("n", F.lit("mine")).withColumn("idx", F.lit(1))
    got = ml.string_index(df, "v", "code").orderBy("id").collect()
    assert got[0].asDict().keys() == {"id", "v", "n", "idx", "code"}
    assert [r.code for r in got] == brute_index(values)
    plan = ml.string_index(df, "v").select("v_index")._jdf.queryExecution().optimizedPlan().toString()
    assert "StringIndexer" not in plan
    assert ml.string_index(df.limit(0), "v").count() == 0
    assert {r.v_index for r in ml.string_index(df.filter("v IS NULL"), "v").collect()} == {0.0}


def test_one_hot_of_nulls(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "v string")
    got = {r.v: (r.v_index, r.v_vec.size, r.v_vec.toArray().tolist()) for r in ml.one_hot(df, "v").collect()}
    assert got == {"x": (0.0, 2, [1.0, 0.0]), "y": (1.0, 2, [0.0, 1.0]), None: (2.0, 2, [0.0, 0.0])}


def test_jdbc_parts_by_hash_of_a_text_column(spark, scratch):
    cfg = {"url": f"jdbc:derby:{scratch}/db;create=true", "driver": DERBY}
    rows = [(i, "x" * (i % 7) + str(i)) for i in range(100)]
    spark.createDataFrame(rows, "ID int, NAME string").write.format("jdbc").option("url", cfg["url"]).option(
        "dbtable", "T3").option("driver", DERBY).option("createTableColumnTypes", "NAME VARCHAR(40)").save()
    out = jdbc.load_database(spark, "sqlite", cfg | {"query": "SELECT ID, NAME FROM T3", "hash_column": "NAME",
                                                     "hash_expression": "LENGTH({column})", "num_partitions": 4})
    assert out.rdd.getNumPartitions() == 4
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and sorted(map(tuple, out.collect())) == sorted(rows, key=lambda r: r[0])


def test_hash_predicates_hold_once_for_every_row():
    import sqlite3
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (v)")
    values = [None, "", "a", "ab", "é日", 1, -5, 2.5, *[f"row {i}" for i in range(50)]]
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    parts = [con.execute(f"SELECT v FROM t WHERE {p}").fetchall() for p in jdbc.hash_predicates("sqlite", "v", 5)]
    assert Counter(x for p in parts for (x,) in p) == Counter(values) and min(map(len, parts)) > 3
    assert jdbc.hash_predicates("mysql", "c", 2) == ["MOD(CRC32(CAST(c AS CHAR)), 2) = 0 OR c IS NULL", "MOD(CRC32(CAST(c AS CHAR)), 2) = 1"]
    assert "HASHTEXT" in jdbc.hash_predicates("postgresql", "c", 2)[1]
    with pytest.raises(ValueError):
        jdbc.validate("sqlite", {"query": "x", "num_partitions": 0})


def test_groups_beyond_the_bound_are_refused(spark):
    from tabulon.operators import udf
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", i) for i in range(9)], "k string, v int")

    def total(pdf):
        return pdf.groupby("k", as_index=False)["v"].sum()

    with pytest.raises(ValueError, match="50 rows, more than max_group_rows"):
        udf.grouped_function(df, ["k"], total, "k string, v long", max_group_rows=49)
    for kw in ({"max_group_rows": 50}, {"max_group_rows": None}, {"pack_rows": 10},
               {"partial": total, "partial_schema": "k string, v long", "max_group_rows": 1}):
        assert sorted(map(tuple, udf.grouped_function(df, ["k"], total, "k string, v long", **kw).collect())) == [
            ("cold", 36), ("hot", 1225)]
    assert udf.grouped_function(df.limit(0), ["k"], total, "k string, v long").count() == 0
