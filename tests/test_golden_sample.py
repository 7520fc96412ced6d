"""The one printed result of the reference: total sales by region of the
12-row sample (compared as a set; the printed order is not a sort order)."""

from pyspark.sql import functions as F

from tabulon.operators import relational as rel
from tabulon.operators import profile as pr
from tabulon.sources.files import load

# The survey's sample table and its totals.
SAMPLE = """region,product,sales,year
North,Product A,12500,2023
North,Product B,8900,2023
North,Product C,15600,2023
South,Product A,9800,2023
South,Product B,11200,2023
South,Product C,13400,2023
East,Product A,14700,2023
East,Product B,10500,2023
East,Product C,16800,2023
West,Product A,11300,2023
West,Product B,9600,2023
West,Product C,14200,2023
"""


def _sample(spark, scratch):
    p = f"{scratch}/sample_sales.csv"
    with open(p, "w") as f:
        f.write(SAMPLE)
    return load(spark, "csv", p)


def test_group_sum_golden(spark, scratch):
    df = _sample(spark, scratch)
    out = rel.sql_transform(spark, df, "SELECT region, SUM(sales) AS total_sales FROM input_data "
                                       "GROUP BY region ORDER BY total_sales DESC")
    got = {r["region"]: r["total_sales"] for r in out.collect()}
    assert got == {"East": 42000, "North": 37000, "South": 34400, "West": 35100}


def test_sample_profile(spark, scratch):
    df = _sample(spark, scratch)
    prof = {r["column_name"]: r for r in pr.profile(df).collect()}
    assert prof["region"]["semantic_type"] == "nominal" and prof["region"]["n_unique"] == 4
    assert prof["product"]["n_unique"] == 3
    assert prof["sales"]["semantic_type"] == "quantitative"
    assert prof["sales"]["min_value"] == 8900 and prof["sales"]["max_value"] == 16800
    assert prof["region"]["samples"] == "East, North, South"
    ft = {r["column_name"]: r["field_type"] for r in pr.field_types(df).collect()}
    assert ft["year"] == "ordinal"          # 1 distinct < 20 and < 6
    assert ft["sales"] == "quantitative"    # 12 distinct, not < 6
    assert ft["region"] == "nominal"
