"""Pages, texts and JSON as they come: missing end tags, nested tables, quoted cells,
values inside prose; CSV folders with other column orders and bad records."""
import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.operators import extract as X
from tabulon.sources.files import load
from tabulon.sources.guards import SourceError


def table(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = X.html_tables(df).orderBy("row_idx", "col_idx").collect()
    return [(r.row_idx, r.col_idx, r.header, r.value) for r in rows]


HEAD = "<table><tr><th>x</th><th>y</th></tr>"
WANT = [(1, 0, "x", "a"), (1, 1, "y", "b"), (2, 0, "x", "c"), (2, 1, "y", "d")]


@pytest.mark.parametrize("html", [
    HEAD + "<tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>",
    "<table><tr><th>x<th>y<tr><td>a<td>b<tr><td>c<td>d</table>",
    "<TABLE class='q>r'><THEAD><TR><TH>x<TH>y<TBODY><TR><TD title=\"</td>\">a<TD>b</TR><TR><TD>c<TD>d</TBODY></TABLE>",
    "<p>" + HEAD + "<tr><td>a<td>b<tr><td>c<td>d",
    HEAD + "<!-- <tr><td>no</td></tr> --><tr><td>a<script>'<td>no'</script></td><td><b>b</b></td></tr><tr><td>c<td>d</table></table></td>",
    "<td>stray</td></tr><caption>n</caption>" + HEAD + "<caption>n</caption><tr></tr><td>a<td>b<tr><td> c\n<td>&#100;</table>"
    .replace("<tr></tr>", "").replace("&#100;", "d"),
])
def test_tables_without_end_tags(spark, html):
    assert table(spark, html) == WANT


def test_a_table_inside_a_cell_is_its_own(spark):
    inner = "<table><tr><td>i<td>j</table>"
    html = HEAD + f"<tr><td>a{inner}<td>b<tr><td>c<td>{inner}d</table>"
    assert table(spark, html) == WANT
    # The larger one is kept, wherever it stands; the first of equal ones.
    big = "<table>" + "".join(f"<tr><td>{i}<td>{i + 1}" for i in range(4)) + "</table>"
    assert table(spark, f"<table><tr><td>out{big}<td>z<tr><td>q</table>")[0] == (1, 0, "0", "1")
    assert table(spark, "<table><tr><td>h<tr><td>one</table><table><tr><td>g<tr><td>two</table>") == [(1, 0, "h", "one")]


def test_tables_plan_is_one_scan_without_shuffle(spark):
    df = spark.createDataFrame([(1, HEAD), (2, None), (3, "no"), (4, "<table></table>")], "page_id long, html string")
    out = X.html_tables(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and out.count() == 0


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "x", "<", ">", "<!--", "-->", '"',
                                 "<td a='", "<script>", "</script>", "<tbody>"]), max_size=25))
def test_any_tag_soup_is_read(parts):
    for t in X._page_tables("".join(parts)):
        for row in t:
            assert len(row["th"]) == len(row["cells"])


def text_rows(spark, text):
    rows = X.text_tables(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("row_idx", "col_idx").collect()
    return [(r.row_idx, r.header, r.value) for r in rows]


def test_quoted_cells_of_text_tables(spark):
    assert text_rows(spark, 'name,n\n"a, b",1\n"c ""d""",2') == [(1, "name", "a, b"), (1, "n", "1"), (2, "name", 'c "d"'), (2, "n", "2")]
    assert text_rows(spark, '"x|y",k\n"1,5","2|3"') == [(1, "x|y", "1,5"), (1, "k", "2|3")]
    assert text_rows(spark, 'h\t"i\tj"\n"a\tb"\tc') == [(1, "h", "a\tb".replace("\t", " ")), (1, "i\tj", "c")]
    assert text_rows(spark, '| a | "b | c" |\n|---|---|\n| 1 | "2" |') == [(1, "a", "1"), (1, "b | c", "2")]
    # An open quote and one inside a cell are plain text.
    assert text_rows(spark, 'a,b\n"x,y\n5" pipe,z') == [(1, "a", '"x'), (1, "b", "y"), (2, "a", '5" pipe'), (2, "b", "z")]


def test_long_quoted_cell(spark):
    long = "v, " * 20000
    assert text_rows(spark, f'a,b\n"{long}",2')[0] == (1, "a", long.strip())


def jsons(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return X.extract_json(df, "text", **kw).orderBy("id").collect()


def test_first_json_value(spark):
    cases = {
        'first {"a": 1} then {"b": 2}': '{"a": 1}',
        '{"a": {"b": [1, "}"]}} tail': '{"a": {"b": [1, "}"]}}',
        '```json\n{"a": 1}\n```': '{"a": 1}',
        '[note] {"a": 1}': '{"a": 1}',
        '{x} and [1, 2] or {"a": 3}': "[1, 2]",
        'He said "see" {"q": "a \\" { b"} ok': '{"q": "a \\" { b"}',
        ' 42 ': "42", '"a \\" b"': '"a \\" b"', "null": "null",
    }
    for r, (text, want) in zip(jsons(spark, list(cases)), cases.items(), strict=True):
        assert r.json_ok and r.json_text == want, text
    bad = ['{"a": 1', "12 apples", "", None, "[1, 2}", "true or false", "} {", '{"a": [1, 2}']
    assert not any(r.json_ok or r.parsed is not None for r in jsons(spark, bad))


def test_required_keys_of_the_first_value(spark):
    got = jsons(spark, ['x {"a": 1} {"b": 2}', '{"a": null, "b": 1}', "none"], required=["a", "b"])
    assert [r.missing_keys for r in got] == ["b", "", None]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.recursive(st.one_of(st.integers(-5, 5), st.text('a"{}[]\\ ', max_size=6), st.booleans(), st.none()),
                    lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text('k"{', max_size=3), x, max_size=3)), max_leaves=8),
       st.text('ab ".,', max_size=8), st.text('ab "{}[].,', max_size=8))
def test_first_value_of_any_prose(spark, value, before, after):
    value = value if isinstance(value, (list, dict)) else [value]
    [r] = jsons(spark, [before + json.dumps(value) + after])
    assert r.json_ok and json.loads(r.json_text) == value


def test_lists_have_items(spark):
    df = spark.createDataFrame([(1, "Buy:\n- milk\n * two  eggs \n3. tea\n4) jam\nno item\n-x")], "doc_id long, text string")
    assert [(r.line_idx, r.item) for r in X.text_lists(df).orderBy("line_idx").collect()] == [
        (1, "milk"), (2, "two  eggs"), (3, "tea"), (4, "jam")]


def folder(scratch, name, files):
    os.makedirs(f"{scratch}/{name}")
    for f, text in files.items():
        with open(f"{scratch}/{name}/{f}", "w", newline="") as out:
            out.write(text)
    return f"{scratch}/{name}"


def test_csv_files_with_other_column_orders(spark, scratch):
    path = folder(scratch, "in", {"1.csv": "a,b\n1,x\n2,y\n", "2.csv": "b,a\nz,3\n", "3 [new].csv": '\n"b",a\n"w,w",4\n', "4.csv": "b,a\n"})
    df = load(spark, "csv", path)
    assert df.dtypes == [("a", "int"), ("b", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, "y"), (3, "z"), (4, "w,w")]
    assert sorted(map(tuple, load(spark, "csv", path, infer_schema=False).collect()))[0] == ("1", "x")
    with pytest.raises(SourceError, match="differ in their columns"):
        load(spark, "csv", folder(scratch, "odd", {"1.csv": "a,b\n1,x\n", "2.csv": "a,c\n1,x\n"}))


@pytest.mark.parametrize("infer", [True, False])
def test_csv_records_with_too_many_fields(spark, scratch, infer):
    path = folder(scratch, "in", {"1.csv": "a,b\n1,2\n3,4,5\n6\n", "2.csv": "b,a\n7,8\n9,10,\n"})
    with pytest.raises(SourceError, match="2 CSV records have more than 2 fields"):
        load(spark, "csv", path, infer_schema=infer)
    got = load(spark, "csv", path, infer_schema=infer, reject_column="rejected")
    rows = sorted((str(r.a), str(r.b), str(r.rejected)) for r in got.collect())
    assert rows == sorted([("1", "2", "None"), ("6", "None", "None"), ("8", "7", "None"), ("None", "None", "3,4,5"), ("None", "None", "9,10,")])


def test_csv_too_many_fields_in_quoted_lines(spark, scratch):
    path = folder(scratch, "in", {"1.csv": 'a,b\n"x\ny",1\n"p\nq",2,3\n'})
    with pytest.raises(SourceError, match="1 CSV records"):
        load(spark, "csv", path)
    assert load(spark, "csv", path, reject_column="r").filter(F.col("r").isNull()).collect()[0].a == "x\ny"


def test_csv_repeated_and_empty_names(spark, scratch):
    path = folder(scratch, "in", {"1.csv": "a,A,,a\n1,2,3,4\n"})
    assert load(spark, "csv", path).columns == ["a", "A.1", "_c2", "a.2"]
    path = folder(scratch, "wide", {"1.csv": '"two\nlines",b\n1,2\n'})
    assert load(spark, "csv", path).columns == ["two\nlines", "b"]
