"""Extraction queries (E1–E6) on pages, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import extract as xt
from tabulon.plans.registry import query
from tabulon.sources.tables import read_table as T

_DECODE = ("replace(replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), "
           "'&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')")


def _clean(x):
    return f"trim(regexp_replace({_DECODE.format(x=f'regexp_replace({x}, ' + repr('<[^>]*>') + ', ' + repr('') + ', ' + repr('g') + ')')}, '\\s+', ' ', 'g'))"


@query("html_links", r"""
WITH z AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>') AS links FROM pages),
e AS (SELECT page_id, unnest(links) AS link, unnest(range(len(links))) AS i FROM z),
h AS (SELECT page_id, i, link, regexp_extract(link, '(?is)^<a\s[^>]*>') AS tag FROM e),
v AS (SELECT page_id, i, link, tag,
             regexp_extract(tag, '(?is)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1) AS raw FROM h),
n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS link_idx,
             trim(raw, chr(34) || chr(39)) AS href, substr(link, len(tag) + 1, len(link) - len(tag) - 4) AS body
      FROM v WHERE raw <> '')
SELECT page_id, CAST(link_idx AS INTEGER) AS link_idx, """ + _DECODE.format(x="href") + " AS href, "
       + _clean("body") + " AS text FROM n")
def html_links(spark, d):
    return xt.html_links(T(spark, d, "pages"))


@query("html_list_items", f"""
WITH z AS (SELECT page_id, regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS it FROM pages),
e AS (SELECT page_id, it, unnest(range(len(it))) AS i FROM z)
SELECT page_id, CAST(i AS INTEGER) AS item_idx, {_clean('it[i + 1]')} AS text FROM e""")
def html_list_items(spark, d):
    return xt.html_list_items(T(spark, d, "pages"))


@query("html_tables")
def html_tables(spark, d):
    """E1 over every page (the test pages hold no <table>; tests use a fixture)."""
    return xt.html_tables(T(spark, d, "pages"))


def _row(shape, first, second):
    """A table row in one of three shapes: all end tags, none, a table inside a cell."""
    return (F.when(shape == 0, F.concat(F.lit("<tr class='r'><td>"), first, F.lit("</td>\n<TD>"), second, F.lit(" </TD></tr>")))
            .when(shape == 1, F.concat(F.lit("<tr><td>"), first, F.lit("<td title='>'>"), second))
            .otherwise(F.concat(F.lit("<tr><td>"), first, F.lit("<td>"), second,
                                F.lit("<table><tr><td>in<td>side</table></td></tr>"))))


def _lines(spark, d, text):
    """``text`` of each line item, in order, as one array per order (an order's lines are few)."""
    return (T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"))
            .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", text.alias("t")))).alias("x"))
            .select("doc_id", F.transform("x", lambda s: s["t"]).alias("lines")))


_LINES_SQL = """
WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_quantity,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)::INTEGER AS i
           FROM lineitem)"""


@query("html_tables_orders", f"""{_LINES_SQL}
SELECT doc_id AS page_id, i AS row_idx, c.col_idx::INTEGER AS col_idx, c.header,
       CASE c.col_idx WHEN 0 THEN l_linenumber::VARCHAR ELSE 'part ' || l_partkey END AS value
FROM r, (VALUES (0, 'line'), (1, 'part')) c(col_idx, header)""")
def html_tables_orders(spark, d):
    """E1 on a page for every order: rows with all end tags, with none, or with a table inside."""
    row = _row(F.col("l_orderkey") % 3, F.col("l_linenumber").cast("string"),
               F.concat(F.lit("<i>part</i> "), F.col("l_partkey").cast("string")))
    head = "<!-- <table><tr><td>no --><p>Order<table width=9><tr><th>line<th>part"
    pages = _lines(spark, d, row).select(F.col("doc_id").alias("page_id"), F.concat(
        F.lit(head), F.array_join("lines", "\n"), F.lit("</table><p>end")).alias("html"))
    return xt.html_tables(pages)


@query("html_tables_built", """
SELECT n_regionkey AS page_id, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INTEGER AS row_idx,
       c.col_idx::INTEGER AS col_idx, c.header, CASE c.col_idx WHEN 0 THEN n_nationkey::VARCHAR ELSE n_name END AS value
FROM nation, (VALUES (0, 'key'), (1, 'name & more')) c(col_idx, header)""")
def html_tables_built(spark, d):
    """E1 on pages built from ``nation``: a small table first, then one with a header row;
    by region with all end tags, without any, and with a table inside the cells."""
    key, name = F.col("n_nationkey").cast("string"), F.concat(F.lit("<b>"), "n_name", F.lit("</b>"))
    shape = F.col("n_regionkey") % 3
    cells = _row(shape, key, name)
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("t")))),
                                    lambda s: s["t"]), "\n")
    head = "<table><tr><td>x</td></tr></table>\n<TABLE border=1><tr><th>key</th><th>name &amp; more</th></tr>"
    pages = (T(spark, d, "nation").groupBy(F.col("n_regionkey").alias("page_id"))
             .agg(F.concat(F.lit(head), rows, F.lit("</TABLE>")).alias("html")))
    return xt.html_tables(pages)


_TEXT_TABLES_SQL = r"""
WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i AS line_idx, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM l0)),
dl AS (SELECT *, CASE WHEN contains(outside, '|') THEN '|' WHEN contains(outside, chr(9)) THEN 'tab'
                      WHEN contains(outside, ',') THEN ',' END AS delim
       FROM (SELECT *, regexp_replace(line, '"[^"]*"', '', 'g') AS outside FROM l)),
fr AS (SELECT *, CASE WHEN delim = '|' THEN regexp_replace(regexp_replace(trim(line), '^\|', ''), '\|$', '') ELSE line END AS body
       FROM dl WHERE delim IS NOT NULL),
sp AS (SELECT doc_id, line_idx, delim, CASE
         WHEN NOT contains(line, '"') THEN string_split(body, CASE delim WHEN 'tab' THEN chr(9) ELSE delim END)
         WHEN delim = '|' THEN regexp_extract_all(body || '|', '( *"[^"]*(?:""[^"]*)*" *|[^|]*)[|]', 1)
         WHEN delim = ',' THEN regexp_extract_all(body || ',', '( *"[^"]*(?:""[^"]*)*" *|[^,]*)[,]', 1)
         ELSE regexp_extract_all(body || chr(9), '( *"[^"]*(?:""[^"]*)*" *|[^\t]*)[\t]', 1) END AS raw FROM fr),
c AS (SELECT doc_id, line_idx, delim, list_transform(raw, lambda x: trim(
        CASE WHEN len(trim(x)) > 1 AND starts_with(trim(x), '"') AND ends_with(trim(x), '"')
             THEN replace(substr(trim(x), 2, len(trim(x)) - 2), '""', '"') ELSE x END)) AS cells FROM sp),
d AS (SELECT *, len(cells) AS n_cells,
             list_bool_and(list_transform(cells, lambda x: regexp_full_match(x, ':?-{2,}:?') OR x = '')) AS is_rule
      FROM c WHERE len(cells) >= 2),
r AS (SELECT *, line_idx - row_number() OVER (PARTITION BY doc_id, delim, n_cells ORDER BY line_idx) AS run FROM d),
runs AS (SELECT doc_id, delim, n_cells, run, count(*) AS n_lines, min(line_idx) AS first_line FROM r GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_lines DESC, first_line) AS rk
                        FROM runs WHERE n_lines >= 2) WHERE rk = 1),
tot AS (SELECT doc_id, count(*) AS n_delimited FROM d GROUP BY doc_id),
t AS (SELECT r.doc_id, r.line_idx, r.cells, CAST(b.n_lines AS DOUBLE) / tot.n_delimited AS confidence
      FROM r JOIN best b USING (doc_id, delim, n_cells, run) JOIN tot USING (doc_id) WHERE NOT r.is_rule),
t2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS row_idx FROM t),
h AS (SELECT doc_id, cells AS hdr FROM t2 WHERE row_idx = 0),
body AS (SELECT t2.doc_id, row_idx, confidence, cells, hdr, unnest(range(len(cells))) AS j FROM t2 JOIN h USING (doc_id) WHERE row_idx > 0)
SELECT doc_id, CAST(row_idx AS INTEGER) AS row_idx, CAST(j AS INTEGER) AS col_idx,
       coalesce(nullif(hdr[j + 1], ''), 'column_' || CAST(j AS VARCHAR)) AS header,
       regexp_replace(cells[j + 1], '\s+', ' ', 'g') AS value, coalesce(confidence, 0.8) AS confidence FROM body"""


@query("text_tables", _TEXT_TABLES_SQL)
def text_tables(spark, d):
    return xt.text_tables(T(spark, d, "documents"))


@query("text_tables_quoted", f"""{_LINES_SQL}
SELECT doc_id, i AS row_idx, c.col_idx::INTEGER AS col_idx, c.header,
       CASE c.col_idx WHEN 0 THEN l_linenumber::VARCHAR ELSE l_partkey || ', "' || l_quantity::BIGINT || '"' END AS value,
       1.0::DOUBLE AS confidence
FROM r, (VALUES (0, 'line'), (1, 'part, "qty"')) c(col_idx, header)""")
def text_tables_quoted(spark, d):
    """E3 on a text for every order, with delimiters and quotes inside quoted cells."""
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(',"'), F.col("l_partkey").cast("string"), F.lit(', ""'),
                    F.col("l_quantity").cast("long").cast("string"), F.lit('"""'))
    docs = _lines(spark, d, line).select("doc_id", F.concat(
        F.lit('Your order\nline,"part, ""qty"""\n'), F.array_join("lines", "\n"), F.lit("\nThanks")).alias("text"))
    return xt.text_tables(docs)


@query("text_lists_orders", f"""{_LINES_SQL}
SELECT doc_id, i AS line_idx, 'part ' || l_partkey || ', ' || l_quantity::BIGINT || ' pieces' AS item FROM r""")
def text_lists_orders(spark, d):
    """E3 on a list for every order, in four kinds of bullets."""
    mark = F.element_at(F.array(F.lit("- "), F.lit("  * "), F.lit("\u2022\t"), F.concat(F.col("l_linenumber").cast("string"), F.lit(") "))),
                        (F.col("l_linenumber") % 4 + 1).cast("int"))
    line = F.concat(mark, F.lit("part "), F.col("l_partkey").cast("string"), F.lit(", "),
                    F.col("l_quantity").cast("long").cast("string"), F.lit(" pieces "))
    docs = _lines(spark, d, line).select("doc_id", F.concat(
        F.lit("The order holds\n"), F.array_join("lines", "\n"), F.lit("\n-no item")).alias("text"))
    return xt.text_lists(docs)


_LIST_RE = r"^\s*(?:[-*•]|\d+[.)])\s+(.+?)\s*$"


@query("text_lists", f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS line_idx, regexp_extract(ls[i + 1], '{_LIST_RE}', 1) AS item
FROM e WHERE regexp_matches(ls[i + 1], '{_LIST_RE}')""")
def text_lists(spark, d):
    return xt.text_lists(T(spark, d, "documents"))


@query("extract_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_valid(props) AS json_ok,
       CASE WHEN json_valid(props) THEN '' END AS missing_keys FROM events""")
def extract_json(spark, d):
    ev = xt.extract_json(T(spark, d, "events"), "props", required=["k"])
    return ev.select("event_id", F.try_variant_get("parsed", "$.k", "int").alias("k"), "json_ok", "missing_keys")


@query("extract_json_prose", """
WITH t AS (SELECT event_id, props, event_id % 4 AS shape FROM events WHERE json_valid(props))
SELECT event_id, shape <> 3 AS json_ok, CASE shape WHEN 3 THEN left(props, len(props) - 1) ELSE props END AS json_text,
       CASE WHEN shape <> 3 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM t""")
def extract_json_prose(spark, d):
    """E4 on event properties inside prose: a value follows, code fences, brackets that are
    no JSON in front, and a value cut off."""
    shape, props = F.col("event_id") % 4, F.col("props")
    text = (F.when(shape == 0, F.concat(F.lit('He said "first" '), props, F.lit(' then {"k": -1}')))
            .when(shape == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```")))
            .when(shape == 2, F.concat(F.lit("[note] {x} "), props, F.lit(" ] }")))
            .otherwise(F.left(props, F.length(props) - 1)))
    ev = T(spark, d, "events").filter(F.try_parse_json("props").isNotNull()).select("event_id", text.alias("t"))
    got = xt.extract_json(ev, "t")
    return got.select("event_id", "json_ok", "json_text", F.try_variant_get("parsed", "$.k", "int").alias("k"))


@query("extraction_confidence", "SELECT doc_id, max(confidence) AS confidence, max(row_idx) AS n_rows, "
       "max(col_idx) AS max_col FROM (" + _TEXT_TABLES_SQL + ") tt GROUP BY doc_id")
def extraction_confidence(spark, d):
    """E5: per document, the share of delimited lines that formed the table."""
    t = xt.text_tables(T(spark, d, "documents"))
    return t.groupBy("doc_id").agg(F.max("confidence").alias("confidence"),
                                   F.max("row_idx").alias("n_rows"), F.max("col_idx").alias("max_col"))
