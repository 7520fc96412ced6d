"""Tables out of text and HTML columns, as regex and window jobs over many
documents at once (one document's lines never leave its task group, and a
document is bounded by its own length)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import q

# HTML entities decoded in extracted cells.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&amp;", "&")]


def decode_entities(c):
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clean_cell(c):
    """Strip tags, decode entities, collapse blanks."""
    no_tags = F.regexp_replace(c, r"<[^>]*>", "")
    return F.trim(F.regexp_replace(decode_entities(no_tags), r"\s+", " "))


# Comments and script are skipped whole; of the tags only those that shape a table matter.
_TABLE_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)(table|thead|tbody|tfoot|caption|tr|t[hd])\b(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*?>", re.I | re.S)


class _Table:
    """An open table: its rows so far, and the parts of the cell that is open (None: no cell)."""

    def __init__(self):
        self.rows: list[dict] = []
        self.row: dict | None = None
        self.cell: list[str] | None = None

    def end_cell(self):
        if self.cell is not None:
            self.row["cells"].append("".join(self.cell))
            self.cell = None

    def end_row(self):
        self.end_cell()
        self.row = None

    def begin_row(self):
        self.end_row()
        self.row = {"th": [], "cells": []}
        self.rows.append(self.row)

    def begin_cell(self, head: bool):
        self.end_cell()
        if self.row is None:
            self.begin_row()
        self.row["th"].append(head)
        self.cell = []


def _page_tables(html: str) -> list[list[dict]]:
    """All tables of a page in the order they open, from one walk over its tags.  A cell ends
    at the next cell, row or table end where its own end tag is missing; a table inside a
    cell is a table of its own, and its text is no part of that cell."""
    tables: list[_Table] = []
    stack: list[_Table] = []
    at = 0
    for m in _TABLE_TOKEN.finditer(html):
        if stack and stack[-1].cell is not None:
            stack[-1].cell.append(html[at:m.start()])
        at = m.end()
        tag, closing = (m[3] or "").lower(), bool(m[2])
        if tag == "table" and not closing:
            stack.append(_Table())
            tables.append(stack[-1])
        elif not stack or not tag:
            continue
        elif tag == "table":
            stack.pop().end_row()
        elif tag in ("td", "th"):
            stack[-1].end_cell() if closing else stack[-1].begin_cell(tag == "th")
        elif tag == "tr" and not closing:
            stack[-1].begin_row()
        else:
            stack[-1].end_row()
    if stack and stack[-1].cell is not None:
        stack[-1].cell.append(html[at:])
    for t in stack:
        t.end_row()
    return [t.rows for t in tables]


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The largest ``<table>`` per page (by cells; the first on ties) as long rows
    (page, row_idx, col_idx, header, value).  Header: the first row made of ``<th>``, else
    the first row with a cell.

    Tags are read as pages have them: end tags may be missing, tables may stand inside
    cells.  One scan, no shuffle: tasks read the tags of the pages that hold a table, all
    else are column functions.  A null page and one without a table give no rows."""
    def largest(batches):
        for batch in batches:
            out = []
            for html in batch.column("html").to_pylist():
                sized = [(sum(len(r["cells"]) for r in t), t) for t in _page_tables(html)]
                out.append(max(sized, key=lambda x: x[0], default=(0, []))[1])
            kind = pa.list_(pa.struct([("th", pa.list_(pa.bool_())), ("cells", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, kind)], names=["doc", "rows"])

    with_table = pages.filter(q(html_col).rlike(r"(?i)<table\b")).select(q(id_col).alias("doc"), q(html_col).alias("html"))
    id_type = with_table.schema["doc"].dataType.simpleString()
    found = with_table.mapInArrow(largest, f"doc {id_type}, rows array<struct<th:array<boolean>,cells:array<string>>>")
    clean = F.transform("rows", lambda r, i: F.struct(i.alias("i"), r["th"].alias("th"), F.transform(r["cells"], clean_cell).alias("cells")))
    full = F.filter("rows", lambda r: F.size(r["cells"]) > 0)
    heads = F.filter("rows", lambda r: F.forall(r["th"], lambda x: x))
    found = found.select("doc", F.explode(F.array(clean)).alias("rows"))
    found = found.select("doc", F.explode(F.array(full)).alias("rows"))
    found = found.select("doc", "rows", F.coalesce(F.get(heads, F.lit(0)), F.get("rows", F.lit(0))).alias("head"))
    body = found.select("doc", "head", F.explode("rows").alias("r")).filter(F.col("r.i") != F.col("head.i"))
    cells = body.select("doc", F.col("r.i").alias("row_idx"), F.col("head.cells").alias("names"),
                        F.posexplode("r.cells").alias("col_idx", "value"))
    name = F.get("names", F.col("col_idx"))
    return cells.select(F.col("doc").alias(id_col), "row_idx", "col_idx",
                        F.coalesce(F.when(name != "", name), F.concat(F.lit("column_"), F.col("col_idx").cast("string")))
                        .alias("header"), "value")


# Address in double quotes, in single quotes, or bare up to a blank or the tag's end.
LINK_RE = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*?)</a>"


def html_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every link as a row (page, link_idx, href, text)."""
    parts = [F.regexp_extract_all(q(html_col), F.lit(LINK_RE), i) for i in range(1, 5)]
    z = pages.select(q(id_col), F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abct", strict=True)]))
                     .alias("link_idx", "z"))
    return z.select(q(id_col), "link_idx",
                    decode_entities(F.concat(*[F.coalesce(f"z.{n}", F.lit("")) for n in "abc"])).alias("href"),
                    clean_cell(F.col("z.t")).alias("text"))


def html_list_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``<li>`` items as rows (page, item_idx, text)."""
    items = F.regexp_extract_all(q(html_col), F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), 1)
    z = pages.select(q(id_col), F.posexplode(items).alias("item_idx", "raw"))
    return z.select(q(id_col), "item_idx", clean_cell(F.col("raw")).alias("text"))


SEPARATOR_CELL = r"^:?-{2,}:?$"


# A cell up to its delimiter: in double quotes (doubled inside), else all up to the delimiter.
_QUOTED = r'( *"[^"]*+(?:""[^"]*+)*+" *|[^{0}]*)[{0}]'


def _cells(line, delimiter: str):
    """Cells of a line; a delimiter inside a quoted cell parts nothing."""
    one = F.regexp_extract_all(F.concat(line, F.lit(delimiter)), F.lit(_QUOTED.format(delimiter)), 1)
    bare = F.transform(one, lambda c: F.when(
        F.trim(c).rlike(r'(?s)^".*"$') & (F.length(F.trim(c)) > 1),
        F.replace(F.substring(F.trim(c), F.lit(2), F.length(F.trim(c)) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(line.contains('"'), bare).otherwise(F.split(line, rf"\{delimiter}" if delimiter == "|" else delimiter))


def _table_line(line, at):
    """A line as (line number, delimiter, cells); no cells without a delimiter."""
    outside = F.when(line.contains('"'), F.regexp_replace(line, r'"[^"]*"', "")).otherwise(line)
    framed = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    delim, cells = F, F
    for d in ("|", "\t", ","):
        delim = delim.when(outside.contains(d), F.lit(d))
        cells = cells.when(outside.contains(d), _cells(framed if d == "|" else line, d))
    cells = cells.otherwise(F.array().cast("array<string>"))
    return F.struct(at.alias("at"), delim.alias("delim"), F.transform(cells, lambda c: F.trim(c)).alias("cells"))


def _longest_run(lines):
    """Start and length (bs, bl) of the longest run of consecutive lines with one
    delimiter and width; the earliest on ties."""
    none = F.struct(F.lit(0).alias("cs"), F.lit(0).alias("cl"), F.lit("").alias("cd"), F.lit(0).alias("cn"),
                    F.lit(0).alias("bs"), F.lit(0).alias("bl"))

    def step(run, x):
        width = F.size(x["cells"])
        table = width >= 2
        goes_on = table & (x["delim"] == run["cd"]) & (width == run["cn"]) & (run["cl"] > 0)
        start = F.when(goes_on, run["cs"]).otherwise(x["at"])
        length = F.when(goes_on, run["cl"] + 1).when(table, 1).otherwise(0)
        longer = length > run["bl"]
        return F.struct(start.alias("cs"), length.alias("cl"), F.coalesce(x["delim"], F.lit("")).alias("cd"),
                        width.alias("cn"), F.when(longer, start).otherwise(run["bs"]).alias("bs"),
                        F.when(longer, length).otherwise(run["bl"]).alias("bl"))

    return F.aggregate(lines, none, step)


def text_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delimited plain-text tables (pipe, tab or comma) as long rows.

    A table is a run of at least two consecutive lines that split into the
    same number (≥ 2) of cells on the same delimiter; per document the longest
    run wins (earliest on ties).  Its first line is the header; markdown rule
    lines are dropped; outer empty cells from ``|a|b|`` framing are removed.  A cell in
    double quotes may hold the delimiter, and a doubled quote is one.
    ``confidence`` = table lines / delimited lines of the document."""
    parsed = F.transform(F.split(q(text_col), "\n"), _table_line)
    # Generators keep the parsed lines and the run from being computed once per use.
    base = docs.select(q(id_col).alias("doc"), F.explode(F.array(parsed)).alias("lines"))
    base = base.select("doc", "lines", F.explode(F.array(_longest_run(F.col("lines")))).alias("run"))
    best = F.slice("lines", F.col("run.bs") + 1, F.col("run.bl"))
    n_delimited = F.size(F.filter("lines", lambda x: F.size(x["cells"]) >= 2))
    rows = (base.filter(F.col("run.bl") >= 2)
            .select("doc", F.filter(best, lambda x: ~F.forall(x["cells"], lambda c: c.rlike(SEPARATOR_CELL) | (c == "")))
                    .alias("rows"), (F.col("run.bl") / n_delimited).alias("confidence")))
    body = (rows.select("doc", "confidence", F.get("rows", F.lit(0))["cells"].alias("hdr"),
                        F.posexplode("rows").alias("row_idx", "r"))
            .filter(F.col("row_idx") > 0).select("doc", "confidence", "hdr", "row_idx", F.col("r.cells").alias("cells")))
    out = body.select("doc", "row_idx", "confidence", F.posexplode(F.arrays_zip(
        F.col("hdr").alias("h"), F.col("cells").alias("v"))).alias("col_idx", "z"))
    return out.select(F.col("doc").alias(id_col), "row_idx", "col_idx",
                      F.coalesce(F.when(F.col("z.h") != "", F.col("z.h")),
                                 F.concat(F.lit("column_"), F.col("col_idx").cast("string"))).alias("header"),
                      F.regexp_replace(F.col("z.v"), r"\s+", " ").alias("value"),
                      F.coalesce(F.col("confidence"), F.lit(0.8)).alias("confidence"))


def text_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bullet or numbered list items (``- x``, ``* x``, ``• x``, ``1. x``)."""
    lines = docs.select(q(id_col), F.posexplode(F.split(q(text_col), "\n")).alias("line_idx", "line"))
    pat = r"^\s*(?:[-*•]|\d+[.)])\s+(.+?)\s*$"
    return lines.filter(F.col("line").rlike(pat)).select(
        q(id_col), "line_idx", F.regexp_extract("line", pat, 1).alias("item"))


FENCE_RE = r"```(?:json)?\s*"


#: Pieces of a text that a scan for brackets looks at: escapes, quotes, brackets, all else.
_JSON_PIECES = r'(?s)\\.|["\[\]{}]|[^"\[\]{}\\]+|\\'
#: A value without brackets that fills the whole text.
_JSON_SCALAR = r'(?s)^(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|"[^"\\]*+(?:\\.[^"\\]*+)*+")$'


def bracketed(c):
    """The outermost complete bracketed stretches of a text, in order.  Brackets inside quotes
    count for nothing, and quotes outside brackets are plain text.  One step per piece."""
    none = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("start"),
                    F.array().cast("array<struct<start:int,size:int>>").alias("found"))

    def step(s, x):
        inside = s["depth"] > 0
        opens = x.isin("{", "[") & ~s["quoted"]
        closes = x.isin("}", "]") & ~s["quoted"] & inside
        start = F.when(opens & ~inside, s["at"]).otherwise(s["start"])
        stretch = F.struct(s["start"].alias("start"), (s["at"] - s["start"] + 1).alias("size"))
        return F.struct((s["at"] + F.length(x)).alias("at"),
                        (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
                        F.when(x == '"', inside & ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), start.alias("start"),
                        F.when(closes & (s["depth"] == 1), F.array_append(s["found"], stretch)).otherwise(s["found"]).alias("found"))

    scan = F.aggregate(F.regexp_extract_all(c, F.lit(_JSON_PIECES), 0), none, step, lambda s: s["found"])
    return F.transform(scan, lambda f: F.substring(c, f["start"], f["size"]))


def json_candidate(c):
    """(text, ok) of the JSON value in a text without its code fences: the first
    outermost bracketed stretch that parses, else the whole text where it is a plain value.
    Without either ``ok`` is false and the text is the first stretch, else all."""
    s = F.trim(F.regexp_replace(c, FENCE_RE, ""))

    def choose(texts):
        good = F.get(F.filter(texts, lambda x: F.try_parse_json(x).isNotNull()), F.lit(0))
        plain = F.when(s.rlike(_JSON_SCALAR) & F.try_parse_json(s).isNotNull(), s)
        return F.struct(F.coalesce(good, plain, F.get(texts, F.lit(0)), s).alias("text"),
                        F.coalesce(good, plain).isNotNull().alias("ok"))

    # The stretches are found once, whatever reads them.
    return F.get(F.transform(F.array(bracketed(s)), choose), F.lit(0))


def extract_json(df: DataFrame, col: str, required: list[str] | None = None) -> DataFrame:
    """Parse the first JSON value inside a text column into a VARIANT.

    Adds ``json_text``, ``parsed`` (null when it does not parse),
    ``json_ok`` and ``missing_keys`` (required keys absent, comma list).  What stands
    before and after the value is left out; a value that is cut off does not parse, and a
    bracket that never closes hides what follows it."""
    out = df.withColumn("_json", F.explode(F.array(json_candidate(q(col)))))
    ok = F.coalesce(F.col("_json.ok"), F.lit(False))
    out = out.withColumn("json_text", F.col("_json.text")).withColumn("parsed", F.when(ok, F.try_parse_json("_json.text")))
    out = out.withColumn("json_ok", ok).drop("_json")
    if required:
        # A present key (even a JSON null) extracts as a variant; an absent one as SQL NULL.
        miss = F.array_compact(F.array(*[F.when(F.try_variant_get("parsed", f"$.{k}", "variant").isNull(),
                                                F.lit(k)) for k in required]))
        out = out.withColumn("missing_keys", F.when(F.col("json_ok"), F.array_join(miss, ",")))
    return out
