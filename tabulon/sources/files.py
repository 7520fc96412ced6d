"""``load(source_type, ...)``: files and databases into a DataFrame.

Every reader is a lazy Spark scan that splits across executors; nothing is
read on the driver.  Excel workbooks are parsed one workbook per task.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import NUMERIC_TEXT, normalise_nan
from tabulon.sources.guards import SourceError, require_rows
from tabulon.sources import jdbc

FILE_TYPES = ("csv", "json", "excel", "parquet")
DB_TYPES = ("mysql", "postgresql", "sqlite")


def _check_path(spark: SparkSession, path: str | None) -> str:
    if not path:
        raise SourceError("file_path is required for file sources")
    # Only local paths can be checked up front; cluster URIs are left to the reader.
    local = path[len("file:"):] if path.startswith("file:") else path
    if "://" not in local and not any(ch in local for ch in "*?[") and not os.path.exists(local):
        raise SourceError(f"File not found: {path}")
    return path


# Spellings of a missing value in CSV files.
NULL_TEXT = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Types tried for a CSV column, narrowest first; text when none fits every value.
_CSV_TYPES = ("int", "bigint", "double", "boolean", "date", "timestamp")


def read_csv(spark: SparkSession, path: str, infer_schema: bool = True,
             schema: T.StructType | str | None = None, multi_line: bool | None = None,
             reject_column: str | None = None) -> DataFrame:
    """CSV with a header in every file, doubled quotes and missing-value spellings.

    One pass over the lines finds each file's header and whether a quoted field holds a
    line break (an odd number of quotes on a line); only then a file is read by one task.
    Fields go by the header of their own file, so files may order their columns
    differently; files with other columns than the first one raise.  Columns come in the
    order of the file whose name sorts first.  A repeated name gets a number (``a``, ``a.1``), an
    empty one is ``_c`` and its place.

    A record with fewer fields than the header is filled with nulls.  One with more raises,
    with the number of such records and an example; with ``reject_column`` it is kept
    instead as a row of nulls with its text in that column."""
    heads, odd = _headers(spark, path)
    if not heads:
        return spark.createDataFrame([], T.StructType())
    multi_line = odd if multi_line is None else multi_line
    first = heads[0][0]
    parts = []
    for names, files in heads:
        if set(names) != set(first) or len(names) != len(first):
            other = sorted(set(names) ^ set(first))
            raise SourceError(f"CSV files differ in their columns: {other} (e.g. {files[0] if files else path})")
        parts.append(_read_group(spark, path if files is None else files, names, multi_line).select(
            *[_q(c) for c in first], "_long"))
    raw = parts[0]
    for x in parts[1:]:
        raw = raw.unionByName(x)
    if reject_column:
        # A rejected record has no values of its own.
        raw = raw.select(*[F.when(F.col("_long").isNull(), _q(c)).alias(c) for c in first], "_long")
    # Whole records are parsed only where every column is read.
    checks = [F.count("_long").alias("n"), F.min("_long").alias("example"), F.count(F.struct(*map(_q, first))).alias("_any"),
              *[F.max(F.length(_q(c))).alias(f"_w{i}") for i, c in enumerate(first)]]
    guess = infer_schema and schema is None
    if guess:
        # The same pass decides the type of every column.
        checks += [F.bool_and(_q(c).isNull() | _fits(c, t)).alias(f"{i}_{t}")
                   for i, c in enumerate(first) for t in _CSV_TYPES]
    found = raw.agg(*checks).first()
    if found["n"] and not reject_column:
        raise SourceError(f"{found['n']} CSV records have more than {len(first)} fields, e.g. {found['example'][:200]}")
    extra = [F.col("_long").alias(reject_column)] if reject_column else []
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return raw.select(*[F.trim(_q(c)).cast(f.dataType).alias(f.name)
                            if not isinstance(f.dataType, T.StringType) else _q(c).alias(f.name)
                            for c, f in zip(first, wanted.fields, strict=True)], *extra)
    out = []
    for i, c in enumerate(first):
        kind = next((t for t in _CSV_TYPES if found[f"{i}_{t}"]), None) if guess else None
        out.append(F.trim(_q(c)).cast(kind).alias(c) if kind else _q(c))
    return raw.select(*out, *extra)


def _headers(spark: SparkSession, path: str) -> tuple[list[tuple[list[str], list[str] | None]], bool]:
    """Column names of every distinct header with its files (None: all of ``path``), that of
    the first file in front; and whether any line has an odd number of quotes."""
    per_file = _file_heads(spark, path)
    # One row per distinct header.
    groups = sorted(per_file.groupBy("head").agg(F.min("file").alias("file"), F.bool_or("broken").alias("broken")).collect(),
                    key=lambda r: r["file"])
    odd = any(r["broken"] for r in groups)
    groups = [r for r in groups if r["head"] is not None]
    files: dict[int, list[str] | None] = {r["head"]: None for r in groups}
    if len(groups) > 1:
        # File names are what the reader lists on the driver anyway.
        for r in per_file.filter(F.col("head").isNotNull()).groupBy("head").agg(F.sort_array(F.collect_set("file")).alias("f")).collect():
            files[r["head"]] = [_plain_path(f) for f in r["f"]]
    out: dict[tuple, tuple[list[str], list[str] | None]] = {}
    for r in groups:
        names = _names(spark, _first_line(spark, _plain_path(r["file"])), _plain_path(r["file"]))
        if tuple(names) in out and files[r["head"]] is not None:
            out[tuple(names)][1].extend(files[r["head"]])
        else:
            out[tuple(names)] = (names, files[r["head"]])
    if len(out) == 1:
        return [(next(iter(out.values()))[0], None)], odd
    return list(out.values()), odd


def _file_heads(spark: SparkSession, path: str) -> DataFrame:
    """(file, head, broken): the hash of each file's first line that is not blank, and whether
    any of its lines has an odd number of quotes."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    head = (F.col("block") == 0) & (F.trim("value") != "")
    broken = F.col("value").contains('"') & (F.regexp_count("value", F.lit('"')) % 2 == 1)
    # Numbers only: an aggregate that holds text would sort all lines of a task by file.
    return lines.groupBy("file").agg(F.min_by(F.when(head, F.xxhash64("value")), F.when(head, F.col("at"))).alias("head"),
                                     F.bool_or(broken).alias("broken"))


def _first_line(spark: SparkSession, file: str) -> str:
    """The first line of a file that is not blank; Spark reads no further."""
    return spark.read.text(file).filter(F.trim("value") != "").first()["value"]


def _plain_path(uri: str) -> str:
    """A listed file's address as a path for the reader, which takes patterns."""
    import re
    from urllib.parse import unquote
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _names(spark: SparkSession, head: str, file: str) -> list[str]:
    import csv
    if head.count('"') % 2:
        # A quoted name holds a line break: Spark reads this one header.
        fields = (spark.read.option("header", False).option("multiLine", True).option("quote", '"')
                  .option("escape", '"').csv(file).first())
    else:
        fields = next(csv.reader([head]))
    names, seen = [], set()
    for i, name in enumerate(fields):
        base = f"_c{i}" if not name else name
        own, k = base, 0
        while own.lower() in seen:
            k += 1
            own = f"{base}.{k}"
        seen.add(own.lower())
        names.append(own)
    return names


#: A field with its comma: in double quotes (doubled inside), else all up to the comma.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^,]*),'


def _read_group(spark: SparkSession, path: str | list[str], names: list[str], multi_line: bool) -> DataFrame:
    """Files of one header as text columns ``names``, missing values null, and ``_long``: the
    text of a record with more fields than names."""
    n = len(names)
    own = [f"_{i}" for i in range(n)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*own, "_bad"]])
    raw = (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
           .csv(path))
    # Spark marks records with another number of fields; of these the short ones are no fault.
    fields = F.size(F.regexp_extract_all(F.concat("_bad", F.lit(",")), F.lit(_FIELD), 0))
    long = F.when(F.col("_bad").isNotNull() & (fields > n), F.col("_bad"))
    return raw.select(*[F.when(~F.trim(c).isin(*NULL_TEXT), F.col(c)).alias(name) for c, name in zip(own, names, strict=True)],
                      long.alias("_long"))


def _fits(c: str, kind: str):
    value = F.trim(_q(c))
    if kind in ("int", "bigint"):
        return value.rlike(r"^[+-]?\d+$") & value.try_cast(kind).isNotNull()
    if kind == "boolean":
        return F.lower(value).isin("true", "false")
    if kind == "date":
        return value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & value.try_cast(kind).isNotNull()
    if kind == "timestamp":
        return value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d") & value.try_cast(kind).isNotNull()
    return value.rlike(NUMERIC_TEXT + r"|(?i)^[+-]?inf(inity)?$") & value.try_cast(kind).isNotNull()


def _q(c: str):
    return F.col("`" + c.replace("`", "``") + "`")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multi_line: bool | None = None) -> DataFrame:
    """JSON-lines, or one array (or object) per file.

    With ``multi_line`` None one pass looks whether every line is an object of its
    own; otherwise each file is one document, read by one task.  A record that does
    not parse raises when it is read."""
    if multi_line is None:
        line = F.trim("value")
        whole = (F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}"))) | (line == "")
        multi_line = not spark.read.text(path).filter(~whole).isEmpty()
    r = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    return (r.schema(schema) if schema is not None else r).json(path)


def load(spark: SparkSession, source_type: str, path: str | None = None,
         db_config: dict | None = None, infer_schema: bool = True,
         schema: T.StructType | str | None = None, multi_line: bool | None = None,
         reject_column: str | None = None) -> DataFrame:
    """Load a table.  ``source_type``: csv, json, excel, parquet, mysql, postgresql, sqlite.
    A table without rows raises.  ``reject_column``: see :func:`read_csv`."""
    st = (source_type or "").lower()
    if st in FILE_TYPES:
        path = _check_path(spark, path)
        if st == "csv":
            df = read_csv(spark, path, infer_schema, schema, multi_line, reject_column)
        elif st == "json":
            df = read_json(spark, path, schema, multi_line)
        elif st == "parquet":
            df = spark.read.parquet(path)
        else:
            df = read_excel(spark, path)
        return require_rows(normalise_nan(df))
    if st in DB_TYPES:
        return require_rows(normalise_nan(jdbc.load_database(spark, st, db_config)))
    raise SourceError(f"Unsupported source type: {source_type}")


# ---------------------------------------------------------------- excel
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RNS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n - 1


def parse_first_sheet(content: bytes) -> list[list[str | None]]:
    """First worksheet of an .xlsx as rows of cell strings (standard library only)."""
    import io
    import zipfile
    import xml.etree.ElementTree as ET

    zf = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in zf.namelist():
        root = ET.fromstring(zf.read("xl/sharedStrings.xml"))
        for si in root.iter(f"{_NS}si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    first = next(wb.iter(f"{_NS}sheet"))
    rid = first.get(f"{_RNS}id")
    target = "worksheets/sheet1.xml"
    if "xl/_rels/workbook.xml.rels" in zf.namelist():
        rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
        for rel in rels:
            if rel.get("Id") == rid:
                target = rel.get("Target").lstrip("/").removeprefix("xl/")
    sheet = ET.fromstring(zf.read(f"xl/{target}"))
    rows: list[list[str | None]] = []
    for row in sheet.iter(f"{_NS}row"):
        cells: dict[int, str | None] = {}
        idx = -1
        for c in row.iter(f"{_NS}c"):
            # The cell reference is optional; without it a cell follows the last one.
            idx = _col_index(c.get("r")) if c.get("r") else idx + 1
            kind = c.get("t")
            v = c.find(f"{_NS}v")
            if kind == "s" and v is not None:
                val = shared[int(v.text)]
            elif kind == "b" and v is not None:
                val = "true" if v.text == "1" else "false"
            elif kind == "inlineStr":
                val = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            else:
                val = v.text if v is not None else None
            cells[idx] = val
        width = max(cells) + 1 if cells else 0
        rows.append([cells.get(i) for i in range(width)])
    return rows


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks under ``path`` → one table; first sheet, first row is the header.

    Each workbook is parsed in its own task (``binaryFile`` + ``mapInPandas``);
    cells arrive as strings and numeric-looking columns are cast afterwards.
    """
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def first_row(batches):
        for pdf in batches:
            rows = [parse_first_sheet(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"header": [[None if h is None else str(h) for h in r[0]] if r else None
                                           for r in rows]})

    # The header decides the schema: the first workbook's first row is parsed
    # on an executor, and only that row reaches the driver.
    head = files.orderBy("path").limit(1).mapInPandas(first_row, "header array<string>").collect()
    if not head:
        raise SourceError(f"No workbook found at {path}")
    if head[0]["header"] is None:
        raise SourceError("Workbook has no rows")
    header = [h if h is not None else f"column_{i}" for i, h in enumerate(head[0]["header"])]
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])

    def parse(batches):
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                rows = parse_first_sheet(bytes(content))
                if not rows:
                    continue
                # Cells go by their own workbook's header names.
                own = [h if h is not None else f"column_{i}" for i, h in enumerate(rows[0])]
                unknown = set(own) - set(header)
                if unknown or any(len(r) > len(own) for r in rows[1:]):
                    raise ValueError(f"Workbooks differ in their columns: {sorted(unknown)}")
                at = {h: i for i, h in enumerate(own)}
                out.extend([[r[at[h]] if h in at and at[h] < len(r) else None for h in header] for r in rows[1:]])
            yield pd.DataFrame(out, columns=header)

    raw = files.mapInPandas(parse, schema)
    num = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    # One pass decides which columns are fully numeric; then cast them.
    checks = raw.agg(*[F.bool_and(F.col(f"`{h}`").isNull() | F.col(f"`{h}`").rlike(num)).alias(h)
                       for h in header]).collect()[0]
    return raw.select(*[F.col(f"`{h}`").cast("double").alias(h) if checks[h] else F.col(f"`{h}`")
                        for h in header])
