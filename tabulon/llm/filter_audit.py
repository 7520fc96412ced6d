"""Filter interaction audit: what each filter removes in every order of the filters.

Every filter keeps, by part of the corpus and range of rows, the sorted list of the rows
that fail it (a posting list); rows of good and of toxic documents are lists of the same
kind.  Within a range, unions of lists are made by merging and differences by galloping:
the shorter list is searched for in the longer one.  Sizes are summed over the ranges, and
all orders, steps and Shapley values follow from the sizes of the unions.

Rows are numbered once, in the written table, so null and repeated ids are no special case
and no range holds more than ``RANGE_ROWS`` rows, whatever the ids are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.batches import Words, row_slices, texts_of
from tabulon.llm.scratch import materialise, release

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
MARKS = r"[#$%&*|]"
#: Rows of a range: a power of two, so a row's range is its number shifted.
RANGE_BITS = 16
RANGE_ROWS = 1 << RANGE_BITS
#: Parts of a group of equal texts that are compared with its smallest id one by one.
SALTS = 16
#: A row of posting lists holds up to seven lists of a range.
_FEW_ROWS = {"spark__sql__execution__arrow__maxRecordsPerBatch": "16"}
REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def failing(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails (A: 1, B: 2, C: 4, D: 8)."""
    words = Words(texts, join=False)
    n = words.n
    ids, _ = words.encoded()
    span = int(ids.max(initial=0)) + 1
    distinct = np.bincount(np.unique(words.text_of_word * span + ids) // span, minlength=n)
    as_int = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    capitals, points = as_int(pc.count_substring_regex(texts, "[A-Z]")), as_int(pc.utf8_length(texts))
    marked = pc.match_substring_regex(texts, MARKS).to_numpy(zero_copy_only=False)
    return ((words.counts < MIN_WORDS) * 1 + (100 * distinct < MIN_DISTINCT_PERCENT * words.counts) * 2
            + (100 * capitals > MAX_CAPITAL_PERCENT * points) * 4 + marked * 8).astype(np.int32)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which members of the sorted ``short`` stand in the sorted ``long``."""
    if not len(long):
        return np.zeros(len(short), dtype=bool)
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    return long[at] == short


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Members of both sorted lists; the shorter is searched for in the longer."""
    return int(gallop(a, b).sum() if len(a) <= len(b) else gallop(b, a).sum())


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members of ``a`` that are not in ``b``; the shorter is searched for in the longer."""
    if len(a) <= len(b):
        return a[~gallop(a, b)]
    return np.delete(a, np.searchsorted(a, b[gallop(b, a)]))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two sorted lists: what the shorter adds goes to its places in the longer."""
    if len(a) < len(b):
        a, b = b, a
    new = b[~gallop(b, a)]
    return np.insert(a, np.searchsorted(a, new), new)


def unions(lists: list[np.ndarray]) -> dict[int, np.ndarray]:
    """The union of every set of lists; a set is a number with one bit for each list."""
    out = {0: np.zeros(0, dtype=np.int64)}
    for mask in range(1, 1 << len(lists)):
        top = mask.bit_length() - 1
        out[mask] = merge(out[mask ^ (1 << top)], lists[top])
    return out


def audit_range(lists: list[np.ndarray], marked: list[np.ndarray]) -> list[tuple[int, int, int, int, list[int]]]:
    """(filter, set of filters before it, failing rows outside that set, of all and of each
    marked list) for one range."""
    union, out = unions(lists), []
    for f, own in enumerate(lists):
        for before in range(1 << len(lists)):
            if not before >> f & 1:
                lost = minus(own, union[before])
                out.append((f, before, len(lost), *[common(lost, m) for m in marked]))
    return out


def numbered(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row per document with its own number: row, part, id, fails (A to D), text_key
    (128 bits of the text's SHA-256)."""
    hashed = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)
    base = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.substring(hashed, 1, 32)).alias("text_key"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def judge(batches):
        for batch in row_slices(batches, "text"):
            columns = [batch.column(c) for c in ("row", "part", "id", "text_key")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(failing(texts_of(batch, "text")))],
                                             names=["row", "part", "id", "text_key", "fails"])

    return materialise(base.mapInArrow(judge, "row long, part string, id long, text_key binary, fails int"), "audit-rows")


def copies(rows: DataFrame) -> DataFrame:
    """Rows (row, part) whose text also stands under a smaller id (by 128 bits of SHA-256).
    Groups of copies are salted by row, so a large one is shared out over ``SALTS`` keys.

    Spark sizes a table before its salts are made, ``SALTS`` times too small, so it would
    broadcast salted tables that the driver cannot hold: these joins sort and merge."""
    groups = (rows.groupBy("text_key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
              .filter(F.col("first") < F.col("last"))
              .select("text_key", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = rows.select("row", "part", "id", "text_key", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(groups.hint("shuffle_merge"), ["text_key", "salt"]).filter(F.col("id") > F.col("first")).select("row", "part")


def postings(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(part, range, list, ids): sorted row numbers by filter, then of good and of toxic
    documents (lists 5 and 6)."""
    letters = F.explode(F.filter(F.array(*[F.when(F.col("fails").bitwiseAND(1 << i) > 0, F.lit(i)) for i in range(4)]),
                                 lambda x: x.isNotNull())).alias("list")
    found = rows.select("row", "part", letters).unionByName(copies(rows).withColumn("list", F.lit(4)))
    marks = (labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.col("quality") == 1).alias("good"),
                           (F.col("toxic") == 1).alias("toxic"))
             .filter(F.col("id").isNotNull()).groupBy("id")
             .agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
             .filter("good OR toxic").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = rows.select("row", "part", "id", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    both = F.explode(F.filter(F.array(F.when(F.col("good"), F.lit(5)), F.when(F.col("toxic"), F.lit(6))),
                              lambda x: x.isNotNull())).alias("list")
    found = found.unionByName(salted.join(marks.hint("shuffle_merge"), ["id", "salt"]).select("row", "part", both))
    # At most RANGE_ROWS numbers in one list.
    return (found.groupBy("part", F.shiftright("row", RANGE_BITS).alias("range"), "list")
            .agg(F.sort_array(F.collect_list("row")).alias("ids")))


def set_sizes(lists: DataFrame) -> DataFrame:
    """(part, filter, before, removed, good, toxic): rows that fail a filter and none of a
    set of others, summed over the ranges."""
    def merge_ranges(batches):
        for batch in batches:
            for part, posted in zip(batch.column("part").to_pylist(), batch.column("posted"), strict=True):
                got = [np.zeros(0, dtype=np.int64)] * 7
                posted = posted.values
                for name, ids in zip(posted.field("list").to_pylist(), posted.field("ids"), strict=True):
                    got[name] = ids.values.to_numpy(zero_copy_only=False)
                table = np.array(audit_range(got[:5], got[5:]), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(table), pa.string()),
                                                  *[pa.array(table[:, k]) for k in range(5)]],
                                                 names=["part", "filter", "before", "removed", "good", "toxic"])

    grouped = lists.groupBy("part", "range").agg(F.collect_list(F.struct("list", "ids")).alias("posted")).select("part", "posted")
    found = grouped.mapInArrow(merge_ranges, "part string, filter long, before long, removed long, good long, toxic long")
    return found.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])


def report(pdf: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part from its set sizes."""
    sizes = {(f, before): (n, good, toxic) for f, before, n, good, toxic in
             pdf[["filter", "before", "removed", "good", "toxic"]].itertuples(index=False)}
    total, every, rows = sizes[-1, 0][0], (1 << len(FILTERS)) - 1, []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before, kept = "".join(FILTERS[f] for f in order), 0, total
        for step, f in enumerate(order, 1):
            removed, good, toxic = sizes.get((f, before), (0, 0, 0))
            kept -= removed
            rows.append((name, step, f, kept, removed, sizes.get((f, 0), (0,))[0] - removed,
                         sizes.get((f, every ^ (1 << f)), (0,))[0], good, toxic))
            before |= 1 << f
    out = pd.DataFrame(rows, columns=["filter_order", "step", "f", "kept", "removed", "redundant", "unique_fails",
                                      "good_lost", "toxic_lost"])
    out["shapley"] = out.groupby("f")["removed"].transform("sum")
    out.insert(0, "part", pdf["part"].iloc[0])
    return out.drop(columns="f")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 100 words, B fewer than 80 distinct words per 100, C more than 10
    capitals ``[A-Z]`` per 100 code points, D any of ``#$%&*|``, E a text that a smaller id
    has as well, anywhere in the table.  A document counts in good_lost (toxic_lost) when any
    label of its id says quality 1 (toxic 1).  ``shapley`` is the sum over all orders of
    what the step's filter removes.

    A null part is the empty string, a null text the empty text.  A null id is neither
    smaller than another nor has it a smaller one, and it has no label.  Rows that repeat
    an id count one by one, and copies under one id do not fail E by each other.  An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = numbered(docs, id_col, text_col, part_col)
    lists = materialise(postings(rows, labels, id_col), "audit-postings")
    sizes = set_sizes(lists)
    # The number of rows of a part rides along as filter -1.
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("removed")).select(
        "part", F.lit(-1).cast("long").alias("filter"), F.lit(0).cast("long").alias("before"), "removed",
        F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    # At most 81 rows for each part, whatever the table's size.
    out = materialise(sizes.unionByName(totals).groupBy("part").applyInPandas(report, REPORT), "audit-report", **_FEW_ROWS)
    release(rows, lists)
    return out
