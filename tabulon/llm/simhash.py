"""SimHash near-dedup: positional byte index, count filter, bit check.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ in at
most ``max_bits`` bits share at least ``8 - max_bits`` of them.  Lists of single bytes
would each hold 1/256 of the corpus, so the index is keyed by groups of positional
bytes: of four byte pairs at least ``4 - max_bits`` pairs are equal, and every choice
of that many pairs is one key.  Fingerprints that meet in a short list (``SHORT``) have their
shared positional bytes tallied; pairs with the guaranteed count are verified bit by
bit.  In a longer list members are looked up by flipping free bits: the same links, in
work linear in the list.
A list too long for that is keyed again by further shared bytes, which leaves at most
``max_bits`` free bytes, so no list is ever unbounded.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.batches import Words, row_slices, texts_of
from tabulon.llm.components import components
from tabulon.llm.scratch import TEXT_BATCHES, materialise, release

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Shingles whose bits are tallied at once.
CHUNK = 1 << 16
#: Lists up to this length are compared row by row within a batch.
SHORT = 64
#: Longer lists than this are keyed again by more shared bytes.
LONG = 100_000


def fingerprint_texts(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints of texts (nulls already empty)."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = Words(pc.ascii_lower(texts))
    buf = bytes(words.joined)
    n_shingles = np.where(words.counts == 0, 0, np.maximum(words.counts - shingle + 1, 1))
    owner = np.repeat(np.arange(words.n), n_shingles)
    first = np.concatenate(([0], np.cumsum(n_shingles)))
    at = np.arange(first[-1]) - first[owner] + words.first[owner] if len(owner) else np.zeros(0, np.int64)
    last = np.minimum(at + shingle - 1, words.first[owner + 1] - 1) if len(owner) else at
    ones = np.zeros((words.n, 64), dtype=np.int64)
    for i in range(0, len(at), CHUNK):
        begin, end = words.start[at[i:i + CHUNK]], words.end[last[i:i + CHUNK]]
        h = np.array([digest(buf[s:e], SEED) for s, e in zip(begin.tolist(), end.tolist(), strict=True)],
                     dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who = owner[i:i + CHUNK]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(who)) + 1))
        ones[who[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    bits = (2 * ones > n_shingles[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (128-bit hash of the text), fp (the fingerprint as a signed long)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.select("doc_id", F.unhex(F.md5("text")).alias("text_key"), "text")

    def compute(batches):
        for batch in row_slices(batches, "text"):
            fp = fingerprint_texts(texts_of(batch, "text"), shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(fp.view(np.int64))],
                names=["doc_id", "text_key", "fp"])

    return base.mapInArrow(compute, "doc_id long, text_key binary, fp long")


def _packed(fp: str, units: list[tuple[int, int]]) -> str:
    """SQL: the (shift, bits) fields of ``fp`` side by side."""
    out, width = [], 0
    for shift, bits in units:
        out.append(f"shiftleft(shiftrightunsigned({fp}, {shift}) & {(1 << bits) - 1}L, {width})")
        width += bits
    return " | ".join(out) or "0L"


def _keys(max_bits: int, refine: bool = False) -> str:
    """SQL array of index keys: (choice number, field values) of every choice."""
    out = []
    for pairs in combinations(range(4), 4 - max_bits):
        fields = [(16 * p, 16) for p in pairs]
        rest = [8 * b for b in range(8) if b // 2 not in pairs]
        more = combinations(rest, len(rest) - max_bits) if refine else [()]
        for extra in more:
            out.append(_packed("fp", fields + [(s, 8) for s in extra]))
    return "array(" + ", ".join(f"struct({i} AS choice, {k} AS value)" for i, k in enumerate(out)) + ")"


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter on shared positional bytes, then the bit check."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= 8 - max_bits
    ok[ok] = np.bitwise_count(x[ok]) <= max_bits
    return ok


def _flips(max_bits: int, free: np.ndarray) -> list[np.uint64]:
    bits = [np.uint64(1) << np.uint64(i) for i in np.flatnonzero(free)]
    out = []
    for k in range(1, max_bits + 1):
        out += [np.bitwise_or.reduce(np.array(c, dtype=np.uint64)) for c in combinations(bits, k)]
    return out


def _long_list(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one list of sorted distinct fingerprints, as stars around each local
    component's smallest member.  Members are looked up by flipping free bits, so the
    work is linear in the list and the output is at most one row per member."""
    union = np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps)
    free = np.unpackbits(np.array([union]).view(np.uint8), bitorder="little").astype(bool)
    label = np.arange(len(fps))
    src, dst = [], []
    for mask in _flips(max_bits, free):
        probe = fps ^ mask
        at = np.minimum(np.searchsorted(fps, probe), len(fps) - 1)
        hit = np.flatnonzero((fps[at] == probe) & (at > label))
        if len(hit):
            src.append(hit)
            dst.append(at[hit])
    if not src:
        return fps[:0], fps[:0]
    i, j = np.concatenate(src), np.concatenate(dst)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[tied]], fps[tied]


def _link_lists(max_bits: int, long_list: int):
    """Rows come sorted by key; lists may span batches.  Emits links, or the members of
    a list that is too long with ``a`` null."""

    def rows(a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)) if a is not None else pa.nulls(len(b), pa.int64()),
             pa.array(b.view(np.int64))], names=["a", "b"])

    def solve(choice, value, fp):
        start = np.concatenate(([0], np.flatnonzero((np.diff(choice) != 0) | (np.diff(value) != 0)) + 1))
        size = np.diff(np.append(start, len(fp)))
        inside = np.repeat(size, size)
        left, right = [], []
        short = inside <= SHORT
        place = np.arange(len(fp)) - np.repeat(start, size)
        for step in range(1, int(min(size.max(), SHORT))):
            i = np.flatnonzero(short & (place + step < inside))
            if len(i) == 0:
                break
            ok = _near(fp[i], fp[i + step], max_bits)
            left.append(fp[i[ok]])
            right.append(fp[i[ok] + step])
        for k in np.flatnonzero(size > SHORT):
            a, b = _long_list(np.unique(fp[start[k]:start[k] + size[k]]), max_bits)
            left.append(a)
            right.append(b)
        if left:
            yield rows(np.concatenate(left), np.concatenate(right))

    def run(batches):
        held: list[tuple] = []
        open_key, passing = None, False
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("choice", "value", "fp")]
            cols[2] = cols[2].view(np.uint64)
            if not len(cols[0]):
                continue
            if passing:
                same = (cols[0] == open_key[0]) & (cols[1] == open_key[1])
                n = int(same.sum())
                if n:
                    yield rows(None, cols[2][:n].copy())
                    cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                passing = False
            if held:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
                held = []
            # The last list may go on in the next batch.
            last = np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0]
            if last:
                yield from solve(*[c[:last].copy() for c in cols])
            held = [c[last:].copy() for c in cols]
            if len(held[0]) > long_list:
                open_key, passing = (held[0][0], held[1][0]), True
                yield rows(None, held[2])
                held = []
        if held:
            yield from solve(*held)

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, long_list: int = LONG) -> DataFrame:
    """``distinct``: distinct fingerprints ``fp``.  Pairs (a, b) that connect exactly the
    fingerprints within ``max_bits`` bits of one another, directly or through others."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    spark = distinct.sparkSession
    if max_bits == 0:
        return spark.createDataFrame([], "a long, b long")

    def index(frame, refine):
        keyed = frame.select("fp", F.explode(F.expr(_keys(max_bits, refine))).alias("k"))
        return (keyed.select(F.col("k.choice").alias("choice"), F.col("k.value").cast("long").alias("value"), "fp")
                .repartition("choice", "value").sortWithinPartitions("choice", "value", "fp"))

    found = materialise(index(distinct, False).mapInArrow(_link_lists(max_bits, long_list), "a long, b long"),
                        "simhash-links")
    again = found.filter(F.col("a").isNull()).select(F.col("b").alias("fp")).distinct()
    pairs = found.filter(F.col("a").isNotNull())
    if again.isEmpty():
        return pairs
    # At most 2 ** (8 * max_bits) fingerprints share a refined key.
    more = index(again, True).mapInArrow(_link_lists(max_bits, 1 << 62), "a long, b long")
    return pairs.unionByName(materialise(more, "simhash-links-2"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    long_list: int = LONG) -> DataFrame:
    """One row per document: doc_id, text_key, fp, root (a fingerprint naming the
    component), component_id (smallest non-null doc_id of the component).

    Null and empty texts have fingerprint 0 and are linked like any other.  Texts with
    fewer words than a shingle are one shingle.  Repeated rows share a fingerprint and
    stay as rows.  A component of null ids only has a null component_id.  An empty table
    gives an empty result; other columns are ignored.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-rows", **TEXT_BATCHES)
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    tied = components(links(classes.select("fp"), max_bits, long_list))
    placed = (classes.join(tied, F.col("fp") == F.col("node"), "left")
              .select("fp", "first_id", F.coalesce("component", "fp").alias("root")))
    roots = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = materialise(placed.join(roots, "root").select("fp", "root", "component_id"), "simhash-member")
    release(classes)
    return rows.join(member, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
          max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the
    smallest id stays (null ids last; among equal ids the smallest text hash, then any)."""
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best")
    best = materialise(found.groupBy("root").agg(first)
                       .select(F.col("best.doc_id").alias("id"), F.col("best.text_key").alias("key")), "simhash-best")
    # The row travels as one value, so no column of its own meets those made here.
    key = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").cast("long").alias("own"), key.alias("hash"))
    kept = rows.join(best, F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("key")), "left_semi")
    order = Window.partitionBy("own", "hash").orderBy(F.xxhash64("row"))
    return kept.withColumn("at", F.row_number().over(order)).filter(F.col("at") == 1).select("row.*")
