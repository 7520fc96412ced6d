"""Embedding near-dedup by an epsilon grid order join.

Unit vectors at cosine ``t`` are ``epsilon = sqrt(2 - 2 t)`` apart, and a projection on
orthonormal directions never lengthens a distance.  Vectors of one label are sorted by
their epsilon grid cells on the leading principal directions and cut into intervals of
bounded size.  Intervals whose boxes are more than epsilon apart are never joined; the
others are joined recursively, halves with distant boxes being skipped, down to small
blocks that are compared by one matrix product.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tabulon.llm.components import components
from tabulon.llm.scratch import materialise, release

COSINE = 0.98
#: Principal directions of the grid.
DIRECTIONS = 8
#: Vectors per length on which the directions are fitted (by hash order).
FIT_VECTORS = 2048
#: Vectors per interval, and the size at which the recursion compares all pairs.
INTERVAL = 1024
LEAF = 128
_SLACK = 1e-9
#: Similarities this close to the threshold are computed again exactly.
_CLOSE = 1e-12
#: Interval pairs are large rows; a batch for Python holds few of them.
_PAIR_ROWS = {"spark__sql__execution__arrow__maxRecordsPerBatch": "16"}


def _usable(vec) -> F.Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _fit(classes: DataFrame, directions: int, fit_vectors: int) -> dict[int, np.ndarray]:
    """Leading principal directions by vector length (one small matrix per length)."""
    size = F.size("embedding")
    order = Window.partitionBy("dim").orderBy(F.xxhash64("no"), "no")
    sample = (classes.select("no", size.alias("dim")).withColumn("at", F.row_number().over(order))
              .filter(F.col("at") <= fit_vectors).select("no"))
    rows = classes.join(sample, "no", "left_semi").select(size.alias("dim"), "embedding")

    def principal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.array([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]]))
        x = x - x.mean(axis=0)
        _, vectors = np.linalg.eigh(x.T @ x)
        top = vectors[:, ::-1][:, :directions].T
        return pd.DataFrame({"dim": [key[0]], "basis": [top.reshape(-1)]})

    found = rows.groupBy("dim").applyInPandas(principal, "dim int, basis array<double>").collect()
    return {r["dim"]: np.array(r["basis"]).reshape(-1, r["dim"]) for r in found}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # Scaled first, so that squares of very large or small values stay in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _intervals(kind: np.dtype, epsilon: float, interval: int, basis):
    """Rows arrive sorted by (label, dim, cell); emits one row per interval."""

    def emit(label, dim, no, mult, vec, number):
        x = np.frombuffer(b"".join(vec), dtype=kind).reshape(len(vec), dim)
        y = _unit(x) @ basis.value[dim].T
        return {"block": number, "label": label, "dim": dim, "no": np.array(no).tobytes(),
                "mult": np.array(mult).tobytes(), "vecs": x.tobytes(), "lo": y.min(axis=0).tolist(),
                "hi": y.max(axis=0).tolist()}

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        held, key, count = ([], [], []), None, 0
        for batch in batches:
            rows = []
            for label, dim, no, mult, vec in zip(*[batch.column(c).to_pylist()
                                                   for c in ("label", "dim", "no", "mult", "vec")], strict=True):
                if held[0] and ((label, dim) != key or len(held[0]) >= interval):
                    rows.append(emit(*key, *held, base + count))
                    held, count = ([], [], []), count + 1
                key = (label, dim)
                for store, value in zip(held, (no, mult, vec), strict=True):
                    store.append(value)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)
        if held[0]:
            yield pa.RecordBatch.from_pylist([emit(*key, *held, base + count)], schema=_BLOCK)

    return run


_BLOCK = pa.schema([("block", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("no", pa.binary()),
                    ("mult", pa.binary()), ("vecs", pa.binary()), ("lo", pa.list_(pa.float64())),
                    ("hi", pa.list_(pa.float64()))])
_BLOCK_DDL = ("block long, label string, dim int, no binary, mult binary, vecs binary, "
              "lo array<double>, hi array<double>")


def _exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.astype(np.float64).tolist(), b.astype(np.float64).tolist()
    dot = math.fsum(x * y for x, y in zip(a, b, strict=True))
    return dot / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))


class _Side:
    def __init__(self, vecs: bytes, dim: int, kind, basis: np.ndarray):
        self.raw = np.frombuffer(vecs, dtype=kind).reshape(-1, dim)
        self.unit = _unit(self.raw)
        self.at = self.unit @ basis.T

    def __len__(self):
        return len(self.raw)


def _join(a: _Side, b: _Side, same: bool, cosine: float, epsilon: float):
    """Index pairs (i, j) with cosine of at least ``cosine``; for one side joined with
    itself only i < j."""
    left, right = [], []
    limit = epsilon * epsilon + _SLACK

    def visit(a0, a1, b0, b1):
        if same and b1 <= a0 + 1:
            return
        ya, yb = a.at[a0:a1], b.at[b0:b1]
        gap = np.maximum(0, np.maximum(ya.min(axis=0) - yb.max(axis=0), yb.min(axis=0) - ya.max(axis=0)))
        if (gap * gap).sum() > limit:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            sim = a.unit[a0:a1] @ b.unit[b0:b1].T
            for i, j in np.argwhere(np.abs(sim - cosine) <= _CLOSE):
                sim[i, j] = 2 * (_exact_cosine(a.raw[a0 + i], b.raw[b0 + j]) >= cosine) - 1
            i, j = np.nonzero(sim >= cosine)
            i, j = i + a0, j + b0
            if same:
                i, j = i[i < j], j[i < j]
            left.append(i)
            right.append(j)
            return
        cuts_a = [a0, (a0 + a1) // 2, a1] if a1 - a0 > LEAF else [a0, a1]
        cuts_b = [b0, (b0 + b1) // 2, b1] if b1 - b0 > LEAF else [b0, b1]
        for p in range(len(cuts_a) - 1):
            for q in range(len(cuts_b) - 1):
                if not (same and cuts_b[q + 1] <= cuts_a[p]):
                    visit(cuts_a[p], cuts_a[p + 1], cuts_b[q], cuts_b[q + 1])

    visit(0, len(a), 0, len(b))
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def _pair_rows(kind, cosine: float, epsilon: float, basis):
    """Per interval pair: for every linked vector its links there (copies counted) and the
    smallest number of its local component, so the output is linear in the interval."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                directions = basis.value[row["dim"]]
                same = row["block"] == row["block_b"]
                a = _Side(row["vecs"], row["dim"], kind, directions)
                b = a if same else _Side(row["vecs_b"], row["dim"], kind, directions)
                i, j = _join(a, b, same, cosine, epsilon)
                if not len(i):
                    continue
                no, mult = np.frombuffer(row["no"], dtype=np.int64), np.frombuffer(row["mult"], dtype=np.int64)
                if not same:
                    no = np.concatenate((no, np.frombuffer(row["no_b"], dtype=np.int64)))
                    mult = np.concatenate((mult, np.frombuffer(row["mult_b"], dtype=np.int64)))
                    j = j + len(a)
                n = np.zeros(len(no), dtype=np.int64)
                np.add.at(n, i, mult[j])
                np.add.at(n, j, mult[i])
                label = no.copy()
                while True:
                    before = label.copy()
                    np.minimum.at(label, i, label[j])
                    np.minimum.at(label, j, label[i])
                    if np.array_equal(before, label):
                        break
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(no[hit]), pa.array(n[hit]), pa.array(label[hit])],
                                                 names=["no", "n", "tie"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 cosine: float = COSINE, directions: int = DIRECTIONS, interval: int = INTERVAL,
                 fit_vectors: int = FIT_VECTORS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and their cosine is at least ``cosine``.
    Null, empty and zero vectors, those with null or non-finite components and those
    without a label link with nothing, and so do vectors of different lengths.  Equal
    vectors of one label are compared once, as a class; every row counts in n_links, so a
    repeated row links with its copy.  component_id is the smallest non-null id reachable;
    a row without an id takes part, and its component_id is null when no id is reachable.
    kept is true when both ids are equal or both null.  An empty table gives an empty
    result; other columns are ignored.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"),
                          F.col(label_col).cast("string").alias("label"))
    single = isinstance(vectors.schema[vec_col].dataType.elementType, FloatType)
    kind = np.dtype("<f4" if single else "<f8")
    if not single:
        base = base.withColumn("embedding", F.col("embedding").cast("array<double>"))
    good = _usable(F.col("embedding")) & F.col("label").isNotNull()
    classes = materialise(
        base.filter(good).groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("mult"))
        .withColumn("no", F.monotonically_increasing_id()), "vector-classes")
    basis = vectors.sparkSession.sparkContext.broadcast(_fit(classes, directions, fit_vectors))
    width = max(epsilon, 1e-6)

    def cells(batches):
        for batch in batches:
            lists = batch.column("embedding").to_pylist()
            dims = np.array([len(v) for v in lists], dtype=np.int32)
            cell: list = [None] * len(lists)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                y = _unit(np.array([lists[i] for i in rows], dtype=np.float64)) @ basis.value[int(d)].T
                for i, c in zip(rows.tolist(), np.floor(y / width).astype(np.int32).tolist(), strict=True):
                    cell[i] = c
            yield pa.RecordBatch.from_arrays(
                [batch.column("no"), batch.column("label"), batch.column("mult"), pa.array(dims),
                 pa.array(cell, pa.list_(pa.int32())),
                 pa.array([np.array(v, dtype=kind).tobytes() for v in lists], pa.binary())],
                names=["no", "label", "mult", "dim", "cell", "vec"])

    gridded = classes.select("no", "label", "mult", "embedding").mapInArrow(
        cells, "no long, label string, mult long, dim int, cell array<int>, vec binary")
    order = ["label", "dim", "cell", "no"]
    blocks = materialise(gridded.repartitionByRange(*order).sortWithinPartitions(*order)
                         .mapInArrow(_intervals(kind, epsilon, interval, basis), _BLOCK_DDL), "vector-blocks")
    pairs = _interval_pairs(blocks, epsilon, width)
    b = blocks.select(F.col("block").alias("block_b"), F.col("no").alias("no_b"), F.col("mult").alias("mult_b"),
                      F.col("vecs").alias("vecs_b"))
    joined = (pairs.join(blocks.select("block", "dim", "no", "mult", "vecs"), "block").join(b, "block_b")
              # A pair with itself needs its vectors once.
              .withColumn("vecs_b", F.when(F.col("block") != F.col("block_b"), F.col("vecs_b"))))
    found = materialise(joined.mapInArrow(_pair_rows(kind, cosine, epsilon, basis), "no long, n long, tie long"),
                        "vector-links", **_PAIR_ROWS)
    tied = components(found.select(F.col("no").alias("a"), F.col("tie").alias("b")))
    counts = found.groupBy("no").agg(F.sum("n").alias("n"))
    placed = (classes.join(counts, "no", "left").join(tied, F.col("no") == F.col("node"), "left")
              .select("label", "embedding", "first_id", F.coalesce("component", "no").alias("root"),
                      (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    roots = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = materialise(placed.join(roots, "root").select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), "n_links", "component_id"), "vector-member")
    release(blocks, found, classes)
    linked = (base.filter(good).join(member, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")))
              .select("vec_id", "n_links", "component_id"))
    alone = base.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                      F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _interval_pairs(blocks: DataFrame, epsilon: float, width: float) -> DataFrame:
    """(block, block_b) with block <= block_b whose boxes are at most epsilon apart.  Boxes
    meet by the cells of the two leading directions that they touch."""
    def touched(grow: int) -> F.Column:
        def cells(k):
            low = F.floor(F.element_at("lo", k) / width) - F.lit(grow)
            high = F.floor(F.element_at("hi", k) / width) + F.lit(grow)
            return F.when(F.size("lo") >= k, F.sequence(low, high)).otherwise(F.array(F.lit(0).cast("long")))
        return F.transform(cells(1), lambda c: F.transform(cells(2), lambda d: F.struct(c.alias("c"), d.alias("d"))))

    meta = blocks.select("block", "label", "dim", "lo", "hi")
    own = meta.withColumn("cell", F.explode(F.flatten(touched(0))))
    near = meta.select(*[F.col(c).alias(f"{c}_b") for c in meta.columns], F.flatten(touched(1)).alias("cells"))
    near = near.withColumn("cell", F.explode("cells")).drop("cells")
    gap = F.aggregate(
        F.zip_with(F.arrays_zip("lo", "hi"), F.arrays_zip(F.col("lo_b").alias("lo"), F.col("hi_b").alias("hi")),
                   lambda a, b: F.greatest(F.lit(0.0), a["lo"] - b["hi"], b["lo"] - a["hi"])),
        F.lit(0.0), lambda s, g: s + g * g)
    return (own.join(near, (F.col("label") == F.col("label_b")) & (F.col("dim") == F.col("dim_b"))
                     & (own["cell"] == near["cell"]))
            .filter((F.col("block") <= F.col("block_b")) & (gap <= F.lit(epsilon * epsilon + _SLACK)))
            .select("block", "block_b").distinct())
