"""Quality classifier: labelled neighbours vote in a latent-semantic space.

A text is a vector of terms: hashed words, hashed 4-grams of character classes, how far
back each word stood last, and the text's length.  Term weights are square roots of counts times
inverse document frequencies; the leading right singular vectors of the labelled texts'
matrix span the latent space.  The labelled vectors are broadcast, every text's cosines
with all of them are computed exactly in blocks, and its nearest neighbours vote for their
label with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.batches import Words, row_slices, texts_of
from tabulon.llm.quality_rules import gram_buckets, quality_marks
from tabulon.llm.scratch import materialise, release

#: Labelled documents per quality that are learned from (by hash order of their ids).  They
#: are the broadcast vectors, so this bounds the model: 2 * SAMPLE_DOCS * DIMENSIONS floats.
SAMPLE_DOCS = 4000
DIMENSIONS = 32
NEIGHBOURS = 25
#: A neighbour's vote weighs its cosine to this power.
SHARPNESS = 4.0
#: Score from which a text is predicted to be good.
THRESHOLD = 0.3
GRAM = 4
GRAM_TERMS = 1 << 12
WORD_TERMS = 1 << 12
#: A word that stood 1, 2, .. back, further back in the text, or never.
BACK = 4
LENGTH_TERMS = 32
TERMS = GRAM_TERMS + WORD_TERMS + BACK + 2 + LENGTH_TERMS
#: Rounds of subspace iteration, further directions carried along, tasks that share them.
ROUNDS = 4
SPARE = 16
FIT_TASKS = 8
#: Texts whose dense term counts are held at once.
BLOCK_ROWS = 256
#: Letters, capitals, digits and white space by class; other ASCII characters by themselves.
_CLASS = np.array([97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57
                   else 32 if c in b"\t\x0b\x0c\r" else c for c in range(256)], dtype=np.uint8)


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of every term, texts x TERMS."""
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = _CLASS[np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]]
    bounds = bounds - bounds[0]
    keys = []
    grams = gram_buckets(data, GRAM, GRAM_TERMS)
    owner = np.repeat(np.arange(n), np.diff(bounds))[:len(grams)]
    inside = np.arange(len(grams)) + GRAM <= bounds[owner + 1]
    keys.append((owner * TERMS + grams)[inside])
    words = Words(texts, join=False)
    ids, distinct = words.encoded()
    row = words.text_of_word * TERMS + GRAM_TERMS
    if len(ids):
        hashed = np.fromiter((xxhash.xxh64_intdigest(w.lower().encode()) % WORD_TERMS for w in distinct.to_pylist()),
                             dtype=np.int64, count=len(distinct))
        keys += [row + hashed[ids], row + WORD_TERMS + _distance(ids, words)]
    sizes = np.minimum(np.log2(words.counts + 1.0).astype(np.int64), LENGTH_TERMS - 1)
    keys.append(np.arange(n) * TERMS + TERMS - LENGTH_TERMS + sizes)
    return np.bincount(np.concatenate(keys), minlength=n * TERMS).reshape(n, TERMS)


def _distance(ids: np.ndarray, words: Words) -> np.ndarray:
    """0 .. BACK - 1: the same word 1 .. BACK words before; BACK: further back; BACK + 1: new."""
    span = int(ids.max()) + 1
    key = words.text_of_word * span + ids
    order = np.argsort(key, kind="stable")
    gap = np.full(len(ids), BACK + 1, dtype=np.int64)
    again = np.flatnonzero(np.diff(key[order]) == 0)
    gap[order[again + 1]] = np.minimum(order[again + 1] - order[again] - 1, BACK)
    return gap


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of the square roots of counts times idf."""
    x = np.sqrt(counts.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches, "text"):
        for i in range(0, part.num_rows, BLOCK_ROWS):
            yield part.slice(i, BLOCK_ROWS)


class Space:
    """The latent space: ``idf`` of every term and ``axes`` (terms x dimensions)."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray):
        self.idf, self.axes = idf, axes

    def vectors(self, texts: pa.Array) -> np.ndarray:
        """Unit vectors of texts; zero where nothing of a text lies in the space."""
        x = weights(term_counts(texts), self.idf) @ self.axes
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.where(size > 1e-6, x / np.maximum(size, 1e-6), 0).astype(np.float32)


def _summed(sample: DataFrame, partial, shape: tuple) -> np.ndarray:
    """Sum over the sample of ``partial(texts)``; each of at most FIT_TASKS tasks sends one array."""
    def add(batches):
        total = np.zeros(shape, dtype=np.float64)
        for block in blocks(batches):
            total += partial(texts_of(block, "text"))
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["x"])

    rows = sample.select("text").coalesce(FIT_TASKS).mapInArrow(add, "x binary").collect()
    return sum((np.frombuffer(r["x"], dtype=np.float32).astype(np.float64).reshape(shape) for r in rows), np.zeros(shape))


def fit_space(sample: DataFrame, dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> Space:
    """The leading right singular vectors of the sample's matrix by subspace iteration."""
    spark = sample.sparkSession
    n = sample.count()
    found = _summed(sample, lambda t: (term_counts(t) > 0).sum(axis=0), (TERMS,))
    idf = (np.log((1.0 + n) / (1.0 + found)) + 1.0).astype(np.float32)
    width = dimensions + SPARE
    axes = np.linalg.qr(np.random.default_rng(1).standard_normal((TERMS, width)))[0].astype(np.float32)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((idf, axes))  # terms x width floats

        def multiply(texts, shared=shared):
            x = weights(term_counts(texts), shared.value[0])
            return x.T @ (x @ shared.value[1])

        image = _summed(sample, multiply, (TERMS, width))
        axes = np.linalg.qr(image)[0].astype(np.float32)
        shared.unpersist()
    # The last image orders the directions by their share of the sample.
    _, _, turn = np.linalg.svd(image.T @ axes, full_matrices=False)
    return Space(idf, np.ascontiguousarray(axes @ turn.T[:, :dimensions].astype(np.float32)))


def votes(vectors: np.ndarray, known: np.ndarray, good: np.ndarray, balance: np.ndarray, k: int,
          sharpness: float) -> np.ndarray:
    """Share of label 1 among the weighted votes of the ``k`` nearest labelled vectors; all
    that are as near as the last one vote as well."""
    near = vectors @ known.T
    k = min(k, near.shape[1])
    last = np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]]
    weight = np.where(near >= last, np.maximum(near, 1e-6) ** sharpness, 0.0) * balance
    yes, no = weight @ good, weight @ (1.0 - good)
    return yes / (yes + no)


def labelled_sample(labels: DataFrame, sample_docs: int) -> DataFrame:
    """(__id, quality): at most ``sample_docs`` distinct ids per quality 0 and 1."""
    marks = quality_marks(labels)
    sizes = marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    # A first cut by the share that is wanted (four times over) leaves few rows to rank.
    share = F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    order = Window.partitionBy("quality").orderBy(share, "__id")
    return materialise(marks.join(sizes, "quality").filter(share * F.col("n") < 4.0 * sample_docs)
                       .withColumn("at", F.row_number().over(order)).filter(F.col("at") <= sample_docs)
                       .select("__id", "quality"), "quality-sample")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        sample_docs: int = SAMPLE_DOCS, dimensions: int = DIMENSIONS):
    """(space, labelled vectors, labels) from at most ``sample_docs`` documents per quality
    whose crc32(id as text) mod 5 is not 0."""
    learned = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 != 0
    # At most 2 * sample_docs ids, so they are broadcast and no text is shuffled.
    marks = labelled_sample(labels.filter(learned).select(F.col(f"`{id_col}`").alias("doc_id"), "quality"), sample_docs)
    sample = materialise(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text"))
                         .join(F.broadcast(marks), "__id").select("__id", "quality", "text"), "neighbour-sample")
    if sample.isEmpty():
        return None
    space = fit_space(sample, dimensions)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def embed(batches):
        for block in blocks(batches):
            v = shared.value.vectors(texts_of(block, "text"))
            yield pa.RecordBatch.from_arrays(
                [block.column("quality"), pa.array([x.tobytes() for x in v], pa.binary())], names=["quality", "v"])

    rows = sample.mapInArrow(embed, "quality int, v binary").collect()
    release(sample, marks)
    # In a stated order, so that the model doesn't depend on the tasks' order.
    rows.sort(key=lambda r: (r["quality"], bytes(r["v"])))
    return (space, np.array([np.frombuffer(r["v"], dtype=np.float32) for r in rows]),
            np.array([float(r["quality"]) for r in rows]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             sample_docs: int = SAMPLE_DOCS, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS,
             sharpness: float = SHARPNESS, threshold: float = THRESHOLD, model=None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``labels`` (doc_id, quality 0 or 1) mark documents; only those whose crc32(id as text)
    mod 5 is not 0 are learned from, and a bounded number of them.  Both qualities
    have equal weight as a whole, however many rows of each are labelled.  ``score``: the
    share of quality 1 in the neighbours' votes.  A text without any word is scored like
    others, by its length; without labelled documents every score is 0.5.  Labels of other
    values and null ids are ignored, contradicting labels of one id count as both, a
    repeated label once.  A null id is never held out.  Repeated rows are scored one by
    one; an empty table gives no rows; other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held_out"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    model = model or fit(docs, labels, id_col, text_col, sample_docs, dimensions)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for block in blocks(batches):
            score = np.full(block.num_rows, 0.5)
            if shared.value:
                space, known, good = shared.value
                share = np.where(good == 1, 1.0 / max(good.sum(), 1), 1.0 / max((1 - good).sum(), 1))
                score = votes(space.vectors(texts_of(block, "text")), known, good, share, neighbours, sharpness)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(score, pa.float64()),
                 pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")
