"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between the
multinomials of trusted texts and of the raw corpus.

Every text is a bag of byte n-grams hashed into buckets.  The counts of all trusted texts
and of all texts give two smoothed multinomials; a text's score is the mean over its
n-grams of ``log p_trusted - log p_raw``.  A text is kept when it passes the
base rules and its score reaches the threshold; there is no random draw.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.batches import Words, row_slices, texts_of
from tabulon.llm.scratch import materialise, session_settings

GRAM = 4
BUCKETS = 1 << 14
#: Pseudo-count of every bucket.
PSEUDO = 1.0
MIN_WORDS = 50
#: Most percent of words that may stand in repeated three-word windows.
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
SYMBOLS = r"[#*$%&|<>]"
#: Score from which a text is kept when no labels fit one.
THRESHOLD = -0.25
#: Width of the score bins on which a threshold is fitted.
BIN = 0.01
#: Where the trusted ids are too many to be broadcast, Spark keeps other texts out of the
#: join's shuffle with a Bloom filter of them (it then takes any size of either side).
_PREFILTER = {"spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
              "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
              "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
              "spark.sql.optimizer.runtime.bloomFilter.numBits": "67108864"}
_MULT = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(data: np.ndarray, gram: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte (the last few starts are cut off)."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        h = (h << np.uint64(8)) | data[k:k + n]
    return ((h * _MULT) >> np.uint64(40)).astype(np.int64) % buckets


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds.astype(np.int64) - bounds[0]


def _inside(bounds: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Text of each n-gram start, and whether the n-gram ends within that text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    return owner, np.arange(n) + gram <= bounds[owner + 1]


def gram_counts(docs: DataFrame, text_col: str, gram: int = GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Counts by bucket over all texts; each task sends one row per bucket it met."""
    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in row_slices(batches, text_col):
            data, bounds = _bytes_of(texts_of(batch, text_col))
            b = gram_buckets(data, gram, buckets)
            if len(b):
                total += np.bincount(b[_inside(bounds, len(b), gram)[1]], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())],
                                         names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    rows = (docs.select(F.col(text_col)).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))
    for r in rows.collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_trusted - log p_raw by bucket; all zero when there is no trusted text."""
    if not trusted.sum():
        return np.zeros(len(raw))
    p, q = trusted + PSEUDO, raw + PSEUDO
    return np.log(p / p.sum()) - np.log(q / q.sum())


def text_scores(texts: pa.Array, ratio: np.ndarray, gram: int) -> np.ndarray:
    data, bounds = _bytes_of(texts)
    b = gram_buckets(data, gram, len(ratio))
    n = len(bounds) - 1
    if not len(b):
        return np.zeros(n)
    owner, ok = _inside(bounds, len(b), gram)
    total = np.bincount(owner[ok], weights=ratio[b[ok]], minlength=n)
    return total / np.maximum(np.bincount(owner[ok], minlength=n), 1)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words = Words(texts, join=False)
    n = words.n
    as_int = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    space = as_int(pc.count_substring_regex(texts, r"[\x20\x09-\x0D]"))
    out = {"n_words": words.counts, "word_chars": as_int(pc.utf8_length(texts)) - space,
           "n_symbols": as_int(pc.count_substring_regex(texts, SYMBOLS))}
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy().astype(np.int64)))
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, ids = owner[full], ids[full]
    distinct = np.unique(owner * (int(ids.max(initial=0)) + 1) + ids)
    distinct_owner = distinct // (int(ids.max(initial=0)) + 1)
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(distinct_owner, minlength=n)
    out["n_repeat_words"] = _repeat_words(words)
    return out


def _repeat_words(words: Words) -> np.ndarray:
    out = np.zeros(words.n, dtype=np.int64)
    k = REPEAT_WINDOW
    if len(words.sizes) < k:
        return out
    ids, _ = words.encoded()
    rank = ids
    # Windows get exact ranks step by step, the text being part of the last one.
    for j in range(1, k):
        a, b = rank[:len(ids) - j], ids[j:]
        rank = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
    owner = words.text_of_word[:len(rank)]
    valid = np.flatnonzero(np.arange(len(rank)) + k <= words.first[owner + 1])
    both = owner[valid] * (int(rank.max()) + 1) + rank[valid]
    _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
    start = valid[count[inverse] >= 2]
    hit = np.zeros(len(words.sizes), dtype=bool)
    for j in range(k):
        hit[start + j] = True
    return np.bincount(words.text_of_word[hit], minlength=words.n).astype(np.int64)


def base_failed(counts: dict[str, np.ndarray], min_words: int, max_repeat: int) -> np.ndarray:
    return (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > max_repeat * counts["n_words"])


def fit_threshold(labelled: DataFrame, default: float = THRESHOLD) -> float:
    """``labelled``: score, quality.  The edge of a score bin with the best mean of the two
    classes' shares on their right side; the middle of the best edges when several tie.
    Without rows of both classes: ``default``."""
    bins = (labelled.filter(F.col("quality").isin(0, 1)).groupBy(F.floor(F.col("score") / BIN).alias("bin"))
            .agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                 F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("poor")))
    # Scores lie within the range of the log ratios, so the bins are few.
    rows = sorted((r["bin"], r["good"], r["poor"]) for r in bins.collect())
    good, poor = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not poor:
        return default
    edges = np.arange(rows[0][0], rows[-1][0] + 2)
    lost = np.array([sum(r[1] for r in rows if r[0] < e) for e in edges]) / good
    caught = np.array([sum(r[2] for r in rows if r[0] < e) for e in edges]) / poor
    value = caught - lost
    best = edges[value >= value.max() - 1e-12]
    return float((best[0] + best[-1]) / 2 * BIN)


def quality_marks(labels: DataFrame) -> DataFrame:
    """(__id, quality): the distinct ids of quality 0 and 1."""
    marks = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality"))
    return marks.filter(F.col("__id").isNotNull() & F.col("quality").isin(0, 1)).distinct()


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            gram: int = GRAM, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
            max_repeat: int = MAX_REPEAT_PERCENT, threshold: float | None = None) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, score, kept.

    ``labels`` (doc_id, quality): the documents of quality 1 are the trusted target; the raw
    counts cover every text of ``docs``.  With ``threshold`` None it is fitted on the score
    histogram of all documents of quality 0 and 1 that pass the base rules.  Null and empty
    texts have no words and fail the base rules; a text shorter than an n-gram scores 0.
    Without trusted texts every score is 0 and the base rules decide.  Repeated rows are
    counted and judged one by one; a label counts once however often it is repeated,
    contradicting labels of one id count as both.  An empty table gives an empty result;
    other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Ids only; their size is known once written, so Spark chooses the join.
    marks = materialise(quality_marks(labels), "quality-marks")
    trusted = base.join(marks.filter(F.col("quality") == 1), F.col("doc_id") == F.col("__id"), "left_semi")
    with session_settings(docs.sparkSession, _PREFILTER):
        target = gram_counts(trusted, "text", gram, buckets)
    ratio = log_ratio(target, gram_counts(base, "text", gram, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # `buckets` doubles

    def judge(batches):
        for batch in row_slices(batches, "text"):
            texts = texts_of(batch, "text")
            counts = base_counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(counts[c], pa.int64()) for c in COUNTS],
                 pa.array(base_failed(counts, min_words, max_repeat)), pa.array(text_scores(texts, shared.value, gram))],
                names=["doc_id", *COUNTS, "base_failed", "score"])

    ddl = (f"doc_id {base.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
           + ", base_failed boolean, score double")
    judged = base.mapInArrow(judge, ddl)
    if threshold is None:
        # Written without the texts: the labels are joined to the scores.
        judged = materialise(judged, "quality-scores")
        # The base rules decide their texts already; the threshold is for the others.
        passed = judged.filter(~F.col("base_failed")).select("doc_id", "score")
        threshold = fit_threshold(passed.join(marks, F.col("doc_id") == F.col("__id")))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
