"""Substring dedup by windows of words, with super-k-mer partitioning.

Windows of ``window`` consecutive words are grouped by their minimiser (the smallest
hash among their ``gram``-word grams); consecutive windows with one minimiser travel
as one packed string to its bucket.  There equal windows are brought together by
sorting exact word sequences, and a window counts as repeated in a document when its
words also start in a document with a smaller id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.batches import Words, mix64, row_slices, sliding_min, texts_of
from tabulon.llm.scratch import materialise
from tabulon.llm.superkmers import (BLOCK_SCHEMA, BUCKET_BOUND, BUCKET_BYTES, FOUND_SCHEMA, NULL_ID, Strings,
                                    bucket_count, buckets_of, found_spans, keyed, pack, piece_batches, ranks, runs,
                                    spans_batch, widened)

WINDOW = 13
GRAM = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Low bits that hold a gram's position; the rest is the hash that orders grams.
_AT = np.uint64((1 << 30) - 1)


def pack_slice(texts: pa.Array, doc: np.ndarray, key: np.ndarray, window: int, gram: int, buckets: int):
    import xxhash
    words = Words(texts)
    n = len(words.sizes)
    if n < window:
        return None
    ids, distinct = words.encoded()
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), dtype=np.uint64,
                        count=len(distinct))
    h = table[ids]
    grams = h[:n - gram + 1].copy()
    for k in range(1, gram):
        grams = grams * _BASE + h[k:n - gram + 1 + k]
    grams = mix64(grams)
    # The position in the low bits makes ties fall to the leftmost gram.
    low = sliding_min((grams & ~_AT) | (np.arange(len(grams), dtype=np.uint64) & _AT), window - gram + 1)
    at = np.arange(len(low))
    owner = words.text_of_word[:len(low)]
    valid = (at + window <= words.first[owner + 1]) & (doc[owner] != NULL_ID)
    first, length = runs(valid, (low & _AT).astype(np.int64))
    if not len(first):
        return None
    begin = words.start[first]
    end = words.end[first + length - 1 + window - 1]
    who = owner[first]
    chosen = mix64(grams[(low[first] & _AT).astype(np.int64)])
    return pack(bytes(words.joined), begin, end, chosen, doc[who], key[who],
                first - words.first[who], buckets)


def _word_ids(strings: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact word ids of all strings back to back, words per string, first word of each."""
    offsets = np.concatenate((strings.starts, [len(strings.text)])).astype(np.int32)
    arr = pa.Array.from_buffers(pa.string(), len(strings), [None, pa.py_buffer(offsets), pa.py_buffer(strings.text)])
    words = Words(arr, join=False)
    return words.encoded()[0], words.counts, words.first[:-1]


def solve(strings: Strings, window: int):
    """Spans of one bucket: per place, runs of windows that also start in a smaller document."""
    place_string = np.repeat(np.arange(len(strings)), strings.n_places)
    place_mark = strings.mark[place_string]
    # Only minimisers that occur in two documents can bring windows together.
    order = np.lexsort((strings.doc, place_mark))
    m, d = place_mark[order], strings.doc[order]
    start = np.concatenate(([0], np.flatnonzero(np.diff(m)) + 1))
    stop = np.append(start[1:], len(m)) - 1
    shared = m[start][d[start] != d[stop]]
    rows = np.flatnonzero(np.isin(strings.mark, shared))
    if not len(rows):
        return None
    strings = strings.pick(rows)
    ids, counts, first = _word_ids(strings)
    rank, have = ids, 1
    while have < window:
        step = min(have, window - have)
        rank = ranks(rank[:-step], rank[step:])
        have += step
    n_windows = counts - window + 1
    string_of = np.repeat(np.arange(len(strings)), n_windows)
    offset = np.arange(len(string_of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    rank = rank[first[string_of] + offset]
    smallest = np.minimum.reduceat(strings.doc, strings.first_place)
    lowest = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, rank, smallest[string_of])
    lowest = lowest[rank]
    # Places of a string share its windows; a place is hit where a smaller document has them.
    return _place_spans(strings, n_windows, lowest, window)


def _place_spans(strings: Strings, n_windows: np.ndarray, lowest: np.ndarray, window: int):
    from tabulon.llm.batches import ragged
    place_string = np.repeat(np.arange(len(strings)), strings.n_places)
    from_window = np.cumsum(n_windows) - n_windows
    out = []
    step = max(1, (1 << 20) // int(n_windows.max()))
    for i in range(0, len(place_string), step):
        owner = place_string[i:i + step]
        sizes = n_windows[owner]
        place = np.repeat(np.arange(len(owner)), sizes)
        at = ragged(from_window[owner], sizes)
        hit = lowest[at] < strings.doc[i:i + step][place]
        first, length = runs(hit, place)
        if len(first):
            who = place[first] + i
            begin = strings.at[who] + at[first] - from_window[place_string[who]]
            out.append(spans_batch(strings.key[who], begin, begin + length - 1 + window))
    return out


def repeated_spans(rows: DataFrame, window: int = WINDOW,
                   gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, bucket_bound: int = BUCKET_BOUND) -> DataFrame:
    """Spans (key, start, stop) of words covered by repeated windows."""
    if not 1 <= gram < window:
        raise ValueError("gram must be at least 1 and below window")
    # A super-k-mer of (window - gram + 2) / 2 windows on average carries window - 1 words more.
    run = (window - gram + 2) / 2
    buckets = bucket_count(rows, "text", (run + window - 1) / run, bucket_bytes)

    def emit(batches):
        for batch in row_slices(batches, "text"):
            out = pack_slice(texts_of(batch, "text"), batch.column("doc").to_numpy(),
                             batch.column("key").to_numpy(), window, gram, buckets)
            if out is not None:
                yield out

    def work(batches):
        for whole, strings in buckets_of(batches, bucket_bound):
            if whole:
                yield from map(widened, solve(strings, window) or ())
            else:
                yield from map(widened, piece_batches(strings))

    def windows_of(string):
        words = string.split(b" ")
        return [b" ".join(words[k:k + window]) for k in range(len(words) - window + 1)]

    blocks = rows.mapInArrow(emit, BLOCK_SCHEMA)
    found = materialise(blocks.repartition("bucket").sortWithinPartitions("bucket")
                        .mapInArrow(work, FOUND_SCHEMA), "window-spans")
    return found_spans(found, windows_of, lambda doc, at, n, low_doc, low_at: low_doc < doc, window)


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, text and the row's spans as two arrays of longs (null when it has none)."""
    lists = (spans.groupBy(F.col("key").alias("k"))
             .agg(F.collect_list(F.struct("start", "stop")).alias("s"))
             .select("k", F.col("s.start").alias("starts"), F.col("s.stop").alias("stops")))
    # Spark's estimate of the spans is scaled down by the wide columns of pieces, which are null in
    # nearly all rows, and would broadcast spans far beyond its threshold.
    return (rows.join(lists.hint("merge"), F.col("key") == F.col("k"), "left")
            .select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "text", "starts", "stops"))


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Mask of the positions in any of the spans."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, stops, -1)
    return np.cumsum(change[:n]) > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES,
                     bucket_bound: int = BUCKET_BOUND) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text (the words left, joined by
    one space), kept_sha256 of that text.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes when any window over it also starts in
    a document with a smaller id; windows are judged on the input.  Null and empty texts
    have no words; texts shorter than a window stay whole.  A null id is neither smaller
    nor larger than another: such rows stay whole and remove nothing.  Repeated rows (same
    id) do not remove one another.  Whole texts are read; a task holds about fifteen
    times its longest text.  An empty table gives an empty result; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, window, gram, bucket_bytes, bucket_bound)

    def cut(batches):
        for batch in row_slices(batches, "text"):
            words = Words(texts_of(batch, "text"))
            n_words, n_removed, left, sha = [], [], [], []
            starts, stops = batch.column("starts"), batch.column("stops")
            own = words.strings.to_pylist()
            for i in range(words.n):
                text, n, removed = own[i], int(words.counts[i]), 0
                if starts[i].is_valid:
                    gone = covered(n, starts[i].values.to_numpy(), stops[i].values.to_numpy())
                    removed = int(gone.sum())
                    text = " ".join([w for w, g in zip(text.split(" "), gone.tolist(), strict=True) if not g])
                n_words.append(n)
                n_removed.append(removed)
                left.append(text)
                sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(left, pa.string()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "text", "kept_sha256"])

    return with_spans(rows, spans).mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, text string, kept_sha256 string")
