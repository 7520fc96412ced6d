"""Arrow batch helpers shared by the operators: row slices of bounded size and
the word view of a column of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def row_slices(batches: Iterator[pa.RecordBatch], column: str,
               max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` bytes each.  What the
    task's buffers leave behind is given back after the last: a worker outlives its task."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + max_bytes, side="right"))
            stop = max(start + 1, min(stop, n))
            yield batch.slice(start, stop - start)
            start = stop
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column with nulls as empty strings."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts.

    ``flat``   all words in order (string array)
    ``first``  word offsets by text (length texts + 1)
    ``sizes``  bytes of each word
    ``joined`` the words of every text joined by one space, texts back to back
    ``start``  byte offset of each word in ``joined``; ``base`` of each text
    """

    def __init__(self, texts: pa.Array, join: bool = True):
        trimmed = pc.ascii_trim_whitespace(texts)
        lists = pc.ascii_split_whitespace(trimmed)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        counts = np.diff(offsets)
        empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
        if empty.any():
            # An empty text splits into one empty word; drop those.
            flat = flat.filter(pc.not_equal(flat, ""))
            counts = np.where(empty, 0, counts)
        self.n = len(texts)
        self.flat = flat
        self.first = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        self.counts = counts.astype(np.int64)
        self.sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        self.text_of_word = np.repeat(np.arange(self.n, dtype=np.int64), self.counts)
        if not join:
            return
        strings = pc.binary_join(lists, " ")
        self.strings = strings
        off = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset:strings.offset + self.n + 1]
        self.joined = memoryview(strings.buffers()[2] or b"")
        self.base = off.astype(np.int64)
        step = np.concatenate(([0], np.cumsum(self.sizes + 1))).astype(np.int64)
        self.start = (self.base[:-1] - step[self.first[:-1]])[self.text_of_word] + step[:-1]
        self.end = self.start + self.sizes

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """Exact ids of the words within this slice, and the distinct words."""
        d = self.flat.dictionary_encode()
        if isinstance(d, pa.ChunkedArray):
            d = d.combine_chunks()
        return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer (murmur3 finaliser) on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling window sizes."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        shift = width - have
        out = np.minimum(out[:-shift], out[shift:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for all i, back to back."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift
