"""Suffix-array dedup: byte strings of a given length that occur more than once.

Equal strings of ``length`` bytes have equal minimisers among their ``gram``-byte
grams, so super-k-mers of bytes bring all places of a string into one bucket.  There
the distinct packed strings are laid out by minimiser and their suffixes sorted to
``length`` bytes by doubling, those of settled windows left out on the way.  In suffix order, with ties in text order, the
previous smaller position and the next one of a suffix that shares ``length`` bytes
are its neighbours in the run of equal prefixes: the longest-previous-factor entry
reaches ``length`` exactly when the run has an earlier member.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.batches import SLICE_BYTES, mix64, ragged, row_slices, sliding_min, texts_of
from tabulon.llm.scratch import materialise
from tabulon.llm.substring_dedup import covered, with_spans
from tabulon.llm.superkmers import (BLOCK_SCHEMA, BUCKET_BOUND, BUCKET_BYTES, FOUND_SCHEMA, Strings,
                                    bucket_count, buckets_of, found_spans, keyed, pack, piece_batches, runs, spans_batch,
                                    widened)

LENGTH = 400
GRAM = 24
#: Bytes of strings whose suffixes are sorted at once: the arrays stay in the processor's cache.
SORT_BYTES = 1 << 17
#: Bits of the word that holds a sort key and its position.
_WORD = 63
_BASE = 0x9E3779B97F4A7C15 | 1
_AT = np.uint64((1 << 30) - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` consecutive bytes, by doubling the hashed length."""
    have, part = 1, data.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    while True:
        if gram & have:
            if out is None:
                out, done = part, have
            else:
                m = len(part) - done
                out = out[:m] * np.uint64(pow(_BASE, have, 1 << 64)) + part[done:]
                done += have
        have *= 2
        if have > gram:
            return mix64(out[:len(data) - gram + 1])
        part = part[:len(part) - have // 2] * np.uint64(pow(_BASE, have // 2, 1 << 64)) + part[have // 2:]


def _emit(buf: bytes, bounds: np.ndarray, doc: np.ndarray, key: np.ndarray, shift: np.ndarray, length: int,
          gram: int, buckets: int):
    """Blocks for texts back to back in ``buf``; ``shift``: byte offset of each in its document."""
    data = np.frombuffer(buf, dtype=np.uint8)
    if len(data) < length:
        return None
    grams = gram_hashes(data, gram)
    low = sliding_min((grams & ~_AT) | (np.arange(len(grams), dtype=np.uint64) & _AT), length - gram + 1)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:len(low)]
    valid = np.arange(len(low)) + length <= bounds[owner + 1]
    low = (low & _AT).astype(np.int64)
    first, n = runs(valid, low)
    if not len(first):
        return None
    who = owner[first]
    return pack(buf, first, first + n + length - 1, mix64(grams[low[first]]), doc[who], key[who],
                first - bounds[who] + shift[who], buckets)


def pack_slice(texts: pa.Array, doc: np.ndarray, key: np.ndarray, length: int, gram: int, buckets: int):
    """Blocks of a slice; a very long text is read in overlapping stretches."""
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    data = memoryview(texts.buffers()[2] or b"")
    if len(texts) > 1 or bounds[-1] - bounds[0] <= 2 * SLICE_BYTES:
        out = _emit(bytes(data[bounds[0]:bounds[-1]]), bounds - bounds[0], doc, key,
                    np.zeros(len(doc), dtype=np.int64), length, gram, buckets)
        if out is not None:
            yield out
        return
    for a in range(int(bounds[0]), int(bounds[1]), SLICE_BYTES):
        part = bytes(data[a:min(a + SLICE_BYTES + length - 1, int(bounds[1]))])
        out = _emit(part, np.array([0, len(part)]), doc, key, np.array([a - bounds[0]]), length, gram, buckets)
        if out is not None:
            yield out


def repeated_suffixes(text: bytes, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings back to back in ``text``: where those windows of ``length`` bytes start that
    also start elsewhere, in suffix order, and which of them begin a run of equal windows.

    Suffixes are ranked by doubling.  One that is alone at some depth has no equal at any
    greater one, so the windows over its bytes are settled; the next round sorts only the
    suffixes in windows that are not."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(data)
    starts = np.cumsum(sizes) - sizes
    window = ragged(starts, sizes - length + 1)
    # First round: as many bytes as fit into a word beside the position.
    used = np.bincount(data, minlength=256) > 0
    codes = (np.cumsum(used) - 1).astype(np.uint8)[data]
    bits, width = n.bit_length(), max(1, (int(used.sum()) - 1).bit_length())
    have = min(length, (_WORD - bits) // width)
    key = codes[:n - have + 1].astype(np.int64)
    for k in range(1, have):
        key <<= width
        key |= codes[k:n - have + 1 + k]
    at, low = ragged(starts, sizes - have + 1), width * have
    key = key[at]
    rank = np.zeros(n, dtype=np.int32)
    while True:
        if int(key.max()).bit_length() + bits <= _WORD:
            # The position in the low bits: a sort of plain words is several times faster than argsort.
            key <<= bits
            key |= at
            key.sort()
            at = key & ((1 << bits) - 1)
            key >>= bits
        else:
            order = np.argsort(key)
            key, at = key[order], at[order]
            del order
        head = np.concatenate(([True], key[1:] != key[:-1]))
        alone = head & np.append(head[1:], True)
        if have == length:
            return at[~alone], head[~alone]
        before = np.zeros(n + 1, dtype=bool)
        before[at + 1] = alone
        before = np.cumsum(before, dtype=np.int32)
        window = window[before[window + length - have + 1] == before[window]]
        del before
        if not len(window):
            return window, np.zeros(0, dtype=bool)
        # A rank is the place of the group's first suffix in suffix order.
        key >>= low
        outer = np.concatenate(([True], key[1:] != key[:-1]))
        index = np.arange(len(at), dtype=np.int32)
        key += np.maximum.accumulate(np.where(head, index, 0))
        key -= np.maximum.accumulate(np.where(outer, index, 0))
        del index
        rank[at] = key
        step = min(have, length - have)
        have += step
        gap = np.flatnonzero(np.diff(window) != 1)
        change = np.zeros(n + 1, dtype=np.int8)
        change[window[np.append(0, gap + 1)]] = 1
        change[window[np.append(gap, len(window) - 1)] + length - have + 1] -= 1
        keep = (np.cumsum(change, dtype=np.int32) > 0)[at]
        at, key = at[keep], key[keep]
        key <<= bits
        key |= rank[at + step]
        low = bits


def _merge(strings: Strings) -> Strings:
    """Equal strings of different slices as one, with all their places."""
    cuts = zip(strings.starts.tolist(), (strings.starts + strings.sizes).tolist(), strict=True)
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(strings.text[a:b], len(seen)) for a, b in cuts], dtype=np.int64)
    if len(seen) == len(number):
        return strings
    order = np.argsort(number, kind="stable")
    where = ragged(strings.first_place[order], strings.n_places[order])
    first = order[np.concatenate(([0], np.flatnonzero(np.diff(number[order])) + 1))]
    n_places = np.bincount(number, weights=strings.n_places).astype(np.int64)
    return Strings(b"".join(seen), strings.sizes[first], strings.mark[first], n_places,
                   strings.doc[where], strings.key[where], strings.at[where])


def mark_groups(strings: Strings, rows: np.ndarray):
    """The strings ``rows`` by mark, in groups of about SORT_BYTES; a mark is never divided."""
    rows = rows[np.argsort(strings.mark[rows], kind="stable")]
    if not len(rows):
        return
    new = np.concatenate(([True], np.diff(strings.mark[rows]) != 0))
    begin = (np.cumsum(strings.sizes[rows]) - strings.sizes[rows])[new]
    part = (begin // SORT_BYTES)[np.cumsum(new) - 1]
    yield from np.split(rows, np.flatnonzero(np.diff(part)) + 1)


def solve(strings: Strings, length: int, keep_first: bool):
    """Spans of one bucket: places whose strings occur elsewhere (earlier, for keep_first)."""
    _, group = np.unique(strings.mark, return_inverse=True)
    total = np.bincount(group, weights=strings.n_places)
    rows = np.flatnonzero(total[group] >= 2)
    if not len(rows):
        return []
    strings = _merge(strings.pick(rows))
    _, group = np.unique(strings.mark, return_inverse=True)
    mixed = np.bincount(group)[group] >= 2
    n_windows = strings.sizes - length + 1
    from_window = np.cumsum(n_windows) - n_windows
    string_of = np.repeat(np.arange(len(strings)), n_windows)
    # Earliest place of each string, in text order.
    place_string = np.repeat(np.arange(len(strings)), strings.n_places)
    order = np.lexsort((strings.at, strings.doc, place_string))
    early = order[np.cumsum(strings.n_places) - strings.n_places]
    repeated = (strings.n_places >= 2)[string_of]
    first_here = np.ones(len(string_of), dtype=bool)
    starts = strings.starts
    # Suffix order of the strings that share a minimiser with a different string.
    for some in mark_groups(strings, np.flatnonzero(mixed)):
        sizes = strings.sizes[some]
        text = b"".join([strings.text[a:a + n] for a, n in zip(starts[some].tolist(), sizes.tolist(), strict=True)])
        at, run_start = repeated_suffixes(text, sizes, length)
        mine = np.searchsorted(np.cumsum(sizes), at, side="right")
        offset = at - (np.cumsum(sizes) - sizes)[mine]
        mine = some[mine]
        window, place = from_window[mine] + offset, early[mine]
        # A run has two members or more: each has a previous or a next factor of `length` bytes.
        repeated[window] = True
        suffix = np.lexsort((strings.at[place] + offset, strings.doc[place], np.cumsum(run_start)))
        first_here[window[suffix]] = run_start
    out = []
    step = max(1, (1 << 20) // int(n_windows.max()))
    for i in range(0, len(place_string), step):
        owner = place_string[i:i + step]
        sizes = n_windows[owner]
        place = np.repeat(np.arange(len(owner)), sizes)
        at = ragged(from_window[owner], sizes)
        hit = repeated[at]
        if keep_first:
            mine = ((strings.doc[early[owner]] == strings.doc[i:i + step])
                    & (strings.at[early[owner]] == strings.at[i:i + step]))
            hit = hit & ~(mine[place] & first_here[at])
        first, n = runs(hit, place)
        if len(first):
            who = place[first] + i
            begin = strings.at[who] + at[first] - from_window[place_string[who]]
            out.append(spans_batch(strings.key[who], begin, begin + n - 1 + length))
    return out


def repeated_spans(rows: DataFrame, length: int = LENGTH,
                   gram: int = GRAM, keep_first: bool = True, bucket_bytes: int = BUCKET_BYTES,
                   bucket_bound: int = BUCKET_BOUND) -> DataFrame:
    """Spans (key, start, stop) of bytes covered by repeated strings of ``length`` bytes."""
    if not 1 <= gram < length:
        raise ValueError("gram must be at least 1 and below length")
    run = (length - gram + 2) / 2
    buckets = bucket_count(rows, "text", (run + length - 1) / run, bucket_bytes)

    def emit(batches):
        for batch in row_slices(batches, "text"):
            yield from pack_slice(texts_of(batch, "text"), batch.column("doc").to_numpy(),
                                  batch.column("key").to_numpy(), length, gram, buckets)

    def work(batches):
        for whole, strings in buckets_of(batches, bucket_bound):
            if whole:
                yield from map(widened, solve(strings, length, keep_first))
            else:
                yield from map(widened, piece_batches(strings))

    def windows_of(string):
        return [string[k:k + length] for k in range(len(string) - length + 1)]

    def hits(doc, at, n, low_doc, low_at):
        return (n >= 2) & ~(keep_first & (doc == low_doc) & (at == low_at))

    blocks = rows.mapInArrow(emit, BLOCK_SCHEMA)
    found = materialise(blocks.repartition("bucket").sortWithinPartitions("bucket")
                        .mapInArrow(work, FOUND_SCHEMA), "suffix-spans")
    return found_spans(found, windows_of, hits, length)


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, keep_first: bool = True, bucket_bytes: int = BUCKET_BYTES,
                   bucket_bound: int = BUCKET_BOUND) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    content (the bytes left), kept_sha256 of them.

    A byte goes when a string of ``length`` bytes over it also starts elsewhere, in the
    same document or another; with ``keep_first`` the earliest place (by id, then byte)
    stays.  Strings are judged on the input, may overlap and never cross documents.
    Texts are UTF-8 bytes; null and empty texts have none; shorter texts stay whole.
    A null id sorts first and takes part like any other.  Repeated rows repeat each
    other's strings (with ``keep_first`` rows of one id and text share its place and
    stay).  Whole texts are read.  An empty table gives an empty result; other columns
    are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, length, gram, keep_first, bucket_bytes, bucket_bound)

    def cut(batches):
        for batch in row_slices(batches, "text"):
            n_bytes, n_removed, n_spans, left, sha = [], [], [], [], []
            starts, stops = batch.column("starts"), batch.column("stops")
            for i, text in enumerate(texts_of(batch, "text").cast(pa.binary())):
                data, removed, n = text.as_py(), 0, 0
                size = len(data)
                if starts[i].is_valid:
                    gone = covered(size, starts[i].values.to_numpy(), stops[i].values.to_numpy())
                    removed = int(gone.sum())
                    n = int(gone[0]) + int((np.diff(gone.astype(np.int8)) == 1).sum())
                    data = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                n_bytes.append(size)
                n_removed.append(removed)
                n_spans.append(n)
                left.append(data)
                sha.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(n_spans, pa.int64()), pa.array(left, pa.binary()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "content", "kept_sha256"])

    return with_spans(rows, spans).mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, content binary, kept_sha256 string")
