"""Super-k-mers: runs of consecutive windows that share a minimiser, packed as one
string and sent to the minimiser's bucket.

Equal windows have equal minimisers, so they meet in one bucket.  Within a slice of
documents equal strings are stored once with the list of their places, and the
strings of one slice for one bucket travel as one compressed block.  A bucket that
outgrows its bound (a minimiser shared by very many documents) is not solved in one
task: its strings are passed on with their places in pieces, each string is judged once
by Spark, and the verdict goes back to the pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.scratch import materialise

#: Bytes of packed strings aimed at per bucket, and the bound up to which one is
#: solved in a task.
BUCKET_BYTES = 8 << 20
BUCKET_BOUND = 64 << 20
#: What a byte of places weighs against the bound: a place is 24 bytes in a block and
#: about ten long integers while it is solved.
PLACE_WEIGHT = 4
#: Places of one block, and of one piece of a string passed on.
BLOCK_PLACES = 1 << 18
PIECE_PLACES = 1 << 14
#: Stands for a null id inside the packed blocks.
NULL_ID = -(1 << 63)
_CHUNK = 1 << 15
_LEVEL = 3

BLOCK_SCHEMA = "bucket int, raw long, text_bytes long, block binary"


def bucket_count(docs: DataFrame, text_col: str, expansion: float, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Number of buckets for a table of texts: one long from one scan."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(1, int(total * expansion / bucket_bytes) + 1)


@dataclass
class Strings:
    """Distinct packed strings with their places.

    ``text``/``sizes``: the strings back to back; ``mark``: 32 bits of the minimiser's
    hash; ``n_places``: places of each string; ``doc``/``key``/``at``: id, row number and
    offset of each place."""

    text: bytes
    sizes: np.ndarray
    mark: np.ndarray
    n_places: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    at: np.ndarray

    def __len__(self):
        return len(self.sizes)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @property
    def first_place(self) -> np.ndarray:
        return np.cumsum(self.n_places) - self.n_places

    def pick(self, rows: np.ndarray) -> Strings:
        """The strings ``rows`` with their places, in that order."""
        from tabulon.llm.batches import ragged
        places = ragged(self.first_place[rows], self.n_places[rows])
        s, z = self.starts[rows], self.sizes[rows]
        text = b"".join([self.text[a:a + n] for a, n in zip(s.tolist(), z.tolist(), strict=True)])
        return Strings(text, z, self.mark[rows], self.n_places[rows],
                       self.doc[places], self.key[places], self.at[places])

    def to_block(self) -> tuple[int, bytes]:
        head = np.array([len(self.sizes), len(self.doc)], dtype=np.int64)
        step = np.diff(self.doc, prepend=np.int64(0))
        row = np.diff(self.key, prepend=np.int64(0))
        raw = b"".join([head.tobytes(), step.tobytes(), self.at.astype(np.int64).tobytes(),
                        row.astype(np.int64).tobytes(), self.mark.astype(np.uint32).tobytes(),
                        self.sizes.astype(np.uint32).tobytes(), self.n_places.astype(np.uint32).tobytes(),
                        self.text])
        return len(raw), pa.Codec("zstd", compression_level=_LEVEL).compress(raw, asbytes=True)

    @staticmethod
    def from_block(raw: int, block: bytes) -> Strings:
        buf = pa.Codec("zstd").decompress(block, decompressed_size=raw, asbytes=True)
        n, m = np.frombuffer(buf, dtype=np.int64, count=2)
        at = 16

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(buf, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        doc = np.cumsum(take(np.int64, m))
        place, key = take(np.int64, m), np.cumsum(take(np.int64, m))
        mark, sizes, n_places = take(np.uint32, n), take(np.uint32, n), take(np.uint32, n)
        return Strings(buf[at:], sizes.astype(np.int64), mark, n_places.astype(np.int64), doc, key, place)

    @staticmethod
    def concat(parts: list[Strings]) -> Strings:
        cat = lambda f: np.concatenate([getattr(p, f) for p in parts])
        return Strings(b"".join([p.text for p in parts]), cat("sizes"), cat("mark"), cat("n_places"),
                       cat("doc"), cat("key"), cat("at"))


def pieces(starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches cut into pieces of at most ``most``: index of the stretch, start and size."""
    from tabulon.llm.batches import ragged
    count = -(-sizes // most)
    row = np.repeat(np.arange(len(sizes)), count)
    skip = ragged(np.zeros(len(sizes), dtype=np.int64), count) * most
    return row, starts[row] + skip, np.minimum(sizes[row] - skip, most)


def pack(buf: bytes, begin: np.ndarray, end: np.ndarray, minimiser: np.ndarray, doc: np.ndarray,
         key: np.ndarray, at: np.ndarray, buckets: int):
    """Record batch of blocks for one slice.  ``begin``/``end``: the packed strings' bytes
    in ``buf``; ``minimiser``: 64-bit hashes; ``doc``/``key``/``at``: places."""
    seen: dict[bytes, int] = {}
    number = np.empty(len(begin), dtype=np.int64)
    for i in range(0, len(begin), _CHUNK):
        pairs = zip(begin[i:i + _CHUNK].tolist(), end[i:i + _CHUNK].tolist(), strict=True)
        got = [seen.setdefault(buf[a:b], len(seen)) for a, b in pairs]
        number[i:i + len(got)] = got
    strings = list(seen)
    seen.clear()
    _, first = np.unique(number, return_index=True)
    bucket = (minimiser[first] >> np.uint64(32)).astype(np.int64) % buckets
    mark = (minimiser[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    by_bucket = np.argsort(bucket, kind="stable")
    places = np.argsort(number, kind="stable")
    n_places = np.bincount(number, minlength=len(strings))
    first_place = np.cumsum(n_places) - n_places
    from tabulon.llm.batches import ragged
    out = {"bucket": [], "raw": [], "text_bytes": [], "block": []}
    for rows in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1):
        if not len(rows):
            continue
        # Strings of very many places go in several entries, and those in several blocks.
        row, start, n = pieces(first_place[rows], n_places[rows], BLOCK_PLACES)
        full = (np.cumsum(n) - 1) // BLOCK_PLACES
        for some in np.split(np.arange(len(row)), np.flatnonzero(np.diff(full)) + 1):
            mine = rows[row[some]]
            where = places[ragged(start[some], n[some])]
            own = [strings[i] for i in mine.tolist()]
            part = Strings(b"".join(own), np.fromiter(map(len, own), dtype=np.int64, count=len(own)), mark[mine],
                           n[some], doc[where], key[where], at[where])
            raw, block = part.to_block()
            out["bucket"].append(int(bucket[rows[0]]))
            out["raw"].append(raw)
            out["text_bytes"].append(len(part.text))
            out["block"].append(block)
    return pa.RecordBatch.from_arrays(
        [pa.array(out["bucket"], pa.int32()), pa.array(out["raw"], pa.int64()),
         pa.array(out["text_bytes"], pa.int64()), pa.array(out["block"], pa.binary())], names=list(out))


def buckets_of(batches, bound: int):
    """Stream rows sorted by bucket.  Yields (True, Strings) for a whole bucket, or
    (False, Strings) for each block of a bucket that outgrew ``bound``."""
    current, held, size, over = None, [], 0, False
    for batch in batches:
        for b, raw, n, block in zip(batch.column("bucket").to_pylist(), batch.column("raw").to_pylist(),
                                    batch.column("text_bytes").to_pylist(), batch.column("block"), strict=True):
            if b != current:
                if held:
                    yield True, Strings.concat([Strings.from_block(*h) for h in held])
                current, held, size, over = b, [], 0, False
            block = (raw, block.as_py())
            if over:
                yield False, Strings.from_block(*block)
                continue
            held.append(block)
            size += n + PLACE_WEIGHT * (raw - n)
            if size > bound:
                over = True
                for h in held:
                    yield False, Strings.from_block(*h)
                held = []
    if held:
        yield True, Strings.concat([Strings.from_block(*h) for h in held])


SPAN_SCHEMA = "key long, start long, stop long"
#: Spans, or pieces of the strings of a bucket beyond the bound: the string and its hash,
#: its places, their number and the smallest.
FOUND_SCHEMA = SPAN_SCHEMA + (", name binary, string binary, n long, low_doc long, low_at long"
                              ", docs binary, keys binary, ats binary")
_SPANS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_PIECES = pa.schema([("name", pa.binary()), ("string", pa.binary()), ("n", pa.int64()), ("low_doc", pa.int64()),
                     ("low_at", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("ats", pa.binary())])
_FOUND = pa.schema([*_SPANS, *_PIECES])


def spans_batch(key, start, stop) -> pa.RecordBatch:
    """Spans, those of a row that touch or overlap as one."""
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    row = np.cumsum(np.concatenate(([0], np.diff(key) != 0))[:len(key)]) << 32
    reach = np.maximum.accumulate(row + stop)
    first = np.flatnonzero(np.concatenate(([True], (row + start)[1:] > reach[:-1]))[:len(key)])
    last = np.append(first[1:], len(key))[:len(first)] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()) for a in (key[first], start[first], (reach - row)[last])], schema=_SPANS)


def widened(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of spans or of pieces with all columns of FOUND_SCHEMA."""
    have = set(batch.schema.names)
    return pa.RecordBatch.from_arrays(
        [batch.column(f.name) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in _FOUND], schema=_FOUND)


def piece_batches(strings: Strings):
    """The strings of a block as rows, each with up to PIECE_PLACES of its places."""
    row, start, n = pieces(strings.first_place, strings.n_places, PIECE_PLACES)
    of = np.repeat(np.arange(len(row)), n)
    low = np.lexsort((strings.at, strings.doc, of))[start]
    docs, ats = strings.doc.astype(np.int64), strings.at.astype(np.int64)
    begin, end = strings.starts, strings.starts + strings.sizes
    weight = np.cumsum(24 * n + strings.sizes[row]) >> 22
    for some in np.split(np.arange(len(row)), np.flatnonzero(np.diff(weight)) + 1):
        own = [strings.text[a:b] for a, b in zip(begin[row[some]].tolist(), end[row[some]].tolist(), strict=True)]
        at = list(zip(start[some].tolist(), (start + n)[some].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(t).digest() for t in own], pa.binary()), pa.array(own, pa.binary()),
             pa.array(n[some], pa.int64()), pa.array(docs[low[some]]), pa.array(ats[low[some]]),
             *[pa.array([v[a:b].tobytes() for a, b in at], pa.binary()) for v in (docs, strings.key.astype(np.int64), ats)]],
            schema=_PIECES)


def found_spans(found: DataFrame, windows_of: Callable, hits: Callable, length: int) -> DataFrame:
    """The spans of FOUND_SCHEMA rows.  Strings passed on in pieces are judged once each:
    ``windows_of(string)`` are its windows, ``hits(doc, at, n, low_doc, low_at)`` says of
    places (rows) and windows (columns) which are repeated, given the number and the
    smallest of all places of the window."""
    spans = found.filter(F.col("name").isNull()).select("key", "start", "stop")
    held = found.filter(F.col("name").isNotNull())
    if held.isEmpty():
        return spans

    def cut(batches):
        for batch in batches:
            for r in batch.to_pylist():
                names = [hashlib.sha256(w).digest() for w in windows_of(r["string"])]
                k = np.arange(len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["name"]] * len(k), pa.binary()), pa.array(k, pa.int32()), pa.array(names, pa.binary()),
                     pa.array(np.full(len(k), r["n"])), pa.array(np.full(len(k), r["low_doc"])),
                     pa.array(r["low_at"] + k)], names=["name", "k", "window", "n", "low_doc", "low_at"])

    lowest = F.min(F.struct("low_doc", "low_at")).alias("low")
    strings = (held.groupBy("name").agg(F.first("string").alias("string"), F.sum("n").alias("n"), lowest)
               .select("name", "string", "n", "low.low_doc", "low.low_at"))
    windows = materialise(strings.mapInArrow(
        cut, "name binary, k int, window binary, n long, low_doc long, low_at long"), "large-windows")
    seen = windows.groupBy("window").agg(F.sum("n").alias("n"), lowest)
    verdict = (windows.select("name", "k", "window").join(seen, "window").groupBy("name")
               .agg(F.sort_array(F.collect_list(F.struct("k", "n", "low.low_doc", "low.low_at"))).alias("v"))
               .select("name", *[F.col(f"v.{c}").alias(f"w_{c}") for c in ("n", "low_doc", "low_at")]))

    def judge(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, key, at = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.int64)
                                for c in ("docs", "keys", "ats"))
                seen = [batch.column(f"w_{c}")[i].values.to_numpy() for c in ("n", "low_doc", "low_at")]
                width = len(seen[0])
                step = max(1, (1 << 20) // width)
                for a in range(0, len(doc), step):
                    hit = np.broadcast_to(hits(doc[a:a + step, None], at[a:a + step, None] + np.arange(width), *seen),
                                          (len(doc[a:a + step]), width)).ravel()
                    first, n = runs(hit, np.repeat(np.arange(len(hit) // width), width))
                    if len(first):
                        who, begin = a + first // width, at[a + first // width] + first % width
                        yield spans_batch(key[who], begin, begin + n - 1 + length)

    return spans.unionByName(held.select("name", "docs", "keys", "ats").join(verdict, "name")
                             .drop("name").mapInArrow(judge, SPAN_SCHEMA))


def runs(flag: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every run of set flags within equal groups."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(group[at]) != 0)) + 1
    first = np.concatenate(([0], cut))
    return at[first], np.diff(np.append(first, len(at)))


def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs, in order: one doubling step of a suffix sort."""
    both = left * (int(right.max(initial=0)) + 1) + right
    return np.unique(both, return_inverse=True)[1]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (null id as NULL_ID), key (a number of the row's own), text (null as empty).  Written
    once, so every reader sees the same numbers whatever becomes of the input's partitions."""
    return materialise(docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.monotonically_increasing_id().alias("key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")),
        "numbered-rows", spark__sql__parquet__compression__codec="zstd")
