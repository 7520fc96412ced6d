"""Phrase collocation mining with FM-indexes over word ids.

The corpus is cut into shards (the texts of one language in one slice).  Every shard gets
a bidirectional FM-index: the Burrows-Wheeler transforms of its word ids and of the
reversed ids, suffixes ordered to the depth that phrases may have, pieces of text parted by
the symbol 0.  A phrase is an interval of suffixes in each of the two orders; one word more
on its left is read off the forward transform, one word more on its right off the reverse
one, and both intervals follow.  So the phrases of k words of a shard come with their
counts from those of k - 1 words, and Spark sums the counts across shards.

Only phrases whose parts are frequent in the whole corpus are extended.  The phrases of a
level that may be frequent reach the tasks as a bit table of at most ``MAX_BITS`` bits.
Which they are is found by hashes: a task sends the hashes of its phrases, 40 bits or so
each, sorted and packed by bucket, and each bucket sums their counts.  Two phrases of one
hash, and a chance hit in the bit table, only let a phrase through that is not frequent:
those let through are counted as text, exactly.  Counts travel in blocks as well: a task
adds up its texts and sends them packed by bucket, and each bucket adds up its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.batches import Words, mix64, ragged, row_slices, texts_of
from tabulon.llm.scratch import materialise, release

MAX_WORDS = 3
MIN_COUNT = 10
#: A phrase goes when a longer candidate holds this percentage of its occurrences.
COVER_PERCENT = 50
TOP = 2000
NO_LANG = "und"
#: Words of one shard; a piece of text is never cut, so a longer piece is a shard by itself.
SHARD_WORDS = 2_000_000
#: Bits of a table of frequent phrases: 16 to 32 for each phrase, up to 16 MB.
MIN_BITS = 1 << 16
MAX_BITS = 1 << 27
#: Copies of a word's count that candidates are joined to, so that a word which starts very
#: many phrases is no single key.
SALTS = 4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10])
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Hashes a task gathers before it sends them, hashes aimed at per bucket, and the low bits
#: of a hash that stay within its bucket.
GATHER = 1 << 22
BUCKET_HASHES = 1 << 21
LOW_BITS = 32
#: Texts a task gathers before it sends them with their counts.
GATHER_TEXTS = 1 << 20
#: Blocks, and so many texts at least, that a bucket holds before they are added up.
HELD_BLOCKS = 64
HELD_TEXTS = 1 << 18
#: Bytes beyond which a text is hashed by itself.
LONG_TEXT = 64
#: A row of the index holds a shard, megabytes each: rows are read from the table and go to a
#: task's worker one by one, else a task holds all of its shards at once.
_ROW_BY_ROW = {"spark__sql__execution__arrow__maxRecordsPerBatch": "1", "spark__sql__parquet__columnarReaderBatchSize": "1"}
#: The index is written a few shards at a time.
_INDEX = {"spark__sql__parquet__compression__codec": "zstd", "parquet__block__size": str(16 << 20)}
#: Words joined by a space in order of their symbols, with their counts and hashes.
INDEX = "lang string, words string, counts array<int>, hashes binary, bwt binary, rbwt binary"


@dataclass
class Index:
    """FM-index of one shard: ``bwt`` and ``rbwt`` over symbols 0 (end of a piece) to V."""

    bwt: np.ndarray
    rbwt: np.ndarray

    @staticmethod
    def build(symbols: np.ndarray, depth: int) -> Index:
        """``symbols`` start and end with 0."""
        def transform(t):
            return t[_suffix_order(t, depth) - 1]
        return Index(transform(symbols), transform(np.ascontiguousarray(symbols[::-1])))

    def __post_init__(self):
        sizes = np.bincount(self.bwt) if len(self.bwt) else np.zeros(1, dtype=np.int64)
        #: First row of every symbol, in both orders alike.
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.sizes = sizes

    def words(self, symbols: np.ndarray) -> Intervals:
        return Intervals(symbols[:, None], self.first[symbols], self.first[symbols], self.sizes[symbols])

    def extend(self, phrases: Intervals, left: bool, keep=None, last: bool = False) -> Intervals:
        """All phrases one word longer on the left (right) side, those for which
        ``keep(ids)`` holds.  ``last``: they are not extended again, so counts will do."""
        bwt = self.bwt if left else self.rbwt
        here, there = (phrases.low, phrases.rlow) if left else (phrases.rlow, phrases.low)
        rows = ragged(here, phrases.size)
        owner = np.repeat(np.arange(len(here)), phrases.size)
        symbol = bwt[rows].astype(np.int64)
        # Order within each interval by symbol: the place there is the place in the other order.
        key, order = _sorted(owner * len(self.first) + symbol, len(here) * len(self.first))
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        size = np.diff(np.append(starts, len(order)))
        head = order[starts]
        who, new = owner[head], symbol[head]
        real = new > 0
        starts, size, head, who, new = (x[real] for x in (starts, size, head, who, new))
        parts = (new[:, None], phrases.ids[who]) if left else (phrases.ids[who], new[:, None])
        ids = np.concatenate(parts, axis=1)
        if keep is not None:
            at = keep(ids)
            ids, starts, size, head, who, new = (x[at] for x in (ids, starts, size, head, who, new))
        if last:
            return Intervals(ids, size, size, size)
        begin = np.cumsum(phrases.size) - phrases.size
        low, rlow = self._target(bwt)[rows[head]], there[who] + starts - begin[who]
        return Intervals(ids, low, rlow, size) if left else Intervals(ids, rlow, low, size)

    def _target(self, bwt: np.ndarray) -> np.ndarray:
        """The row that each row leads to: the first of its symbol, and as many further as that
        symbol stands in ``bwt`` before."""
        places = _sorted(bwt, len(self.first))[1]
        out = np.empty(len(bwt), dtype=np.int64)
        out[places] = np.arange(len(bwt))
        return out


@dataclass
class Intervals:
    """Phrases as ids (one row each) with first row in either order and count."""

    ids: np.ndarray
    low: np.ndarray
    rlow: np.ndarray
    size: np.ndarray


def _sorted(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """``keys`` (0 to ``bound`` - 1) in order and the place of each, equal keys by place.  Key and
    place share a 64-bit word where they fit: numpy sorts plain words many times faster."""
    shift = max(1, (len(keys) - 1).bit_length()) if len(keys) else 1
    if (int(bound) - 1).bit_length() + shift > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    word = np.sort((keys.astype(np.uint64) << np.uint64(shift)) | np.arange(len(keys), dtype=np.uint64))
    return (word >> np.uint64(shift)).astype(np.int64), (word & np.uint64((1 << shift) - 1)).astype(np.int64)


def _suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols; a depth-limited index needs no more."""
    rank, have = t.astype(np.int64), 1
    while True:
        step = min(have, depth - have)
        key, bound = rank, int(rank.max(initial=0)) + 1
        if step > 0:
            after = np.concatenate((rank[step:], np.zeros(min(step, len(rank)), dtype=np.int64)))
            key, bound = rank * bound + after, bound * bound
        key, order = _sorted(key, bound)
        have += max(step, 0)
        if have >= depth:
            return order
        rank = np.empty(len(t), dtype=np.int64)
        rank[order] = np.cumsum(np.diff(key, prepend=key[:1]) > 0)


def pieces_of(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of texts in lower case, and for each whether it starts a piece."""
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    base = bounds.astype(np.int64) - bounds[0]
    raw = bytes(memoryview(texts.buffers()[2] or b"")[bounds[0]:bounds[-1]]).translate(_LOWER)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(base.astype(np.int32).tobytes()), pa.py_buffer(raw))
    words = Words(plain, join=False)
    data = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1]))[:len(data)]
    before[base[:-1][base[:-1] < len(data)]] = True
    line = np.cumsum(data == 10)[np.flatnonzero(~space & before)]
    opens = np.ones(len(line), dtype=bool)
    opens[1:] = (np.diff(line) > 0) | (np.diff(words.text_of_word) > 0)
    return words, opens


def shards(ids: np.ndarray, opens: np.ndarray, lang: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(language, word ids, whether each opens a piece) of every shard of whole pieces."""
    for number in np.unique(lang):
        at = np.flatnonzero(lang == number)
        starts = np.append(np.flatnonzero(opens[at]), len(at))
        i = 0
        while i < len(starts) - 1:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, side="right")) - 1)
            part = at[starts[i]:starts[j]]
            yield int(number), ids[part], opens[part]
            i = j


def index_shards(docs: DataFrame, lang_col: str, text_col: str, depth: int,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: its words with their counts, and the two transforms (32-bit ids)."""
    base = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))

    def build(batches):
        for batch in row_slices(batches, "text"):
            words, opens = pieces_of(texts_of(batch, "text"))
            if not len(words.flat):
                continue
            tags = batch.column("lang").dictionary_encode()
            every, table = words.encoded()
            lang = tags.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.text_of_word]
            for number, ids, opening in shards(every, opens, lang, shard_words):
                counts = np.bincount(ids, minlength=len(table))
                used = np.flatnonzero(counts)
                counts, symbol = counts[used], (np.cumsum(counts > 0) - 1)[ids]
                t = np.zeros(len(ids) + int(opening.sum()) + 1, dtype=np.int32)
                t[np.arange(len(ids)) + np.cumsum(opening)] = symbol + 1
                fm = Index.build(t, depth)
                own = table.take(pa.array(used))
                name = tags.dictionary[number]
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), " ")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()], pa.string()), joined,
                     pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(counts, pa.int32())),
                     *[pa.array([x.tobytes()], pa.binary()) for x in (
                         word_hashes(name.as_py(), own), fm.bwt.astype("<i4"), fm.rbwt.astype("<i4"))]],
                    names=["lang", "words", "counts", "hashes", "bwt", "rbwt"])

    return base.mapInArrow(build, INDEX)


def word_hashes(lang: str, words: list[str] | pa.Array) -> np.ndarray:
    return text_hashes(words if isinstance(words, pa.Array) else pa.array(words, pa.string()), xxhash.xxh64_intdigest(lang.encode()))


def text_hashes(texts: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of a string array, eight bytes of all texts at a time; of long texts by xxHash."""
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = bytes(memoryview(texts.buffers()[2] or b"")[bounds[0]:bounds[-1]]) + bytes(8)
    start, sizes = bounds[:-1] - bounds[0], np.diff(bounds)
    at_byte = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
    out = mix64(np.uint64(seed) + sizes.astype(np.uint64) * _BASE)
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG_TEXT))
    for done in range(0, LONG_TEXT, 8):
        chunk, left = at_byte[start[live] + done], sizes[live] - done
        short = left < 8
        chunk[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[live] = mix64(out[live] * _BASE + chunk)
        live = live[left > 8]
    for i in np.flatnonzero(sizes > LONG_TEXT):
        out[i] = xxhash.xxh64_intdigest(raw[start[i]:start[i] + sizes[i]], seed)
    return out


def phrase_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of phrases given the hashes of their words, one row each."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(hashes.shape[1]):
        out = mix64(out * _BASE + hashes[:, k])
    return out


class Frequent:
    """A bit table of phrases: never misses one that it was built from.  With ``buckets`` it is
    built from bucket and low bits of their hashes."""

    def __init__(self, bits: np.ndarray, buckets: int | None = None):
        self.bits, self.buckets = bits, buckets

    @staticmethod
    def slots(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
        mixed, mask = mix64(hashes), np.uint64(n_bits - 1)
        return (mixed & mask).astype(np.int64), ((mixed >> np.uint64(32)) & mask).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if self.buckets:
            low = np.uint64((1 << LOW_BITS) - 1)
            hashes = (hashes & low) | (((hashes >> np.uint64(LOW_BITS)) % np.uint64(self.buckets)) << np.uint64(LOW_BITS))
        out = np.ones(len(hashes), dtype=bool)
        for slot in self.slots(hashes, 64 * len(self.bits)):
            out &= (self.bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
        return out

    @staticmethod
    def of(hashes: DataFrame, n: int, buckets: int | None = None) -> Frequent:
        """From a column ``hash`` of ``n`` phrase hashes: tasks send the 64-bit cells they
        set, Spark joins them, and at most ``MAX_BITS`` bits reach the driver."""
        n_bits = MIN_BITS
        while n_bits < min(16 * n, MAX_BITS):
            n_bits *= 2

        def cells(batches):
            for batch in batches:
                values = batch.column("hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                slot = np.concatenate(Frequent.slots(values, n_bits))
                cell, where = np.unique(slot >> 6, return_inverse=True)
                value = np.zeros(len(cell), dtype=np.uint64)
                np.bitwise_or.at(value, where, np.uint64(1) << (slot & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(value.view(np.int64), pa.int64())],
                                                 names=["cell", "bits"])

        got = (hashes.select("hash").mapInArrow(cells, "cell long, bits long")
               .groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow())
        out = np.zeros(n_bits // 64, dtype=np.uint64)
        out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        return Frequent(out, buckets)


def hashes_of(table: DataFrame) -> DataFrame:
    """The hashes of phrases (lang, phrase) of one size as a column ``hash``."""
    def hash_rows(batches):
        for batch in batches:
            tags = batch.column("lang").dictionary_encode()
            number = tags.indices.to_numpy(zero_copy_only=False)
            split = [p.split(" ") for p in batch.column("phrase").to_pylist()]
            out = np.zeros(len(split), dtype=np.uint64)
            for i, lang in enumerate(tags.dictionary.to_pylist()):
                at = np.flatnonzero(number == i)
                flat = word_hashes(lang, [w for j in at for w in split[j]])
                out[at] = phrase_hashes(flat.reshape(len(at), -1))
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64), pa.int64())], names=["hash"])

    return table.select("lang", "phrase").mapInArrow(hash_rows, "hash long")


def shard_phrases(row: dict, tables: list[Frequent], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, ids, counts, word hashes by id) of the phrases of 2, 3, .. ``k`` words of a shard.
    ``tables[i]`` holds the frequent phrases of i + 1 words: phrases are kept that it
    holds, or, beyond the last table, whose parts it holds.  Words join on the left and
    on the right in turn."""
    fm = Index(np.frombuffer(row["bwt"], dtype="<i4"), np.frombuffer(row["rbwt"], dtype="<i4"))
    hashes = np.concatenate((np.zeros(1, dtype=np.uint64), np.frombuffer(row["hashes"], dtype=np.uint64)))
    found = fm.words(1 + np.flatnonzero(tables[0](phrase_hashes(hashes[1:, None]))))
    for size in range(2, k + 1):
        left = size % 2 == 0

        def known(ids, size=size, left=left):
            if size <= len(tables):
                return tables[size - 1](phrase_hashes(hashes[ids]))
            # The other part is the phrase that was extended.
            part = ids[:, :-1] if left else ids[:, 1:]
            return tables[size - 2](phrase_hashes(hashes[part]))

        found = fm.extend(found, left, known, last=size == k)
        yield size, found.ids, found.size, hashes


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            values = {c: batch.column(c)[i] for c in batch.schema.names}
            yield {c: x.values if isinstance(x, pa.ListScalar) else x.as_py() for c, x in values.items()}


def _packed(hashes: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, n, block): the bucket's sorted low hash bits as steps, and counts up to 255."""
    mask = np.uint64((1 << LOW_BITS) - 1)
    # A bucket follows from the upper bits alone, so equal hashes meet.
    bucket = ((hashes >> np.uint64(LOW_BITS)) % np.uint64(buckets)).astype(np.uint64)
    # Bucket, low bits and count in one word: 24 bits are left to the bucket.
    word = np.sort((((bucket << np.uint64(LOW_BITS)) | (hashes & mask)) << np.uint64(8)) | np.minimum(counts, 255).astype(np.uint64))
    key = word >> np.uint64(8)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    total = np.minimum(np.add.reduceat(word & np.uint64(255), starts), 255).astype(np.uint8)
    key = key[starts]
    edges = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(LOW_BITS))
    low = (key & mask).astype(np.uint32)
    codec, rows = pa.Codec("zstd", compression_level=1), []
    for i in np.flatnonzero(np.diff(edges)):
        part = low[edges[i]:edges[i + 1]]
        block = np.diff(part, prepend=np.uint32(0)).tobytes() + total[edges[i]:edges[i + 1]].tobytes()
        rows.append((int(i), len(part), codec.compress(block, asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()), strict=True)],
                                      names=["bucket", "n", "block"])


def _unpacked(n: int, block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(block, decompressed_size=5 * n, asbytes=True)
    return np.cumsum(np.frombuffer(raw, dtype=np.uint32, count=n), dtype=np.uint32), np.frombuffer(raw, dtype=np.uint8, offset=4 * n)


def frequent_hashes(index: DataFrame, tables: list[Frequent], k: int, min_count: int, buckets: int) -> DataFrame:
    """Column ``hash``: (bucket, low bits) as one number for every hash whose phrases of ``k``
    words occur ``min_count`` times or more together (255 times, if that is less: a packed count stops there)."""
    shared = index.sparkSession.sparkContext.broadcast(tables)

    def send(batches):
        held, n = [], 0
        for row in _shards(batches):
            for size, ids, counts, hashes in shard_phrases(row, shared.value, k):
                if size == k and len(ids):
                    held.append((phrase_hashes(hashes[ids]), counts))
                    n += len(ids)
            if n >= GATHER:
                yield _packed(*map(np.concatenate, zip(*held, strict=True)), buckets)
                held, n = [], 0
        if held:
            yield _packed(*map(np.concatenate, zip(*held, strict=True)), buckets)

    def add(batches):
        yield from hash_sums(batches, min_count)

    blocks = index.select("hashes", "bwt", "rbwt").mapInArrow(send, "bucket int, n int, block binary")
    return (blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "hash long"))


def hash_sums(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """The frequent hashes of every bucket from its blocks; rows come sorted by bucket.  Blocks
    are added up when they hold as many hashes as the sums so far, so that each is sorted a
    few times, however many blocks there are."""
    now, held, n_sums, n_held = None, [], 0, 0
    for batch in batches:
        for bucket, n, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "block")), strict=True):
            if bucket != now and held:
                yield _sums(now, held, min_count)
                held, n_sums, n_held = [], 0, 0
            now = bucket
            held.append(_unpacked(n, block))
            n_held += n
            if len(held) >= HELD_BLOCKS and n_held >= n_sums:
                held = [_summed(held)]
                n_sums, n_held = len(held[0][0]), 0
    if held:
        yield _sums(now, held, min_count)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    low, counts = map(np.concatenate, zip(*held, strict=True))
    mask = np.uint64((1 << 32) - 1)
    word = np.sort((low.astype(np.uint64) << np.uint64(32)) | np.minimum(counts.astype(np.int64), 1 << 31).astype(np.uint64))
    low = (word >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    return low[starts], np.minimum(np.add.reduceat(word & mask, starts), 1 << 31).astype(np.int64)


def _sums(bucket: int, held: list, min_count: int) -> pa.RecordBatch:
    low, counts = _summed(held)
    often = low[counts >= min(min_count, 255)].astype(np.int64) | np.int64(bucket << LOW_BITS)
    return pa.RecordBatch.from_arrays([pa.array(often, pa.int64())], names=["hash"])


def _added(texts: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Distinct texts and the sums of their counts."""
    table = pa.table({"text": pa.chunked_array(texts, pa.string()), "f": np.concatenate(counts)})
    table = table.group_by("text", use_threads=False).aggregate([("f", "sum")]).combine_chunks()
    return _one(table.column("text")), table.column("f_sum").to_numpy().astype(np.int64)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _packed_texts(texts: pa.Array, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, n, block): counts, lengths and bytes of the bucket's texts."""
    bucket, order = _sorted(text_hashes(texts) % np.uint64(buckets), buckets)
    texts, counts = texts.take(pa.array(order)), counts[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    sizes, data = np.diff(bounds), memoryview(texts.buffers()[2])
    codec, rows = pa.Codec("zstd", compression_level=1), []
    for i in np.flatnonzero(np.diff(edges)):
        a, b = edges[i], edges[i + 1]
        block = counts[a:b].tobytes() + sizes[a:b].tobytes() + bytes(data[bounds[a]:bounds[b]])
        rows.append((int(i), int(b - a), len(block), codec.compress(block, asbytes=True)))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)],
                                      names=["bucket", "n", "size", "block"])


def _unpacked_texts(n: int, size: int, block: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = pa.Codec("zstd").decompress(block, decompressed_size=size, asbytes=True)
    bounds = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(np.frombuffer(raw, dtype=np.int32, count=n, offset=8 * n), out=bounds[1:])
    return (pa.StringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(memoryview(raw)[12 * n:])),
            np.frombuffer(raw, dtype=np.int64, count=n))


def text_sums(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, size, f) of every bucket's texts that occur ``min_count`` times or more,
    from its blocks; rows come sorted by bucket."""
    def frequent(held):
        texts, counts = _added(*zip(*held, strict=True))
        often = counts >= min_count
        texts, counts = texts.filter(pa.array(often)), counts[often]
        # The language stands before the last line break: no word holds one.
        parts = pc.split_pattern(texts, "\n", max_splits=1, reverse=True).flatten()
        lang, phrase = (parts.take(pa.array(np.arange(k, len(parts), 2))) for k in (0, 1))
        size = pc.add(pc.count_substring(phrase, " "), pa.scalar(1, pa.int32()))
        return pa.RecordBatch.from_arrays([lang, phrase, size, pa.array(counts, pa.int64())], names=["lang", "phrase", "size", "f"])

    now, held, n_sums, n_held = None, [], 0, 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "size", "block")), strict=True):
            if row[0] != now and held:
                yield frequent(held)
                held, n_sums, n_held = [], 0, 0
            now = row[0]
            held.append(_unpacked_texts(*row[1:]))
            n_held += row[1]
            if n_held >= max(n_sums, HELD_TEXTS):
                held = [_added(*zip(*held, strict=True))]
                n_sums, n_held = len(held[0][0]), 0
    if held:
        yield frequent(held)
    pa.default_memory_pool().release_unused()


def count_texts(rows: DataFrame, counted, min_count: int, buckets: int) -> DataFrame:
    """(lang, phrase, size, f): summed counts of the texts that ``counted(row)`` yields with
    their counts for each shard, ``min_count`` or more.  Before a text stand its language and a
    line break."""
    def send(batches):
        texts, counts, n = [], [], 0
        for row in _shards(batches):
            for text, f in counted(row):
                texts.append(text)
                counts.append(f)
                n += len(f)
                if n >= GATHER_TEXTS:
                    yield _packed_texts(*_added(texts, counts), buckets)
                    texts, counts, n = [], [], 0
        if n:
            yield _packed_texts(*_added(texts, counts), buckets)
        pa.default_memory_pool().release_unused()

    def add(batches):
        yield from text_sums(batches, min_count)

    blocks = rows.mapInArrow(send, "bucket int, n int, size long, block binary")
    return (blocks.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(add, "lang string, phrase string, size int, f long"))


def _words(row: dict) -> tuple[pa.Array, pa.Array]:
    """The words of a shard in order of their symbols, and the same after the language."""
    words = pc.split_pattern(pa.array([row["words"]], pa.string()), " ").flatten()
    return words, pc.binary_join_element_wise(pa.scalar(row["lang"] + "\n", pa.string()), words, "")


def count_words(index: DataFrame, min_count: int, buckets: int) -> DataFrame:
    """(lang, phrase, f) of single words."""
    def counted(row):
        yield _words(row)[1], row["counts"].to_numpy(zero_copy_only=False).astype(np.int64)

    return count_texts(index.select("lang", "words", "counts"), counted, min_count, buckets).select("lang", "phrase", "f")


def count_phrases(index: DataFrame, tables: list[Frequent], sizes: list[int], min_count: int, buckets: int) -> DataFrame:
    """(lang, phrase, size, f): summed counts of the phrases of ``sizes`` that the tables leave."""
    shared = index.sparkSession.sparkContext.broadcast(tables)  # at most MAX_BITS bits each

    def counted(row):
        words, heads = _words(row)
        for size, ids, counts, _ in shard_phrases(row, shared.value, sizes[-1]):
            if size in sizes and len(ids):
                parts = [(words if j else heads).take(pa.array(ids[:, j] - 1)) for j in range(size)]
                yield pc.binary_join_element_wise(*parts, " "), counts.astype(np.int64)

    return count_texts(index.select("lang", "words", "hashes", "bwt", "rbwt"), counted, min_count, buckets)


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS,
                     min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f) of the phrases of 1, 2, .. ``max_words`` words that occur
    ``min_count`` times or more in their language, and (lang, n) with n all words."""
    index = materialise(index_shards(docs, lang_col, text_col, max_words, shard_words), "phrase-index", **_INDEX)
    total = materialise(index.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
                        .groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    buckets = max(1, (total.agg(F.sum("n")).first()[0] or 0) // BUCKET_HASHES + 1)
    levels = [materialise(count_words(index, min_count, buckets), "phrases-1", **_ROW_BY_ROW)]
    tables = [Frequent.of(hashes_of(levels[0]), levels[0].count())]
    for k in range(2, max_words + 1):
        often = materialise(frequent_hashes(index, tables, k, min_count, buckets), f"phrase-hashes-{k}", **_ROW_BY_ROW)
        tables.append(Frequent.of(often, often.count(), buckets))
        release(often)
    found = materialise(count_phrases(index, tables, list(range(2, max_words + 1)), min_count, buckets), "phrases", **_ROW_BY_ROW)
    levels += [found.filter(F.col("size") == k).select("lang", "phrase", "f") for k in range(2, max_words + 1)]
    release(index)
    return levels, total


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS,
         min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, top: int | None = TOP,
         shard_words: int = SHARD_WORDS) -> DataFrame:
    """Collocations of every language: lang, rank, phrase, a, l, r, n, score, cut,
    left_most, right_most.

    Texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into
    words, A-Z in lower case.  Candidates are the phrases of 2 to ``max_words`` words found
    ``min_count`` times or more (a).  A cut after ``cut`` words gives the counts l and r of
    its parts and the score floor(1000000 * a * a / (l * r)); the lowest cut counts, the
    first of equal ones.  n: all words of the language.  ``left_most`` and ``right_most``:
    the greatest count of a candidate one word longer on that side (null: none).  A
    candidate with at least ``cover_percent`` percent of its occurrences inside a longer
    one is dropped: the candidate one word longer between the two has no fewer occurrences, so
    looking one word further is enough.  The first ``top`` of each language are
    kept (None: all), by score and a descending and phrase in byte order.

    A null language counts as ``und``, a null text as empty.  Repeated rows count
    each time.  An empty table, or one without a frequent phrase, gives no rows.  Other
    columns are ignored.
    """
    if max_words < 2:
        raise ValueError("a collocation has two words at least")
    levels, total = frequent_phrases(docs, lang_col, text_col, max_words, min_count, shard_words)
    # A word may be part of very many candidates, so its count stands under several salts.
    known = levels[0].withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    for x in levels[1:-1]:
        known = known.unionByName(x.withColumn("salt", F.lit(0)))
    found = levels[1]
    for x in levels[2:]:
        found = found.unionByName(x)
    words = F.split("phrase", " ")
    found = found.withColumnRenamed("f", "a").withColumn("words", words).withColumn("size", F.size("words"))

    # Every cut asks for the counts of its two parts.
    def cuts(row):
        return F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(
            F.struct(k.alias("cut"), F.lit(0).alias("side"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("part")),
            F.struct(k.alias("cut"), F.lit(1).alias("side"),
                     F.array_join(F.slice("words", k + 1, F.col("size") - k), " ").alias("part")))))

    asked = (found.select("lang", "phrase", "a", F.explode(cuts(found)).alias("x"))
             .select("lang", "phrase", "a", "x.*")
             .withColumn("salt", F.when(F.col("part").contains(" "), 0)
                         .otherwise(F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))))
    parts = (asked.join(known.withColumnRenamed("phrase", "part"), ["lang", "part", "salt"])
             .select("lang", "phrase", "a", "cut", "side", "f"))
    # The counts of candidates one word longer go to the phrases they extend, as sides 2 and 3.
    inner = lambda start: F.array_join(F.slice("words", F.lit(start), F.col("size") - 1), " ")
    longer = (found.filter(F.col("size") > 2)
              .select("lang", "a", F.explode(F.array(F.struct(inner(2).alias("phrase"), F.lit(2).alias("side")),
                                                     F.struct(inner(1).alias("phrase"), F.lit(3).alias("side")))).alias("x"))
              .select("lang", "x.phrase", F.lit(None).cast("long").alias("a"), F.lit(0).alias("cut"), "x.side", F.col("a").alias("f")))
    # One shuffle by phrase gathers all of these.
    most_of = lambda cut, side: F.max(F.when((F.col("cut") == cut) & (F.col("side") == side), F.col("f")))
    facts = parts.unionByName(longer).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), *[most_of(k, side).alias(f"{name}{k}") for k in range(1, max_words) for side, name in enumerate("lr")],
        most_of(0, 2).alias("left_most"), most_of(0, 3).alias("right_most"))
    # a * a * 1000000 and l * r pass 64 bits; no score is above 1000000.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    part = F.lit(1000000).cast("decimal(7,0)") * (wide("a") * wide("a")).cast("decimal(31,0)")
    facts = facts.withColumn("top_half", part.cast("decimal(38,0)"))
    for k in range(1, max_words):
        facts = facts.withColumn(f"product{k}", (wide(f"l{k}") * wide(f"r{k}")).cast("decimal(38,0)"))
    scores = [F.when(F.col(f"l{k}").isNotNull(), F.struct(
        F.expr(f"top_half div product{k}").cast("long").alias("score"), F.lit(k).alias("cut"),
        F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, max_words)]
    best = facts.select("lang", "phrase", "a", F.array_min(F.array(*scores)).alias("x"), "left_most", "right_most")

    most = F.greatest("left_most", "right_most")
    kept = best.filter(most.isNull() | (100 * most < cover_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.select("lang", "phrase", "a", "x.*", "left_most", "right_most").withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut",
        "left_most", "right_most")
