"""Packing token sequences by cutting-stock column generation.

Documents are cut into full sequences, pieces of whole units and a tail shorter than
a unit, so a histogram of a few dozen lengths describes the corpus.  A linear program
over cutting patterns of that histogram is solved by column generation, a knapsack
dynamic program pricing new patterns.  Patterns are rounded down, the rest is filled
first-fit decreasing, and the pieces, ranked within their length, take the patterns'
slots in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from string import ascii_lowercase, punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.batches import Words, ragged, row_slices, texts_of
from tabulon.llm.scratch import TEXT_BATCHES, materialise

SEQUENCE = 2048
#: Pieces are multiples of this many tokens, besides one shorter tail per document.
UNIT = 64
END_ID = 1
#: Distinct strings whose ids a worker remembers; with more, those met least are forgotten.
CACHE_WORDS = 200_000
#: Words of letters handed to the tokenizer as one string.
JOINED = 200
#: Closing punctuation of more characters stays with its word.
CLOSING = 8
_LETTERS = r"^\p{Ll}+$"
_LOWER, _PUNCTUATION = (np.isin(np.arange(256), np.frombuffer(x.encode(), dtype=np.uint8))
                        for x in (ascii_lowercase, punctuation))


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts.  The tokenizer drops white space, never joins across it, reads
    lower case and splits letters from punctuation, so every distinct string between
    white space, in lower case and without closing punctuation, is encoded once and
    remembered.  New words of letters alone are encoded many at a time: each ends with
    the only one of its ids that ends a word.  Words of a-z need no normalising and go
    straight to the tokenizer's model."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ends_word = self._ends_word()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.first = np.zeros(1, dtype=np.int64)
        self.met = np.zeros(0, dtype=np.int32)

    def _ends_word(self) -> np.ndarray | None:
        """Which ids end a word; None where the vocabulary does not mark every word's end."""
        from tokenizers.pre_tokenizers import ByteLevel
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        if not suffix or not all(c + suffix in vocab for c in ByteLevel.alphabet()):
            return None
        out = np.zeros(max(vocab.values()) + 1, dtype=bool)
        out[[n for token, n in vocab.items() if token.endswith(suffix)]] = True
        return out

    def _forget(self):
        """Keep the strings met in most slices, half of CACHE_WORDS at most and none met once."""
        often = np.flatnonzero(self.met > 1)
        kept = np.sort(often[np.argsort(-self.met[often], kind="stable")[:CACHE_WORDS // 2]])
        strings, sizes = list(self.known), self.first[kept + 1] - self.first[kept]
        self.ids = self.ids[ragged(self.first[kept], sizes)]
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        # What was met long ago counts less each time.
        self.met = self.met[kept] // 2
        self.known = {strings[i]: at for at, i in enumerate(kept.tolist())}

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words back to back, and how many each has."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _joined(self, words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters.  Each has at least one id that ends a word, so where
        there are as many of those as words, each word has one."""
        if self.ends_word is None or not words:
            return self._one_by_one(words)
        parts = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        got = tokenizer.encode_batch_fast([" ".join(part) for part in parts], add_special_tokens=False)
        flat, sizes = [], []
        for part, encoded in zip(parts, got, strict=True):
            ids = np.array(encoded.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends_word[ids])
            size = np.diff(ends, prepend=-1)
            if len(ends) != len(part) or ends[-1] != len(ids) - 1:
                ids, size = self._one_by_one(part)
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Places of distinct strings in the memory; new ones are encoded."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        listed = words.to_numpy(zero_copy_only=False).tolist()
        out = np.fromiter(map(self.known.get, listed, repeat(-1)), dtype=np.int64, count=len(listed))
        new = np.flatnonzero(out < 0)
        if len(new):
            strings = words.take(pa.array(new))
            letters, ascii_ = (x.to_numpy(zero_copy_only=False) for x in (
                pc.match_substring_regex(strings, _LETTERS), pc.string_is_ascii(strings)))
            kinds = [new[letters & ascii_], new[letters & ~ascii_], new[~letters]]
            new, fresh = np.concatenate(kinds), [[listed[i] for i in k.tolist()] for k in kinds]
            flat, sizes = zip(self._joined(fresh[0], self.model), self._joined(fresh[1], self.tokenizer),
                              self._one_by_one(fresh[2]), strict=True)
            base = len(self.first) - 1
            self.ids = np.concatenate((self.ids, *flat))
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))))
            out[new] = np.arange(base, base + len(new))
            self.known.update(zip(chain.from_iterable(fresh), range(base, base + len(new)), strict=True))
            self.met = np.concatenate((self.met, np.zeros(len(new), dtype=np.int32)))
        self.met[out] += 1
        return out

    def _distinct(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct strings back to back, and their offsets."""
        parts = stems_and_closings(pc.ascii_lower(distinct)).dictionary_encode()
        at = self.numbers(parts.dictionary)[parts.indices.to_numpy()].reshape(2, -1).T.reshape(-1)
        sizes = self.first[at + 1] - self.first[at]
        return (self.ids[ragged(self.first[at], sizes)],
                np.concatenate(([0], np.cumsum(sizes)[1::2])).astype(np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, END_ID after each, and the texts' offsets."""
        words = Words(texts, join=False)
        at, distinct = words.encoded()
        table, first = self._distinct(distinct)
        sizes = np.diff(first)[at]
        flat = table[ragged(first[at], sizes)]
        per_text = np.bincount(words.text_of_word, weights=sizes, minlength=words.n).astype(np.int64)
        ends = np.cumsum(per_text)
        out = np.insert(flat, ends, np.uint32(END_ID))
        return out, np.concatenate(([0], ends + np.arange(1, words.n + 1)))


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[ragged(starts, sizes)]))


def stems_and_closings(words: pa.Array) -> pa.Array:
    """Words without the ASCII punctuation that follows a lower-case letter at their end,
    which the tokenizer reads on its own, and then what was cut off each (or nothing)."""
    bounds = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + len(words) + 1]
    bounds = bounds.astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    starts, stops = bounds[:-1], bounds[1:]
    cut_at, left = stops.copy(), np.flatnonzero(stops > starts)
    for _ in range(CLOSING):
        left = left[_PUNCTUATION[data[cut_at[left] - 1]]]
        cut_at[left] -= 1
        left = left[cut_at[left] > starts[left]]
    closed = np.flatnonzero((cut_at < stops) & (cut_at > starts))
    last = data[cut_at[closed] - 1]
    after = _LOWER[last]
    wide = np.flatnonzero(last >= 0x80)
    stems = _strings(data, starts[closed[wide]], (cut_at - starts)[closed[wide]])
    after[wide] = pc.match_substring_regex(stems, r"\p{Ll}$").to_numpy(zero_copy_only=False)
    whole = np.ones(len(words), dtype=bool)
    whole[closed[after]] = False
    cut_at = np.where(whole, stops, cut_at)
    return _strings(data, np.concatenate((starts, cut_at)), np.concatenate((cut_at - starts, stops - cut_at)))


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """The worker's own encoder, loaded once; what one task encoded the next ones look up."""
    return Encoder(path)


def cut(length: int, sequence: int, unit: int) -> list[int]:
    """Piece lengths of a document: full sequences, whole units, a tail."""
    out = [sequence] * (length // sequence)
    rest = length % sequence
    if rest >= unit:
        out.append(rest - rest % unit)
    if rest % unit:
        out.append(rest % unit)
    return out


def cuts(lengths: np.ndarray, sequence: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`cut` of many documents: the piece lengths back to back, and each one's document."""
    rest = lengths % sequence
    tail = rest % unit
    parts = np.stack((lengths // sequence, rest >= unit, tail > 0), axis=1).astype(np.int64)
    size = np.stack((np.full(len(lengths), sequence), rest - tail, tail), axis=1)
    return np.repeat(size.reshape(-1), parts.reshape(-1)), np.repeat(np.arange(len(lengths)), parts.sum(axis=1))


def pieces(docs: DataFrame, id_col: str, text_col: str, sequence: int, unit: int, path: str) -> DataFrame:
    """One row per piece; ``rank`` numbers the pieces of one length within a task's ``chunk``."""
    def run(batches: Iterator[pa.RecordBatch]):
        encoder, chunk = worker_encoder(path), TaskContext.get().partitionId()
        used = np.zeros(sequence + 1, dtype=np.int64)
        for batch in row_slices(batches, "text"):
            ids, first = encoder.encode(texts_of(batch, "text"))
            raw, total = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.diff(first)
            size, doc = cuts(total, sequence, unit)
            # The documents' pieces lie back to back, as their ids do.
            ends = np.cumsum(size)
            begin = ends - size
            crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip((4 * begin).tolist(), (4 * ends).tolist(), strict=True)),
                              dtype=np.int64, count=len(size))
            order = np.argsort(size, kind="stable")
            counts = np.bincount(size, minlength=sequence + 1)
            rank = np.empty(len(size), dtype=np.int64)
            rank[order] = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts) + used[size[order]]
            used += counts
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), *[pa.array(c, pa.int64()) for c in (
                    begin - first[doc], size, crc, total[doc], rank, np.full(len(size), chunk))]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "chunk"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                "rank long, chunk long")


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best unbounded filling of the capacity: its value and the count of each length."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    size, value = lengths[order], values[order]
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            got = best[c - size[:fits[c]]] + value[:fits[c]]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], took[c] = got[k], order[k]
    counts = np.zeros(len(lengths), dtype=np.int64)
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(lengths[took[c]])
    return float(best[capacity]), counts


def generate_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and fractional uses of the linear program's last basis.
    Ends when the proven gap is under a quarter of a sequence."""
    m = len(lengths)
    basis = np.diag(capacity // lengths).astype(float)
    for _ in range(40 * m + 100):
        use = np.linalg.solve(basis, demand.astype(float))
        price = np.linalg.solve(basis.T, np.ones(m))
        value, counts = knapsack(np.maximum(price, 0), lengths, capacity)
        # Farley's bound: the optimum is at least (sum of uses) / value.
        if value <= 1 + 1e-9 or use.sum() * (1 - 1 / value) < 0.25:
            break
        step = np.linalg.solve(basis, counts.astype(float))
        ok = step > 1e-9
        ratio = np.where(ok, use / np.where(ok, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = counts
    return basis.round().astype(np.int64), np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pieces by length, sequences)] that use the histogram up exactly."""
    lengths = np.array(sorted((n for n, c in histogram.items() if c), reverse=True), dtype=np.int64)
    if not len(lengths):
        return []
    left = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    basis, use = generate_patterns(lengths, left, capacity)
    plan = []
    for p in np.argsort(-use, kind="stable"):
        counts = basis[:, p]
        some = counts > 0
        times = int(min(np.floor(use[p] + 1e-9), (left[some] // counts[some]).min()))
        if times > 0:
            plan.append(({int(n): int(c) for n, c in zip(lengths[some], counts[some], strict=True)}, times))
            left = left - counts * times
    # What rounding left over, first-fit decreasing by length.
    bins: list[tuple[int, dict[int, int]]] = []
    for n, count in zip(lengths.tolist(), left.tolist(), strict=True):
        for b in range(len(bins)):
            space, held = bins[b]
            k = min(count, space // n)
            if k:
                held[n] = held.get(n, 0) + k
                bins[b] = (space - k * n, held)
                count -= k
        while count > 0:
            k = min(count, capacity // n)
            bins.append((capacity - k * n, {n: k}))
            count -= k
    return plan + [(held, 1) for _, held in bins]


class Slots:
    """Where the pieces of each length go: ranks, in order, fill the patterns' slots."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        by_length: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for counts, times in plan:
            offset = 0
            for n in sorted(counts, reverse=True):
                by_length.setdefault(n, []).append((used.get(n, 0), counts[n], sequence, offset))
                used[n] = used.get(n, 0) + counts[n] * times
                offset += counts[n] * n
            sequence += times
        self.sequences = sequence
        self.table = {n: np.array(rows, dtype=np.int64) for n, rows in by_length.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            table = self.table[int(n)]
            entry = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
            nth, slot = np.divmod(rank[rows] - entry[:, 0], entry[:, 1])
            sequence[rows] = entry[:, 2] + nth
            offset[rows] = entry[:, 3] + slot * n
        return sequence, offset


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
         unit: int = UNIT, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its token ids and END_ID; every id lies in exactly one piece, and
    the pieces of a sequence leave no gaps from 0.  A null or empty text is END_ID alone.
    Every row is a document of its own, also when its id is null or repeated.  Long texts
    are cut into full sequences and a rest.  An empty table gives an empty result; other
    columns are ignored.
    """
    if not 1 <= unit <= sequence:
        raise ValueError("unit must be between 1 and the sequence length")
    table = materialise(pieces(docs, id_col, text_col, sequence, unit, tokenizer or default_tokenizer()),
                        "pack-pieces", **TEXT_BATCHES)
    counts = materialise(table.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    # One row per length: at most sequence / unit + unit rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(Slots(plan_patterns(histogram, sequence)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = (table.join(offsets, ["chunk", "length"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("rank") + F.col("before")).alias("rank")))

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            seq, off = slots.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)],
                                             names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(assign, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                     "sequence_id long, offset long")
