"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The
score of a word is the sum over all its segmentations into pieces of the product
of their probabilities (forward algorithm), and a text's score is the product over
its words.  Piece probabilities come from a few rounds of expectation maximisation
on the words of all labelled documents: every round is a job over the counted words, and
one number per language and piece reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.batches import Words, mix64, ragged, row_slices, texts_of
from tabulon.llm.scratch import TEXT_BATCHES, materialise, release
from tabulon.operators.ranking import exact_quantiles, quantile_names

EM_ROUNDS = 3
#: Pieces longer than this many code points are left out of the vocabulary.
MAX_PIECE = 8
#: A longer word is read as stretches of this many code points.
MAX_WORD = 32
#: Probability of one code point that is no piece.
UNKNOWN = 1e-8
#: Pseudo-count of every piece.
PSEUDO = 1e-3
UNDETERMINED = "und"
#: Share of a language's labelled texts that may lie below its least score per letter.
BELOW = 0.01
#: Letters from which a text's score per letter says something of the text.
MIN_LETTERS = 20
#: Words whose scores a worker remembers.
CACHE_WORDS = 200_000
_MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters, optionally with the word mark in front."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        bare = piece[1:] if piece.startswith(_MARK) else piece
        if len(piece) <= MAX_PIECE and piece == piece.lower() and (bare.isalpha() or piece == _MARK):
            out.add(piece)
    return sorted(out)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words back to back, and each word's length."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    return flat, np.fromiter(map(len, words), dtype=np.int64, count=len(words))


def _spans(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` columns from each start; codes is words x positions."""
    n = codes.shape[1] - length + 1
    h = np.zeros((codes.shape[0], n), dtype=np.uint64)
    for k in range(length):
        h = h * _BASE + codes[:, k:k + n]
    return mix64(h ^ np.uint64(length))


class Pieces:
    """Lookup from spans of code points to piece numbers; the last number is 'unknown'."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        by_len: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_len.setdefault(len(p), []).append(i)
        self.keys, self.ids = {}, {}
        for length, idx in by_len.items():
            flat, _ = _codes([pieces[i] for i in idx])
            h = _spans(flat.reshape(-1, length).astype(np.uint64), length)[:, 0]
            order = np.argsort(h)
            self.keys[length], self.ids[length] = h[order], np.array(idx, dtype=np.int64)[order]

    def find(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Piece number of every span, -1 where there is none (unknown for one code point)."""
        n = codes.shape[1] - length + 1
        none = self.n if length == 1 else -1
        if length not in self.keys:
            return np.full((codes.shape[0], n), none, dtype=np.int64)
        h, keys = _spans(codes, length), self.keys[length]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, self.ids[length][at], none)


def _by_length(words: list[str], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, code matrix) of words of one length, in chunks of bounded size."""
    flat, lengths = _codes(words)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, edges):
        if not len(group):
            continue
        size = int(lengths[group[0]])
        step = max(1, cells // (size + 1))
        for i in range(0, len(group), step):
            part = group[i:i + step]
            yield part, flat[starts[part][:, None] + np.arange(size)].astype(np.uint64)


def _forward(pieces: Pieces, codes: np.ndarray, probs: np.ndarray):
    """alpha: words x (positions + 1) x languages; found: piece numbers by length.
    ``probs``: (pieces + 2) x languages, the last row zero for 'no piece'."""
    n, size = codes.shape
    found = {k: pieces.find(codes, k) for k in range(1, min(MAX_PIECE, size) + 1)}
    alpha = np.zeros((size + 1, n, probs.shape[1]))
    alpha[0] = 1.0
    for t in range(1, size + 1):
        for k in range(1, min(MAX_PIECE, t) + 1):
            ids = found[k][:, t - k]
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                alpha[t, hit] += alpha[t - k, hit] * probs[ids[hit]]
    return alpha, found


def word_scores(pieces: Pieces, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Log of the summed segmentation probability, words x languages."""
    out = np.empty((len(words), probs.shape[1]))
    for part, codes in _by_length(words, max(1, 2_000_000 // probs.shape[1])):
        alpha, _ = _forward(pieces, codes, probs)
        out[part] = np.log(alpha[-1])
    return out


def expected_counts(pieces: Pieces, words: list[str], counts: np.ndarray, probs: np.ndarray | None = None) -> np.ndarray:
    """Expected number of uses of each piece in words with counts: over their segmentations
    under ``probs``, or without any every occurrence by its length."""
    expected = np.zeros(pieces.n + 1)
    for part, codes in _by_length(words, 500_000):
        size = codes.shape[1]
        if probs is None:
            for k in range(1, min(MAX_PIECE, size) + 1):
                ids = pieces.find(codes, k)
                w = np.broadcast_to(counts[part][:, None], ids.shape)[ids >= 0]
                expected += np.bincount(ids[ids >= 0], weights=w * float(k), minlength=pieces.n + 1)
            continue
        alpha, found = _forward(pieces, codes, probs[:, None])
        beta = np.zeros((size + 1, len(part)))
        beta[size] = 1.0
        scale = counts[part] / alpha[-1, :, 0]
        for t in range(size - 1, -1, -1):
            for k in range(1, min(MAX_PIECE, size - t) + 1):
                ids = found[k][:, t]
                hit = np.flatnonzero(ids >= 0)
                if not len(hit):
                    continue
                step = probs[ids[hit]] * beta[t + k, hit]
                beta[t, hit] += step
                expected += np.bincount(ids[hit], weights=alpha[t, hit, 0] * step * scale[hit],
                                        minlength=pieces.n + 1)
    return expected


def _normalised(expected: np.ndarray) -> np.ndarray:
    p = expected[:-1] + PSEUDO
    return np.append(p / p.sum(), UNKNOWN)


def split_words(texts: pa.Array) -> Words:
    """Runs of letters and marks in lower case."""
    letters = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
    return Words(letters, join=False)


def marked(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Marked stretches of at most MAX_WORD code points, and how many each word has."""
    out, n = [], np.ones(len(words), dtype=np.int64)
    for i, w in enumerate(words):
        if len(w) <= MAX_WORD:
            out.append(_MARK + w)
        else:
            parts = [w[j:j + MAX_WORD] for j in range(0, len(w), MAX_WORD)]
            out.append(_MARK + parts[0])
            out.extend(parts[1:])
            n[i] = len(parts)
    return out, n


class Scorer:
    """Scores slices of texts; remembers the scores of words it has met."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.pieces, self.probs = Pieces(pieces), np.vstack([probs, np.zeros((1, probs.shape[1]))])
        self.known: dict[str, int] = {}
        self.values = np.empty((CACHE_WORDS, probs.shape[1]))

    def unique(self, words: list[str]) -> np.ndarray:
        at = np.fromiter((self.known.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        out = np.empty((len(words), self.probs.shape[1]))
        old = at >= 0
        out[old] = self.values[at[old]]
        miss = np.flatnonzero(~old)
        if len(miss):
            new = [words[i] for i in miss]
            parts, n = marked(new)
            scores = word_scores(self.pieces, parts, self.probs)
            if len(parts) != len(new):
                scores = np.add.reduceat(scores, np.cumsum(n) - n, axis=0)
            out[miss] = scores
            room = min(CACHE_WORDS - len(self.known), len(new))
            first = len(self.known)
            self.values[first:first + room] = scores[:room]
            self.known.update(zip(new[:room], range(first, first + room), strict=True))
        return out

    def texts(self, texts: pa.Array, letters: bool = False) -> tuple:
        """Log score by language, and whether a text has a letter; with ``letters`` how many,
        each word's start counted as one more."""
        words = split_words(texts)
        total = np.zeros((words.n, self.probs.shape[1]))
        if len(words.flat):
            ids, distinct = words.encoded()
            scores = self.unique(distinct.to_pylist())
            some = np.flatnonzero(words.counts)
            total[some] = np.add.reduceat(scores[ids], words.first[some], axis=0)
        letter = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        if not letters:
            return total, letter
        sizes = pc.utf8_length(words.flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        return total, letter, np.bincount(words.text_of_word, weights=sizes, minlength=words.n).astype(np.int64)


def learned(id_col: str, lang_col: str, text_col: str):
    """Whether a document is learned from: one with a text and a language whose crc32(id as
    text) mod 5 is not 0."""
    key = F.col(id_col).cast("string").cast("binary")
    return (F.crc32(key) % 5 != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        vocabulary: str | None = None):
    """Fit on all :func:`learned` documents.  Returns (pieces, languages, probs)."""
    pieces = read_pieces(vocabulary or default_vocabulary())
    texts = docs.filter(learned(id_col, lang_col, text_col)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        for batch in row_slices(batches, "text"):
            words = split_words(texts_of(batch, "text"))
            if not len(words.flat):
                continue
            lang = batch.column("lang").take(pa.array(words.text_of_word))
            t = pa.table({"lang": lang, "word": words.flat}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from t.rename_columns({"count_all": "n"}).select(["lang", "word", "n"]).to_batches()

    counts = materialise(texts.mapInArrow(count, "lang string, word string, n long")
                         .groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words", **TEXT_BATCHES)
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return pieces, langs, np.zeros((len(pieces) + 1, 0))
    probs = None
    for _ in range(1 + EM_ROUNDS):
        probs = _round(counts, pieces, langs, probs)
    release(counts)
    return pieces, langs, probs


def _round(counts: DataFrame, pieces: list[str], langs: list[str], probs: np.ndarray | None) -> np.ndarray:
    """Piece probabilities, pieces x languages, from the expected counts under ``probs``."""
    shared = counts.sparkSession.sparkContext.broadcast((pieces, probs))

    def expect(batches):
        table, probs = None, shared.value[1]
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            table = table or Pieces(shared.value[0])
            tags = batch.column("lang").dictionary_encode()
            number = tags.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(tags.dictionary.to_pylist()):
                rows, at = pa.array(np.flatnonzero(number == i)), langs.index(lang)
                parts, n = marked(batch.column("word").take(rows).to_pylist())
                weight = np.repeat(batch.column("n").take(rows).to_numpy().astype(float), n)
                found = expected_counts(table, parts, weight, None if probs is None else probs[:, at])
                sums[at] = sums[at] + found if at in sums else found
        for at, found in sums.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), at)), pa.array(used), pa.array(found[used])],
                                             names=["lang", "piece", "n"])

    # At most one row per language and piece of the fixed vocabulary.
    got = (counts.mapInArrow(expect, "lang long, piece long, n double")
           .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow())
    expected = np.zeros((len(pieces) + 1, len(langs)))
    expected[got.column("piece").to_numpy(), got.column("lang").to_numpy()] = got.column("n").to_numpy()
    return np.stack([_normalised(expected[:, i]) for i in range(len(langs))], axis=1)


def least_per_letter(found: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     min_letters: int = MIN_LETTERS) -> DataFrame:
    """(lang, least): the score per letter that 99 % of the labelled texts of a learned
    language with at least ``min_letters`` letters reach.  ``found``: :func:`identify` with
    ``per_letter``; all texts that :func:`fit` learns from count."""
    own = found.filter(learned(id_col, lang_col, text_col) & F.col("own_per_letter").isNotNull()
                       & (F.col("n_letters") >= min_letters))
    least = exact_quantiles(own.select(F.col(lang_col).cast("string").alias("lang"), F.col("own_per_letter").alias("value")),
                            [BELOW], keys=("lang",))
    return least.select("lang", F.col(quantile_names([BELOW])[0]).alias("least"))


def identify(docs: DataFrame, model=None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", vocabulary: str | None = None, per_letter: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``held_out``, ``lang_pred`` and ``score`` (replacing
    input columns of these names), and with ``per_letter`` the predicted language's log
    score per letter, word starts counted (null without a letter), ``n_letters`` and the
    same of ``lang_col``'s own language (null where that is not learned).

    ``score`` is the posterior of the predicted language under equal priors.  A null
    text, an empty one and one without a letter get ``und`` and 0.0, and so does every
    text when there is nothing to learn from.  Ties go to the first language in code
    point order.  A null id is never learned from and not held out.  Whole texts are
    read; words longer than MAX_WORD code points are read in stretches.  Repeated rows
    are judged one by one; an empty table gives an empty result.
    """
    pieces, langs, probs = model or fit(docs, id_col, text_col, lang_col, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, probs))
    added = ["held_out", "lang_pred", "score", *(["per_letter", "n_letters", "own_per_letter"] if per_letter else [])]
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    names = base.columns

    def score(batches):
        scorer, place = Scorer(*shared.value) if langs else None, {x: i for i, x in enumerate(langs)}
        for batch in row_slices(batches, text_col):
            n = batch.num_rows
            pred, best = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
            letter, letters, height = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(n)
            own, own_height = np.full(n, -1), np.zeros(n)
            if scorer:
                total, letter, letters = scorer.texts(texts_of(batch, text_col), True)
                if per_letter:
                    tags = [place.get(x, -1) for x in batch.column(lang_col).cast(pa.string()).to_pylist()]
                    own = np.where(letter, np.array(tags, dtype=np.int64), -1)
                    own_height = total[np.arange(n), own] / np.maximum(letters, 1)
                top = total.argmax(axis=1)
                height = total[np.arange(n), top] / np.maximum(letters, 1)
                total -= total.max(axis=1, keepdims=True)
                post = 1.0 / np.exp(total).sum(axis=1)
                pred[letter] = np.array(langs, dtype=object)[top[letter]]
                best[letter] = post[letter]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(best, pa.float64()),
                 *([pa.array(height, mask=~letter), pa.array(letters, pa.int64()), pa.array(own_height, mask=own < 0)]
                   if per_letter else [])],
                names=[*batch.schema.names, *added[1:]])

    schema = base.withColumn("held_out", held)
    out = _schema_with(schema, "lang_pred string, score double" + (", per_letter double, n_letters long, own_per_letter double" if per_letter else ""))
    return schema.mapInArrow(score, out).select(*names, *added)


def _schema_with(df: DataFrame, more: str):
    """The schema of ``df`` with more fields."""
    from pyspark.sql.types import StructType
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])
