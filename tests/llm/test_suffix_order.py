"""The suffix sort of op8: equal windows in suffix order, and how much of a bucket it sorts."""
import random

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import suffix_dedup
from tabulon.llm.superkmers import Strings


def brute(strings, length):
    """Starts of the windows that occur twice or more, sorted by their bytes, and run starts."""
    text, places, base = b"".join(strings), {}, 0
    for s in strings:
        for k in range(len(s) - length + 1):
            places.setdefault(s[k:k + length], []).append(base + k)
        base += len(s)
    runs = [sorted(places[w]) for w in sorted(places) if len(places[w]) >= 2]
    return text, [p for r in runs for p in r], [k == 0 for r in runs for k in range(len(r))]


def corpus(seed, letters):
    rng = random.Random(seed)
    word = lambda n: bytes(rng.choice(letters) for _ in range(n))
    shared = [word(rng.randrange(20, 120)) for _ in range(6)]
    return [word(rng.randrange(30)) + rng.choice(shared) + word(rng.randrange(30)) + rng.choice(shared) + word(45)
            for _ in range(30)] + [b"\x00" * 90, b"\x00" * 70 + b"\xff", bytes(range(256))]


@pytest.mark.parametrize("length", [1, 3, 5, 8, 13, 40, 45])
@pytest.mark.parametrize("word", [63, 30])
def test_windows_come_in_suffix_order(length, word, monkeypatch):
    # With 30 bits, keys and positions do not share a word after the first round.
    monkeypatch.setattr(suffix_dedup, "_WORD", word)
    for seed, letters in enumerate((b"a", b"ab", bytes(range(256)), b"\x00\x01\xff", b"etaoin shr")):
        strings = corpus(seed, letters)
        text, at, head = brute(strings, length)
        got = suffix_dedup.repeated_suffixes(text, np.array([len(s) for s in strings]), length)
        order = np.lexsort((got[0], np.cumsum(got[1])))
        assert got[0][order].tolist() == at and got[1].tolist() == head


@pytest.mark.parametrize("keep_first", [False, True])
def test_groups_of_minimisers_do_not_change_the_spans(keep_first, monkeypatch):
    texts = [s.decode("latin-1") for s in corpus(9, b"etaoin shr")[:30] * 2]
    doc = np.array(random.Random(2).sample(range(1000), len(texts)))
    blocks = [Strings.from_block(r, b.as_py())
              for p in suffix_dedup.pack_slice(pa.array(texts), doc, np.arange(len(texts)), 40, 8, 1)
              for r, b in zip(p["raw"].to_pylist(), p["block"], strict=True)]
    strings = Strings.concat(blocks)

    def gone():
        spans = [r for b in suffix_dedup.solve(strings, 40, keep_first) for r in b.to_pylist()]
        return {(r["key"], k) for r in spans for k in range(r["start"], r["stop"])}

    whole = gone()
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 300)
    groups = list(suffix_dedup.mark_groups(strings, np.arange(len(strings))))
    assert len(groups) > 5 and sorted(np.concatenate(groups).tolist()) == list(range(len(strings)))
    assert all(not set(strings.mark[a]) & set(strings.mark[b]) for a in groups for b in groups if a is not b)
    assert gone() == whole
    places = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 39):
            places.setdefault(t[k:k + 40], []).append((doc[i], k, i))
    assert whole == {(i, k + j) for p in places.values() if len(p) >= 2
                     for d, k, i in p for j in range(40) if not (keep_first and (d, k, i) == min(p))}


def test_settled_windows_are_not_sorted_again(monkeypatch):
    """Strings that share a minimiser and nothing else: not nine sorts of all their suffixes."""
    rng = np.random.default_rng(4)
    strings = [rng.bytes(300) + b"the shared gram, 24 long" + rng.bytes(276) for _ in range(60)]
    one = np.ones(60, dtype=np.int64)
    held = Strings(b"".join(strings), 600 * one, np.full(60, 7, dtype=np.uint32), one, np.arange(60), np.arange(60), 0 * one)
    count = []
    for name in ("sort", "argsort", "unique"):
        def counted(a, *rest, plain=getattr(np, name), **named):
            count.append(np.size(a))
            return plain(a, *rest, **named)
        monkeypatch.setattr(np, name, counted)
    assert suffix_dedup.solve(held, 400, False) == []
    assert sum(count) < 2 * len(held.text)
