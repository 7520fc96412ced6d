"""Gaps of any size between a text and a template."""
import random

import pytest

from tabulon.llm import license_scan as S


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_common_subsequence_of_gaps(monkeypatch, cells):
    monkeypatch.setattr(S, "TABLE_CELLS", cells)
    rng = random.Random(cells)
    for _ in range(80):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(18))] for _ in range(2))
        got = S.common([9, *a, 9], [8, *b], 1, 1 + len(a), 1, 1 + len(b))
        assert len(got) == lcs(a, b)
        assert all(a[i - 1] == b[j - 1] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_a_gap_without_unique_words_is_aligned_whole():
    # 80 words against 120 that hold all of them, every word at least twice on both sides.
    rng = random.Random(4)
    a = [f"w{i % 20}" for i in range(80)]
    b = list(a)
    for _ in range(40):
        b.insert(rng.randrange(len(b)), f"w{rng.randrange(20)}")
    assert len(S.patience(["x", *a, "y"], ["z", *b, "q"])) == 80


def test_own_notices_are_told_apart():
    lists = {k: S.words_of(t) for k, t in S.TEMPLATES.items()}
    for name in ("GPL-2.0-header", "LGPL-2.1-header", "AGPL-3.0-header", "GPL-header", "BSD-2-Clause", "BSD-3-Clause"):
        text = S.words_of("some words before " + S.TEMPLATES[name] + " and some after")
        assert [h["license"] for h in S.licenses(text, lists, S.MIN_COVERAGE)] == [name]
