"""Epsilon grid order join against all pairs."""
import random

import numpy as np
import pytest

from tabulon.llm.vector_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<{}>, label int, n_links string"


def table(seed=1, n=260, dim=12):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.normal(size=(25, dim))
    for i in range(n):
        v = centres[rng.integers(25)] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.5])
        rows.append((i * 2, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(1001, None, 1), (1002, [0.0] * dim, 1), (1003, [1.0, None] * (dim // 2), 1), (1004, rows[0][1], None),
             (1005, [float("nan")] + [1.0] * (dim - 1), 1), (1006, [float("inf")] + [1.0] * (dim - 1), 1), (1007, [], 1),
             (None, rows[3][1], rows[3][2]), (None, [1.0, 2.0], 7), rows[5], (1008, [3.0, 4.0], 1), (1009, [6.0, 8.0], 1),
             (1010, [x * 4 for x in rows[7][1]], rows[7][2])]
    return [(*r, "x") for r in rows]


def brute(rows, cosine):
    n = len(rows)
    good = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1])
            and any(r[1]) for r in rows]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if g else None for r, g in zip(rows, good, strict=True)]
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) \
                    and unit[i] @ unit[j] >= cosine:
                links[i].add(j)
                links[j].add(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        todo, comp = [i], {i}
        while todo:
            for j in links[todo.pop()] - comp:
                comp.add(j)
                todo.append(j)
        seen |= comp
        ids = [rows[j][0] for j in comp if rows[j][0] is not None]
        for j in comp:
            c = min(ids) if ids else None
            out[j] = (rows[j][0], len(links[j]), c, rows[j][0] == c)
    return sorted(out, key=str)


@pytest.mark.parametrize("interval,kind,cosine,directions", [(1024, "float", 0.98, 8), (20, "float", 0.98, 3),
                                                             (20, "double", 0.9, 1)])
def test_links(spark, interval, kind, cosine, directions, monkeypatch):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(3)
    got = near_vectors(df, interval=interval, cosine=cosine, directions=directions)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=str) == brute(rows, cosine)


def test_all_alone_and_empty(spark):
    df = spark.createDataFrame([(1, None, 1, ""), (2, [1.0], None, "")], SCHEMA.format("float"))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()) \
        == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors(df.limit(0)).count() == 0


def test_recursion_skips_and_finds(monkeypatch):
    from tabulon.llm import vector_dedup as V
    monkeypatch.setattr(V, "LEAF", 4)
    rng = np.random.default_rng(2)
    random.seed(1)
    x = rng.normal(size=(60, 6)).astype("<f4")
    x[30:] = x[:30] + rng.normal(size=(30, 6)).astype("<f4") * 0.05
    basis = np.eye(6)[:2]
    a, b = V._Side(x[:35].tobytes(), 6, np.dtype("<f4"), basis), V._Side(x[35:].tobytes(), 6, np.dtype("<f4"), basis)
    sim = a.unit @ b.unit.T
    assert set(zip(*V._join(a, b, False, 0.95, (2 - 1.9) ** 0.5), strict=True)) == set(zip(*np.nonzero(sim >= 0.95), strict=True))
    own = a.unit @ a.unit.T
    i, j = np.nonzero(np.triu(own, 1) >= 0.95)
    assert set(zip(*V._join(a, a, True, 0.95, (2 - 1.9) ** 0.5), strict=True)) == set(zip(i, j, strict=True))
