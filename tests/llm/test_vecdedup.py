import numpy as np
import pytest

from seqlab.llm import vecdedup

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, cls int, vec string"


def brute(rows, least):
    def unit(v):
        if v is None or any(x is None for x in v) or not len(v):
            return None
        x = np.array(v, np.float32).astype(float)
        return x / np.linalg.norm(x) if np.isfinite(x).all() and x.any() else None

    units = [unit(v) if label is not None and i is not None else None for i, v, label in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = units[a], units[b]
            if x is not None and y is not None and len(x) == len(y) and rows[a][2] == rows[b][2] and x @ y >= least:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for a, r in enumerate(rows):
        low[find(a)] = min((r[0] if r[0] is not None else 10 ** 9), low.get(find(a), 10 ** 9))
    return sorted((-1 if r[0] is None else r[0], n, -1 if r[0] is None else low[find(a)]) for a, (r, n) in enumerate(zip(rows, links, strict=True)))


def vectors(seed=2, groups=12, dim=8):
    rnd = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        center = rnd.normal(size=dim)
        for _ in range(rnd.choice([1, 5, 25])):
            rows.append([len(rows), (center + 0.25 * rnd.normal(size=dim)).tolist(), int(g % 3)])
    rows += [[len(rows) + i, rows[3][1], rows[3][2]] for i in range(30)]  # equal vectors
    rows += [[900, [2 * x for x in rows[3][1]], rows[3][2]], [901, rows[3][1], None], [902, None, 1], [903, [0.0] * dim, 1],
             [904, [], 1], [905, [float("nan")] * dim, 1], [906, [float("inf")] + [1.0] * (dim - 1), 1], [907, [None] + [1.0] * (dim - 1), 1],
             [None, rows[3][1], rows[3][2]], [908, [1.0] * 3, 1], [909, [1.0] * 3, 1], [3, rows[3][1], rows[3][2]], [910, [1e30] * dim, 1]]
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("cell,block", [(1024, 2048), (8, 2048), (8, 5)])
def test_matches_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vecdedup, "CELL", cell)
    monkeypatch.setattr(vecdedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    found = vecdedup.near_duplicates(df, 0.93).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in found) == brute(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_empty_table(spark):
    assert vecdedup.near_duplicates(spark.createDataFrame([], SCHEMA), 0.93).count() == 0
