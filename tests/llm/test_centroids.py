"""Centroid clustering against a brute force of the stated rounds, and awkward vectors."""
import hashlib
import math
import random

import numpy as np
import pytest

from seqlab.llm import centroids as C


def brute(rows, k, rounds, dims, seed=2, scale=256):
    """Every distance from scratch with Python's integers; rows are (vec_id, vector)."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    drawn = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    centers = [x for _, x in drawn]
    if not centers:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers)) for _, x in kept]

    for _ in range(rounds):
        who = [j for _, j in assign()]
        for j in range(len(centers)):
            own = [x for (_, x), w in zip(kept, who) if w == j]
            if own:
                centers[j] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    total = sum(d for d, _ in found)
    inertia = {j: sum(d for d, w in found if w == j) for _, j in found}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, inertia[j], total, sha[j]) for (i, _), (d, j) in zip(kept, found)), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance string, x string")
    return sorted(map(tuple, C.clustered(df, **how).collect()), key=str)


def awkward():
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(i % 5, 0.4) for _ in range(6)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (8, [9.0] * 6), (None, [0.5] * 6), (400, None), (401, [1.0] * 5), (402, []),
             (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [float("nan")] + [1.0] * 5), (405, [float("inf")] + [1.0] * 5),
             (406, [-0.0] * 6), (407, [0.0] * 6), (408, [-1e-9] * 6)]
    rows += [(500 + i, [2.0, -2.0, 2.0, -2.0, 2.0, -2.0]) for i in range(150)]  # a third of all are copies
    return rows


@pytest.mark.parametrize("k, rounds", [(12, 4), (1, 2), (3, 0), (700, 2)])
def test_equals_brute_force(spark, k, rounds):
    rows = awkward()
    got = run(spark, [(*r, "a", None, "b") for r in rows], k=k, rounds=rounds, dims=6)
    assert got == brute(rows, k, rounds, 6)


def test_no_vectors_and_only_unfit_ones(spark):
    for rows in ([], [(1, None), (2, [1.0])], [(None, [1.0] * 6)]):
        assert run(spark, [(*r, "a", None, "b") for r in rows], k=4, rounds=2, dims=6) == []


def test_changes_of_few_components_update_dot_products():
    rnd = np.random.default_rng(3)
    x = rnd.integers(-200, 200, (50, 8)).astype(np.int32)
    old = rnd.integers(-200, 200, (5, 8))
    new = old.copy()
    new[1, 3] += 7
    new[4] -= 1
    got = C.updated(x, x.astype(np.int64) @ old.T, new - old)
    assert (got == x.astype(np.int64) @ new.T).all()
    large = np.full((3, 8), C.LARGEST - 1, np.int32)
    assert (C.updated(large, np.zeros((3, 5), np.int64), np.full((5, 8), C.LARGEST - 1)) == 8 * (C.LARGEST - 1) ** 2).all()


def test_component_beyond_the_integers_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e9] * 6, "a", None, "b")], k=2, rounds=1, dims=6)
