import random

from seqlab.llm.components import components


def test_chains_stars_loops_and_nulls(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (4, None), (1, 0)]
    edges += [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
