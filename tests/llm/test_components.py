"""Components of chains, stars, cycles and random edges, against union-find."""

import random

from emberseal.llm.components import components


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(700, 701), (701, 702), (702, 700), (5, 5)]
    edges += [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(110)] + [(-3, 9_000_000_000), (9_000_000_000, 42)]
    r.shuffle(edges)
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.v: x.c for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root if v != 5}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
