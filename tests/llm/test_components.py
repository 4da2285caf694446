"""Components against union-find."""

import random

from siltstone.llm.common import Stage
from siltstone.llm.components import components


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(2)
    cases = [
        [(i, i + 1) for i in range(300)],  # a chain
        [(rng.randrange(400), rng.randrange(400)) for _ in range(260)],
        [(1000, i) for i in range(200)] + [(5, 5), (7, 1001), (1001, 7)],  # a hub, a loop, a pair twice
        [(rng.randrange(50) * 7, -rng.randrange(50)) for _ in range(60)],
        [],
    ]
    for k, edges in enumerate(cases):
        df = spark.createDataFrame(edges, "a long, b long")
        got = {r["node"]: r["component"] for r in components(df, Stage(spark, "t"), f"c{k}").collect()}
        assert got == plain(edges)
