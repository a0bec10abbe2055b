import random

import pytest

from ledgerloom.llm.components import components


def by_hand(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def path(n):
    return [(i, i + 1) for i in range(n)]


RNG = random.Random(1)
GRAPHS = {
    "none": [],
    "loops and nulls": [(1, 1), (None, 2), (3, None)],
    "one edge, repeated and turned": [(2, 1), (1, 2), (2, 1)],
    "path": path(40),
    "shuffled path": [(hash((i, 7)) % 10**6, hash((i + 1, 7)) % 10**6) for i in range(60)],
    "star around the largest": [(1000, i) for i in range(200)],
    "sparse": [(RNG.randrange(120), RNG.randrange(120)) for _ in range(70)],
    "negative": [(-5, 3), (3, 9), (-7, 9), (20, 21)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_every_node_gets_its_smallest(spark, name):
    frame = spark.createDataFrame(GRAPHS[name], "a long, b long")
    rows = components(frame).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["root"] for r in rows} == by_hand(GRAPHS[name])
