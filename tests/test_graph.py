"""Components against union-find."""

import random

import pytest

from ledgerloom.operators.graph import components


def plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def shapes():
    r = random.Random(4)
    chain = list(range(40))
    r.shuffle(chain)
    return {
        "random": [(r.randrange(60), r.randrange(60)) for _ in range(50)], "chain": list(zip(chain, chain[1:], strict=False)), "star": [(30, i) for i in range(60) if i != 30],
        "stars of stars": [(100 + i % 5, i) for i in range(50)] + [(100 + i, 200) for i in range(5)], "none": [],
    }


@pytest.mark.parametrize("name", shapes())
def test_components(spark, name):
    links = [x for x in shapes()[name] if x[0] != x[1]]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == plain(links)
