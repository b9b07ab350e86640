"""Levels by raking and compressing against a plain topological sort."""

import random

import pytest

from loomgraph.operators import graph
from loomgraph.operators.leveling import longest


def plain(edges):
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    nodes = {x for e in edges for x in e}
    level, left = {}, set(nodes)
    while ready := [n for n in left if not any(b == n and a in left for a, b in edges)]:
        for n in ready:
            level[n] = max((level[a] + 1 for a, b in edges if b == n), default=0)
        left -= set(ready)
    return level


def got(spark, edges, rounds=None):
    df = spark.createDataFrame(edges, "src string, dst string")
    rows = longest(df, rounds).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["level"] for r in rows}


def shuffled(rng, edges):
    names = sorted({x for e in edges for x in e})
    to = dict(zip(names, rng.sample([f"n{i}" for i in range(len(names))], len(names)), strict=True))
    return [(to[a], to[b]) for a, b in edges]


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in (sorted(rng.sample(range(40), 2)) for _ in range(25 + 10 * seed))]  # acyclic
    edges += [(100 + i, 101 + i) for i in range(12)] + [(3, 100), (112, 7)] if seed % 2 else [(200 + i, 201 + i) for i in range(9)] + [(205, 3)]
    edges += [(300, 301), (301, 302), (302, 300), (302, 303), (303, 304), (310, 310), (310, 311), (320, 321), (321, 320), (330, 303)]  # rings, what lies behind them, a self-loop
    edges = shuffled(rng, [(str(a), str(b)) for a, b in edges])
    assert got(spark, [*edges, edges[0], (None, "x"), ("y", None)]) == plain(edges)


def test_a_path_of_ten_thousand(spark):
    rng, rounds = random.Random(9), []
    names = rng.sample(range(10_000), 10_000)
    found = got(spark, [(str(names[i]), str(names[i + 1])) for i in range(9_999)], rounds)
    assert found == {str(n): i for i, n in enumerate(names)}
    assert sum(rounds) < 20


def test_trees_and_empty(spark):
    tree = [(str(i), str((i - 1) // 2)) for i in range(1, 63)] + [("a", "b"), ("b", "62")]
    assert got(spark, tree) == plain(tree)
    assert got(spark, []) == {} and not graph.has_cycle(spark.createDataFrame(tree, "src string, dst string"))
    assert graph.has_cycle(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))
