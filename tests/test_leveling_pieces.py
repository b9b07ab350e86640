"""Levels of edges that lie together: found where they lie, and the same however they lie."""

import random

import pytest
from test_leveling import plain, shuffled

from loomgraph.operators.leveling import longest


def got(spark, edges, parts, kind="string", **how):
    df = spark.createDataFrame(edges, f"src {kind}, dst {kind}").coalesce(parts)
    rows = longest(df, **how).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["level"] for r in rows}


def test_chains_that_lie_together_need_no_round(spark):
    rng, edges, want = random.Random(3), [], {}
    for chain in range(300):
        names = [f"c{chain}-{i}" for i in rng.sample(range(100), 12)]
        edges += zip(names, names[1:])
        want |= {n: i for i, n in enumerate(names)}
    rounds = []
    assert got(spark, edges, 1, rounds=rounds) == want
    assert rounds == []


@pytest.mark.parametrize("stretch, depth", [(4, 1000), (9, 1000), (1000, 2)])
def test_stretches_that_cut_pieces(spark, stretch, depth):
    rng = random.Random(stretch)
    edges = [(f"t{i}-{a}", f"t{i}-{b}") for i in range(6) for a, b in (sorted(rng.sample(range(5), 2)) for _ in range(6))]
    edges += [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("s", "s"), ("s", "t"), ("p", "q")]
    edges = [*shuffled(rng, edges), ("z0", "z1"), ("z0", "z1"), ("z1", "z2"), (None, "z9"), ("z9", None)]
    rounds = []
    assert got(spark, edges, 2, stretch=stretch, depth=depth, rounds=rounds) == plain(edges)
    assert rounds


def test_numbers_and_what_a_cycle_blocks(spark):
    edges = [(1, 2), (2, 3), (1, 3), (10, 11), (11, 10), (11, 12), (20, 20), (20, 21), (30, 31)]
    rounds = []
    assert got(spark, edges, 1, "long", rounds=rounds) == plain(edges) and rounds == []
