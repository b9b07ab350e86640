"""Diameter by few sources, measures and betweenness in parts, against plain breadth-first searches."""

import random

import pytest
from compare import SF

from loomgraph.operators import graph
from loomgraph.plans import catalogue


def neighbours(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def search(near, start):
    depth, order = {start: 0}, [start]
    for x in order:
        for y in sorted(near[x]):
            if y not in depth:
                depth[y] = depth[x] + 1
                order.append(y)
    return depth, order


def biggest(near):
    left, best = set(near), set()
    while left:
        part = set(search(near, min(left))[0])
        left -= part
        best = max(best, part, key=lambda p: (len(p), -1))
    return best


def central(near):
    out = dict.fromkeys(near, 0.0)
    for s in near:
        depth, order = search(near, s)
        paths = {s: 1}
        for x in order[1:]:
            paths[x] = sum(paths[y] for y in near[x] if depth[y] == depth[x] - 1)
        dep = dict.fromkeys(order, 0.0)
        for x in reversed(order[1:]):
            for y in near[x]:
                if depth[y] == depth[x] - 1:
                    dep[y] += paths[y] / paths[x] * (1 + dep[x])
            out[x] += dep[x]
    n = len(near)
    return {x: v / ((n - 1) * (n - 2)) for x, v in out.items()}


def far(near):
    part = biggest(near)
    d = [v for s in part for v in search(near, s)[0].values() if v]
    return max(d), round(sum(d) / len(d), 6)


@pytest.mark.parametrize("kind", ["tree", "sparse"])
def test_diameter_and_measures(spark, kind):
    rng = random.Random(kind)
    edges = {"tree": [(i, rng.randrange(max(0, i - 6), i)) for i in range(1, 25)], "sparse": [(rng.randrange(40), rng.randrange(40)) for _ in range(60)], "ring": [(i, (i + 1) % 9) for i in range(9)]}[kind]
    edges += [(100, 101), (101, 102), (5, 5)]
    near = neighbours(edges)
    df = spark.createDataFrame([*edges, edges[0], edges[1][::-1]], "src long, dst long")
    row = graph.diameter(df).first()
    assert row["diameter"] == far(near)[0] and row["sources"] <= len(biggest(near)) + 4
    m = graph.measures(df, rows=300).first()  # several parts
    assert (m["diameter"], m["mean_path"], m["nodes"]) == (*far(near), len(near))


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert tuple(graph.diameter(none).first()) == (0, 0)


def test_loops(spark):
    rows = catalogue.Tables(spark, SF).kg_loops.where("status = 'proposed'").select("predecessor_id", "successor_id").collect()
    near = neighbours([tuple(r) for r in rows])
    assert catalogue.QUERIES["oG13_diameter"](spark, SF).first()["diameter"] == far(near)[0]
    got = {r["node"]: r["betweenness"] for r in catalogue.QUERIES["oG10_loops"](spark, SF).collect()}
    want = central(near)
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_betweenness_in_parts(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(45)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = central(neighbours(edges))
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(df, rows=200).collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_nodes_with_the_same_neighbours_are_one_source(spark):
    edges = [(h, 10 + (h + 1) % 3) for h in range(3)] + [(h, 100 + 10 * h + i) for h in range(3) for i in range(6)] + [(h, 200 + i) for h in (0, 1) for i in range(5)]
    edges += [(10, 11), (11, 12), (12, 300), (300, 301), (900, 901), (900, 902), (7, 7)]
    near = neighbours(edges)
    df = spark.createDataFrame(edges, "src long, dst long")
    e = graph.undirected(df)
    members, both = graph.twins(e, graph.Scratch(e, "twins-test"))
    found = {r["node"]: r["rep"] for r in members.collect()}
    assert all(found[x] == min(y for y in near if near[y] == near[x]) for x in near)
    assert both.count() == sum(len({found[y] for y in near[x]}) for x in set(found.values()))
    want = central(near)
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(df).collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 2e-6 for x in want)
    m, d = graph.measures(df).first(), graph.diameter(df).first()
    assert (m["diameter"], m["mean_path"], m["nodes"]) == (*far(near), len(near))
    assert d["diameter"] == far(near)[0] and d["sources"] <= len(set(found.values())) + 4
    star = spark.createDataFrame([(0, i) for i in range(1, 9)], "src long, dst long")
    assert graph.diameter(star).first()["diameter"] == 2 and graph.measures(star).first()["mean_path"] == round((16 + 56 * 2) / 72, 6)
