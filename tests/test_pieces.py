"""Sequences of pieces that lie in one task, against the search by layers."""

import random

import pytest

from loomgraph.operators import graph, pieces


def graph_rows():
    """Chains long and short, crossings, cycles, self-loops, repeated edges, null ends, in no order."""
    rng = random.Random(2)
    rows = [(f"a{i:02}", f"a{i + 1:02}") for i in range(14)] + [(f"b{i}", f"b{i + 1}") for i in range(4)] * 2 + [(f"b{i}", f"b{i}") for i in (2,)]
    rows += [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("c2", "c3"), ("d0", "d1"), ("d1", None), (None, "e1"), ("e0", "e1")]
    rows += [(f"f{a}", f"f{b}") for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.3] + [("g", f"g{i}") for i in range(12)] + [(f"{k}x", f"{k}y") for k in range(30)]
    rng.shuffle(rows)
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.select("start", "entity", "n", "sequence", "has_cycle", "cycle", "truncated").collect()), key=repr)


@pytest.mark.parametrize("max_depth, small, stretch", [(3, 1000, 200), (50, 11, 4), (0, 1000, 4)])
def test_sequences_of_pieces_and_by_layers(spark, monkeypatch, max_depth, small, stretch):
    cut = pieces._pieces
    monkeypatch.setattr(pieces, "_pieces", lambda edges, *_: cut(edges, stretch, 1000))
    e = spark.createDataFrame(graph_rows(), "src string, dst string")
    names = spark.createDataFrame([("a01", "second"), ("f3", "z"), ("b1", None), ("nowhere", "n"), ("1x", "zz")], "id string, name string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # pieces go over several batches
    try:
        every = graph._ends(e).withColumnRenamed("node", "start")
        assert rows_of(graph.sequences(e, None, names, max_depth, small)) == rows_of(graph._sequences_by_layers(e, every, names, max_depth))
        some = spark.createDataFrame([(x,) for x in ("a05", "a05", "f3", "c3", "nowhere", "g", "1y", "d0", "other")], "start string")
        assert rows_of(graph.sequences(e, some, names, max_depth, small)) == rows_of(graph._sequences_by_layers(e, some, names, max_depth))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_pieces_need_no_layers(spark, monkeypatch):
    def never(*_):
        raise AssertionError("layer by layer")

    monkeypatch.setattr(graph, "_layers", never)
    e = spark.createDataFrame([(100 * k + i, 100 * k + i + 1) for i in range(60) for k in (3, 1, 2)], "src long, dst long").repartition(3)  # ends of a piece lie apart
    names = spark.createDataFrame([(105, "five")], "id long, name string")
    got = {r["start"]: r for r in graph.sequences(e, None, names).collect()}
    assert len(got) == 183
    for k in (1, 2, 3):
        for i in range(61):
            r = got[100 * k + i]
            want = ["five" if 100 * k + j == 105 else str(100 * k + j) for j in range(max(0, i - 50), min(60, i + 50) + 1)]
            assert r["sequence"] == want and r["n"] == len(want) and r["truncated"] == (i >= 50 or i <= 10) and not r["has_cycle"]
