"""The pivot join against all pairs, and what it leaves out."""

import math
import random

import pytest
from compare import SF

from loomgraph.operators import similarity
from loomgraph.plans import catalogue


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not a:
        return None
    if any(x is None or not math.isfinite(x) for x in (*a, *b)):
        return None
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else None


def plain(rows, new, threshold):
    out = set()
    for a, x in rows:
        if a in new:
            for b, y in rows:
                if a != b and (b not in new or a < b) and (s := cosine(x, y)) is not None and s >= threshold:
                    out.add((a, b, s))
    return sorted(out)


def clustered(rng, n, dims, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[i % 6]]) for i in range(n)]


@pytest.mark.parametrize(("dims", "spread", "threshold", "pivots", "part"), [(8, 0.1, 0.9, None, 4096), (40, 1.0, 0.5, 7, 5), (5, 3.0, 0.3, 1, 3), (130, 1.0, 0.5, None, 50)])
def test_delta_pairs(spark, dims, spread, threshold, pivots, part):
    rng = random.Random(dims)
    rows = clustered(rng, 150, dims, spread)
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # a hot vector
    rows += [(300, None), (301, []), (302, [0.0] * dims), (303, [float("nan")] * dims), (304, [1.0, *[None] * (dims - 1)]), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [1e-9 * x for x in rows[1][1]]), (308, [float("inf")] * dims), rows[3], rows[3]]
    new = {i for i, _ in rows if i % 4 == 0} | {306, 303}
    live = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    got = similarity.delta_pairs(live.where(live["id"].isin(*new)), live, threshold, pivots, part)
    want = plain(rows, new, threshold)
    assert want and [(r["a"], r["b"]) for r in got.orderBy("a", "b", "score").collect()] == [(a, b) for a, b, _ in want]
    assert [r["score"] for r in got.orderBy("a", "b", "score").collect()] == pytest.approx([s for _, _, s in want], abs=2e-6)
    assert "Cartesian" not in got._jdf.queryExecution().toString()


def test_found_pairs_are_not_shuffled(spark):
    rows = clustered(random.Random(2), 60, 4, 0.5)
    for extra in ([], [(0, rows[0][1][::-1])]):  # an id with two vectors may give a pair twice
        live = spark.createDataFrame(rows + extra, "id long, vector array<double>")
        got = similarity.delta_pairs(live.where("id % 3 = 0"), live, 0.5)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lstrip().startswith("Aggregate") == bool(extra) and "Join" not in plan.split("FlatMapCoGroups")[0]
        assert len({tuple(r) for r in got.collect()}) == got.count() > 0


def test_clusters_are_skipped(spark):
    rows = clustered(random.Random(1), 600, 16, 0.05)
    live = spark.createDataFrame(rows, "id long, vector array<double>")
    r = similarity.work(live.where("id % 10 = 0"), live, 0.95, 12).first()
    assert (r["new"], r["live"], r["square"]) == (60, 600, 360_000)
    assert 0 < r["scored"] < 0.25 * 60 * 600


def test_threshold_and_empty_tables(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, vector array<double>")
    assert similarity.delta_pairs(none, none, 0.5).count() == similarity.delta_pairs(none, one, 0.5).count() == similarity.delta_pairs(one, none, 0.5).count() == 0
    assert [tuple(r) for r in similarity.delta_pairs(one, one, 1.0).collect()] == [(1, 2, 1.0)]
    with pytest.raises(ValueError):
        similarity.delta_pairs(one, one, 0.0)


def test_scored_pairs_are_few(spark):
    r = catalogue.QUERIES["oN10_work"](spark, SF).first()
    assert 0 < r["scored"] <= r["new"] * r["live"] < 0.2 * r["square"]
