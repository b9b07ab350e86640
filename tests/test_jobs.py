"""Steps that are resumed after a crash at any place, clusters by group, abstractions on demand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import clustering, jobs
from loomgraph.sources.store import Store


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


STEPS = [
    ("double", lambda t: {"a": t["a"].withColumn("x", F.col("x") * 2)}),
    ("add", lambda t: {"a": t["a"].unionByName(t["a"].withColumn("x", F.col("x") + 1)), "log": t["log"].unionByName(t["a"].select(F.col("x").cast("string").alias("said")))}),
    ("sum", lambda t: {"total": t["a"].agg(F.sum("x").alias("n"))}),
]


def test_interrupted_and_whole_runs_agree(spark, tmp_path):
    def start(name):
        store = Store(spark, f"file://{tmp_path}/{name}")
        store.commit({"a": spark.createDataFrame([(1,), (5,)], "x int"), "log": spark.createDataFrame([], "said string")})
        return store

    whole = start("whole")
    assert jobs.resumable(whole, STEPS) == ["double", "add", "sum"] and jobs.resumable(whole, STEPS) == []
    broken = start("broken")

    def die(_):
        raise RuntimeError("died")

    half = lambda t: {"a": t["a"].limit(0), "log": t["log"].select(F.raise_error(F.lit("half")).cast("string").alias("said")).unionByName(spark.createDataFrame([("x",)], "said string").select(F.when(F.col("said") == "x", F.raise_error(F.lit("half"))).alias("said")))}
    for i, name in enumerate(n for n, _ in STEPS):
        with pytest.raises(Exception, match="half"):  # within the step, one table written
            jobs.resumable(broken, [*STEPS[:i], (name, half)])
        with pytest.raises(RuntimeError, match="died"):  # after its commit
            jobs.resumable(broken, STEPS, die)
    assert jobs.resumable(broken, STEPS) == []
    a, b = whole.read(), broken.read()
    assert set(a) == set(b) and all(rows_of(a[n]) == rows_of(b[n]) for n in a)


@pytest.mark.parametrize("small", [4096, 8])
def test_linkage_by_group(spark, small):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 6))
    rows = [(f"g{i % 4}" if i % 9 else None, i, None if i == 7 else [float(x) for x in centres[i % 3] + rng.normal(size=6) * 0.1]) for i in range(60)]
    df = spark.createDataFrame(rows, "grp string, id long, vector array<double>")
    got = {(r["grp"], r["id"]): r["cluster"] for r in clustering.linkage_by_group(df, 0.25, small=small).collect()}
    assert len(got) == 60
    for grp in {r[0] for r in rows}:
        own = [(i, v) for g, i, v in rows if g == grp]
        want = {r["id"]: r["cluster"] for r in clustering.average_linkage(spark.createDataFrame(own, "id long, vector array<double>"), 0.25, False).collect()}
        assert {i: c for (g, i), c in got.items() if g == grp} == want


def test_abstractions_on_demand(spark):
    rng = random.Random(1)
    rows = [(f"a{i:02}", f"s{i % 2}", "S", "requires", f"o{i}", "", [], "accepted" if i % 7 else "deprecated", i) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, subject_id string, subject string, predicate string, object string, rationale string, conditions array<string>, status string, seq int")
    vectors = spark.createDataFrame([(r[0], [1.0, 0.0] if int(r[0][1:]) % 3 else [0.0, rng.random() + 1]) for r in rows], "id string, vector array<double>")
    says = lambda made: made.select("id", F.lit("All of it").alias("statement"), F.lit("why").alias("abstraction_rationale"), F.lit(0.7).alias("confidence"))
    nodes = jobs.compress(df, vectors, says, spark.createDataFrame([("s1",)], "id string"))
    want = {tuple(r[0] for r in rows if r[1] == "s1" and r[7] == "accepted" and (int(r[0][1:]) % 3 > 0) == k) for k in (True, False)}
    assert {tuple(r["child_ids"]) for r in nodes.collect()} == want and {r["status"] for r in nodes.collect()} == {"proposed"}
    dry = jobs.compress(df, vectors, says, dry=True)
    assert dry.columns == ["subject_id", "cluster", "child_ids", "prompt"] and dry.count() == 4


def test_equal_vectors_of_a_group_and_no_cap(spark):
    from pyspark.sql import functions as F

    from loomgraph.operators import clustering, jobs

    rows = [(f"g{i % 3}" if i % 3 else None, f"i{i:03}", [[1.0, 0.0], [0.0, 2.0], [0.0, 1.0], None][i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "grp string, id string, vector array<double>")
    want = {r[1]: min(x[1] for x in rows if x[0] == r[0] and x[2] and r[2] and (x[2][0] > 0) == (r[2][0] > 0)) if r[2] else r[1] for r in rows}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go over several batches
    try:
        got = {r["id"]: r["cluster"] for r in clustering.linkage_by_group(df, 0.25).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    said = df.where("grp is not null").select(F.col("grp").alias("subject_id"), "id", F.lit("o").alias("object_id"), F.lit("requires").alias("predicate"), F.lit("").alias("rationale"), F.array().cast("array<string>").alias("conditions"), F.lit("accepted").alias("status"), F.lit(0).alias("seq"))
    names = spark.createDataFrame([("g1", "one"), ("o", "object")], "id string, name string")
    run = lambda cap: [(r["subject_id"], r["cluster"], r["prompt"].split("\n")[0]) for r in jobs.compress(said, df.where("vector is not null").select("id", "vector"), lambda m: m, dry=True, cap=cap, entities=names).collect()]
    every = sorted(run(None))
    assert len(every) == 4 and every[0][2] == "  1. one requires object" and every[2][2] == "  1. g2 requires object"
    assert run(3) == every[:3]


@pytest.mark.parametrize("small", [4096, 12])  # with 12, some subjects and, with as many vectors, all go through the rounds
@pytest.mark.parametrize("named", [True, False])
def test_shared_vectors_give_the_same_abstractions(spark, small, named):
    rng = np.random.default_rng(8)
    keys = [(k, None if k == 3 else [0.0, 0.0] if k == 4 else [float(x) for x in rng.normal(size=2 if k < 9 else 3)]) for k in range(11)] + [(11, [1.0, 0.0]), (12, [2.0, 0.0])]
    keys = keys[3:] if small == 12 else keys
    rows = [(f"i{i:03}", None if i % 41 == 0 else f"s{i % 5 if i % 3 else 7}", f"o{i % 4}", "requires", "why" if i % 2 else "", ["c"] if i % 5 == 0 else [], "proposed" if i % 6 else "deprecated", 3 - i % 3, int(rng.integers(0, 14))) for i in range(130)]
    df = spark.createDataFrame(rows, "id string, subject_id string, object_id string, predicate string, rationale string, conditions array<string>, status string, seq int, v int")
    df = df if named else df.withColumns({"subject": F.lower("subject_id"), "object": F.col("object_id")})
    vectors = spark.createDataFrame(keys, "v int, vector array<double>")
    entities = spark.createDataFrame([("s1", "one"), ("o2", "two"), ("s9", "none"), ("s2", None)], "id string, name string") if named else None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        said = lambda d, v, **more: rows_of(jobs.compress(d, v, lambda m: m, dry=True, least=2, entities=entities, **more))
        want = said(df, df.join(vectors, "v").select("id", "vector"), cap=None)
        assert len(want) > 5 and max(len({rows[int(i[1:])][8] for i in r[2]}) for r in want) > 1
        assert said(df.unionByName(df.where("id < 'i050'")), vectors, cap=None, by="v", small=small) == want
        assert said(df, vectors, cap=4, by="v") == want[:4]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shared_vectors_are_not_dealt_with_their_rows(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("a vector for each row")

    monkeypatch.setattr(clustering, "linkage_by_group", never)
    rows = [(f"i{i}", f"s{i % 4}", f"o{i}", "requires", "", [], "accepted", 0, i % 3 % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, subject_id string, object_id string, predicate string, rationale string, conditions array<string>, status string, seq int, v int")
    entities = spark.createDataFrame([("s1", "one")], "id string, name string")
    made = jobs.compress(df, spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "v int, vector array<double>"), lambda m: m, dry=True, cap=None, entities=entities, by="v")
    assert len(made.collect()) == 8
