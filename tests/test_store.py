"""The versioned store: crashes, damage, conflicts, upserts, migrations, and a stream that fills it."""

import os
import random

import pytest
from compare import SF, duck, same
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomgraph.plans import catalogue
from loomgraph.plans.projection import with_views
from loomgraph.sources.store import Conflict, Damaged, Store, fingerprint, keyed, live
from loomgraph.streaming import arrivals

SCHEMA = "id long, v string, tags array<string>, n int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/store"


def test_fingerprints_see_values_not_order(spark):
    rows = [(1, None, ["a", None], 1), (2, "x", [None, "a"], None), (2, "x", [None, "a"], None), (None, "1", [], 0)]
    one = fingerprint(spark.createDataFrame(rows, SCHEMA))
    assert one == fingerprint(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3))
    for changed in ([(1, None, [None, "a"], 1), *rows[1:]], [(None, 1, ["a", None], 1), *rows[1:]], [*rows[:3], (None, "1", None, 0)], [rows[0], rows[0], *rows[2:]]):
        assert fingerprint(spark.createDataFrame([tuple(map(lambda x: x, (r[0], None if r[1] is None else str(r[1]), *r[2:]))) for r in changed], SCHEMA)) != one
    assert fingerprint(spark.createDataFrame([], SCHEMA))[0]["rows"] == 0


def test_a_writer_that_dies_leaves_the_old_version(spark, path, tmp_path):
    store = Store(spark, path)
    assert store.versions() == [] and store.read() == {}
    a = spark.createDataFrame([(1, "a", ["x"], 1), (2, None, None, None)], SCHEMA)
    assert store.commit({"t": a, "u": a.limit(0)}) == 1
    with pytest.raises(Exception, match="died"):
        store.commit({"t": a.limit(0), "u": a.withColumn("v", F.when(F.col("id") > 0, F.raise_error(F.lit("died"))).otherwise("x"))})
    assert store.versions() == [1] and rows_of(store.read()["t"]) == rows_of(a) and store.read()["u"].count() == 0
    assert len(os.listdir(tmp_path / "store" / "data")) > 2 and store.vacuum() >= 1  # what the dead writer left
    assert len(os.listdir(tmp_path / "store" / "data")) == 2 and rows_of(store.read()["t"]) == rows_of(a)
    (tmp_path / "store" / "versions" / "2.json.abc.tmp").write_text("{")  # a manifest half written is none
    assert store.versions() == [1] and store.commit({"u": a}) == 2
    assert rows_of(store.read()["u"]) == rows_of(store.read()["t"]) == rows_of(store.read(1)["t"])


@pytest.mark.parametrize("key", [[], ["id"]])
def test_damage_is_refused(spark, path, tmp_path, key):
    store = Store(spark, path)
    rows = [(i, f"v{i}", [], i) for i in range(50)]
    store.commit({"t": spark.createDataFrame(rows, SCHEMA)}, keys={"t": key})
    entry = store.manifest()["tables"]["t"]
    assert rows_of(store.read()["t"]) == sorted(rows, key=repr) and sum(p["rows"] for p in entry["parts"]) == 50
    part = entry["parts"][0]["path"]
    df = spark.read.parquet(part)
    first = df.first()["id"]
    changed = spark.createDataFrame([(r["id"], "other" if r["id"] == first else r["v"], r["tags"], r["n"]) for r in df.collect()], SCHEMA)
    changed.write.mode("overwrite").parquet(part)  # as many rows as before
    with pytest.raises(Damaged):
        store.read()
    assert store.read(check=False)["t"].count() == 50


def test_writers_in_conflict(spark, path):
    store = Store(spark, path)
    a = spark.createDataFrame([(1, "a", [], 1)], SCHEMA)
    store.commit({"t": a})
    seen = store.manifest()["number"]
    store.commit({"t": a.withColumn("n", F.lit(2))}, seen)
    with pytest.raises(Conflict):
        store.commit({"t": a}, seen)
    late = store.manifest(1)
    with pytest.raises(Conflict):  # both had read version 1, and the other one is published
        store._version(late, late["tables"])
    assert store.read()["t"].first()["n"] == 2 and store.read(1)["t"].first()["n"] == 1
    with pytest.raises(ValueError):
        store.manifest(9)


def test_upserts_are_the_latest_rows(spark, path):
    rng = random.Random(4)
    store = Store(spark, path)
    store.commit({"t": keyed(spark.createDataFrame([], SCHEMA)), "other": spark.createDataFrame([(1,)], "x int")}, keys={"t": ["id"]}, buckets=5)
    want = {}
    for batch in range(4):
        rows = [(rng.randrange(30), f"b{batch}", None, rng.choice([None, *range(9)])) for _ in range(25)]
        rows = [(*r[:3], r[3] if r[3] is None else r[3] * 100 + batch * 25 + i) for i, r in enumerate(rows)]  # no ties but nulls
        rows = [r for r in rows if r[3] is not None or batch == 0]
        for r in rows:
            key = (r[3] is not None, r[3] or 0)
            if r[0] not in want or key > want[r[0]][0]:
                want[r[0]] = (key, r)
        store.upsert("t", spark.createDataFrame(rows + rows[:2], SCHEMA), ["n"], "s", batch, gone=F.col("n") % 7 == 0)
        number = store.manifest()["number"]
        assert store.upsert("t", spark.createDataFrame([(1, "again", None, 10**6)], SCHEMA), ["n"], "s", batch) == number  # applied already
    got = {r["id"]: r["n"] for r in live(store.read()["t"]).collect()}
    assert got == {k: r[3] for k, (_, r) in want.items() if not (r[3] is not None and r[3] % 7 == 0)}
    before = {p["bucket"]: p["path"] for p in store.manifest()["tables"]["t"]["parts"]}
    store.upsert("t", spark.createDataFrame([(3, "one", [], 10**7)], SCHEMA), ["n"])
    after = {p["bucket"]: p["path"] for p in store.manifest()["tables"]["t"]["parts"]}
    assert sum(before.get(b) != after[b] for b in after) == 1  # only the bucket it touches is written
    with pytest.raises(ValueError):
        store.upsert("t", spark.createDataFrame([(None, "x", [], 1)], SCHEMA), ["n"])
    assert store.upsert("t", spark.createDataFrame([], SCHEMA), ["n"]) and store.read()["other"].count() == 1


def test_migrations(spark, path):
    Store(spark, path).commit({"t": spark.createDataFrame([(1, "a", [], 1)], SCHEMA), "old": spark.range(2)}, keys={"t": ["id"]})
    steps = {1: lambda t: {"t": t["t"].withColumnRenamed("v", "name")}, 2: lambda t: t | {"new": t["t"].select("name")}}
    new = Store(spark, path, steps, 3)
    assert new.read()["t"].columns == ["id", "name", "tags", "n"] and set(new.read()) == {"t", "new"}
    assert new.migrate() == 2 == new.migrate() and new.manifest()["format"] == 3 and rows_of(new.read()["new"]) == [("a",)]
    with pytest.raises(ValueError, match="newer"):
        Store(spark, path).read()
    with pytest.raises(ValueError, match="no migration"):
        Store(spark, path, {}, 4).read()


def changes(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(20) if i % 11 else None, rng.randrange(40) if i % 13 else None, rng.choice("IUUUD"), None, "s", None, f"c{i}", i / 3) for i in range(200)]
    return spark.createDataFrame([*rows, rows[7], rows[7]], arrivals.CHANGE)


def last(rows):
    best = {}
    for r in rows:
        key = (r["seq"] is not None, r["seq"] or 0, r["change_id"])
        if r["client_id"] is not None and (r["client_id"] not in best or key > best[r["client_id"]][0]):
            best[r["client_id"]] = key, tuple(r)
    return sorted((x for _, x in best.values() if x[3] != "D"), key=repr)


def test_changes_by_stream(spark, tmp_path):
    df = changes(spark)
    assert rows_of(arrivals.replay_changes(df, f"file://{tmp_path}", 3, 4)) == last(df.collect())
    assert arrivals.replay_changes(df.limit(0), f"file://{tmp_path}/none", 2).count() == 0


def test_crash_between_the_two_commits(spark, tmp_path):
    df, failed = changes(spark).where("client_id is not null"), []
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"t": keyed(df.limit(0))}, keys={"t": ["client_id"]})

    def fail(number):
        if number not in failed:
            failed.append(number)
            raise RuntimeError("lost")

    for k in range(3):
        df.where(f"change_id % 3 = {k}").write.parquet(f"file://{tmp_path}/landing/{k}")
        args = (spark, f"file://{tmp_path}/landing", f"file://{tmp_path}/checkpoint", store, "t", arrivals.CHANGE, ["seq", "change_id"], "op = 'D'", fail)
        with pytest.raises(StreamingQueryException):
            arrivals.merge(*args)
        arrivals.merge(*args)
    assert len(failed) == 3 and store.versions() == [1, 2, 3, 4]
    assert rows_of(live(store.read()["t"])) == last(df.collect())


def test_queries(spark):
    changed = spark.read.parquet(f"{SF}/client_changes.parquet")
    assert rows_of(catalogue.QUERIES["oT4_changes"](spark, SF)) == last(changed.select([c.split()[0] for c in arrivals.CHANGE.split(", ")]).collect())
    sql = """WITH a AS (SELECT unnest([subject_id, object_id]) AS id FROM kg_assertions WHERE status = 'accepted')
SELECT id, name, CASE WHEN status = 'proposed' AND id IN (SELECT id FROM a) THEN 'accepted' ELSE status END AS status, (status = 'proposed' AND id IN (SELECT id FROM a))::INTEGER AS revision FROM kg_entities"""
    same(catalogue.QUERIES["oS13_store"](spark, SF), with_views(sql), duck())
