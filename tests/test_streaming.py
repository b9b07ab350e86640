"""The stream of arrivals against the batch answer: restarts, a crash after a write, late and repeated rows."""

import datetime as dt

import pytest
from compare import SF
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomgraph.plans import catalogue
from loomgraph.streaming import arrivals

T = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def events(spark):
    rows = []
    for i in range(300):
        at = T + dt.timedelta(minutes=11 * i)
        late = dt.timedelta(minutes=i % 7, hours=30 if i % 17 == 0 else 0)
        rows.append((i, at, at + late, ("a", "b", None)[i % 3], None if i % 9 == 0 else float("nan") if i % 31 == 0 else i / 8))
    rows += [rows[5], rows[6], (7, rows[7][1], rows[7][2] + dt.timedelta(hours=40), *rows[7][3:])]  # copies, one of them late
    rows += [(900, None, T, "a", 1.0), (901, T, None, "a", 1.0), (902, T, T + dt.timedelta(days=9), "a", 1.0), (903, T + dt.timedelta(days=90), T, "a", 1.0)]  # refused
    return spark.createDataFrame(rows, arrivals.EVENT)


@pytest.mark.parametrize("slices", [1, 4])
def test_stream_is_the_batch(spark, tmp_path, slices):
    df = events(spark)
    want = rows_of(arrivals.batch(df, "2 days", "1 hour"))
    assert rows_of(arrivals.replay(df, f"file://{tmp_path}", "2 days", "1 hour", slices)) == want
    assert sum(r[2] for r in want) == 300 and arrivals.refused(df, "2 days").count() == 4


def test_crash_between_write_and_commit(spark, tmp_path):
    df = events(spark)
    landing, checkpoint, out = (f"file://{tmp_path}/{x}" for x in ("landing", "checkpoint", "counts"))
    failed = []

    def fail(number):
        if number not in failed:
            failed.append(number)
            raise RuntimeError("lost")

    for k, part in enumerate([*arrivals.slices_of(df, 3), arrivals.end_mark(df, "2 days", "1 hour")]):
        part.write.parquet(f"{landing}/{k}")
        for _ in range(9):
            try:
                arrivals.run(spark, landing, checkpoint, out, "2 days", "1 hour", fail)
                break
            except StreamingQueryException:
                continue
    assert len(failed) >= 4  # every batch was written, lost and written again
    assert rows_of(arrivals.results(spark, out)) == rows_of(arrivals.batch(df, "2 days", "1 hour"))


def test_no_events(spark, tmp_path):
    assert arrivals.replay(events(spark).limit(0), f"file://{tmp_path}", slices=2).count() == 0


def test_query_is_the_batch(spark):
    clicks = spark.read.parquet(f"{SF}/clicks.parquet")
    df = clicks.select(F.col("click_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("arrived_at").cast("timestamp").alias("arrived"), "kind", "value")
    assert rows_of(catalogue.QUERIES["oT3_stream"](spark, SF)) == rows_of(arrivals.batch(df, "4 days", "1 hour"))
