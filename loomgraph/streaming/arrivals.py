"""Events as a stream of files with late and repeated rows: kept state, restarts, and results written once.

The stream drops repeats and counts in tumbling windows under one watermark; both keep state in the checkpoint, so a
query that was stopped or died goes on where it was. A batch of results is written to a folder of its own number, over
whatever an earlier attempt of this batch left there; a window comes out once, when the watermark has passed its end.

What counts as too late is a matter of the row alone (its arrival less its time), not of how the files were cut into
batches. So the stream's answer is that of a batch over the same rows, however often it was stopped in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.store import Store, keyed, live

#: Columns of an event, and its types in the stream.
EVENT = "id long, at timestamp, arrived timestamp, kind string, value double"
COUNTS = "start timestamp, kind string, n long, cents long"


def accepted(events: DataFrame, late: str) -> DataFrame:
    """Events with a time that arrived no later than late after it; the others are refused(), and never come into a stream."""
    return events.where(F.col("at").isNotNull() & (F.col("arrived") <= F.col("at") + F.expr(f"INTERVAL {late}")) & (F.col("arrived") >= F.col("at")))


def refused(events: DataFrame, late: str) -> DataFrame:
    """Events without time or arrival, those that arrived too late, and those that say they arrived before they happened."""
    fits = (F.col("arrived") <= F.col("at") + F.expr(f"INTERVAL {late}")) & (F.col("arrived") >= F.col("at"))
    return events.where(~F.coalesce(fits, F.lit(False)))


def counts(events: DataFrame, width: str) -> DataFrame:
    """(start, kind, n, cents) of events in windows of width; money that is null or not finite counts as nothing. Hot kinds are added up before they are shuffled."""
    cents = F.when(F.isnan("value") | (F.abs("value") == F.lit(float("inf"))), None).otherwise(F.floor(F.col("value") * 100 + 0.5).cast("long"))
    grouped = events.groupBy(F.window("at", width).alias("w"), "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(cents), F.lit(0)).alias("cents"))
    return grouped.select(F.col("w.start").alias("start"), "kind", "n", "cents")


def batch(events: DataFrame, late: str, width: str) -> DataFrame:
    """The answer over all events at once: repeats of an id are copies, and count once. Events without an id are no copies of one another only if they differ."""
    return counts(accepted(events, late).dropDuplicates(["id", "at"]), width)


def slices_of(events: DataFrame, slices: int) -> list[DataFrame]:
    """events in the order of their arrival, as a source would deliver them; rows without arrival come first."""
    ends = events.agg(F.percentile_approx(F.col("arrived").cast("double"), [k / slices for k in range(1, slices)], 10_000)).first()[0] if slices > 1 else []
    at = F.coalesce(F.col("arrived").cast("double"), F.lit(float("-inf")))
    place = sum(((at > F.lit(e)).cast("int") for e in ends or []), F.lit(0))
    return [events.where(place == k) for k in range(slices)]


def end_mark(events: DataFrame, late: str, width: str) -> DataFrame:
    """One event so far ahead that every window before it closes; its own never does."""
    ahead = F.coalesce(F.max("at"), F.lit("2000-01-01").cast("timestamp")) + F.expr(f"INTERVAL {late}") + F.expr(f"INTERVAL {late}") + F.expr(f"INTERVAL {width}") + F.expr(f"INTERVAL {width}")
    return events.agg(ahead.alias("at")).select(F.lit(None).cast("long").alias("id"), "at", F.col("at").alias("arrived"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("value"))


def run(spark: SparkSession, landing: str, checkpoint: str, out: str, late: str, width: str, after: Callable[[int], None] | None = None) -> None:
    """Takes in what has landed since the last run of this checkpoint, and ends. after is called when a batch is written, with its number.

    State is kept as the session says; where ids within the watermark outgrow the executors' memory, that should be
    RocksDB (spark.sql.streaming.stateStore.providerClass), which costs some megabytes of disk for each partition.
    """
    stream = spark.readStream.schema(EVENT).parquet(f"{landing}/*")
    once = accepted(stream, late).withWatermark("at", late).dropDuplicatesWithinWatermark(["id", "at"])

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if after:
            after(number)

    counts(once, width).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def results(spark: SparkSession, out: str) -> DataFrame:
    """The windows that have come out so far."""
    return spark.read.schema(COUNTS).parquet(f"{out}/batch=*")


def replay(events: DataFrame, folder: str, late: str = "4 days", width: str = "1 hour", slices: int = 3) -> DataFrame:
    """The counts of events as a stream in folder: each slice lands and is taken in by a start of its own on one checkpoint; then the end mark.

    The same as batch(): rows without a time, too late, or from the future are refused by both, an empty table gives no
    windows, a null kind is a kind. events has the columns of EVENT.
    """
    spark = events.sparkSession
    landing, checkpoint, out = (f"{folder}/{x}" for x in ("landing", "checkpoint", "counts"))
    for k, part in enumerate(slices_of(events, slices)):
        part.write.parquet(f"{landing}/{k}")
        run(spark, landing, checkpoint, out, late, width)
    end_mark(events, late, width).write.parquet(f"{landing}/end")
    run(spark, landing, checkpoint, out, late, width)
    return results(spark, out)


def merge(spark: SparkSession, landing: str, checkpoint: str, store: Store, name: str, schema: str, latest: list[str], gone: str, after: Callable[[int], None] | None = None) -> None:
    """Takes what has landed since the last run into a keyed table of a store, a version for each batch, and ends.

    A batch that is run again, after a crash between the store's commit and the stream's, finds its number applied and
    changes nothing. gone is the condition under which a row deletes its key.
    """
    stream = spark.readStream.schema(schema).parquet(f"{landing}/*")

    def write(rows: DataFrame, number: int) -> None:
        store.upsert(name, rows, latest, stream=checkpoint, batch=number, gone=F.expr(gone))
        if after:
            after(number)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


CHANGE = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def replay_changes(changes: DataFrame, folder: str, slices: int = 3, buckets: int = 8) -> DataFrame:
    """The state of every client after its changes came as a stream into a store in folder, in slices by change_id and a start for each.

    changes has the columns of CHANGE. Of a client's changes that of the greatest seq counts, of equals that of the
    greatest change_id, whenever it came; op D deletes. Changes without a client are refused. Repeats change nothing.
    """
    spark = changes.sparkSession
    known = changes.where("client_id is not null").select([c.split()[0] for c in CHANGE.split(", ")])
    store, landing = Store(spark, f"{folder}/store"), f"{folder}/landing"
    store.commit({"clients_now": keyed(spark.createDataFrame([], CHANGE))}, keys={"clients_now": ["client_id"]}, buckets=buckets)
    ends = known.agg(F.percentile_approx("change_id", [k / slices for k in range(1, slices)] or [0.5], 10_000)).first()[0] or []
    place = sum(((F.coalesce("change_id", F.lit(-1)) > F.lit(e)).cast("int") for e in ends), F.lit(0)) if slices > 1 else F.lit(0)
    for k in range(slices):
        known.where(place == k).write.parquet(f"{landing}/{k}")
        merge(spark, landing, f"{folder}/checkpoint", store, "clients_now", CHANGE, ["seq", "change_id"], "op = 'D'")
    return live(store.read()["clients_now"])
