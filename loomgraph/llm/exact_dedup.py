"""Exact deduplication by a heavy-hitter split, in DataFrame functions only.

Spark's frequent-items sketch (Misra-Gries counters) finds digests that may be frequent, each bucket of digests with
counters of its own. Their counts are then taken exactly, and the winners of those that are frequent are broadcast,
so their copies go map-side. All other digests are shuffled and ranked in ordinary windows, whose groups are small
because the frequent ones have gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, fresh, small, table, written

BUCKETS = 32
COUNTERS = 256
HEAVY = 64


def digest(text):
    """SHA-256 of the text with A-Z lowered; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def heavy_digests(rows: DataFrame, buckets: int = BUCKETS, counters: int = COUNTERS, heavy: int = HEAVY) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that are found and verified as frequent: at most buckets * counters rows.

    Misra-Gries misses none that fill more than 1/(0.75 * counters) of their bucket's rows. Those it misses are
    handled exactly by the ordinary shuffle, so the split decides speed, never results.
    """
    bucketed = rows.select("digest", F.pmod(F.hash("digest"), F.lit(buckets)).alias("bucket"))
    sketches = bucketed.groupBy("bucket").agg(F.expr(f"approx_top_k(digest, {counters}, {counters})").alias("top"))
    candidates = sketches.select(F.explode("top").alias("t")).where(F.col("t.count") >= heavy).select(F.col("t.item").alias("digest"))
    exact = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return exact.where(F.col("group_size") >= heavy)


def decide(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """rows (doc_id, digest) to doc_id, keep_id, group_size, kept, digest: one row for each row of rows."""
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    hot = marked.where(F.col("group_size").isNotNull())
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    lost = hot.where(~wins).withColumn("kept", F.lit(False))
    # a winner's row may be repeated: one of them stays
    won = hot.where(wins).groupBy("digest", "doc_id", "keep_id", "group_size").agg(F.count("*").alias("n"))
    won = won.select("digest", "doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    won = won.withColumn("kept", F.col("nth") == 1).drop("nth")
    group = Window.partitionBy("digest")
    light = marked.where(F.col("group_size").isNull()).select("digest", "doc_id")
    light = light.select("digest", "doc_id", F.max("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"), (F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())) == 1).alias("kept"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    return light.select(columns).unionByName(lost.select(columns)).unionByName(won.select(columns))


def exact_dedup(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    Null text counts as empty. The largest doc_id of equal texts stays; a null doc_id is below all others. Of repeated
    rows one stays. An empty table gives no rows; other columns of docs play no part.
    """
    rows = written(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    return decide(rows, written(heavy_digests(rows, heavy=heavy), "heavy"))


def survivors(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The documents that stay, whole, with the columns of docs. Texts that win are not grouped or sorted by digest."""
    key = fresh(docs, "exact_digest")
    decisions = written(exact_dedup(docs, heavy), "decisions")
    pair = ["doc_id", "digest"]
    gone = decisions.groupBy(pair).agg(F.bool_or("kept").alias("any"), F.count("*").alias("n"))
    keyed = docs.withColumn(key, digest(F.col("text")))
    match = lambda right: keyed["doc_id"].eqNullSafe(right["doc_id"]) & (keyed[key] == right["digest"])
    dropped = small(gone.where(~F.col("any") | (F.col("n") > 1)).select(pair))
    once = keyed.join(dropped, match(dropped), "left_anti").drop(key)
    repeated = gone.where(F.col("any") & (F.col("n") > 1)).select(pair)
    if repeated.isEmpty():
        return once
    again = keyed.join(repeated, match(repeated), "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    return once.unionByName(again)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP3_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
