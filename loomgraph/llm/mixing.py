"""Mixing sources to target weights.

Tokens are summed by source, targets follow from the weights, and each document is emitted floor(rate) times plus
once more with the probability that the fraction of its source's rate gives. The coin is a hash of seed and doc_id,
so a rerun, a retried task or another partitioning gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, fresh, small, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, get the weights in turn. share times all words is dealt by weight; a source
    takes at most cap times its own words, and what it leaves is dealt again until nobody is above. That is a water
    level: a source of cap/weight below the level is full. Sorted by cap/weight, the level after the k fullest is
    (total - their caps) / (weights left). One row per source, so the one-partition windows stay small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source, in this order, that its level does not fill sets the level for all after it
    final = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(everything)
    rows = rows.withColumn("final", final["level"])
    return rows.select("source", "source_size", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("final"))).alias("target"))


def coin(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of seed and id, or of the text of a row without an id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, rate and copies, one row per document.

    Null text has size 0; null source is a source of its own; a source without words has rate 0; repeated rows each
    count and share their coin, rows without an id if their texts are equal; an empty table gives no rows. Columns of these names in docs are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies")
    sized = docs.withColumn("size", word_count(F.col("text")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    key = fresh(docs, "mix_source")
    targets = source_targets(sizes, weights, share, cap).withColumnRenamed("source", key)
    if docs.select("source").distinct().limit(100_001).count() <= 100_000:  # else joined by shuffling, hot sources split by AQE
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col(key)), "left").drop(key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", rate)
    extra = (coin(F.col("doc_id"), F.col("text"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate").cast("long") + extra)


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of docs.

    Nulls, repeats and empty tables as in mix. A document whose source has no words is not taken, and neither is any with
    no copies; an empty text in a source with words is taken like its neighbours. docs may have columns of any name, also of those that mix gives: they come out as they were.
    """
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))  # out of reach of the names that mix gives
    mixed = mix(whole, **options).where(F.col("copies") > 0)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("whole.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS coin, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place,
  ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(most) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM w WINDOW p AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, coalesce(weight * (SELECT arg_min(level, place) FROM f WHERE level * weight < most), most)) AS target FROM f),
j AS (SELECT d.doc_id, d.coin, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coin), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM j)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
