"""Nothing is lost on the way: columns with the operators' own names, long texts before others, most bytes through the tree."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import SF
from loomgraph.llm import mixing, quality, sharding, toxicity

CLASHING = {"size": "777", "source_size": "x", "target": "y", "rate": "z", "copies": "many", "copy": "c", "whole": "w", "quality_score": "keep", "digest": "d", "exact_digest": "e", "mix_source": "m", "mix_copy": "n", "prefix": "p", "component_id": "q", "n_shingles": "r", "u": "s", "kept": "t"}


def test_clashing_columns_keep_their_values(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).withColumns({c: F.concat(F.lit(v), F.col("doc_id").cast("string")) for c, v in CLASHING.items()})
    want = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r.asDict() == want[r["doc_id"]] for r in rows), name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")


def test_emit_and_good_alone(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", 777, "x", 2.0) for i in range(4)], "doc_id long, text string, source string, size int, rate string, copies double").withColumn("lang", F.lit("en"))
    assert {(r["size"], r["rate"], r["copies"]) for r in mixing.emit(docs).collect()} == {(777, "x", 2.0)}
    kept = quality.good(docs.withColumn("quality_score", F.lit("keep")), spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert kept.count() == 4 and {r["quality_score"] for r in kept.collect()} == {"keep"}


@pytest.mark.parametrize("place", range(6))
def test_a_long_text_costs_no_other(spark, place):
    ids = [i for i in range(60) if not spark.range(1).select(toxicity.held_out(F.lit(i))).first()[0]][:6]
    labels = spark.createDataFrame([(i, 0) for i in ids], "doc_id long, toxic int")
    order = [r["doc_id"] for r in labels.orderBy(F.md5(F.concat(F.lit("tox:"), F.col("doc_id").cast("string")))).collect()]
    docs = [(i, "x" * 5000 if k == place else f"text {i}") for k, i in enumerate(order)]
    df = spark.createDataFrame(docs + [docs[(place + 1) % 6]] * 500, "doc_id long, text string")  # repeats count once
    rows = toxicity.training_rows(df, labels, most=1000)
    assert sorted(t for t, _ in rows) == sorted(t for _, t in docs if len(t) < 5000)


def test_most_bytes_go_through_the_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = docs.groupBy("text").agg(F.sum(F.octet_length("text") + 1).alias("w"))
    total = groups.agg(F.sum("w")).first()[0]
    dealt = groups.where(F.col("w") * sharding.SHARDS * sharding.ATOM > total).agg(F.sum("w")).first()[0] or 0
    load = [r["s"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert dealt < 0.1 * total and len(load) == 16 and max(load) < 1.04 * total / 16 and min(load) > 0.96 * total / 16
