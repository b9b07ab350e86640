"""A training corpus from documents: quality, exact and near duplicates, source mix, token pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next. All but the last return the columns of documents, with whatever other columns docs has.

Nulls in any column, empty and very long texts, ties, repeated rows and empty tables are handled as each operator's
docstring says: a row without an id is judged by its text like any other, null text counts as empty, of repeated rows
one stays after exact_dedup, and an empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import exact_dedup, jaccard, mixing, pieces, quality
from loomgraph.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the quality classifier, trained on docs and labels, rejects."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, case of A-Z aside: that of the largest doc_id."""
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8."""
    return jaccard.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix of sources takes them."""
    return mixing.emit(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token pieces of every row of docs; null text gives null pieces."""
    return pieces.encode(docs).select("doc_id", "pieces")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_duplicates", near_stage),
    ("mix", mix_stage),
    ("pieces", pieces_stage),
]
#: SQL can express neither the classifier nor the pieces; tests/llm calls every stage and compares it with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
