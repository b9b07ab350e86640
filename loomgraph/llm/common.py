"""Shared helpers of the training-data operators: table access, durable intermediates, word rules."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import remove, shared_dir

#: A word, as the contracts define it: a run of anything but ASCII space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a list of keys is broadcast; its size is counted first, and longer lists are joined by shuffling.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def save(df: DataFrame, name: str) -> str:
    """df as a Parquet table in the shared folder; its path. The table is removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df saved and read back: that cuts the lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(save(df, name))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run as a function of Arrow batches that gives its memory back when a task ends: Python workers are used again, and each stage has its own."""

    def tidy(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidy


def slices(batch, rows: int = 512) -> Iterator:
    """A batch in slices of rows at most, so that what is computed of them stays small."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII text takes the fast lower()."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, low))


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most bound rows, else unchanged (then it is joined by shuffling)."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
