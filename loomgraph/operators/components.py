"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b", folder: str | None = None) -> DataFrame:
    """(node, component): each node of an edge with the smallest node it is connected to.

    Every round hangs the neighbours of a node below its smallest neighbour, first the larger ones, then the smaller
    ones; the number of rounds grows with the logarithm of the longest path. Minima are taken by partial aggregation
    and joined back, so a node with very many neighbours is not gathered anywhere. Each round is a written table, and the
    one before it is deleted. It ends when a round changes nothing.
    Self-loops only name their node; null ends are ignored; no edges give no rows.
    """
    save = Scratch(edges, "components", folder)
    raw = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = save(raw.where("u = v").select(F.col("u").alias("node")).distinct())
    now = save(raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _print(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = save(small)
        save.drop(save.n - 1)
        then, seen = seen, _print(now)
        if then == seen:
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).unionByName(loops).distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(roots.select("node", F.col("node").alias("component")))


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]
