"""Exact similarity join of new rows with all rows by a pivot index.

Rows are unit vectors. Some of them are pivots; every row belongs to the cell of its nearest pivot, and a cell knows the
least and the greatest angle of its rows to the pivot. By the triangle inequality on angles a new row can be within the
angle of the threshold only of rows whose angle to the pivot differs by no more than that from its own, so it goes to
the cells that leave room for it and no others. Cells are cut into parts of bounded size, and so are the new rows, so
neither a cell of many copies nor a large delta is a hot group; a task multiplies two parts as matrices.

How much is skipped depends on the vectors: near copies and clusters leave most cells out. In many dimensions without any
structure all angles are near 90 degrees and no cell can be left out; then a row meets all live ones, and what saves
work is that rows which are not new never meet one another.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import dot
from loomgraph.session import Scratch, ship

#: Rows of a part of a cell, or of the new rows, and pivots at most; the pivots are broadcast.
PART = 4096
PIVOTS = 1024
#: A task holds a part of a cell and up to DEAL parts of new rows.
DEAL = 8
#: More components than LONG are multiplied with the pivots by a loop instead of unrolled code.
LONG = 128
#: Rounding of sums and angles that may not hide a pair.
SLACK = 1e-6


def _product(a: Column, b: Column, dims: int) -> Column:
    """The product of two vectors of one length: unrolled where it is dims and not long, else in a loop."""
    if dims > LONG or not dims:
        return dot(a, b)
    unrolled = reduce(lambda x, y: x + y, [F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(dims)])
    return F.when(F.col("size") == dims, unrolled).otherwise(dot(a, b))


def _angle(cos: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def units(rows: DataFrame) -> DataFrame:
    """id, size and u: the length of the vector and its direction.

    Vectors that are null, empty, zero or hold a null or non-finite component have no direction and are left out: their
    cosine is 0, which no positive threshold lets in. Repeated rows stay repeated.
    """
    x = F.transform("vector", lambda v: v.cast("double"))
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))), F.lit(False)) & (F.size(x) > 0)
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    found = rows.select("id", x.alias("x"), sound.alias("sound")).where("sound").withColumn("length", length).where((F.col("length") > 0) & (F.col("length") < F.lit(math.inf)))
    return found.select("id", F.size("x").alias("size"), F.transform("x", lambda v: v / F.col("length")).alias("u"))


class Index(NamedTuple):
    """cells: size, cell, u, low, high, rows, parts. members: cell, part, id, size and u. dims: the longest vector."""

    cells: DataFrame
    members: DataFrame
    dims: int


def build(live: DataFrame, keep: Scratch, pivots: int | None = None, part: int = PART) -> Index:
    """The index of units. Pivots are drawn by a hash of their ids: a quarter of the root of the rows, PIVOTS at most, and one for each length."""
    n, dims = live.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    wanted = pivots or min(PIVOTS, 1 + math.isqrt(n) // 4)
    drawn = live.select("id", "size", "u").orderBy(F.xxhash64("id", "size"), "id", "u").limit(wanted)
    lengths = live.groupBy("size").agg(F.min(F.struct("id", "u")).alias("x")).select("x.id", "size", "x.u")
    chosen = keep(drawn.unionByName(lengths).dropDuplicates(["size", "u"]).select(F.col("size"), F.xxhash64("u", "size").alias("cell"), "u"))
    every = chosen.groupBy("size").agg(F.collect_list(F.struct("cell", F.col("u").alias("p"))).alias("pivots"))  # at most PIVOTS and the lengths, in a row for each length
    nearest = F.array_max(F.transform("pivots", lambda p: F.struct(dot(F.col("u"), p["p"]).alias("cos"), p["cell"].alias("cell"))))
    held = live.join(F.broadcast(every), "size").withColumn("at", nearest).select("id", "size", "u", F.col("at.cell").alias("cell"), _angle(F.col("at.cos")).alias("angle"))
    held = keep(held)
    stats = held.groupBy("cell", "size").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("rows"))
    cells = keep(chosen.join(stats, ["cell", "size"]).withColumn("parts", F.ceil(F.col("rows") / part).cast("int")))
    members = held.join(F.broadcast(cells.select("cell", "size", "parts")), ["cell", "size"]).select("cell", F.pmod(F.xxhash64("id", "u"), F.col("parts")).cast("int").alias("part"), "id", "size", "u")
    return Index(cells, members, dims)


def _met(new: DataFrame, index: Index, threshold: float, deal: int) -> DataFrame:
    """new rows, in deal parts, with every part of every cell that may hold a row within the threshold."""
    limit = math.acos(max(-1.0, min(1.0, threshold - SLACK))) + SLACK
    cells = F.broadcast(index.cells.select("size", "cell", F.col("u").alias("p"), "low", "high", "parts"))
    at = new.join(cells, "size").withColumn("angle", _angle(_product(F.col("u"), F.col("p"), index.dims)))
    room = (F.col("angle") <= F.col("high") + limit) & (F.col("angle") >= F.col("low") - limit)
    return at.where(room).select("id", "u", "size", "cell", F.pmod(F.xxhash64("id", "u"), F.lit(deal)).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _prepared(new: DataFrame, live: DataFrame, threshold: float, pivots: int | None, part: int) -> tuple[DataFrame, DataFrame, Index, DataFrame]:
    """What meets: the new rows and the members of cells, both by size, cell, part and share; the index; the new rows."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive: below it every pair would be one")
    keep = Scratch(live, "pivots")
    index = build(keep(units(live).distinct()), keep, pivots, part)
    fresh = keep(units(new).distinct())
    deal = max(1, -(-fresh.count() // (DEAL * part)))
    left = _met(fresh, index, threshold, deal)
    known = fresh.select(F.col("id").alias("known")).distinct()
    marked = index.members.join(known, F.col("id") == F.col("known"), "left").withColumn("both", F.col("known").isNotNull()).drop("known")
    right = marked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    return left, right, index, fresh


def delta_pairs(new: DataFrame, live: DataFrame, threshold: float, pivots: int | None = None, part: int = PART) -> DataFrame:
    """(a, b, score): every row a of new with every row b of live, other than itself, whose cosine reaches the threshold.

    new and live: id, vector. A pair of two new rows comes once, the smaller id first; rows of live that are not new never
    meet one another. Exact. The threshold must be positive. Repeated rows of one id and vector count once; vectors of
    different lengths have no cosine; those without a direction take no part; empty tables give no pairs.
    """
    ship(live.sparkSession)
    left, right, index, fresh = _prepared(new, live, threshold, pivots, part)
    kinds = dict(left.dtypes)["id"], dict(right.dtypes)["id"]

    def products(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        u, v = np.stack(x["u"].to_numpy()), np.stack(y["u"].to_numpy())
        one, other, both, out = x["id"].to_numpy(), y["id"].to_numpy(), y["both"].to_numpy(bool), []
        for start in range(0, len(x), 1024):
            score = np.round(u[start : start + 1024] @ v.T, 6)
            a, b = np.nonzero(score >= threshold)
            found = pd.DataFrame({"a": one[start + a], "b": other[b], "score": score[a, b]})
            out.append(found[(found["a"] != found["b"]) & (~both[b] | (found["a"] < found["b"]))])
        return pd.concat(out)

    keys = ["size", "cell", "part", "share"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(products, f"a {kinds[0]}, b {kinds[1]}, score double").where("a <> b")
    # Each two rows meet once, so only an id with several vectors can give a pair twice.
    several = any(not df.groupBy("id").count().where("count > 1").isEmpty() for df in (fresh, index.members))
    return found.distinct() if several else found


def work(new: DataFrame, live: DataFrame, threshold: float, pivots: int | None = None, part: int = PART) -> DataFrame:
    """One row of what delta_pairs does: rows new and live, cells, pairs of all live rows with all, and pairs that are scored."""
    left, right, index, fresh = _prepared(new, live, threshold, pivots, part)
    keys = ["size", "cell", "part", "share"]
    met = left.groupBy(*keys).agg(F.count("*").alias("x")).join(right.groupBy(*keys).agg(F.count("*").alias("y")), keys).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("scored"))
    sizes = index.members.agg(F.count("*").alias("live")).crossJoin(fresh.agg(F.count("*").alias("new"))).crossJoin(index.cells.agg(F.count("*").alias("cells")))  # a row each
    return sizes.crossJoin(met).select("new", "live", "cells", (F.col("live") * F.col("live")).alias("square"), "scored")
