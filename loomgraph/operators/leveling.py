"""Longest paths from the sources of a graph by raking and compressing, in rounds that grow with the logarithm of a chain.

A round does two things. Compress: a node with one way in and one way out only passes a level on, as the larger of a sum
and a constant; such nodes look past one another by pointer jumping, so a chain of n nodes is one edge after log n
steps, and its nodes are resolved from the chain's head afterwards. Rake: nodes without a way in have their level, and
leave. Chains and trees of any depth thus end in few rounds; a graph that is deep without chains still takes one for
each level. Nodes on or behind a cycle are never reached and have no level.

Before the rounds, what lies together is done where it lies: a task cuts the edges that it reads into stretches and finds
the levels of each connected piece of a stretch. A piece none of whose nodes is in another piece is the whole of its
component, and finished; only the others go through the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from loomgraph.operators.normalise import merged
from loomgraph.session import Scratch, ship

#: Edges of a stretch, about; a task holds one.
STRETCH = 200_000
#: Levels to which a stretch is followed in its task; deeper pieces go through the rounds.
DEPTH = 1_000


def _stretch_levels(src: np.ndarray, dst: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """level (-1: none) of n nodes, the edges' ends by start and where each node's begin, and whether all was followed to its end."""
    order = np.argsort(src, kind="stable")
    to, begin = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    level, waits = np.full(n, -1, np.int32), np.bincount(dst, minlength=n)
    now, at = np.flatnonzero(waits == 0), 0
    while len(now) and at < depth:
        level[now] = at
        out = begin[now + 1] - begin[now]
        ends = to[np.repeat(begin[now] - np.cumsum(out) + out, out) + np.arange(out.sum())]
        np.subtract.at(waits, ends, 1)
        ends = np.unique(ends)
        now, at = ends[waits[ends] == 0], at + 1
    return level, to, begin, not len(now)


def _pieces(edges: DataFrame, stretch: int, depth: int) -> DataFrame:
    """(node, piece, level, deep, next): the nodes of each connected piece of a stretch of edges, with the nodes that its edges lead to.

    level is null on or behind a cycle. A piece that is deep was not followed to its end.
    """
    ship(edges.sparkSession)
    kind = dict(edges.dtypes)["src"]

    def solved(held: list[pa.RecordBatch], base: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        both = pa.concat_arrays([t[c].combine_chunks() for c in ("src", "dst")]).dictionary_encode()
        names, places = both.dictionary, both.indices.to_numpy()
        src, dst = places[: len(t)], places[len(t) :]
        level, to, begin, ended = _stretch_levels(src, dst, len(names), depth)
        root = merged(np.arange(len(names)), src, dst)
        deep = np.zeros(len(names), bool)
        if not ended:
            deep[root[level < 0]] = True
        ahead = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), names.take(pa.array(to)))
        return pa.RecordBatch.from_arrays([names, pa.array(base + root), pa.array(level, mask=level < 0), pa.array(deep[root]), ahead], ["node", "piece", "level", "deep", "next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, rows = TaskContext.get().partitionId() << 40, [], 0
        for part in (batch.slice(at, stretch) for batch in batches for at in range(0, batch.num_rows, stretch)):
            held.append(part)
            rows += part.num_rows
            if rows >= stretch:
                out = solved(held, base)
                base, held, rows = base + out.num_rows, [], 0
                yield out
        if rows:
            yield solved(held, base)

    return edges.mapInArrow(run, f"node {kind}, piece long, level int, deep boolean, next array<{kind}>")


def _jumped(chain: DataFrame, save: Scratch) -> tuple[DataFrame, int]:
    """chain (node, head, a, c) with each head the first node that is not in chain, and the steps taken; rows of pure rings are left out."""
    n = chain.count()
    steps = 0
    while n and steps <= math.ceil(math.log2(n + 1)):
        ahead = chain.select(F.col("node").alias("at"), F.col("head").alias("next"), F.col("a").alias("more"), F.col("c").alias("least"))
        both = chain.join(ahead, F.col("head") == F.col("at"), "left")
        if both.where("at is not null").isEmpty():
            return chain, steps
        on = F.col("at").isNotNull()
        jumped = both.select("node", F.when(on, F.col("next")).otherwise(F.col("head")).alias("head"), F.when(on, F.col("a") + F.col("more")).otherwise(F.col("a")).alias("a"), F.when(on, F.greatest(F.col("c"), F.col("least") + F.col("a"))).otherwise(F.col("c")).alias("c"))
        chain = save(jumped)
        if steps:
            save.drop(save.n - 1)
        steps += 1
    return chain.join(chain.select(F.col("node").alias("head")), "head", "left_anti").select("node", "head", "a", "c"), steps


def longest(edges: DataFrame, rounds: list[int] | None = None, stretch: int = STRETCH, depth: int = DEPTH) -> DataFrame:
    """(node, level): edges of the longest path from a source, for nodes that no cycle blocks.

    Repeated edges count once, edges with a null end are ignored, a self-loop blocks its node. No edges give no rows.
    rounds, if given, gets the steps of every round, jumps included. Edges of a component that lie together (in stretches
    of about so many edges, and to so many levels) need no round; how edges lie does not change the result.
    """
    kind = edges.select(F.array("src", "dst").alias("ends")).schema["ends"].dataType.elementType
    edges = edges.where("src is not null and dst is not null").select(F.col("src").cast(kind), F.col("dst").cast(kind))
    if not isinstance(kind, AtomicType):
        return _by_rounds(edges, rounds)
    save = Scratch(edges, "pieces")
    found = save(_pieces(edges, stretch, depth))
    # A hash that two nodes share opens pieces without need; it closes none.
    mark = F.xxhash64("node").alias("mark")
    shared = save(found.groupBy(mark).agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high").select("mark"))
    done = found.where("level is not null").select("node", "level", "piece")
    if shared.isEmpty() and found.where("deep").isEmpty():
        return done.select("node", "level")
    open_ = save(found.select("piece", mark).join(shared, "mark", "left_semi").select("piece").unionByName(found.where("deep").select("piece")).distinct())
    rest = found.join(open_, "piece", "left_semi").select(F.col("node").alias("src"), F.explode("next").alias("dst"))
    return done.join(open_, "piece", "left_anti").select("node", "level").unionByName(_by_rounds(rest, rounds))


def _by_rounds(edges: DataFrame, rounds: list[int] | None) -> DataFrame:
    """longest of edges without null ends, raking and compressing."""
    save = Scratch(edges, "longest")
    e = save(edges.distinct().withColumn("w", F.lit(1)))
    base = save(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("base", F.lit(0)))
    done, later = [], []
    while True:
        into = e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("head"), "w", (F.col("src") == F.col("dst")).alias("loop"))
        out = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast(dict(e.dtypes)["src"]).alias("head"), F.lit(None).cast("int").alias("w"), F.lit(False).alias("loop"))
        ends = into.unionByName(out).groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.max("head").alias("head"), F.max("w").alias("w"), F.bool_or("loop").alias("loop"))
        nodes = save(base.join(ends, "node", "left"))
        at = save.n
        first = save(nodes.where("i = 1 and o = 1 and not loop").select("node", "head", F.col("w").alias("a"), F.col("base").alias("c")))
        steps = 0
        if not first.isEmpty():
            chain, steps = _jumped(first, save)
            later.append(save(chain))
            inner = first.select("node")
            last = e.join(later[-1].withColumnsRenamed({"node": "src"}), "src").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti")
            short = last.select(F.col("head").alias("src"), "dst", (F.col("a") + F.col("w")).alias("w"))
            rest = e.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti")
            e2 = save(rest.unionByName(short).groupBy("src", "dst").agg(F.max("w").alias("w")))
            given = last.select(F.col("dst").alias("node"), (F.col("c") + F.col("w")).alias("given"))
            left = nodes.select("node", "base").join(inner, "node", "left_anti").join(given.groupBy("node").agg(F.max("given").alias("given")), "node", "left")
            nodes2 = save(left.select("node", F.greatest("base", F.coalesce("given", F.lit(0))).alias("base")))
        else:
            e2, nodes2 = e, nodes.select("node", "base")
        ready = save(nodes2.join(e2.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if rounds is not None:
            rounds.append(steps + 1)
        if ready.isEmpty():
            if first.isEmpty():
                break
            e, base = e2, nodes2
            continue
        done.append(ready)
        gone = e2.join(ready.withColumnRenamed("node", "src"), "src")
        raised = gone.groupBy(F.col("dst").alias("node")).agg(F.max(F.col("base") + F.col("w")).alias("given"))
        base = save(nodes2.join(ready.select("node"), "node", "left_anti").join(raised, "node", "left").select("node", F.greatest("base", F.coalesce("given", F.lit(0))).alias("base")))
        e = save(e2.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
        save.drop(at)
        if base.isEmpty():
            break
    if not done:
        return base.select("node", F.col("base").alias("level")).limit(0)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    found = found.select("node", F.col("base").alias("level"))
    for chain in reversed(later):  # a head may itself have been compressed in a later round
        more = chain.join(found.select(F.col("node").alias("head"), "level"), "head").select("node", F.greatest(F.col("level") + F.col("a"), F.col("c")).alias("level"))
        found = save(found.unionByName(more))
    return found.select("node", F.col("level").cast("int").alias("level"))
