"""Sharding by a k-d tree over text metadata, in DataFrame functions only.

The tree splits recursively at weighted medians along the widest dimension until every leaf is one shard of about the
target bytes. The dimensions (size, share of non-ASCII bytes, lines) are functions of the text, with its CRC to order
ties, so copies of a text meet the same splits and share a shard, and a document finds its leaf without any join. The
medians come from histograms that executors add up: the driver sees a bounded number of bins, never rows.
A text that fills, with its copies, more than 1/ATOM of a shard is more than a split can even out: such texts (at most
SHARDS * ATOM of them) are dealt first, largest to the emptiest, and the splits leave room for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import table, written

SHARDS = 16
ATOM = 8
BINS = 1024
ROUNDS = 8
GRID = (1 << 30) - 1
DIMS = ("d_size", "d_wide", "d_lines")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc and the raw dimensions; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text)
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return docs.select("doc_id", (size + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.log(size + F.lit(1.0)).alias("d_size"), (F.octet_length(text) / F.greatest(F.length(text), F.lit(1))).cast("double").alias("d_wide"), F.log(lines.cast("double")).alias("d_lines"))


def _keys(rows: DataFrame) -> DataFrame:
    """The dimensions on a common integer grid, the CRC below them: position = grid * 2^32 + crc."""
    low = rows.agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = rows
    for d in DIMS:
        lo, hi = low[f"lo_{d}"], low[f"hi_{d}"]
        place = F.floor((F.col(d) - F.lit(lo)) / F.lit(hi - lo) * F.lit(GRID)).cast("long") if lo is not None and hi > lo else F.lit(0).cast("long")
        out = out.withColumn(d, place * F.lit(1 << 32) + F.col("crc"))
    return out


def _route(tree: dict, node: int) -> Column:
    """The leaf, or open node, that the splits found so far lead to."""
    if node not in tree:
        return F.lit(node)
    dim, cut, left, right = tree[node]
    return F.when(F.col(dim) <= F.lit(cut), _route(tree, left)).otherwise(_route(tree, right))


def _medians(rows: DataFrame, wanted: dict[int, tuple[str, float, int, int]]) -> dict[int, int]:
    """For each node (dimension, weight wanted on the left, low, high): the last position that goes left.

    Each round counts the bytes in BINS bins of the open range, for all nodes at once, and narrows it to the bin that
    holds the wanted weight, down to one position: exact, however the positions are spread.
    """
    open_, found, passed = dict(wanted), {}, {n: 0 for n in wanted}
    while open_:
        position = reduce(lambda rest, n: F.when(F.col("node") == n, F.col(open_[n][0])).otherwise(rest), open_, F.lit(None).cast("long"))
        low = reduce(lambda rest, n: F.when(F.col("node") == n, F.lit(open_[n][2])).otherwise(rest), open_, F.lit(0))
        high = reduce(lambda rest, n: F.when(F.col("node") == n, F.lit(open_[n][3])).otherwise(rest), open_, F.lit(0))
        step = reduce(lambda rest, n: F.when(F.col("node") == n, F.lit((open_[n][3] - open_[n][2]) // BINS + 1)).otherwise(rest), open_, F.lit(1))
        bins = rows.withColumn("at", position).where(F.col("at").between(low, high)).withColumn("bin", F.floor((F.col("at") - low) / step).cast("long"))
        by_node: dict[int, list] = {}
        for r in bins.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect():
            by_node.setdefault(r["node"], []).append((r["lo"], r["hi"], r["w"]))
        for n, (dim, want, lo, hi) in list(open_.items()):
            at, best = passed[n], (abs(want - passed[n]), lo - 1)
            inner = None
            for a, b, w in sorted(by_node.get(n, [])):
                if at < want < at + w and a < b:
                    inner = (dim, want, a, b), at
                best = min(best, (abs(want - at), a - 1), (abs(want - at - w), b))
                at += w
            if inner:
                open_[n], passed[n] = inner
            else:
                found[n] = best[1]
                del open_[n]
    return found


def plan(rows: DataFrame, shards: int = SHARDS) -> tuple[dict, dict[int, int], list[tuple]]:
    """rows of measures on the grid to the tree, the shard of each leaf and the shards of the large texts."""
    groups = written(rows.groupBy("crc", *DIMS).agg(F.sum("size").alias("weight")), "kd-groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    big = groups.where(F.col("weight") * F.lit(shards * ATOM) > F.lit(total)).collect()  # fewer than shards * ATOM, by their weights
    load, dealt = [0] * shards, []
    for r in sorted(big, key=lambda r: (-r["weight"], r["crc"], *(r[d] for d in DIMS))):
        s = min(range(shards), key=lambda i: (load[i], i))
        load[s] += r["weight"]
        dealt.append((r["crc"], *(r[d] for d in DIMS), s))
    level = _level(load, total)
    room = [max(0.0, level - x) for x in load]
    rest = groups.where(F.col("weight") * F.lit(shards * ATOM) <= F.lit(total))
    tree: dict = {}
    spans, fresh_id = {0: (0, shards)}, 1
    while any(b - a > 1 for a, b in spans.values()):
        noded = rest.withColumn("node", _route(tree, 0))
        ranges = {r["node"]: r for r in noded.groupBy("node").agg(F.sum("weight").alias("w"), *[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        wanted = {}
        for n, (a, b) in spans.items():
            if b - a > 1 and n in ranges:
                r, mid = ranges[n], (a + b) // 2
                dim = max(DIMS, key=lambda d: ((r[f"hi_{d}"] >> 32) - (r[f"lo_{d}"] >> 32), -DIMS.index(d)))
                share = sum(room[a:mid]) / (sum(room[a:b]) or 1)
                wanted[n] = (dim, r["w"] * share, r[f"lo_{dim}"], r[f"hi_{dim}"])
        cuts = _medians(noded, wanted)
        for n, (a, b) in list(spans.items()):
            if b - a > 1:
                dim, cut = (wanted[n][0], cuts[n]) if n in cuts else (DIMS[0], 0)
                tree[n] = (dim, cut, fresh_id, fresh_id + 1)
                spans |= {fresh_id: (a, (a + b) // 2), fresh_id + 1: ((a + b) // 2, b)}
                fresh_id += 2
                del spans[n]
    return tree, {n: a for n, (a, _) in spans.items()}, dealt


def _level(load: list[int], total: int) -> float:
    """The common height to which the rest fills the shards above what the large texts take."""
    rest = total - sum(load)
    for k, height in enumerate(sorted(load), 1):
        nxt = sorted(load)[k] if k < len(load) else float("inf")
        if (need := sum(sorted(load)[:k]) + rest) <= nxt * k:
            return need / k
    return total / max(1, len(load))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per document.

    Null text counts as empty; equal texts share a shard, so a text with more than its share of all bytes, be it very
    long or often repeated, makes one shard larger. Repeated rows get a slot each. Other columns of docs play no part,
    whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = _keys(written(measures(docs), "kd-rows"))
    tree, leaves, dealt = plan(rows, shards)
    leaf = _route(tree, 0)
    by_leaf = F.element_at(F.create_map(*[F.lit(x) for n, s in leaves.items() for x in (n, s)]), leaf)
    big = spark.createDataFrame(dealt, "crc long, " + ", ".join(f"{d} long" for d in DIMS) + ", big_shard int")
    placed = rows.join(F.broadcast(big), ["crc", *DIMS], "left").withColumn("shard", F.coalesce("big_shard", by_leaf).cast("int"))
    # slots: rank in a bucket of the shard, plus the rows of the buckets before it
    buckets = max(8, rows.count() // 1_000_000 + 1)
    placed = placed.select("doc_id", "size", "crc", "shard", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(buckets)).alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # shards * buckets rows
    before = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "crc"))
    slots = placed.withColumn("rank", rank).join(small_counts(before, shards * buckets), ["shard", "bucket"])
    return slots.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def small_counts(counts: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(counts.drop("n")) if rows <= 200_000 else counts.drop("n")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """docs as Parquet, a folder per shard; doc_id must be unique here."""
    docs.join(shard(docs, shards).select("doc_id", "shard", "slot"), "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
