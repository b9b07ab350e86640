"""Optimal assignment between two sides of any size, as an auction in rounds over blocks.

Bidders (the smaller side, filled up with idle ones) bid for objects. A bidder knows its best objects at the prices of
the round that listed them, and a bound on what the others are worth to it; as prices only rise, the list stays valid
until the bound is met. A task holds the lists of one lot of bidders and lets them bid against one another; the highest
bid of all lots wins the object. Bids are raised by steps that shrink from phase to phase, while prices stay.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Scratch, ship

#: Similarities count in steps of 1 / QUANTUM; the total found is the largest of these whole numbers.
QUANTUM = 10**8
#: A phase's step over the next one's.
SHRINK = 16
LEAST = -(2**62)


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """vectors as rows, filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        if v is not None:
            row[: len(v)] = v
    return out


def _lists(need: DataFrame, objects: DataFrame, prices: DataFrame, known: int, quantum: int) -> DataFrame:
    """(pid, b, items, bound): the known best objects of each of need (pid, b, v, i, blocks), and what the next one is worth."""
    left = need.select("pid", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "b", "v")
    right = objects.join(prices.select("pid", "o", "price"), ["pid", "o"]).join(need.select("pid", (F.col("i") + 0).alias("i")).distinct(), "pid").select("pid", "i", "j", "o", "v", "price", "n")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"pid": [], "b": [], "o": [], "worth": [], "net": []})
        x, y = x.sort_values("b", ignore_index=True), y.sort_values("o", ignore_index=True)
        width = max(1, max(len(v) for side in (x, y) for v in side["v"] if v is not None) if x["v"].notna().any() or y["v"].notna().any() else 1)
        u, w = matrix(x["v"], width), matrix(y["v"], width)
        price, scale, out = y["price"].to_numpy(np.int64), int(y["n"].iloc[0]) + 1, []
        keep = min(known + 1, len(y))
        for start in range(0, len(x), 512):
            worth = np.rint(np.clip(u[start : start + 512] @ w.T, -1, 1) * quantum).astype(np.int64) * scale
            net = worth - price
            # Each bidder looks from a place of its own, so that equal objects are not all listed for the same few.
            mine = x["b"].to_numpy()[start : start + 512]
            turn = (mine[:, None] * 7919 + np.arange(len(y))) % len(y)
            at = np.take_along_axis(turn, np.argpartition(-np.take_along_axis(net, turn, 1), keep - 1, axis=1)[:, :keep], 1)
            names = np.repeat(mine, keep)
            out.append(pd.DataFrame({"b": names, "o": y["o"].to_numpy()[at].ravel(), "worth": np.take_along_axis(worth, at, 1).ravel(), "net": np.take_along_axis(net, at, 1).ravel()}))
        return pd.concat(out, ignore_index=True).assign(pid=x["pid"].iloc[0])

    keys = ["pid", "i", "j"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "pid long, b long, o long, worth long, net long")
    ranked = best.groupBy("pid", "b").agg(F.reverse(F.array_sort(F.collect_list(F.struct("net", F.xxhash64("b", "o").alias("tie"), "o", "worth")))).alias("all"))
    bound = F.when(F.size("all") > known, F.col("all")[known]["net"]).otherwise(F.lit(LEAST))
    return ranked.select("pid", "b", F.slice("all", 1, known).alias("items"), bound.alias("bound"))


def _bid(part: pd.DataFrame) -> pd.DataFrame:
    """(pid, o, price, b): what a lot of bidders bids; o is null where the list of b no longer tells its best object."""
    part = part.sort_values(["b", "o"], ignore_index=True)
    step = int(part["step"].iloc[0])
    objects, at = np.unique(part["o"].to_numpy(), return_inverse=True)
    price = np.zeros(len(objects), np.int64)
    price[at] = part["price"].to_numpy()
    names, starts = np.unique(part["b"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(part))
    worth, bound = part["worth"].to_numpy(np.int64), part["bound"].to_numpy(np.int64)
    owner, touched, spent = np.full(len(objects), -1), np.zeros(len(objects), bool), []
    mine = np.flatnonzero(part["mine"].to_numpy())
    owner[at[mine]] = np.searchsorted(names, part["b"].to_numpy()[mine])
    busy = part["busy"].to_numpy()
    queue = deque(i for i in range(len(names)) if not busy[starts[i]])
    while queue:
        i = queue.popleft()
        here = slice(starts[i], ends[i])
        net = worth[here] - price[at[here]]
        k = int(net.argmax())
        top, floor = int(net[k]), int(bound[starts[i]])
        if top < floor:
            spent.append(i)
            continue
        net[k] = LEAST
        second = max(floor, int(net.max()))
        o = at[here][k]
        price[o] += (top - second if second > LEAST else 0) + step
        if owner[o] >= 0:
            queue.append(owner[o])
        owner[o], touched[o] = i, True
    bids = pd.DataFrame({"o": objects[touched], "price": price[touched], "b": names[owner[touched]]})
    out = pd.concat([bids.astype({"o": "Int64", "price": "Int64"}), pd.DataFrame({"o": pd.array([None] * len(spent), "Int64"), "price": pd.array([None] * len(spent), "Int64"), "b": names[spent]})], ignore_index=True)
    return out.assign(pid=part["pid"].iloc[0])[["pid", "o", "price", "b"]]


def assign(members: DataFrame, pairs: DataFrame, block: int = 4096, known: int = 256, lot: int = 4096, quantum: int = QUANTUM) -> DataFrame:
    """(pid, a, b): for each of pairs (pid, side_a, side_b) the assignment of largest total cosine of members (node, side, v).

    node, side and pid are longs, node is unique, v holds unit vectors; null or zero vectors have the cosine 0 with all,
    shorter ones count as filled up with zeros. Every row of the smaller side gets a partner. Cosines count in steps of
    1 / quantum; of assignments with equal totals any one is given. A pair with an empty side gives nothing. A task holds
    two blocks of vectors, or the lists of one lot of bidders. Where one lot holds a pair, the rounds are the phases and
    those that list objects anew, which are more the shorter the lists; lots that bid against one another take hundreds.
    """
    ship(members.sparkSession)
    save = Scratch(members, "auction")
    size = members.groupBy("side").agg(F.count("*").alias("n"))
    sized = pairs.join(size.select(F.col("side").alias("side_a"), F.col("n").alias("na")), "side_a").join(size.select(F.col("side").alias("side_b"), F.col("n").alias("nb")), "side_b")
    flip = F.col("na") > F.col("nb")
    few, many = F.when(flip, F.col("side_b")).otherwise(F.col("side_a")), F.when(flip, F.col("side_a")).otherwise(F.col("side_b"))
    sized = save(sized.select("pid", few.alias("few"), many.alias("many"), F.least("na", "nb").alias("k"), F.greatest("na", "nb").alias("n"), flip.alias("flip")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    largest = sized.agg(F.max("n")).first()[0]
    if largest is None:
        return save.spark.createDataFrame([], "pid long, a long, b long")
    place = lambda name: F.pmod(F.xxhash64(name), F.col("blocks")).cast("int")
    real = sized.join(members, F.col("few") == F.col("side")).select("pid", "blocks", "n", F.col("node").alias("b"), "v")
    idle = sized.where("k < n").select("pid", "blocks", "n", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("k"))).alias("b")).withColumn("b", -F.col("b").cast("long"))
    bidders = save(real.unionByName(idle, allowMissingColumns=True).withColumns({"i": place("b"), "lot": F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / lot).cast("int")).cast("int")}))
    objects = save(sized.join(members, F.col("many") == F.col("side")).select("pid", "n", F.col("node").alias("o"), "v", place("node").alias("j")))
    total = bidders.count()
    prices = save(objects.select("pid", "o", F.lit(0).cast("long").alias("price"), F.lit(None).cast("long").alias("b")))
    lists = save(_lists(bidders, objects, prices, known, quantum))

    def step(phase: int):
        return F.greatest(F.lit(1).cast("long"), F.floor(quantum * (F.col("n") + 1) / F.lit(float(SHRINK) ** phase)).cast("long"))

    phase, listed = 0, save.n
    while phase == 0 or quantum * (largest + 1) >= SHRINK**phase:
        phase += 1
        # Where the step is the last phase's already, its assignment stands.
        again = sized.where(step(phase) < step(phase - 1)).select(F.col("pid").alias("again"))
        freed = prices.join(again, F.col("pid") == F.col("again"), "left").select("pid", "o", "price", F.when(F.col("again").isNull(), F.col("b")).alias("b"))
        prices, priced = save(freed), save.n
        while prices.where("b is not null").count() < total:
            held = prices.where("b is not null").select("pid", "b", F.lit(True).alias("busy"))
            entry = lists.join(bidders.select("pid", "b", "lot", "n"), ["pid", "b"]).join(held, ["pid", "b"], "left")
            entry = entry.select("pid", "lot", "b", "bound", F.coalesce("busy", F.lit(False)).alias("busy"), step(phase).alias("step"), F.explode("items").alias("e"))
            entry = entry.select("pid", "lot", "b", "bound", "busy", "step", F.col("e.o").alias("o"), F.col("e.worth").alias("worth"))
            seen = prices.select("pid", "o", "price", F.col("b").alias("owner"))
            entry = entry.join(seen, ["pid", "o"]).withColumn("mine", F.coalesce(F.col("owner") == F.col("b"), F.lit(False))).drop("owner")
            bids = save(entry.groupBy("pid", "lot").applyInPandas(_bid, "pid long, o long, price long, b long"))
            spent = bids.where("o is null").select("pid", "b")
            refresh = not spent.isEmpty()
            rank = F.struct("price", (-F.col("b")).alias("first"), "b")
            merged = prices.unionByName(bids.where("o is not null")).groupBy("pid", "o").agg(F.max(rank).alias("r")).select("pid", "o", "r.price", "r.b")
            prices = save(merged)
            old, priced = priced, save.n
            save.drop(old)
            if refresh:
                fresh = _lists(bidders.join(spent, ["pid", "b"], "left_semi"), objects, prices, known, quantum)
                lists = save(lists.join(spent, ["pid", "b"], "left_anti").unionByName(fresh))
                old, listed = listed, save.n
                save.drop(old)
    matched = prices.where("b >= 0").join(sized.select("pid", "flip"), "pid")
    return matched.select("pid", F.when(F.col("flip"), F.col("o")).otherwise(F.col("b")).alias("a"), F.when(F.col("flip"), F.col("b")).otherwise(F.col("o")).alias("b"))
