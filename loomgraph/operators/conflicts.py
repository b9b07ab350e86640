"""Conflicts between statements: candidate pairs, classes and what they change, divergence, cycles, cascade, the whole batch.

Every step takes tables and returns the changed tables with the pairs, decisions and log rows of the same delta.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph, lifecycle, normalise, similarity

BAD = ("conflicted", "deprecated")
LIVE = ("proposed", "accepted")
CLASSES = ("duplicate", "complementary", "contradictory", "unrelated")
QUEUE_CAP = 500
BY = "conflict batch"


def unordered(pairs: DataFrame, a: str = "item_a_id", b: str = "item_b_id") -> DataFrame:
    """pairs with low and high, so that (a, b) and (b, a) match."""
    return pairs.withColumn("low", F.least(a, b)).withColumn("high", F.greatest(a, b))


def candidates(items: DataFrame, vectors: DataFrame, known: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(item_a_id, item_b_id, score): live items of one type that are similar and not yet a pair, in either order.

    items: id, status, evaluated. a is not evaluated yet, and the smaller id if neither is. vectors: id, vector. Subjects
    play no part.
    """
    live = items.where(F.col("status").isin(*LIVE)).select("id", "evaluated").join(vectors.select("id", "vector"), "id")
    pairs = similarity.delta_pairs(live.where("not evaluated"), live, threshold)
    found = pairs.select(F.col("a").alias("item_a_id"), F.col("b").alias("item_b_id"), "score")
    seen = unordered(known).select("low", "high")
    return unordered(found).join(seen, ["low", "high"], "left_anti").drop("low", "high")


def apply_classes(items: DataFrame, classified: DataFrame, item_type: str, conflicted: int = 0, cap: int = QUEUE_CAP, limit: int | None = None) -> dict[str, DataFrame]:
    """items, pairs and log after classified (item_a_id, item_b_id, classification) is applied.

    An unknown class is unrelated, a null one (the classifier failed) makes no pair. Contradictory pairs make both items
    conflicted that are not conflicted or deprecated, until cap items are: the queue is looked at before each item a, in
    the order of ids. limit is the number of classified pairs; the item at which it is reached is the last one visited.
    Every visited item counts as evaluated, whatever became of its pairs. Of pairs in both orders the first counts.
    """
    order = ["item_a_id", "item_b_id"]
    first = unordered(classified).groupBy("low", "high").agg(F.min(F.struct(*order, "classification")).alias("x"))
    rows = first.select("x.*")
    last = None
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
        last = rows.agg(F.max("item_a_id").alias("x"), F.count("*").alias("n")).first()
        last = last["x"] if last["n"] >= limit else None
    kind = F.lower(F.trim("classification"))
    pairs = rows.where("classification is not null").withColumn("classification", F.when(kind.isin(*CLASSES), kind).otherwise("unrelated"))
    hit = pairs.where("classification = 'contradictory'").select("item_a_id", F.explode(F.array(*order)).alias("id"))
    hit = hit.groupBy("id").agg(F.min("item_a_id").alias("turn"))
    moved = items.where(~F.col("status").isin(*BAD)).select("id", "status").join(hit, "id")
    room = cap - conflicted
    # the cap is reached within the turn of the room-th item that moves; later turns are paused
    edge = moved.orderBy("turn", "id").limit(max(room, 0)).agg(F.max("turn").alias("turn"), F.count("*").alias("n")).first()
    if room <= 0:
        moved = moved.limit(0)
    elif edge["n"] >= room:
        moved = moved.where(F.col("turn") <= F.lit(edge["turn"]))
    visited = F.col("status").isin(*LIVE) & ~F.col("evaluated") & (F.lit(True) if last is None else F.col("id") <= F.lit(last))
    stamped = items.withColumn("evaluated", F.col("evaluated") | visited)
    return {
        "items": lifecycle.with_status(stamped, moved, "conflicted"),
        "pairs": pairs.select("item_a_id", F.lit(item_type).alias("item_a_type"), "item_b_id", F.lit(item_type).alias("item_b_type"), "classification"),
        "log": lifecycle.changed(moved.select("id", "status"), item_type, "conflicted", BY),
    }


Save = Callable[[DataFrame], DataFrame]


def divergence(process: DataFrame, save: Save = lambda df: df) -> dict[str, DataFrame]:
    """items, pairs, decisions and log after relations of which models differ on the constraint became conflicted.

    Each is paired with the first of its group by seq and id, the first with the second. save: what keeps the delta that
    all four are derived from.
    """
    key = ["predecessor_id", "successor_id"]
    groups = normalise.process_divergence(process).select(*key, "first")
    rows = process.where(F.col("status").isin(*LIVE)).join(groups, key)
    second = rows.where("id <> first").groupBy(key).agg(F.min(F.struct("seq", "id")).alias("s")).select(*key, F.col("s.id").alias("second"))
    rows = rows.join(second, key).select("id", "status", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other"))
    rows = save(rows)
    kind = F.lit("process_relation")
    return {
        "items": lifecycle.with_status(process, rows, "conflicted"),
        "pairs": rows.select(F.col("id").alias("item_a_id"), kind.alias("item_a_type"), F.col("other").alias("item_b_id"), kind.alias("item_b_type"), F.lit("contradictory").alias("classification")),
        "decisions": rows.select(F.col("id").alias("item_id"), kind.alias("item_type"), F.lit("defer").alias("decision"), F.lit(BY).alias("reviewer")),
        "log": lifecycle.changed(rows, "process_relation", "conflicted", BY),
    }


def cyclic_relations(process: DataFrame) -> DataFrame:
    """(id, status) of live relations whose ends lie in one strongly connected component of two nodes or more."""
    live = process.where(F.col("status").isin(*LIVE))
    comps = graph.strong_components(live.select(F.col("predecessor_id").alias("src"), F.col("successor_id").alias("dst")))
    a, b = (comps.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("predecessor_id", "x"), ("successor_id", "y")))
    return live.join(a, "predecessor_id").join(b, "successor_id").where("x = y").select("id", "status")


def cycles(process: DataFrame, save: Save = lambda df: df) -> dict[str, DataFrame]:
    """items and log after every relation on a cycle became conflicted; a node that only precedes itself is no cycle."""
    rows = save(cyclic_relations(process))
    return {"items": lifecycle.with_status(process, rows, "conflicted"), "log": lifecycle.changed(rows, "process_relation", "conflicted", BY)}


def cascade(nodes: DataFrame, assertions: DataFrame, changed: DataFrame | None = None, save: Save = lambda df: df) -> dict[str, DataFrame]:
    """nodes and log after abstractions (id, status, child_ids) with more than half of their children conflicted or deprecated became conflicted.

    changed (id): only parents of these are looked at. A child that does not exist counts among all, one named twice twice.
    """
    live = nodes.where(~F.col("status").isin(*BAD))
    children = live.select("id", "status", F.explode("child_ids").alias("child"))
    if changed is not None:
        touched = children.join(changed.select(F.col("id").alias("child")).distinct(), "child", "left_semi").select("id").distinct()
        children = children.join(touched, "id", "left_semi")
    found = children.join(assertions.select(F.col("id").alias("child"), F.col("status").alias("says")), "child", "left")
    bad = F.count_if(F.coalesce(F.col("says").isin(*BAD), F.lit(False)))
    rows = save(found.groupBy("id", "status").agg(F.count("*").alias("n"), bad.alias("bad")).where("bad * 2 > n"))
    return {"items": lifecycle.with_status(nodes, rows, "conflicted"), "log": lifecycle.changed(rows.select("id", "status"), "abstraction_node", "conflicted", f"{BY} (cascade)")}


def counters(items: dict[str, DataFrame], process: DataFrame) -> DataFrame:
    """The dry run: (item_type, unevaluated) of live items, and pairs of relations whose models differ."""
    out = process.sparkSession.createDataFrame([], "item_type string, unevaluated long")
    for name, df in items.items():
        out = out.unionByName(df.agg(F.lit(name).alias("item_type"), F.count_if(F.col("status").isin(*LIVE) & ~F.col("evaluated")).alias("unevaluated")))
    return out.unionByName(normalise.process_divergence(process).agg(F.lit("divergence").alias("item_type"), F.count("*").alias("unevaluated")))


def batch(tables: dict[str, DataFrame], vectors: dict[str, DataFrame], classify: Callable[[DataFrame], DataFrame], cap: int = QUEUE_CAP, limit: int | None = None, threshold: float = 0.80, promote: bool = True) -> dict[str, DataFrame]:
    """The whole batch in its order: pairs by type, divergence, cycles, cascade, promotion.

    tables: assertions, constraints, patterns, process, abstractions, pairs, log; vectors: by type; classify adds
    classification to candidate pairs. Each step reads what the one before wrote, so every step's tables are saved; the
    conflicted of all types count towards the cap. Returns the tables and decisions.
    """
    save = graph.Scratch(tables["pairs"], "conflicts")
    out = dict(tables)
    pairs, log, decisions = [], [], []
    for name, kind in (("assertions", "assertion"), ("constraints", "constraint"), ("patterns", "pattern")):
        if name in vectors:
            queue = sum(out[t].where("status = 'conflicted'").count() for t in ("assertions", "constraints", "patterns", "process") if t in out)
            known = out["pairs"].select("item_a_id", "item_b_id")
            found = save(classify(save(candidates(out[name], vectors[name], known, threshold))))
            done = {k: save(v) for k, v in apply_classes(out[name], found, kind, queue, cap, limit).items()}
            out[name] = done["items"]
            pairs.append(done["pairs"])
            log.append(done["log"])
    for step in (divergence, cycles):
        done = step(out["process"], save)
        out["process"] = save(done["items"])
        log.append(done["log"])
        pairs += [done["pairs"]] if "pairs" in done else []
        decisions += [done["decisions"]] if "decisions" in done else []
    now_bad = out["assertions"].where("status = 'conflicted'").select("id")
    done = cascade(out["abstractions"], out["assertions"], now_bad, save)
    out["abstractions"] = save(done["items"])
    log.append(done["log"])
    after, accepted = lifecycle.promote(out["assertions"], promote)
    accepted = save(accepted)
    out["assertions"] = save(after)
    more, promoted = lifecycle.status_log(accepted)
    decisions.append(more.select("item_id", F.lit("assertion").alias("item_type"), "decision", "reviewer"))
    log.append(promoted.select("item_id", F.lit("assertion").alias("item_type"), "old_status", "new_status", F.current_timestamp().alias("changed_at"), "changed_by"))
    for key, parts in (("pairs", pairs), ("log", log)):
        for p in parts:
            out[key] = out[key].unionByName(p, allowMissingColumns=True)
    out["decisions"] = decisions[0]
    for p in decisions[1:]:
        out["decisions"] = out["decisions"].unionByName(p)
    return out
