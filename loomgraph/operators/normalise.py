"""Normalisation: reference resolution, predicate mapping, origins of abstractions, conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.arrays import units
from loomgraph.functions.scalars import cosine, norm
from loomgraph.operators import clustering
from loomgraph.operators.knowledge import with_names
from loomgraph.session import Scratch, ship

#: Clusters up to which a queue's keys are broadcast.
BROADCAST_ROWS = 200_000
#: Rows of a part of similar pairs at most; a task holds two parts.
PART = 32_768


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, block: str | None = None, blocks: int | None = None) -> DataFrame:
    """(a, b, score): ids of left and right whose vectors reach the cosine, each unordered pair once.

    Exact. With a block column only rows of a block meet. Both sides are dealt into parts and every part of one meets every
    part of the other, so no task sees a whole side (blocks: how many parts, by default eight, or fewer of some thousand
    rows, or more of at most PART): as a product of matrices of unit vectors, or by equi-join where the
    threshold lets pairs in that have no cosine (their score is 0). If left and right are one and the same table, two
    parts meet once.
    """
    if not block and threshold > 0:
        return _block_products(left, right, threshold, blocks or _parts(left, right))
    if blocks is None:
        blocks = max(1, -(-max(left.count(), right.count()) // 4096))
    l = left.select(F.col("id").alias("a"), F.col("vector").alias("va"), *([F.col(block).alias("k")] if block else []))  # noqa: E741
    r = right.select(F.col("id").alias("b"), F.col("vector").alias("vb"), *([F.col(block).alias("k")] if block else []))
    if block and threshold > 0:
        return _block_products(left, right, threshold, blocks, block)
    if not block:
        each = F.sequence(F.lit(0), F.lit(blocks - 1))
        l = l.withColumn("i", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")).withColumn("j", F.explode(each)).withColumn("k", F.struct("i", "j")).drop("i", "j")  # noqa: E741
        r = r.withColumn("j", F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int")).withColumn("i", F.explode(each)).withColumn("k", F.struct("i", "j")).drop("i", "j")
    pairs = l.join(r, "k").where("a < b")
    return pairs.select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("score")).where(F.col("score") >= threshold)


def similar_links(rows: DataFrame, threshold: float, blocks: int | None = None) -> DataFrame:
    """(a, b): few links that connect the same ids as similar_pairs of rows with themselves; each task hands on at most one for each of its rows."""
    rows = rows.where("id is not null")
    return _block_products(rows, rows, threshold, blocks or _parts(rows, rows), links=True).where("a <> b")


def _parts(left: DataFrame, right: DataFrame) -> int:
    n = left.count() if left is right else max(left.count(), right.count())
    return max(1, -(-n // PART), min(8, -(-n // 4096)))


def _hits(x: pa.ChunkedArray, y: pa.ChunkedArray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of x and of y, and the score, where the cosine reaches the threshold; some at a time."""
    ys = units(y)
    for n, (at, u) in units(x).items():
        if n not in ys:
            continue
        to, v = ys[n]
        step = max(1, 2**20 // len(v))
        for start in range(0, len(at), step):
            raw = u[start : start + step] @ v.T
            a, b = np.nonzero(raw >= threshold - 1e-6)
            score = np.round(raw[a, b], 6)
            ok = score >= threshold
            yield at[start + a[ok]], to[b[ok]], score[ok]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, where each node has the least place of its component so far, after the links of a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _block_products(left: DataFrame, right: DataFrame, threshold: float, blocks: int, label: str | None = None, links: bool = False) -> DataFrame:
    """Pairs by products of blocks of unit vectors. A label is cut into blocks by its size, so that a frequent one is no hot group.

    A task gives its pairs in batches, so that they are never held together; or, with links, a link from each node to
    the first of those it is connected to in this task.
    """
    ship(left.sparkSession)
    one = left is right
    keys = ["k"] if label else []
    sides = [df.where("vector is not null").select(F.col("id").alias("id"), F.col("vector").alias("vector"), *([F.col(label).alias("k")] if label else [])) for df in (left, right)]
    if label:
        size = sides[0].unionByName(sides[1]).groupBy("k").agg(F.count("*").alias("rows"))
        size = size.select(F.col("k").alias("of"), F.least(F.lit(blocks), F.ceil(F.col("rows") / 4096)).cast("int").alias("parts"))
        sides = [df.join(size, F.col("k") == F.col("of")).drop("of") for df in sides]
    else:
        sides = [df.withColumn("parts", F.lit(blocks)) for df in sides]
    sides = [df.withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")) for df in sides]
    if one:  # of two parts the lesser is the left one, and a part meets itself once
        dealt = sides[0].withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select(*keys, F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") <= F.col("q")).alias("first"), "id", "vector")
    else:
        each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = sides[0].select(*keys, F.col("p").alias("i"), each.alias("j"), F.lit(True).alias("first"), "id", "vector")
        dealt = dealt.unionByName(sides[1].select(*keys, each.alias("i"), F.col("p").alias("j"), F.lit(False).alias("first"), "id", "vector"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        alone = one and key[-2].as_py() == key[-1].as_py()
        x, y = t.filter(t["first"]), t if alone else t.filter(pc.invert(t["first"]))
        ids = x["id"] if alone else pa.chunked_array(x["id"].chunks + y["id"].chunks, x["id"].type)
        shift, root = 0 if alone else len(x), np.arange(len(ids))
        for a, b, score in _hits(x["vector"], y["vector"], threshold):
            if links:
                root = merged(root, a, b + shift)
                continue
            one_id, other = x["id"].take(pa.array(a)).combine_chunks(), y["id"].take(pa.array(b)).combine_chunks()
            less = pc.fill_null(pc.less(one_id, other), False)
            if one and not alone:
                turned = pc.fill_null(pc.greater(one_id, other), False)
                one_id, other, less = pc.if_else(turned, other, one_id), pc.if_else(turned, one_id, other), pc.or_(less, turned)
            yield pa.RecordBatch.from_arrays([one_id, other, pa.array(score)], ["a", "b", "score"]).filter(less)
        if links:
            at = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(c)).combine_chunks() for c in (at, root[at])], ["a", "b"])

    kinds = dict(left.dtypes)["id"], dict(right.dtypes)["id"]
    return dealt.groupBy(*keys, "i", "j").applyInArrow(run, f"a {kinds[0]}, b {kinds[1]}" + ("" if links else ", score double"))


def best_match(rows: DataFrame, candidates: DataFrame, bound: int = 10_000, blocks: int = 16) -> DataFrame:
    """id, best, score: the candidate of highest cosine for each row, of equals the largest.

    Up to bound candidates are broadcast. With more, every block of rows meets every block of candidates by equi-join.
    """
    c = candidates.select(F.col("id").alias("candidate"), F.col("vector").alias("cv"))
    same = F.size("vector") == F.size("cv")
    if c.limit(bound + 1).count() <= bound:
        pairs = rows.join(F.broadcast(c), same)
    else:
        each = F.sequence(F.lit(0), F.lit(blocks - 1))
        l = rows.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("i"), F.explode(each).alias("j"))  # noqa: E741
        c = c.select("candidate", "cv", F.explode(each).alias("i"), F.pmod(F.xxhash64("candidate"), F.lit(blocks)).cast("int").alias("j"))
        pairs = l.join(c, ["i", "j"]).where(same)
    scored = pairs.select("id", "candidate", F.round(cosine(F.col("vector"), F.col("cv")), 6).alias("score"))
    return scored.groupBy("id").agg(F.max(F.struct("score", F.col("candidate"))).alias("m")).select("id", F.col("m.candidate").alias("best"), F.col("m.score").alias("score"))


def centroids(rows: DataFrame, label: str = "label") -> DataFrame:
    """(id, vector): each label with the mean of its vectors."""
    means = rows.select(label, F.posexplode("vector").alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("vector")).select(F.col(label).alias("id"), "vector")


def bands(matches: DataFrame, auto: float = 0.85, ambiguous: float = 0.60) -> DataFrame:
    return matches.withColumn("band", F.when(F.col("score") >= auto, "auto").when(F.col("score") >= ambiguous, "ambiguous").otherwise("pending"))


def resolve_references(refs: DataFrame, items: DataFrame, threshold: float = 0.85, blocks: int = 16) -> DataFrame:
    """refs (owner, pos, name) with item_id: by exact name in the order of seq, else by best cosine, or null (still pending).

    The cosine step is taken if refs and items have a vector. It asks once for each name left over, and the item of
    highest cosine that reaches the threshold wins, of equals the first by seq; every block of names meets every block of items.
    """
    best = items.groupBy(norm(F.col("name")).alias("key")).agg(F.min_by("id", "seq").alias("item_id"))
    found = refs.withColumn("key", norm(F.col("name"))).join(best, "key", "left")
    if "vector" not in refs.columns or "vector" not in items.columns:
        return found.drop("key")
    each = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = found.where("item_id is null and vector is not null").groupBy("key").agg(F.min("vector").alias("vector"))
    left = left.select(F.col("key").alias("asked"), "vector", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("i"), F.explode(each).alias("j"))
    own = items.where("vector is not null").select(F.col("id").alias("near"), F.col("vector").alias("cv"), "seq", F.explode(each).alias("i"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("j"))
    pairs = left.join(own, ["i", "j"]).where(F.size("vector") == F.size("cv")).select("asked", "near", "seq", cosine(F.col("vector"), F.col("cv")).alias("score"))
    near = pairs.where(F.round("score", 6) >= threshold).groupBy("asked").agg(F.min_by("near", F.struct(-F.col("score"), F.col("seq"))).alias("near"))
    return found.join(near, F.col("key") == F.col("asked"), "left").withColumn("item_id", F.coalesce("item_id", "near")).drop("key", "asked", "near", "vector")


def origins(children: DataFrame) -> DataFrame:
    """(node, origin, n) of the children that exist."""
    return children.groupBy("node", F.col("knowledge_origin").alias("origin")).agg(F.count("*").alias("n"))


def majority_origin(counts: DataFrame) -> DataFrame:
    """The most frequent origin; of equals the first by name."""
    best = counts.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("k"), "origin")).alias("m"))
    return best.select("node", F.col("m.origin").alias("origin"), (-F.col("m.k")).alias("n"))


def process_divergence(process: DataFrame) -> DataFrame:
    """Pairs of which at least two models say different things about the constraint: predecessor_id, successor_id, models, n, first.

    The least and the greatest model or constraint tell that there are two; models are counted for the pairs found only.
    """
    live = process.where(F.col("status").isin("accepted", "proposed"))
    key = ["predecessor_id", "successor_id"]
    groups = live.groupBy(key).agg(F.min("source_model").alias("m"), F.max("source_model").alias("m2"), F.bool_or("hard_constraint").alias("any"), F.bool_and("hard_constraint").alias("all"), F.count("*").alias("n"), F.min(F.struct("seq", "id")).alias("first"))
    groups = groups.where("m <> m2 and any and not all")
    models = live.join(groups.select(key), key, "left_semi").select(*key, "source_model").distinct().groupBy(key).agg(F.count("*").alias("models"))
    return groups.join(models, key).select(*key, "models", "n", F.col("first.id").alias("first"))


def cascade(children: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes that become conflicted: more than half of their children are conflicted or deprecated, and one is conflicted.

    children: node, status (null for a child that does not exist, which counts among all). nodes (node, status): those
    that are conflicted or deprecated already stay as they are.
    """
    bad = F.coalesce(F.col("status").isin("conflicted", "deprecated"), F.lit(False))
    groups = children.groupBy("node").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.bool_or(F.coalesce(F.col("status") == "conflicted", F.lit(False))).alias("any"))
    found = groups.where("any and bad * 2 > n").select("node", "n", "bad")
    return found if nodes is None else found.join(nodes.where(~F.col("status").isin("conflicted", "deprecated")).select("node"), "node", "left_semi")


def coverage(truth: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many of truth's keys rows has, and the ratio."""
    keys = truth.select(key).distinct()
    hit = keys.join(rows.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return hit.agg(F.count("*").alias("total"), F.count("hit").alias("matched")).withColumn("ratio", F.round(F.col("matched") / F.col("total"), 6))


def elect(members: DataFrame, degrees: DataFrame) -> DataFrame:
    """members (cluster, id, seq) with canonical: the id of most assertion ends, of equals the first."""
    rows = members.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = rows.groupBy("cluster").agg(F.min(F.struct((-F.col("degree")).alias("k"), "seq", "id")).alias("m"))
    return rows.join(best.select("cluster", F.col("m.id").alias("canonical")), "cluster")


def degrees(assertions: DataFrame) -> DataFrame:
    """id, degree: assertions that an id ends; a self-loop counts once."""
    ends = F.explode(F.array_distinct(F.array("subject_id", "object_id")))
    return assertions.select(ends.alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def first_by_name(rows: DataFrame, name: str = "name", order: str = "seq") -> DataFrame:
    """The first row of each trimmed, lowered name."""
    w = Window.partitionBy(norm(F.col(name))).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def merge(entities: DataFrame, aliases: DataFrame, assertions: DataFrame, elected: DataFrame) -> dict[str, DataFrame]:
    """entities, aliases and assertions after elected (id, canonical) was carried out.

    Losers become merged and their names aliases of the winner; assertions point at winners, so one between two that merged
    becomes a loop. Nothing else is re-pointed, the losers' own aliases neither.
    """
    lost = elected.where("id <> canonical").select(F.col("id").alias("loser"), F.col("canonical").alias("winner"))
    named = entities.join(lost, F.col("id") == F.col("loser")).select(F.col("winner").alias("entity_id"), F.col("name").alias("alias"), "seq")
    gone = entities.join(lost.select(F.col("loser").alias("id"), F.lit(True).alias("_gone")), "id", "left")
    out = assertions
    for end in ("subject_id", "object_id"):
        out = out.join(lost.withColumnsRenamed({"loser": "_from", "winner": "_to"}), F.col(end) == F.col("_from"), "left").withColumn(end, F.coalesce("_to", end)).drop("_from", "_to")
    return {
        "entities": gone.withColumn("status", F.when(F.col("_gone"), "merged").otherwise(F.col("status"))).drop("_gone"),
        "aliases": aliases.unionByName(named, allowMissingColumns=True),
        "assertions": out,
    }


def fill_references(owners: DataFrame, items: DataFrame, names: str, ids: str, vectors: DataFrame | None = None, threshold: float = 0.85, others_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(owners, pending): the names in an array column turned into ids, which are added to the ids that are there.

    owners: id and the two array columns; items: id, name, seq, status, deprecated ones left out. A name is found exactly
    (case and outer spaces aside, the first by seq), else by the best cosine that reaches the threshold, where vectors
    (key, vector) has one for the name and the item's name; with others_only an owner is not its own reference. What is not
    found is pending (id, name). The names are cleared. Without any item nothing changes.
    """
    live = items.where("status <> 'deprecated'").select(F.col("id").alias("item"), norm(F.col("name")).alias("key"), F.struct("seq", "id").alias("order"))
    if live.isEmpty():
        return owners, owners.select("id", F.lit("").alias("name")).limit(0)
    flat = owners.select("id", F.posexplode(names).alias("pos", "name")).withColumn("name", F.trim("name")).where("name <> ''").withColumn("key", norm(F.col("name")))
    hits = flat.join(live, "key")
    hits = hits.where("item <> id") if others_only else hits
    exact = hits.groupBy("id", "pos").agg(F.min_by("item", "order").alias("exact"))
    found = flat.join(exact, ["id", "pos"], "left").withColumn("near", F.lit(None).cast("string"))
    if vectors is not None:
        asked = found.where("exact is null").select("key").distinct().join(vectors, "key")
        best = _two_nearest(asked, live.join(vectors, "key").select("item", "order", F.col("vector").alias("cv")), threshold)
        found = found.drop("near").join(best, "key", "left")
        own = F.filter("near", lambda x: (x != F.col("id"))) if others_only else F.col("near")
        found = found.withColumn("near", F.get(own, F.lit(0)).cast("string"))
    found = found.withColumn("item", F.coalesce(F.col("exact").cast("string"), "near"))
    new = found.where("item is not null").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("_new"))
    filled = owners.join(new, "id", "left")
    more = F.array_except(F.coalesce("_new", F.array().cast("array<string>")), F.col(ids))
    filled = filled.withColumn(ids, F.concat(F.col(ids), more)).withColumn(names, F.array().cast("array<string>")).drop("_new")
    return filled.select(*owners.columns), found.where("item is null").select("id", "name")


def _two_nearest(asked: DataFrame, items: DataFrame, threshold: float, blocks: int = 16) -> DataFrame:
    """(key, near): up to two items of highest cosine at or above the threshold, the best first; block by block."""
    each = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = asked.select("key", "vector", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("i"), F.explode(each).alias("j"))
    right = items.select("item", "order", "cv", F.explode(each).alias("i"), F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("j"))
    pairs = left.join(right, ["i", "j"]).where(F.size("vector") == F.size("cv")).select("key", "item", "order", F.round(cosine(F.col("vector"), F.col("cv")), 6).alias("score")).where(F.col("score") >= threshold)
    top = Window.partitionBy("key").orderBy(F.col("score").desc(), "order")
    two = pairs.withColumn("nth", F.row_number().over(top)).where("nth <= 2")
    return two.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col("item").cast("string").alias("item")))), lambda x: x["item"]).alias("near"))


def fill_pending_entities(forces: DataFrame, pending: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forces, pending): pending names (entity_name, source_force_id) that a lookup (key, entity_id) knows are added to affects, and no longer pending.

    A pending name goes even if its force does not exist.
    """
    rows = pending.withColumn("key", norm(F.col("entity_name"))).join(names.select("key", "entity_id"), "key", "left")
    new = rows.where("entity_id is not null").groupBy(F.col("source_force_id").alias("id")).agg(F.array_sort(F.collect_set("entity_id")).alias("_new"))
    filled = forces.join(new, "id", "left")
    filled = filled.withColumn("affects", F.concat("affects", F.array_except(F.coalesce("_new", F.array().cast("array<string>")), "affects"))).drop("_new")
    return filled.select(*forces.columns), rows.where("entity_id is null").select(*pending.columns)


def map_predicates(assertions: DataFrame, mapped: DataFrame, core, reviewer: str) -> tuple[DataFrame, DataFrame]:
    """(assertions, log): predicates rewritten by mapped (predicate, canonical) where the canonical one is of the core."""
    good = mapped.where(F.col("canonical").isin(*core) & (F.col("predicate") != F.col("canonical"))).select("predicate", "canonical").distinct()
    rows = assertions.join(F.broadcast(good) if good.limit(10_001).count() <= 10_000 else good, "predicate", "left")
    out = rows.withColumn("predicate", F.coalesce("canonical", "predicate")).select(*assertions.columns)
    return out, good.select(F.col("predicate").alias("from_predicate"), F.col("canonical").alias("to_predicate"), F.lit(reviewer).alias("reviewer"))


def predicate_plan(assertions: DataFrame, vectors: DataFrame, core, mappings: DataFrame | None = None, answers: DataFrame | None = None, model: str = "model") -> DataFrame:
    """(predicate, canonical, how) of every predicate in use that is not of the core.

    mapped: an earlier mapping has it, rows are not rewritten again; embedding: the closest core predicate reaches 0.85;
    llm:<model>: between 0.60 and that, an answer (predicate, answer) names a core predicate; pending: all else.
    """
    used = assertions.select("predicate").distinct().where(~F.col("predicate").isin(*core))
    at = vectors.select(F.col("key").alias("id"), "vector")
    scored = bands(best_match(used.select(F.col("predicate").alias("id")).join(at, "id"), at.where(F.col("id").isin(*core))))
    rows = used.join(scored.withColumnRenamed("id", "predicate"), "predicate", "left")
    early = (mappings if mappings is not None else assertions.select(F.lit("").alias("from_predicate"), F.lit("").alias("to_predicate")).limit(0)).groupBy(F.col("from_predicate").alias("predicate")).agg(F.min("to_predicate").alias("earlier"))
    said = (answers.select("predicate", F.lower(F.trim("answer")).alias("said")) if answers is not None else rows.select("predicate", F.lit(None).cast("string").alias("said")).limit(0)).groupBy("predicate").agg(F.min("said").alias("said"))
    rows = rows.join(early, "predicate", "left").join(said, "predicate", "left")
    how = F.when(F.col("earlier").isNotNull(), "mapped").when(F.col("band") == "auto", "embedding").when((F.col("band") == "ambiguous") & F.col("said").isin(*core), f"llm:{model}").otherwise("pending")
    canonical = F.when(how == "mapped", F.col("earlier")).when(how == "embedding", F.col("best")).when(how != "pending", F.col("said"))
    return rows.select("predicate", canonical.alias("canonical"), how.alias("how"))


def abstraction_groups(assertions: DataFrame, least: int = 3) -> DataFrame:
    """Live assertions of subjects that have at least so many of them."""
    live = assertions.where(F.col("status").isin("accepted", "proposed"))
    enough = live.groupBy("subject_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("subject_id")
    return live.join(enough, "subject_id", "left_semi")


def abstractions(assertions: DataFrame, labels: DataFrame, proposed: int = 0, cap: int | None = 5_000, least: int = 3, entities: DataFrame | None = None) -> DataFrame:
    """(id, subject_id, cluster, child_ids, prompt) of clusters (labels: id, cluster) of at least so many live assertions of a subject.

    assertions: id, subject_id, subject, predicate, object, rationale, conditions, status, seq. Children and the numbered
    lines of the prompt are in the order of seq and id. With proposed abstractions waiting, only as many are made as the
    queue has room for, in the order of subjects and clusters; without a cap, all. With entities (id, name), assertions have
    object_id, and no names: subjects and objects are named once it is known which are needed.
    """
    return clusters_made(abstraction_groups(assertions, least), labels, proposed, cap, least, entities)


def _tail():
    """What a line of a prompt says after the statement: the rationale and the conditions."""
    why = F.when(F.coalesce("rationale", F.lit("")) != "", F.concat(F.lit(" — "), "rationale")).otherwise("")
    return F.concat(why, F.when(F.size("conditions") > 0, F.concat(F.lit(" [when: "), F.array_join("conditions", "; "), F.lit("]"))).otherwise(""))


def clusters_made(live: DataFrame, labels: DataFrame, proposed: int, cap: int | None, least: int, entities: DataFrame | None) -> DataFrame:
    """abstractions of rows that abstraction_groups has left."""
    rows = live.join(labels, "id")
    room = None if cap is None else max(0, cap - proposed)
    if room is not None:
        # the queue's clusters are found by counts; only their rows are named, gathered and put into words
        counted = live.select("id", "subject_id").join(labels, "id").groupBy("subject_id", "cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        first = counted.orderBy("subject_id", "cluster").limit(room).select(F.col("subject_id").alias("s"), F.col("cluster").alias("c"))
        few = room <= BROADCAST_ROWS
        first = Scratch(live, "queue")(first) if few else first
        mine = F.broadcast(first) if few else first
        some = live.join(mine.select("s").distinct(), F.col("subject_id").eqNullSafe(F.col("s")), "left_semi") if few else live
        rows = some.join(labels, "id").join(mine, F.col("subject_id").eqNullSafe(F.col("s")) & F.col("cluster").eqNullSafe(F.col("c")), "left_semi")
    if entities is not None:
        rows = with_names(rows, entities, "subject", "object")
    line = F.concat(F.concat_ws(" ", "subject", "predicate", "object"), _tail())
    groups = rows.groupBy("subject_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("seq", "id", line.alias("line")))).alias("all"), F.count("*").alias("n")).where(F.col("n") >= least)
    text = F.array_join(F.transform("all", lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    made = groups.select("subject_id", "cluster", F.transform("all", lambda x: x["id"]).alias("child_ids"), text.alias("prompt"))
    made = made.withColumn("id", F.sha2(F.concat_ws("|", F.lit("abstraction"), "child_ids"), 256))
    return made if room is None else made.orderBy("subject_id", "cluster")


def clusters_together(live: DataFrame, known: list[tuple], by: str, threshold: float, least: int, entities: DataFrame | None) -> DataFrame:
    """abstractions, without a cap, of live assertions whose vectors are few: known has the unit vector, or None, of each value of their column by.

    The rows of a subject meet once, in the order of ids, with a row of its name; their task clusters them, which takes the
    numbers of their vectors and not the vectors, and puts the clusters into words. A repeated id of a subject counts once.
    """
    ship(live.sparkSession)
    kinds = dict(live.dtypes)
    code, vectors, group = {}, [], []
    for _, v in known:  # equal vectors have one number
        number = None if v is None else code.setdefault(tuple(x + 0.0 for x in v), len(code))
        if number == len(vectors):
            vectors.append(np.array(v, float))
        group.append(number)
    near = np.arange(len(vectors))
    for size in {len(v) for v in vectors}:
        at = np.array([i for i, v in enumerate(vectors) if len(v) == size])
        u = np.array([vectors[i] for i in at])
        a, b = np.nonzero(1 - np.clip(np.round(u @ u.T, 12), -1, 1) <= threshold)
        near = merged(near, at[a], at[b])
    numbers = live.sparkSession.createDataFrame([(k[0], -1 if g is None else g) for k, g in zip(known, group, strict=True)], f"_by {kinds[by]}, code int")
    rows = live.where("subject_id is not null and id is not null").join(F.broadcast(numbers), F.col(by) == F.col("_by"))
    given = "subject" if entities is None else F.lit("")
    rows = rows.select("subject_id", "id", "seq", "code", given, "predicate", "object" if entities is None else "object_id", _tail().alias("tail"))
    if entities is not None:
        rows = with_names(rows, entities, "object")
    rest = F.concat(F.concat_ws(" ", given, "predicate", "object"), "tail")
    rows = rows.select("subject_id", "id", "seq", "code", rest.alias("rest"))
    if entities is not None:  # a name comes before what is said of it
        names = entities.where("id is not null and name is not null").select(F.col("id").cast(kinds["subject_id"]).alias("subject_id"), *[F.lit(None).cast(kinds[c] if c in kinds else "int").alias(c) for c in ("id", "seq", "code")], F.col("name").alias("rest"))
        rows = rows.unionByName(names)
    named = entities is not None

    def heads(s: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The place of the first member of its cluster for each row, of subjects s one after another."""
        head = np.arange(len(s))
        on = np.flatnonzero(code >= 0)
        if not len(on):
            return head
        _, first, to = np.unique(s[on] * len(vectors) + code[on], return_index=True, return_inverse=True)
        head[on] = on[first[to]]
        one = on[first]
        who, count = np.unique(s[one] * len(vectors) + near[code[one]], return_counts=True)
        for x in np.unique(who[count > 1] // len(vectors)) if threshold > 0 else np.unique(s):
            a, b = np.searchsorted(s, [x, x + 1])
            own = [vectors[c] if c >= 0 else np.zeros(0) for c in code[a:b]]
            head[a:b] = a + clustering.group_labels(np.concatenate(own), np.array([len(v) for v in own]), threshold, False)
        return head

    def made(t: pa.Table) -> pa.RecordBatch:
        subject, ids, said = (t[c].combine_chunks() for c in ("subject_id", "id", "rest"))
        other = np.concatenate([[True], pc.not_equal(subject[1:], subject[:-1]).to_numpy(zero_copy_only=False)])
        start = np.flatnonzero(other)
        s, is_name = np.cumsum(other) - 1, ids.is_null().to_numpy(zero_copy_only=False)
        again = np.concatenate([[False], pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)]) & ~other
        keep = np.flatnonzero(~is_name & ~again)
        head = heads(s[keep], t["code"].to_numpy()[keep].astype(np.int64))
        seq = pc.rank(t["seq"].combine_chunks().take(pa.array(keep)), null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((np.arange(len(keep)), seq, head))
        begin = np.flatnonzero(np.diff(head[order], prepend=-1))
        size = np.diff(begin, append=len(order))
        order, begin, size = order[np.repeat(size >= least, size)], begin[size >= least], size[size >= least]
        upto = np.concatenate([[0], np.cumsum(size)])
        nth = np.arange(len(order)) - np.repeat(upto[:-1], size) + 1
        at = pa.array(keep[order])
        line = said.take(at)
        if named:
            name = pc.if_else(pa.array(is_name[start]), said.take(pa.array(start)), subject.take(pa.array(start)).cast(pa.string()))
            line = pc.binary_join_element_wise(name.take(pa.array(s[keep[order]])), line, "")
        line = pc.binary_join_element_wise("  ", pa.array(nth).cast(pa.string()), ". ", line, "")
        gathered = lambda x: pa.ListArray.from_arrays(pa.array(upto, pa.int32()), x)
        first = pa.array(keep[head[order[upto[:-1]]]]) if len(size) else pa.array([], pa.int64())
        return pa.RecordBatch.from_arrays([subject.take(first), ids.take(first), gathered(ids.take(at)), pc.binary_join(gathered(line), "\n")], ["subject_id", "cluster", "child_ids", "prompt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Subjects lie together; the last one of a batch may go on in the next."""
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not len(t):
                continue
            last = pc.not_equal(t["subject_id"], t["subject_id"][len(t) - 1]).to_numpy()
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield made(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield made(held)

    rows = rows.repartition("subject_id").sortWithinPartitions("subject_id", "id")
    out = rows.mapInArrow(run, f"subject_id {kinds['subject_id']}, cluster {kinds['id']}, child_ids array<{kinds['id']}>, prompt string")
    return out.withColumn("id", F.sha2(F.concat_ws("|", F.lit("abstraction"), "child_ids"), 256))


def accept_abstractions(made: DataFrame, statements: DataFrame, verdicts: DataFrame | None = None, model: str = "model", judge: str | None = None) -> DataFrame:
    """Abstraction rows: made with a statement (id, statement, abstraction_rationale, confidence), without those that a judge rejects.

    verdicts: id, verdict. A verdict of yes (something new is claimed) rejects; a missing one does not, nor does any if the
    judge is the model itself.
    """
    rows = made.join(statements, "id")
    if verdicts is not None and judge != model:
        rows = rows.join(verdicts.where(F.lower(F.trim("verdict")) == "yes").select("id"), "id", "left_anti")
    return rows.select("id", "statement", "child_ids", "abstraction_rationale", "confidence", F.col("prompt").alias("source_prompt"), F.lit("proposed").alias("status"), F.lit(model).alias("source_model"))


def parents(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Abstractions (id, child_ids) that have one of children (id) among theirs."""
    flat = nodes.select("id", F.explode("child_ids").alias("child"))
    hit = flat.join(children.select(F.col("id").alias("child")).distinct(), "child", "left_semi").select("id").distinct()
    return nodes.join(hit, "id", "left_semi")


def proposed(nodes: DataFrame) -> DataFrame:
    return nodes.where("status = 'proposed'")


def verify(truth: DataFrame, rows: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.90, target: float = 0.80) -> tuple[DataFrame, DataFrame]:
    """(coverage, unmatched) of ground truth by accepted rows that were not entered by hand.

    truth and rows: id, subject_id, predicate, object_id, status, source_model. Exact on the key, else by the best cosine of
    vectors (id, vector). coverage: total, matched, ratio, passed.
    """
    key = ["subject_id", "predicate", "object_id"]
    corpus = rows.where("source_model <> 'human' and status = 'accepted'")
    left = truth.join(corpus.select(key).distinct(), key, "left_anti")
    if vectors is not None:
        near = best_match(left.select("id").join(vectors, "id"), corpus.select("id").join(vectors, "id"))
        left = left.join(near.where(F.col("score") >= threshold).select("id"), "id", "left_anti")
    n = truth.agg(F.count("*").alias("total")).crossJoin(left.agg(F.count("*").alias("missing")))  # one row each
    ratio = F.coalesce(F.try_divide(F.col("total") - F.col("missing"), F.col("total")), F.lit(0.0))
    return n.select("total", (F.col("total") - F.col("missing")).alias("matched"), F.round(ratio, 6).alias("ratio"), ((F.col("total") == 0) | (ratio >= target)).alias("passed")), left


def todo(patterns: DataFrame, assertions: DataFrame, core, least: int = 3) -> DataFrame:
    """The dry run of normalisation: (what, n) of patterns and references to resolve, predicates outside the core, and groups and rows to abstract."""
    refs = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    one = lambda df, name, x: df.agg(F.lit(name).alias("what"), x.cast("long").alias("n"))
    groups = abstraction_groups(assertions, least)
    parts = [
        one(patterns, "patterns with force references", F.count_if(F.size("force_descriptions") > 0)), one(patterns, "force references", refs("force_descriptions")), one(patterns, "pattern references", refs("related_pattern_names")),
        one(assertions.where(~F.col("predicate").isin(*core)).select("predicate").distinct(), "predicates outside the core", F.count("*")),
        one(groups.select("subject_id").distinct(), "groups to abstract", F.count("*")), one(groups, "rows to abstract", F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
