"""Entity resolution and knowledge queries, for one request or a whole table of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.arrays import units
from loomgraph.functions.scalars import decode_list, in_context, norm, origin_rank
from loomgraph.session import ship


def resolve(names: DataFrame, entities: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """names with entity_id: names of entities that are not merged come first, then aliases of such entities, each in order of seq.

    Names are trimmed and lowered. A name that nothing matches gets null. One window over the keys asked for only.
    """
    live = entities.where("status <> 'merged'")
    by_name = live.select(norm(F.col("name")).alias("key"), F.col("id").alias("entity_id"), F.lit(0).alias("prio"), "seq")
    by_alias = aliases.join(live.select("id"), F.col("entity_id") == F.col("id"), "left_semi").select(F.lower("alias").alias("key"), "entity_id", F.lit(1).alias("prio"), "seq")
    asked = names.withColumn("key", norm(F.col(name)))
    wanted = by_name.unionByName(by_alias).join(asked.select("key").distinct(), "key", "left_semi")
    best = wanted.groupBy("key").agg(F.min_by("entity_id", F.struct("prio", "seq")).alias("entity_id"))
    return asked.join(best, "key", "left").drop("key")


def resolve_like(entities: DataFrame, pattern: str, merged: bool = True) -> DataFrame:
    """Entities whose name matches a case-insensitive LIKE pattern; merged ones too unless told otherwise."""
    rows = entities.where(F.col("name").ilike(pattern))
    return rows if merged else rows.where("status <> 'merged'")


def with_names(rows: DataFrame, entities: DataFrame, *columns: str) -> DataFrame:
    """rows with <c> for each <c>_id: the entity's name, else the id itself."""
    for c in columns:
        names = entities.select(F.col("id").alias(f"{c}_key"), F.col("name").alias(f"{c}_name"))
        rows = rows.join(names, F.col(f"{c}_id") == F.col(f"{c}_key"), "left")
        rows = rows.withColumn(c, F.coalesce(f"{c}_name", f"{c}_id")).drop(f"{c}_key", f"{c}_name")
    return rows


def requirements(assertions: DataFrame, entities: DataFrame, subjects: DataFrame | None = None, context: str | None = None) -> DataFrame:
    """What subjects require or depend on; all statuses. subjects: a table with id."""
    rows = assertions.where(F.col("predicate").isin("requires", "depends_on"))
    rows = rows if subjects is None else rows.join(subjects, F.col("subject_id") == subjects["id"], "left_semi")
    rows = rows if context is None else rows.where(in_context(decode_list(F.col("applicability")), context))
    return with_names(rows, entities, "subject", "object")


def dependencies(assertions: DataFrame, entities: DataFrame, subjects: DataFrame) -> DataFrame:
    """depends_on assertions with a subject at either end; one that has it at both counts once. Two equi-joins instead of an OR."""
    rows = assertions.where("predicate = 'depends_on'")
    ids = subjects.select(F.col("id").alias("asked"))
    ends = rows.join(ids, F.col("subject_id") == F.col("asked"), "left_semi").unionByName(rows.join(ids, F.col("object_id") == F.col("asked"), "left_semi"))
    return with_names(ends.dropDuplicates(["id"]), entities, "subject", "object")


def shared_filter(rows: DataFrame, min_confidence: float = 0.0, include_proposed: bool = False) -> DataFrame:
    """Drops low confidence and, unless asked for, proposed rows. Conflicted and deprecated rows pass."""
    rows = rows.where(F.col("confidence") >= min_confidence)
    return rows if include_proposed else rows.where("status <> 'proposed'")


def ranking() -> list[Column]:
    return [F.col("confidence").desc(), origin_rank(F.col("knowledge_origin")), F.col("id")]


def ranked(rows: DataFrame, limit: int, per: str | None = None) -> DataFrame:
    """The best limit rows, of all or of each value of per."""
    if per is None:
        return rows.orderBy(*ranking()).limit(limit)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*ranking()))).where(F.col("rank") <= limit)


def member_names(rows: DataFrame, items: DataFrame, lists: str, key: str = "id") -> DataFrame:
    """rows' key and names: the names of the ids in an array column, in its order, unknown ids as themselves."""
    flat = rows.select(key, F.posexplode(lists).alias("pos", "item"))
    names = items.select(F.col("id").alias("item"), "name")
    found = flat.join(names, "item", "left").select(key, "pos", F.coalesce("name", "item").alias("name"))
    return found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "|").alias("names"))


def touching(relations: DataFrame, entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations that have one of ids at either end, once each, with names."""
    asked = ids.select(F.col("id").alias("asked"))
    ends = relations.join(asked, F.col("subject_id") == F.col("asked"), "left_semi").unionByName(relations.join(asked, F.col("object_id") == F.col("asked"), "left_semi"))
    return with_names(ends.dropDuplicates(["subject_id", "relation", "object_id"]), entities, "subject", "object")


def search(queries: DataFrame, vectors: DataFrame, live: DataFrame, k: int = 10, min_score: float = 0.0, bound: int = 10_000, block: int = 4096) -> DataFrame:
    """query_id, item_id, score: the k most similar vectors by cosine, then without items that are not live.

    Queries are dealt into blocks of about bound by a hash of their id, vectors into blocks of about block, and each two
    blocks meet in a task as a product of matrices, which hands on k rows for each query. The k best of all come from
    one window, whose groups Spark cuts to k rows before the shuffle.
    """
    ship(vectors.sparkSession)
    many, some = max(1, -(-vectors.count() // block)), max(1, -(-queries.count() // bound))
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["item_id"]
    left = queries.where("query_vector is not null").select(F.col("query_id").alias("query_id"), F.col("query_vector").alias("query_vector"), F.pmod(F.xxhash64("query_id"), F.lit(some)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("j"))
    right = vectors.where("vector is not null").select("item_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(some - 1))).alias("i"), F.pmod(F.xxhash64("item_id"), F.lit(many)).cast("int").alias("j"))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.take(pc.sort_indices(y, sort_keys=[("item_id", "ascending")], null_placement="at_start"))  # of equals the first
        ys, found = units(y["vector"]), []
        for n, (at, u) in units(x["query_vector"]).items():
            if n not in ys:
                continue
            to, v = ys[n]
            step = max(1, 2**21 // len(v))
            for start in range(0, len(at), step):
                score = np.round(u[start : start + step] @ v.T, 6) + 0.0
                least = np.partition(score, -k, 1)[:, -k] if len(v) > k else np.full(len(score), -np.inf)
                a, b = np.nonzero(score >= np.maximum(least, min_score)[:, None])
                s = score[a, b]
                order = np.lexsort((b, -s, a))
                a, b, s = a[order], b[order], s[order]
                ahead = np.arange(len(a)) - np.searchsorted(a, a) < k
                found.append((at[start + a[ahead]], to[b[ahead]], s[ahead]))
        a, b, s = (np.concatenate([f[c] for f in found]) if found else np.array([], kind) for c, kind in enumerate((int, int, float)))
        return pa.table({"query_id": x["query_id"].take(pa.array(a)), "item_id": y["item_id"].take(pa.array(b)), "score": pa.array(s)})

    scored = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    found = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id"))).where(F.col("rank") <= k)
    return found.join(live.select("item_id"), "item_id", "left_semi").select("query_id", "item_id", "score")


def property_sets(psets: DataFrame, entities: DataFrame, defaults: DataFrame) -> DataFrame:
    """entity_id, ifc_class, properties, source: curated properties by class, else the defaults of the entity's type."""
    own = psets.groupBy("entity_id", "ifc_class").agg(F.array_join(F.array_sort(F.collect_list("property_name")), "|").alias("properties")).withColumn("source", F.lit("curated"))
    bare = entities.join(psets, entities["id"] == psets["entity_id"], "left_anti")
    few = defaults.limit(10_001).count() <= 10_000  # a row for each type, as a rule
    fallback = bare.join(F.broadcast(defaults) if few else defaults, "entity_type").select(F.col("id").alias("entity_id"), "ifc_class", "properties", F.lit("default").alias("source"))
    return own.unionByName(fallback)


def constraints(rows: DataFrame, entities: DataFrame, ids: DataFrame, limit: int = 20, min_confidence: float = 0.0, include_proposed: bool = False, context: str | None = None) -> DataFrame:
    """Rows of subjects (id), filtered, ranked and cut to limit for each subject: constraints, failure modes, patterns. A context counts where rows have applicability."""
    own = rows.join(ids.select(F.col("id").alias("asked")).distinct(), F.col("subject_id") == F.col("asked"), "left_semi")
    own = shared_filter(own, min_confidence, include_proposed)
    if context is not None and "applicability" in rows.columns:
        own = own.where(in_context(F.col("applicability"), context))
    return with_names(ranked(own, limit, "subject_id"), entities, "subject")


def acting_forces(forces: DataFrame, ids: DataFrame, limit: int = 20, min_confidence: float = 0.0, include_proposed: bool = False) -> DataFrame:
    """(entity_id, id, name, direction, rank): forces whose affects name an entity (id), ranked for each entity; a force that names it twice counts once."""
    flat = shared_filter(forces, min_confidence, include_proposed).withColumn("entity_id", F.explode(F.array_distinct("affects")))
    own = flat.join(ids.select(F.col("id").alias("asked")).distinct(), F.col("entity_id") == F.col("asked"), "left_semi")
    return ranked(own, limit, "entity_id").select("entity_id", "id", "name", "direction", "rank")


def pattern_forces(patterns: DataFrame, forces: DataFrame) -> DataFrame:
    """patterns with forces (the names of force_ids in their order, unknown ids as themselves, else the raw descriptions) and a warning where only descriptions are there."""
    flat = patterns.select("id", F.posexplode("force_ids").alias("pos", "force"))
    named = flat.join(forces.select(F.col("id").alias("force"), "name"), "force", "left").select("id", "pos", F.coalesce("name", "force").alias("name"))
    lists = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("_names"))
    rows = patterns.join(lists, "id", "left")
    raw = F.coalesce("force_descriptions", F.array().cast("array<string>"))
    return rows.withColumn("forces", F.coalesce("_names", raw)).withColumn("forces_warning", F.when(F.col("_names").isNull() & (F.size(raw) > 0), "unresolved_descriptions")).drop("_names")


def not_found(requests: DataFrame, entities: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """(error, query): a row for each request whose name is no entity."""
    return resolve(requests, entities, aliases, name).where("entity_id is null").select(F.lit("entity_not_found").alias("error"), F.col(name).alias("query"))


def propose(requests: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Requests (subject, predicate, object) as assertion rows, or the error that keeps them from being one. The predicate is free."""
    rows = resolve(requests, entities, aliases, "subject").withColumnRenamed("entity_id", "subject_id")
    rows = resolve(rows, entities, aliases, "object").withColumnRenamed("entity_id", "object_id")
    error = F.when(F.col("subject_id").isNull(), "subject_not_found").when(F.col("object_id").isNull(), "object_not_found")
    return rows.select("subject", "predicate", "object", "subject_id", "object_id", F.coalesce(error, F.lit("proposed")).alias("outcome"), F.when(error.isNull(), F.sha2(F.concat_ws("|", "subject_id", "predicate", "object_id"), 256)).alias("id"))


def proposed_rows(requests: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """The assertion rows that good requests (subject, predicate, object, rationale, and confidence and origin or null) append."""
    more = requests.select("subject", "predicate", "object", "rationale", F.coalesce("confidence", F.lit(0.7)).alias("confidence"), F.coalesce("origin", F.lit("architectural")).alias("knowledge_origin"))
    good = propose(requests.select("subject", "predicate", "object").distinct(), entities, aliases).where("outcome = 'proposed'")
    return good.join(more, ["subject", "predicate", "object"]).select("id", "subject_id", "predicate", "object_id", "confidence", "knowledge_origin", "rationale", F.lit("proposed").alias("status"), F.lit("mcp_agent").alias("source_model"))
