"""Curation by hand: ground truth, merges, entrances, settings, aliases, imported patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scalars import CORE_PREDICATES, name_key, norm, stated_confidence
from loomgraph.operators.knowledge import resolve, with_names
from loomgraph.operators.lifecycle import with_status

#: Settings of a new store (fixed values).
DEFAULTS = {"graph_rebuild_threshold": "50000", "embedding_model": "all-mpnet-base-v2", "auto_promote_enabled": "1", "api_enabled": "0", "query_max_results": "20", "llm_timeout_seconds": "120", "log_format": "text"}
CONFIG = "key string, value string"


def add(requests: DataFrame, entities: DataFrame, aliases: DataFrame, predicates=CORE_PREDICATES) -> DataFrame:
    """Requests (subject, predicate, object) as accepted ground-truth rows, or the error that keeps them from being one.

    outcome is unknown_predicate, subject_not_found, object_not_found or accepted; only accepted rows have an id.
    """
    rows = resolve(requests, entities, aliases, "subject").withColumnRenamed("entity_id", "subject_id")
    rows = resolve(rows, entities, aliases, "object").withColumnRenamed("entity_id", "object_id")
    error = F.when(~F.coalesce(F.col("predicate").isin(*predicates), F.lit(False)), "unknown_predicate").when(F.col("subject_id").isNull(), "subject_not_found").when(F.col("object_id").isNull(), "object_not_found")
    made = {"status": "accepted", "knowledge_origin": "human", "source_model": "human"}
    rows = rows.withColumn("outcome", F.coalesce(error, F.lit("accepted")))
    good = F.col("outcome") == "accepted"
    rows = rows.withColumns({k: F.when(good, v) for k, v in made.items()} | {"confidence": F.when(good, F.lit(1.0))})
    return rows.withColumn("id", F.when(good, name_key(F.col("subject_id"), F.col("predicate"), F.col("object_id"), F.lit("human"))))


def ground_truth(assertions: DataFrame, entities: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Assertions entered by hand, with names; of entities (id) at either end, if given."""
    rows = assertions.where("source_model = 'human'")
    if only is not None:
        ids = only.select(F.col("id").alias("asked")).distinct()
        ends = rows.join(ids, F.col("subject_id") == F.col("asked"), "left_semi").unionByName(rows.join(ids, F.col("object_id") == F.col("asked"), "left_semi"))
        rows = ends.dropDuplicates(["id"])
    return with_names(rows, entities, "subject", "object")


def merge_names(entities: DataFrame, aliases: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, aliases) after merges (loser, winner): the loser is marked, its name becomes an alias of the winner.

    Rows that point at the loser stay as they are; normalise.merge re-points them. A merge into itself, or with an end
    that does not exist, changes nothing.
    """
    found = merges.where("loser <> winner").join(entities.select(F.col("id").alias("winner")), "winner", "left_semi")
    found = found.join(entities.select(F.col("id").alias("loser"), "name", "seq"), "loser")
    new = found.select(F.col("winner").alias("entity_id"), F.col("name").alias("alias"), "seq")
    return with_status(entities, found.select(F.col("loser").alias("id")), "merged"), aliases.unionByName(new, allowMissingColumns=True)


def set_entrance(entities: DataFrame, ids: DataFrame, value: bool | None = None) -> DataFrame:
    """entities with is_entrance set for ids, or turned where no value is given, and warning for those that are no spaces."""
    hit = ids.select(F.col("id").alias("_hit")).distinct()
    rows = entities.join(hit, F.col("id") == F.col("_hit"), "left")
    mine = F.col("_hit").isNotNull()
    new = ~F.col("is_entrance") if value is None else F.lit(value)
    rows = rows.withColumn("is_entrance", F.when(mine, new).otherwise(F.col("is_entrance")))
    return rows.withColumn("warning", F.when(mine & (F.col("entity_type") != "space"), "not_a_space")).drop("_hit")


def new_config(spark: SparkSession, more: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((DEFAULTS | (more or {})).items()), CONFIG)


def get_config(config: DataFrame, key: str) -> str | None:
    row = config.where(F.col("key") == key).first()
    return row["value"] if row else None


def set_config(config: DataFrame, key: str, value: str | None) -> tuple[DataFrame, str | None]:
    """(config, warning): the key set, or unset by None. An unknown key is only warned about."""
    rest = config.where(F.col("key") != key)
    if value is not None:
        rest = rest.unionByName(config.sparkSession.createDataFrame([(key, value)], CONFIG))
    return rest, None if key in DEFAULTS else f"unknown key {key}"


def list_config(config: DataFrame) -> DataFrame:
    return config.orderBy("key")


def add_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """aliases with new ones (entity_id, alias, seq) that the entity has not got, case and spaces aside."""
    have = aliases.select("entity_id", norm(F.col("alias")).alias("_key"))
    rows = new.withColumn("_key", norm(F.col("alias"))).where("_key <> ''").join(have, ["entity_id", "_key"], "left_anti")
    return aliases.unionByName(rows.dropDuplicates(["entity_id", "_key"]).drop("_key"))


def import_patterns(existing: DataFrame, new: DataFrame, paraphrased: Column | None = None, model: str = "human") -> tuple[DataFrame, DataFrame]:
    """(patterns, outcomes): new patterns (name, confidence as stars, section, problem, solution, related names) by exact name.

    An unknown name is inserted as accepted ground truth; a known one is updated where its text was paraphrased, else
    skipped. outcomes: outcome, n.
    """
    rows = new.dropDuplicates(["name"]).withColumn("fresh", F.lit(False) if paraphrased is None else F.coalesce(paraphrased, F.lit(False)))
    marked = rows.join(existing.select("name", F.lit(True).alias("known")), "name", "left").withColumn("outcome", F.when(F.col("known").isNull(), "inserted").when(F.col("fresh"), "updated").otherwise("skipped"))
    added = marked.where("outcome = 'inserted'").select(
        name_key(F.lit("pattern"), F.col("name")).alias("id"), "name", F.when(F.coalesce(F.col("section"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array("section")).alias("context"),
        "problem", "solution", "related_pattern_names", stated_confidence(F.col("confidence")).alias("confidence"), F.lit("accepted").alias("status"), F.lit("human").alias("knowledge_origin"), F.lit(model).alias("source_model"))
    better = marked.where("outcome = 'updated'").select("name", F.col("problem").alias("_problem"), F.col("solution").alias("_solution"))
    kept = existing.join(better, "name", "left")
    kept = kept.withColumn("source_model", F.when(F.col("_problem").isNotNull(), model).otherwise(F.col("source_model")))
    kept = kept.withColumn("problem", F.coalesce("_problem", "problem")).withColumn("solution", F.coalesce("_solution", "solution")).select(*existing.columns)
    return kept.unionByName(added, allowMissingColumns=True).select(*existing.columns), marked.groupBy("outcome").agg(F.count("*").alias("n"))


def seed_psets(existing: DataFrame, seed: DataFrame, entities: DataFrame, aliases: DataFrame, force: bool = False) -> DataFrame:
    """Property sets with a seed (entity_name, ifc_class, property_name) added, names resolved; unknown names are left out.

    Where there are rows already nothing is added, unless forced: then rows of an earlier seed go and the new ones come.
    """
    found = resolve(seed, entities, aliases, "entity_name").where("entity_id is not null").drop("entity_name").withColumn("source_model", F.lit("seed"))
    if not force:
        return existing if not existing.isEmpty() else existing.unionByName(found, allowMissingColumns=True)
    return existing.where("source_model <> 'seed'").unionByName(found, allowMissingColumns=True)
