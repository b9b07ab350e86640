"""Status reports, integrity checks, compliance rules, extraction post-processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ("proposed", "accepted", "deprecated", "conflicted")


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(item_type, proposed, accepted, deprecated, conflicted, total): other statuses are in no total."""
    out = None
    for name, df in tables.items():
        counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
        part = df.agg(F.lit(name).alias("item_type"), *counts)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("total", sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0])))


def orphaned_conflicted(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Conflicted items that no conflict pair names."""
    named = pairs.select(F.explode(F.array("item_a_id", "item_b_id")).alias("id")).distinct()
    return items.where("status = 'conflicted'").join(named, "id", "left_anti")


def stale_pairs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with a deprecated member."""
    gone = items.where("status = 'deprecated'").select("id")
    a = pairs.join(gone, pairs["item_a_id"] == gone["id"], "left_semi")
    b = pairs.join(gone, pairs["item_b_id"] == gone["id"], "left_semi")
    return a.unionByName(b).distinct()


def queue_depth(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("item_a_id", "item_b_id")).alias("id")).agg(F.count_distinct("id").alias("depth"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("model").agg(F.count("*").alias("entries"), F.sum(F.octet_length("response")).alias("bytes"), F.count_distinct(F.sha2("response", 256)).alias("distinct_responses"))


def compliance(facts: DataFrame, needs: dict[str, float]) -> DataFrame:
    """(requirement, outcome, n): places by the outcome of a chain of rules.

    facts: place, requirement, value; needs: least value by requirement. No fact is UNCHECKED, else PASS or FAIL.
    """
    wanted = F.create_map(*[F.lit(x) for k, v in needs.items() for x in (k, float(v))])
    rows = facts.select("place").distinct().select("place", F.explode(wanted).alias("requirement", "least")).join(facts, ["place", "requirement"], "left")
    rows = rows.withColumn("outcome", F.when(F.col("value").isNull(), "UNCHECKED").when(F.col("value") >= F.col("least"), "PASS").otherwise("FAIL"))
    return rows.groupBy("requirement", "outcome").agg(F.count("*").alias("n"))


def invalid_rows(rows: DataFrame, rules: dict) -> DataFrame:
    """Rows that break rules, with the names of the rules they break: the quarantine table."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.withColumn("broken", F.array_join(broken, ",")).where("broken <> ''")


def batches(rows: DataFrame, key: str, order: list[str], size: int = 20) -> DataFrame:
    """rows with batch: chunks of size rows of a key in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def merge_findings(findings: DataFrame, least: float = 0.70) -> DataFrame:
    """(item_id, finding_type) with the number of models, the highest confidence, and whether it is applied or only logged."""
    out = findings.groupBy("item_id", "finding_type").agg(F.count_distinct("model").alias("models"), F.max("confidence").alias("confidence"), F.count_distinct("detail").alias("details"))
    return out.withColumn("applied", F.col("confidence") >= least)


def first_wins(process: DataFrame) -> DataFrame:
    """The first row of each (predecessor, successor, model), self-loops dropped, with how many said otherwise."""
    w = Window.partitionBy("predecessor_id", "successor_id", "source_model")
    rows = process.where("predecessor_id <> successor_id").withColumn("nth", F.row_number().over(w.orderBy("seq", "id")))
    rows = rows.withColumn("first_says", F.first("hard_constraint").over(w.orderBy("seq", "id"))).withColumn("n", F.count("*").over(w))
    other = F.sum(F.when(F.col("hard_constraint") != F.col("first_says"), 1).otherwise(0)).over(w)
    return rows.withColumn("divergent", other).where("nth = 1").select("id", "predecessor_id", "successor_id", "source_model", "hard_constraint", "n", "divergent")


def chunks(docs: DataFrame, size: int = 1000) -> DataFrame:
    """(doc_id, chunk, chars): texts cut into pieces of size characters, empty ones dropped."""
    n = F.ceil(F.length("text") / size).cast("int")
    rows = docs.where(F.length("text") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("piece", F.substring("text", F.col("chunk") * size + 1, F.lit(size))).select("doc_id", "chunk", "piece")


def view_exists(spark: SparkSession, name: str) -> bool:
    """Whether the session knows a table or view of this name."""
    return spark.catalog.tableExists(name)


def failed_references(pending: DataFrame) -> DataFrame:
    """Pending force references whose name failed its validation."""
    return pending.where("failure_type = 'validation_failure'")


def foreign_vectors(embeddings: DataFrame, model: str) -> DataFrame:
    """(model, n): vectors of other models than the one that is set."""
    return embeddings.where(F.col("model") != model).groupBy("model").agg(F.count("*").alias("n"))


def repair(items: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, pairs): conflicted items that no pair names are proposed again, pairs with a deprecated member are deleted."""
    lost = orphaned_conflicted(items, pairs).select(F.col("id").alias("_id"))
    rows = items.join(lost, F.col("id") == F.col("_id"), "left").withColumn("status", F.when(F.col("_id").isNotNull(), "proposed").otherwise(F.col("status"))).drop("_id")
    key = ["item_a_id", "item_b_id"]
    return rows, pairs.join(stale_pairs(pairs, items).select(key), key, "left_anti")


def cache_rows(cache: DataFrame, model: str | None = None, entity: str | None = None, since=None, before=None, limit: int | None = 20) -> DataFrame:
    """Cache rows of a model, an entity, a time, newest first, of equals by hash."""
    for column, value in (("model", model), ("entity_name", entity)):
        cache = cache if value is None else cache.where(F.col(column) == value)
    cache = cache if since is None else cache.where(F.col("cached_at") >= F.lit(since))
    cache = cache if before is None else cache.where(F.col("cached_at") < F.lit(before))
    cache = cache.orderBy(F.col("cached_at").desc(), "prompt_hash")
    return cache if limit is None else cache.limit(limit)


def clear_cache(cache: DataFrame, model: str | None = None, entity: str | None = None, before=None) -> DataFrame:
    """cache without the rows that all given filters match; without any filter none is left."""
    hit = F.lit(True)
    for column, value in (("model", model), ("entity_name", entity)):
        hit = hit if value is None else hit & F.coalesce(F.col(column) == value, F.lit(False))
    hit = hit if before is None else hit & (F.col("cached_at") < F.lit(before))
    return cache.where(~hit)


def _one_of(c: str, *values: str) -> Column:
    return F.col(c).isin(*values)


#: What rows of each type must satisfy (fixed values of the vocabularies).
ENTITY_TYPES = ("component", "system", "space", "material", "activity", "ifc_class")
ORIGINS = ("physical", "engineering", "architectural", "cultural", "human", "imported", "schema")


def validators(item_type: str) -> dict[str, Column]:
    """The rules for rows of a type, for invalid_rows: confidence in 0 to 1, known values, a rationale for relations in a process, no origin for abstractions."""
    rules = {"status": _one_of("status", *STATUSES, *(("merged",) if item_type == "entity" else ()))}
    if item_type == "entity":
        return rules | {"entity_type": _one_of("entity_type", *ENTITY_TYPES)}
    rules["confidence"] = F.col("confidence").between(0, 1)
    if item_type == "abstraction_node":
        return rules | {"knowledge_origin": F.col("knowledge_origin").isNull()}
    rules["knowledge_origin"] = _one_of("knowledge_origin", *ORIGINS)
    if item_type == "process_relation":
        rules["rationale"] = F.trim("rationale") != ""
    if item_type == "force":
        rules["direction"] = _one_of("direction", "increase", "decrease")
    return rules
