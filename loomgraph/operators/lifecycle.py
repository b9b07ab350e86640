"""Status and provenance: promotion, purge, history, pending values, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import review_threshold

HARD = ("physical", "engineering")
#: What makes two rows of a type the same statement; relations in a process are not promoted.
NATURAL_KEYS = {
    "assertion": ("subject_id", "predicate", "object_id"),
    "constraint": ("subject_id", "rule", "constraint_type"),
    "pattern": ("name",),
    "force": ("name",),
    "antipattern": ("name", "subject_id"),
    "spatial_relation": ("subject_id", "relation", "object_id"),
}


def promote_single(assertions: DataFrame) -> DataFrame:
    """Proposed, evaluated, hard-origin assertions that three framings agree on."""
    return assertions.where((F.col("status") == "proposed") & F.col("evaluated") & F.col("knowledge_origin").isin(*HARD) & (F.col("cpc") >= 0.85) & (F.col("framings") >= 3))


def promote_groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Natural keys of still proposed, evaluated rows that enough models hold with enough confidence: two and 0.80 if any is hard, else three and 0.90.

    The mean is compared as it is, in decimals, so that neither rounding nor the order of adding decides; mean is for reading.
    """
    total = F.sum(F.col("confidence").cast("decimal(18,9)"))
    groups = rows.where((F.col("status") == "proposed") & F.col("evaluated")).groupBy(*key).agg(F.count_distinct("source_model").alias("models"), F.round(F.avg("confidence"), 6).alias("mean"), (total >= F.lit(0.8).cast("decimal(18,9)") * F.count("*")).alias("fair"), (total >= F.lit(0.9).cast("decimal(18,9)") * F.count("*")).alias("high"), F.bool_or(F.col("knowledge_origin").isin(*HARD)).alias("hard"), F.count("*").alias("n"))
    return groups.where(F.when(F.col("hard"), (F.col("models") >= 2) & F.col("fair")).otherwise((F.col("models") >= 3) & F.col("high"))).drop("fair", "high")


def promote(assertions: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(assertions, accepted): single promotions first, then groups of what is still proposed. accepted: id, reviewer."""
    if not enabled:
        return assertions, assertions.where("false").select("id", F.lit("").alias("reviewer"))
    one = promote_single(assertions).select("id", F.col("source_model").alias("reviewer"))
    rest = assertions.join(one, "id", "left_anti")
    key = list(NATURAL_KEYS["assertion"])
    won = rest.where((F.col("status") == "proposed") & F.col("evaluated")).join(promote_groups(rest, key).select(key), key, "left_semi")
    accepted = one.unionByName(won.select("id", F.lit("consensus").alias("reviewer")))
    marked = assertions.join(accepted.select("id", F.lit("accepted").alias("new")), "id", "left")
    return marked.withColumn("status", F.coalesce("new", "status")).drop("new"), accepted


def status_log(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Review decisions and log rows of one delta: one each per item."""
    decisions = accepted.select(F.col("id").alias("item_id"), F.lit("accept").alias("decision"), "reviewer")
    log = accepted.select(F.col("id").alias("item_id"), F.lit("proposed").alias("old_status"), F.lit("accepted").alias("new_status"), F.col("reviewer").alias("changed_by"))
    return decisions, log


def promote_type(rows: DataFrame, item_type: str) -> DataFrame:
    """(id, reviewer) of the rows of any type that the agreement of models promotes; a null in the natural key counts as a value."""
    key = list(NATURAL_KEYS[item_type])
    filled = rows.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in key})
    ready = filled.where((F.col("status") == "proposed") & F.col("evaluated"))
    return ready.join(promote_groups(filled, key).select(key), key, "left_semi").select("id", F.lit("consensus").alias("reviewer"))


def changed(rows: DataFrame, item_type: str, status: str, by: str, at=None) -> DataFrame:
    """Log rows for rows (id, status) that get a new status."""
    return rows.select(F.col("id").alias("item_id"), F.lit(item_type).alias("item_type"), F.col("status").alias("old_status"), F.lit(status).alias("new_status"), (F.current_timestamp() if at is None else F.lit(at)).alias("changed_at"), F.lit(by).alias("changed_by"))


def with_status(rows: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """rows in which those whose id is among ids have a new status."""
    hit = ids.select(F.col("id").alias("_hit")).distinct()
    return rows.join(hit, F.col("id") == F.col("_hit"), "left").withColumn("status", F.when(F.col("_hit").isNotNull(), status).otherwise(F.col("status"))).drop("_hit")


def purge_tables(tables: dict[str, DataFrame], run, run_column: str = "extraction_run_id", at=None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, log): every row of the run that is not deprecated becomes it, in all tables, with a log row each."""
    out, log = {}, None
    mine = lambda t: F.coalesce(F.col(run_column) == F.lit(run), F.lit(False)) & (F.col("status") != "deprecated")
    for name, t in tables.items():
        part = changed(t.where(mine(t)), name, "deprecated", "purge", at)
        log = part if log is None else log.unionByName(part)
        out[name] = t.withColumn("status", F.when(mine(t), "deprecated").otherwise(F.col("status")))
    return out, log


def decisions_for(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Review decisions about items (id); an item has a decision if it has a row here."""
    return decisions.join(items.select(F.col("id").alias("item_id")).distinct(), "item_id", "left_semi")


def pairs_for(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Conflict pairs with one of items (id) at either end, once each."""
    asked = items.select(F.col("id").alias("asked")).distinct()
    ends = pairs.join(asked, F.col("item_a_id") == F.col("asked"), "left_semi").unionByName(pairs.join(asked, F.col("item_b_id") == F.col("asked"), "left_semi"))
    return ends.dropDuplicates(["item_a_id", "item_b_id"])


def purge(tables: dict[str, DataFrame], run: str) -> DataFrame:
    """(table, old_status, n): rows of the run that purging deprecates."""
    parts = [t.where((F.col("source_model") == run) & (F.col("status") != "deprecated")).groupBy(F.lit(name).alias("table"), F.col("status").alias("old_status")).agg(F.count("*").alias("n")) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def history(log: DataFrame) -> DataFrame:
    """The log with a first row per item: nothing to proposed, at the time of its first change."""
    first = log.groupBy("item_id").agg(F.min("changed_at").alias("changed_at"))
    first = first.select("item_id", F.lit(True).alias("is_initial"), F.lit(None).cast("string").alias("old_status"), F.lit("proposed").alias("new_status"), "changed_at", F.lit(-1).cast("long").alias("id"))
    rows = first.unionByName(log.select("item_id", F.lit(False).alias("is_initial"), "old_status", "new_status", "changed_at", "id"))
    order = Window.partitionBy("item_id").orderBy(F.col("is_initial").desc(), "changed_at", "id")
    return rows.withColumn("step", F.row_number().over(order))


def pending_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Counts and first/last sightings of values, merged: (value, n, first_seen, last_seen)."""
    seen = new.groupBy("value").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    both = existing.unionByName(seen)
    return both.groupBy("value").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def review_queue(pending: DataFrame, items: int, limit: int = 20) -> DataFrame:
    return pending.where(F.col("n") >= review_threshold(F.lit(items))).orderBy(F.col("n").desc(), "value").limit(limit)
