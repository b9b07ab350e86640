"""What extraction passes do after the model has answered: lookups, filters, merging, state changes, resume, ledger.

Answers come as tables with the columns that the model gave; every function is a plan over them. seq is the order in
which answers arrived, ids are hashes of natural keys, so a rerun writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import SPATIAL_RELATIONS, direction_named, name_key, norm, word_forms
from loomgraph.operators import lifecycle

PROVENANCE = ("confidence", "knowledge_origin", "rationale", "source_model")


def discover(answers: DataFrame, entities: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """New entities of discovered concepts (name, entity_type, seq): the first of each name, without those that exist in any status.

    Extra seeds (name, seq) come after them, as spaces.
    """
    rows = answers.select("name", "entity_type", F.lit(0).alias("late"), "seq")
    if seeds is not None:
        rows = rows.unionByName(seeds.select("name", F.lit("space").alias("entity_type"), F.lit(1).alias("late"), "seq"))
    rows = rows.withColumn("key", norm(F.col("name"))).where("key <> ''")
    new = rows.join(entities.select(norm(F.col("name")).alias("key")), "key", "left_anti")
    first = new.groupBy("key").agg(F.min(F.struct("late", "seq", "name", "entity_type")).alias("x"))
    return first.select(name_key(F.lit("entity"), F.col("key")).alias("id"), F.trim("x.name").alias("name"), F.col("x.entity_type").alias("entity_type"), F.lit("proposed").alias("status"), F.col("x.seq").alias("seq"))


def lookup(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, entity_id, entity_type): lower-case names of entities that are not merged, their aliases, and plural and singular forms.

    An exact key wins over a form; of exact keys the last wins, aliases after names; of forms the first.
    """
    live = entities.where("status <> 'merged'").select(F.col("id").alias("entity_id"), "entity_type", F.lower("name").alias("key"), F.lit(0).alias("late"), "seq")
    named = aliases.join(live.select("entity_id", "entity_type"), "entity_id").select("entity_id", "entity_type", F.lower("alias").alias("key"), F.lit(1).alias("late"), "seq")
    exact = live.unionByName(named)
    forms = exact.select("entity_id", "entity_type", F.explode(word_forms(F.col("key"))).alias("key"), "late", "seq")
    last = exact.groupBy("key").agg(F.max(F.struct("late", "seq", "entity_id", "entity_type")).alias("x"))
    first = forms.groupBy("key").agg(F.min(F.struct("late", "seq", "entity_id", "entity_type")).alias("y"))
    both = last.join(first, "key", "full")
    best = F.coalesce("x", "y")
    return both.select("key", best["entity_id"].alias("entity_id"), best["entity_type"].alias("entity_type"))


def _resolved(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """rows whose name in column is known, with <column>_id and <column>_type."""
    found = names.select(F.col("key").alias("_key"), F.col("entity_id").alias(f"{column}_id"), F.col("entity_type").alias(f"{column}_type"))
    return rows.join(found, norm(F.col(column)) == F.col("_key")).drop("_key")


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("confidence", F.bround("confidence", 4)).withColumn("status", F.lit("proposed"))


def assertions(groups: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of matched answers (subject_id, grp, seq, predicate, object, confidence, ..., consistency, size): one for each group.

    The first answer speaks for its group; the confidence is the mean, rounded. Groups whose object is blank, unknown or
    the subject itself give nothing.
    """
    first = groups.groupBy("subject_id", "grp").agg(F.min_by(F.struct("predicate", "object", "knowledge_origin", "rationale", "source_model"), "seq").alias("x"), F.avg("confidence").alias("confidence"), F.first("consistency").alias("cpc"), F.first("size").alias("framings"))
    rows = first.select("subject_id", "grp", "x.*", "confidence", "cpc", "framings").where(F.trim("object") != "")
    rows = _rounded(_resolved(rows, names, "object").where("object_id <> subject_id"))
    return rows.withColumn("id", name_key(F.col("subject_id"), F.col("grp"), F.col("source_model"))).drop("object", "grp")


def spatial(answers: DataFrame, entities: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, pending): relations of components and spaces; an unknown relation is kept, and pending as a new value."""
    able = entities.where(F.col("entity_type").isin("component", "space")).select(F.col("id").alias("subject_id"))
    rows = answers.join(able, "subject_id", "left_semi").where(F.trim("object") != "")
    rows = _rounded(_resolved(rows, names, "object").where("object_id <> subject_id").drop("object"))
    pending = rows.where(~F.col("relation").isin(*SPATIAL_RELATIONS)).groupBy(F.col("relation").alias("value")).agg(F.count("*").alias("n"))
    return rows.withColumn("id", name_key(F.col("subject_id"), F.col("relation"), F.col("object_id"), F.col("source_model"))), pending


def process(answers: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """entities (new activities), relations and divergences of answers (predecessor, successor, hard_constraint, rationale, source_model, seq).

    Blank names and rationales are skipped. A name that no entity has, case aside and merged ones left out, becomes an
    activity. Self-loops go; the first of each (predecessor, successor, model) stays, others that differ from it count.
    """
    rows = answers.where((F.trim(F.coalesce("rationale", F.lit(""))) != "") & (F.trim("predecessor") != "") & (F.trim("successor") != ""))
    known = entities.where("status <> 'merged'").groupBy(F.lower("name").alias("key")).agg(F.min_by("id", F.struct("seq", "id")).alias("found"))
    asked = rows.select(F.explode(F.array("predecessor", "successor")).alias("name"), "seq", "source_model")
    first = asked.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("seq", "name", "source_model")).alias("x"))
    all_ = first.join(known, "key", "left").withColumn("id", F.coalesce("found", name_key(F.lit("activity"), F.col("key"))))
    new = all_.where("found is null").select("id", F.col("x.name").alias("name"), F.lit("activity").alias("entity_type"), F.lit("proposed").alias("status"), F.col("x.source_model").alias("source_model"), F.col("x.seq").alias("seq"))
    for end in ("predecessor", "successor"):
        rows = rows.join(all_.select(F.col("key").alias(f"_{end}"), F.col("id").alias(f"{end}_id")), F.lower(end) == F.col(f"_{end}")).drop(f"_{end}")
    rows = rows.where("predecessor_id <> successor_id")
    key = ["predecessor_id", "successor_id", "source_model"]
    one = rows.groupBy(key).agg(F.min(F.struct("seq", "hard_constraint", "rationale")).alias("x"), F.count_if("hard_constraint").alias("hard"), F.count("*").alias("n"))
    says = F.col("x.hard_constraint")
    differ = F.when(says, F.col("n") - F.col("hard")).otherwise(F.col("hard"))
    made = one.select(name_key(*map(F.col, key)).alias("id"), *key, says.alias("hard_constraint"), F.trim("x.rationale").alias("rationale"), F.lit(0.8).alias("confidence"), F.lit("engineering").alias("knowledge_origin"), F.lit("proposed").alias("status"), differ.alias("divergent"))
    return {"entities": new, "relations": made.drop("divergent"), "divergences": made.where("divergent > 0").select(*key, "divergent")}


def constraints(answers: DataFrame) -> DataFrame:
    """Constraint rows of answers (subject_id, rule, constraint_type, ...): blank rules skipped, rules trimmed."""
    rows = _rounded(answers.where(F.trim(F.coalesce("rule", F.lit(""))) != "").withColumn("rule", F.trim("rule")))
    return rows.withColumn("id", name_key(F.col("subject_id"), F.col("rule"), F.col("constraint_type"), F.col("source_model")))


def antipatterns(answers: DataFrame) -> DataFrame:
    """Anti-pattern rows of answers (subject_id, name, conditions, consequences, mitigations, ...): blank names skipped."""
    rows = _rounded(answers.where(F.trim(F.coalesce("name", F.lit(""))) != "").withColumn("name", F.trim("name")))
    return rows.withColumn("id", name_key(F.lit("antipattern"), F.col("subject_id"), F.col("name"), F.col("source_model")))


def patterns(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Pattern rows of components, spaces and systems: name, problem and solution must not be blank."""
    able = entities.where(F.col("entity_type").isin("component", "space", "system")).select(F.col("id").alias("subject_id"))
    rows = answers.join(able, "subject_id", "left_semi")
    for c in ("name", "problem", "solution"):
        rows = rows.where(F.trim(F.coalesce(c, F.lit(""))) != "").withColumn(c, F.trim(c))
    return _rounded(rows).withColumn("id", name_key(F.lit("pattern"), F.col("subject_id"), F.col("name"), F.col("source_model")))


def forces(answers: DataFrame, entities: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """forces, pending_entities and pending_forces of answers (subject_id, name, direction, affects, ..., seq) of components, spaces and systems.

    A name without a word for its direction is a validation failure. Names in affects become ids in their order; unknown
    ones are pending, blank ones nothing.
    """
    able = entities.where(F.col("entity_type").isin("component", "space", "system")).select(F.col("id").alias("subject_id"))
    rows = answers.join(able, "subject_id", "left_semi").where(F.trim(F.coalesce("name", F.lit(""))) != "")
    rows = rows.withColumn("id", name_key(F.lit("force"), F.col("subject_id"), F.col("name"), F.col("source_model"), F.col("seq"))).withColumn("ok", direction_named(F.col("name"), F.col("direction")))
    flat = rows.where("ok").select("id", F.posexplode("affects").alias("pos", "asked")).where(F.trim("asked") != "")
    found = flat.join(names.select(F.col("key").alias("_key"), "entity_id"), norm(F.col("asked")) == F.col("_key"), "left").drop("_key")
    ids = found.where("entity_id is not null").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))), lambda x: x["entity_id"]).alias("affected"))
    made = _rounded(rows.where("ok").join(ids, "id", "left")).withColumn("affects", F.coalesce("affected", F.array().cast("array<string>"))).withColumn("name", F.trim("name"))
    return {
        "forces": made.drop("affected", "ok", "subject_id"),
        "pending_entities": found.where("entity_id is null").select(F.col("asked").alias("entity_name"), F.col("id").alias("source_force_id")),
        "pending_forces": rows.where("not ok").select(F.col("name").alias("description"), F.lit("validation_failure").alias("failure_type")),
    }


def prompts(rows: DataFrame, size: int = 20) -> DataFrame:
    """(subject_id, batch, n, text): live assertions of a subject, size at a time in the order of seq and id, as text for the model.

    rows: id, subject_id, subject, predicate, object, status, seq, and the lists conditions, exceptions, applicability.
    """
    w = Window.partitionBy("subject_id").orderBy("seq", "id")
    live = rows.where(F.col("status").isin("accepted", "proposed")).withColumn("nth", F.row_number().over(w)).withColumn("batch", F.floor((F.col("nth") - 1) / size).cast("int"))
    more = [F.when(F.size(c) > 0, F.concat(F.lit(f"\n  {label}: "), F.array_join(c, "; "))).otherwise("") for c, label in (("conditions", "conditions"), ("exceptions", "existing exceptions"), ("applicability", "applicability"))]
    line = F.concat(F.lit("["), "id", F.lit("] "), "subject", F.lit(" "), "predicate", F.lit(" "), "object", *more)
    lines = F.array_sort(F.collect_list(F.struct("nth", line.alias("line"))))
    return live.groupBy("subject_id", "batch").agg(F.count("*").alias("n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("text"))


def findings(answers: DataFrame, least: float = 0.70) -> DataFrame:
    """Answers (item_id, finding_type, detail, confidence, model, seq) merged by item and type.

    details are the different ones in the order they came; the canonical one has the highest confidence among the first
    answers of each detail, the first of equals. models counts who said so; below least a finding is only logged.
    """
    one = answers.groupBy("item_id", "finding_type", "detail").agg(F.min_by(F.struct("seq", "confidence", "model"), "seq").alias("x"))
    best = F.max_by(F.struct(F.col("detail"), F.col("x.confidence").alias("confidence"), F.col("x.model").alias("model")), F.struct(F.col("x.confidence"), -F.col("x.seq")))
    details = F.transform(F.array_sort(F.collect_list(F.struct(F.col("x.seq").alias("seq"), "detail"))), lambda d: d["detail"])
    models = answers.groupBy("item_id", "finding_type").agg(F.count_distinct("model").alias("models"))
    out = one.groupBy("item_id", "finding_type").agg(best.alias("best"), details.alias("details")).join(models, ["item_id", "finding_type"])
    return out.select("item_id", "finding_type", "models", F.col("best.detail").alias("detail"), F.col("best.confidence").alias("confidence"), F.col("best.model").alias("model"), "details", (F.col("best.confidence") >= least).alias("applied"))


def apply_findings(rows: DataFrame, merged: DataFrame) -> dict[str, DataFrame]:
    """assertions, decisions and log after merged findings; counts by what became of them in outcomes.

    exception adds its details to exceptions, context_limitation to applicability, what is there already is not added;
    potential_error of two models or more makes the item conflicted, of one it is only logged; scope_restriction only
    defers. Items that do not exist are skipped.
    """
    here = merged.where("applied").join(rows.select(F.col("id").alias("item_id"), "status"), "item_id")
    lists = {"exceptions": "exception", "applicability": "context_limitation"}
    out = rows
    for column, kind in lists.items():
        new = here.where(F.col("finding_type") == kind).select(F.col("item_id").alias("_id"), F.col("details").alias("_new"))
        out = out.join(new, F.col("id") == F.col("_id"), "left").withColumn(column, F.when(F.col("_new").isNotNull(), F.concat(F.col(column), F.array_except("_new", column))).otherwise(F.col(column))).drop("_id", "_new")
    wrong = here.where((F.col("finding_type") == "potential_error") & (F.col("models") >= 2))
    scope = here.where("finding_type = 'scope_restriction'")
    decided = wrong.select("item_id", F.col("detail").alias("rationale"), F.col("model").alias("reviewer")).unionByName(scope.select("item_id", F.concat(F.lit("scope_restriction: "), "detail").alias("rationale"), F.col("model").alias("reviewer")))
    outcome = F.when(~F.col("applied"), "logged").when(F.col("status").isNull(), "missing").when(F.col("finding_type") == "potential_error", F.when(F.col("models") >= 2, "conflicted").otherwise("logged")).when(F.col("finding_type") == "scope_restriction", "deferred").when(F.col("finding_type").isin(*lists.values()), F.col("finding_type")).otherwise("ignored")
    fate = merged.join(rows.select(F.col("id").alias("item_id"), "status"), "item_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
    return {
        "assertions": lifecycle.with_status(out, wrong.select(F.col("item_id").alias("id")), "conflicted"),
        "decisions": decided.select("item_id", F.lit("assertion").alias("item_type"), F.lit("defer").alias("decision"), "rationale", "reviewer"),
        "log": lifecycle.changed(wrong.select(F.col("item_id").alias("id"), "status"), "assertion", "conflicted", "findings"),
        "outcomes": fate,
    }


def schema_classes(mentions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, new): mentions (name, description, seq) of names that start with Ifc, with the entity each stands for, and the entities made.

    An entity of the type ifc_class is found by its lower-case name, any other by its exact name; else one is made of the
    first mention, with full confidence and origin schema.
    """
    rows = mentions.where(F.col("name").startswith("Ifc")).withColumn("key", F.lower("name"))
    classes = entities.where("entity_type = 'ifc_class'").groupBy(F.lower("name").alias("key")).agg(F.max_by("id", F.struct("seq", "id")).alias("by_class"))
    exact = entities.groupBy("name").agg(F.min_by("id", F.struct("seq", "id")).alias("by_name"))
    one = rows.groupBy("key").agg(F.min(F.struct("seq", "name", "description")).alias("x")).select("key", "x.*")
    one = one.join(classes, "key", "left").join(exact, "name", "left").withColumn("id", F.coalesce("by_class", "by_name", name_key(F.lit("ifc_class"), F.col("key"))))
    new = one.where("by_class is null and by_name is null").select("id", "name", "description", F.lit("ifc_class").alias("entity_type"), F.lit("proposed").alias("status"), F.lit(1.0).alias("confidence"), F.lit("schema").alias("knowledge_origin"), "seq")
    return rows.join(one.select("key", F.col("id").alias("entity_id")), "key").drop("key"), new


def mentioned_classes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, seq): every Ifc name in a text, in order; a stand-in for a model's answer."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(r"\bIfc[A-Za-z]+"), 0)).alias("pos", "name"))
    return found.select(key, "name", F.lit("").alias("description"), (F.xxhash64(key, "pos")).alias("seq"))


def outstanding(units: DataFrame, progress: DataFrame, number: str, model: str) -> DataFrame:
    """units (entity_id) of a pass that the model has not completed."""
    done = progress.where((F.col("pass_number") == number) & (F.col("model") == model) & (F.col("status") == "completed"))
    return units.join(done.select("entity_id"), "entity_id", "left_anti")


def completed(progress: DataFrame, units: DataFrame, number: str, model: str) -> DataFrame:
    """progress with units marked as completed, a row for each unit however often it was done."""
    key = ["pass_number", "entity_id", "model"]
    new = units.select(F.lit(number).alias("pass_number"), "entity_id", F.lit(model).alias("model")).distinct().withColumn("status", F.lit("completed"))
    return progress.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def reset(progress: DataFrame, numbers: tuple[str, ...]) -> DataFrame:
    """progress without the named passes, so that they run again."""
    return progress.where(~F.col("pass_number").isin(*numbers))


def statuses(progress: DataFrame, numbers: tuple[str, ...] = ("10a", "10b", "10c")) -> DataFrame:
    """(pass_number, done): whether each of the named passes was completed by some model."""
    asked = progress.sparkSession.createDataFrame([(n,) for n in numbers], "pass_number string")
    have = progress.where("status = 'completed'").groupBy("pass_number").agg(F.lit(True).alias("done"))
    return asked.join(have, "pass_number", "left").select("pass_number", F.coalesce("done", F.lit(False)).alias("done"))


def counts(entities: DataFrame, assertions: DataFrame, run: str, when: str) -> DataFrame:
    """(run, when, entities, assertions): a row of the run ledger, before or after."""
    n = entities.agg(F.count("*").alias("entities")).crossJoin(assertions.agg(F.count("*").alias("assertions")))  # one row each
    return n.select(F.lit(run).alias("run"), F.lit(when).alias("when"), "entities", "assertions")
