"""Text of query results, the dispatcher and service over the query tools, and the compliance report's rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scalars import decode_list, origin_rank
from loomgraph.operators import knowledge

#: Fixed values of the report: floor materials that count as slip resistant or waterproof, element classes that prove a
#: system, and objects that a model's geometry and materials cannot show.
SLIP_RESISTANT = ("tiles", "concrete", "stone", "vinyl", "screed", "terrazzo", "ceramic", "epoxy", "resin", "linoleum")
WATERPROOF = ("tiles", "concrete", "stone", "vinyl", "ceramic", "epoxy", "resin", "membrane", "linoleum")
SYSTEMS = {
    "Ventilation System": ("IfcAirTerminal", "IfcDuctSegment", "IfcDuctFitting", "IfcFan", "IfcUnitaryEquipment"),
    "HVAC System": ("IfcAirTerminal", "IfcDuctSegment", "IfcCoil", "IfcUnitaryEquipment", "IfcSpaceHeater"),
    "Heating System": ("IfcSpaceHeater", "IfcUnitaryEquipment", "IfcBoiler"),
    "Electrical System": ("IfcElectricDistributionBoard", "IfcLightFixture", "IfcElectricAppliance", "IfcProtectiveDevice", "IfcSwitchingDevice", "IfcOutlet"),
    "Lighting System": ("IfcLightFixture",),
    "Drainage System": ("IfcSanitaryTerminal", "IfcWasteTerminal"),
    "Rough-in Plumbing": ("IfcSanitaryTerminal", "IfcValve"),
    "Plumbing System": ("IfcSanitaryTerminal", "IfcValve"),
    "Fire Suppression System": ("IfcFireSuppressionTerminal",),
    "Fire Protection System": ("IfcFireSuppressionTerminal", "IfcAlarm"),
    "Security System": ("IfcAlarm",),
    "Structural Frame": ("IfcBeam", "IfcColumn", "IfcSlab"),
    "Foundation": ("IfcFooting",),
}
FLOORS = {"Anti-slip Flooring": SLIP_RESISTANT, "Waterproof Flooring": WATERPROOF}
COUNTED = {"Windows": "windows", "Doors": "doors", "Entrance Door": "doors", "External Door": "doors"}
UNSHOWN = ("Countertop Material", "Refrigeration Unit", "Nosing Profile", "Door Hardware", "Stringer", "Landing", "Ceiling", "Countertop", "Cabinetry")
USAGES = {"kitchen": "Kitchen", "living": "Living Room", "circulation": "Hallway / Circulation Corridor", "toilet": "Toilet / WC", "stair": "Staircase / Stair Hall", "retail": "Retail Unit / Shop Front"}


def _listed(label: str, c: str) -> Column:
    return F.when(F.size(c) > 0, F.concat(F.lit(f"    {label}: "), F.array_join(c, "; ")))


def _score() -> Column:
    """Two decimals, halves to even as the confidence's binary value has it."""
    return F.concat(F.lit("    confidence="), F.format_number("confidence", 2), F.lit("  origin="), "knowledge_origin", F.lit("  status="), "status")


#: What a result of each type looks like: first line, then the lists under it.
LAYOUTS: dict[str, tuple[Callable[[], Column], tuple[str, ...]]] = {
    "assertion": (lambda: F.concat(F.lit("  "), "subject", F.lit(" —["), "predicate", F.lit("]→ "), "object"), ("conditions", "exceptions")),
    "constraint": (lambda: F.concat(F.lit("  ["), F.upper("constraint_type"), F.lit("] "), "rule"), ("conditions", "exceptions")),
    "antipattern": (lambda: F.concat(F.lit("  "), "name"), ("conditions", "consequences", "mitigations")),
    "force": (lambda: F.concat(F.lit("  ["), F.upper("direction"), F.lit("] "), "name"), ()),
    "spatial": (lambda: F.concat(F.lit("  "), "subject", F.lit(" —["), "relation", F.lit("]→ "), "object"), ()),
}


def text(rows: DataFrame, kind: str) -> DataFrame:
    """rows with text: how a result of the type reads, a line for what it says, its confidence, and each list that is not empty."""
    head, lists = LAYOUTS[kind]
    lines = [head(), _score(), *[_listed(c, c) for c in lists if c in rows.columns]]
    if kind == "force" and "rationale" in rows.columns:
        lines.append(F.when(F.coalesce("rationale", F.lit("")) != "", F.concat(F.lit("    rationale: "), "rationale")))
    return rows.withColumn("text", F.concat_ws("\n", *lines))


def sequence_text(sequences: DataFrame) -> DataFrame:
    """(start, text) of process sequences (start, entity, sequence, has_cycle, cycle, truncated)."""
    step = lambda x, i: F.concat(F.lit("  "), F.lpad((i + 1).cast("string"), 3, " "), F.when(x == F.col("entity"), ". ● ").otherwise(". → "), x)
    parts = [F.concat(F.lit("Process sequence for '"), "entity", F.lit("'\n")), F.when(F.col("has_cycle"), F.concat(F.lit("  WARNING: cycle detected — "), F.coalesce("cycle", F.lit("")), F.lit("\n"))), F.array_join(F.transform("sequence", step), "\n"), F.when(F.col("truncated"), "  ... (truncated at max_depth)")]
    return sequences.select("start", F.concat_ws("\n", *parts).alias("text"))


def assertion_query(assertions: DataFrame, entities: DataFrame, ids: DataFrame, min_confidence: float = 0.0, include_proposed: bool = False) -> DataFrame:
    """Assertions with one of ids at either end, accepted and, if asked for, proposed; best confidence first, then origin, then id."""
    wanted = ["accepted", "proposed"] if include_proposed else ["accepted"]
    rows = assertions.where(F.col("status").isin(wanted) & (F.col("confidence") >= min_confidence))
    asked = ids.select(F.col("id").alias("asked")).distinct()
    ends = rows.join(asked, F.col("subject_id") == F.col("asked"), "left_semi").unionByName(rows.join(asked, F.col("object_id") == F.col("asked"), "left_semi"))
    return knowledge.with_names(ends.dropDuplicates(["id"]), entities, "subject", "object").orderBy(F.col("confidence").desc(), origin_rank(F.col("knowledge_origin")), "id")


def by_repository(rows: DataFrame, subject: str | None = None, predicate: str | None = None, unevaluated: bool = False, origin: str | None = None) -> DataFrame:
    """The repository's filters. Rows without a knowledge origin (abstractions) refuse a filter on it."""
    if origin is not None and "knowledge_origin" not in rows.columns:
        raise ValueError("these rows have no knowledge_origin")
    for column, value in (("subject_id", subject), ("predicate", predicate), ("knowledge_origin", origin)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.where("conflict_evaluated_at is null") if unevaluated else rows


class Service:
    """The query tools over the tables of a store, by entity name. An unknown name gives an error row, never an exception."""

    KINDS = ("assertion", "constraint", "antipattern", "force", "spatial", "process")

    def __init__(self, tables: dict[str, DataFrame]):
        self.t = tables

    def ready(self) -> bool:
        """Whether there is an entity to ask about."""
        return not self.t["entities"].where("status <> 'merged'").isEmpty()

    def entity(self, name: str) -> DataFrame:
        asked = self.t["entities"].sparkSession.createDataFrame([(name,)], "name string")
        return knowledge.resolve(asked, self.t["entities"], self.t["aliases"]).where("entity_id is not null").select(F.col("entity_id").alias("id"))

    def query(self, kind: str, name: str, min_confidence: float = 0.0, max_results: int = 20, include_proposed: bool = False) -> DataFrame:
        """Results of a type about an entity, ranked and cut; error and query where the name is unknown."""
        if kind not in self.KINDS:
            raise ValueError(f"unknown type {kind}: one of {', '.join(self.KINDS)}")
        ids = self.entity(name)
        if ids.isEmpty():
            return ids.sparkSession.createDataFrame([("entity_not_found", name)], "error string, query string")
        if kind == "assertion":
            return assertion_query(self.t["assertions"], self.t["entities"], ids, min_confidence, include_proposed).limit(max_results)
        if kind == "process":
            from loomgraph.operators import graph

            edges = graph.precedes(self.t["edges"])
            return graph.sequences(edges, ids.select(F.col("id").alias("start")), self.t["entities"])
        if kind == "force":
            rows = self.t["forces"].join(F.broadcast(ids.withColumnRenamed("id", "asked")), F.array_contains("affects", F.col("asked")), "left_semi")
        elif kind == "spatial":
            rows = knowledge.touching(self.t["spatial"], self.t["entities"], ids)
        else:
            own = self.t["constraints" if kind == "constraint" else "antipatterns"]
            rows = own.join(ids.withColumnRenamed("id", "asked"), F.col("subject_id") == F.col("asked"), "left_semi")
        return knowledge.ranked(knowledge.shared_filter(rows, min_confidence, include_proposed), max_results)


def usage(pset_usage: Column, name: Column) -> Column:
    """What a space is for: the first part of its stated usage, else the first known word in its name, else null."""
    stated = F.trim(F.element_at(F.split(F.lower(pset_usage), "-"), 1))
    named = F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(k)), F.lit(k)) for k in USAGES])
    return F.when(F.coalesce(pset_usage, F.lit("")) != "", stated).otherwise(named)


def space_facts(spaces: DataFrame, bounds: DataFrame, layers: DataFrame) -> DataFrame:
    """(space, usage, floor, windows, doors) of spaces (space, usage, name), bounds (space, element, ifc_class) and layers (element, material)."""
    floors = bounds.where("ifc_class = 'IfcCovering'").join(layers, "element").groupBy("space").agg(F.array_sort(F.collect_set(F.lower("material"))).alias("floor"))
    seen = bounds.groupBy("space").agg(F.count_if(F.col("ifc_class") == "IfcWindow").alias("windows"), F.count_if(F.col("ifc_class") == "IfcDoor").alias("doors"))
    rows = spaces.select("space", usage(F.col("usage"), F.col("name")).alias("usage")).join(floors, "space", "left").join(seen, "space", "left")
    return rows.withColumn("floor", F.coalesce("floor", F.array().cast("array<string>"))).fillna(0, ["windows", "doors"])


def model_facts(elements: DataFrame, layers: DataFrame) -> DataFrame:
    """One row of a model's elements (element, ifc_class): for each system whether it is there, and whether a wall is insulated."""
    systems = elements.agg(*[F.coalesce(F.bool_or(F.col("ifc_class").isin(*kinds)), F.lit(False)).alias(name) for name, kinds in SYSTEMS.items()])
    walls = elements.where("ifc_class = 'IfcWall'").join(layers, "element").agg(F.coalesce(F.bool_or(F.contains(F.lower("material"), F.lit("insulation"))), F.lit(False)).alias("Insulation"))
    return systems.crossJoin(walls)  # one row each


def rules(spark: SparkSession) -> DataFrame:
    """(object, fact, priority): which fact decides on an object; of several that a space has, the one of the least priority."""
    rows = [("Flooring", "floor", 0), ("Insulation", "insulation", 0)]
    rows += [(o, f"floor for {o}", 0) for o in FLOORS] + [(o, column, 0) for o, column in COUNTED.items()] + [(o, f"system {o}", 0) for o in SYSTEMS] + [(o, "unshown", 1) for o in UNSHOWN]
    return spark.createDataFrame(rows, "object string, fact string, priority int")


def evidence(facts: DataFrame, model: DataFrame) -> DataFrame:
    """facts with evidence: by name of a fact, whether it holds in a space or its model (null: it cannot be told) and what is said in either case."""
    floor = F.col("floor")
    listed = F.array_join(floor, ", ")
    says = lambda holds, yes, no: F.struct(holds.cast("boolean").alias("holds"), yes.cast("string").alias("yes"), no.cast("string").alias("no"))
    out = {"floor": says(F.size(floor) > 0, F.concat(F.lit("floor material present: "), listed), F.lit("no floor covering found")), "insulation": says(F.col("Insulation"), F.lit("insulation layer found in wall assemblies"), F.lit("no insulation layer in any wall assembly")), "unshown": says(F.lit(None), F.lit(None), F.lit("requires non-geometric IFC data"))}
    for name, approved in FLOORS.items():
        good = F.array_intersect(floor, F.array(*map(F.lit, approved)))
        bad = F.when(F.size(floor) == 0, "no floor covering found").otherwise(F.concat(F.lit("floor is "), listed, F.lit(f" — not in approved set {{{', '.join(sorted(approved))}}}")))
        out[f"floor for {name}"] = says(F.size(good) > 0, F.concat(F.lit("approved material: "), F.array_join(F.array_sort(good), ", ")), bad)
    for column in dict.fromkeys(COUNTED.values()):
        out[column] = says(F.col(column) > 0, F.concat(F.col(column).cast("string"), F.lit(f" {column[:-1]}(s)")), F.lit(f"no {column} found"))
    for name in SYSTEMS:
        out[f"system {name}"] = says(F.col(f"`{name}`"), F.lit("system elements present in model"), F.lit("no MEP elements of this type found in model"))
    named = F.create_map(*[x for k, v in out.items() for x in (F.lit(k), v)])
    return facts.crossJoin(F.broadcast(model)).withColumn("evidence", named).select(*facts.columns, "evidence")  # model is one row


def check(facts: DataFrame, requirements: DataFrame, model: DataFrame, ruled: DataFrame | None = None) -> DataFrame:
    """space_type, predicate, object, space, outcome, detail of every space against the requirements (entity, predicate, object, confidence) of its usage.

    ruled, by default rules(), is a table (object, fact, priority): the fact of least priority decides PASS or FAIL; one
    that cannot be told, and an object without a rule, is UNCHECKED. Where all spaces of a usage agree there is one row
    without a space.
    """
    ruled = rules(facts.sparkSession) if ruled is None else ruled
    one = ruled.groupBy("object").agg(F.min_by("fact", F.struct("priority", "fact")).alias("fact"))
    entity = F.create_map(*[F.lit(x) for kv in USAGES.items() for x in kv])
    known = evidence(facts, model).withColumn("entity", F.try_element_at(entity, F.col("usage"))).where("entity is not null")
    rows = known.join(requirements, "entity").join(one, "object", "left").withColumn("said", F.try_element_at("evidence", F.col("fact")))
    outcome = F.when(F.col("said.holds"), "PASS").when(~F.col("said.holds"), "FAIL").otherwise("UNCHECKED")
    detail = F.when(F.col("said.holds"), F.col("said.yes")).otherwise(F.coalesce(F.col("said.no"), F.concat(F.lit("no check implemented for '"), "object", F.lit("'"))))
    rows = rows.select(F.col("usage").alias("space_type"), "predicate", "object", "confidence", "space", outcome.alias("outcome"), detail.alias("detail"))
    key = ["space_type", "predicate", "object", "confidence"]
    groups = rows.groupBy(key).agg(F.min("outcome").alias("one"), F.max("outcome").alias("other"), F.min_by("detail", "space").alias("said"))
    agreed = groups.where("one = other").select(*key, F.lit(None).cast("string").alias("space"), F.col("one").alias("outcome"), F.col("said").alias("detail"))
    apart = rows.join(groups.where("one <> other").select(key), key, "left_semi").select(*key, F.col("space").cast("string").alias("space"), "outcome", "detail")
    return agreed.unionByName(apart)


def totals(checks: DataFrame) -> DataFrame:
    return checks.groupBy("outcome").agg(F.count("*").alias("n"))


def failures(checks: DataFrame) -> DataFrame:
    """What failed, once for each object and detail: the first by space type and space."""
    order = F.struct("space_type", "predicate", F.coalesce("space", F.lit("")))
    return checks.where("outcome = 'FAIL'").groupBy("object", "detail").agg(F.min(order).alias("x")).select("x.space_type", "x.predicate", "object", "detail")


def names_of(rows: DataFrame, column: str) -> DataFrame:
    """rows with a JSON list column decoded, for text()."""
    return rows.withColumn(column, decode_list(F.col(column)))


__all__ = ["Service", "assertion_query", "by_repository", "check", "evidence", "failures", "model_facts", "names_of", "rules", "sequence_text", "space_facts", "text", "totals", "usage"]
