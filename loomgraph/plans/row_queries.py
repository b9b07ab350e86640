"""Rows, where other queries compare counts of them, and queries of operators that had tests only."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.scalars import CORE_PREDICATES, assertion_text, constraint_text, decode_list, pattern_text
from loomgraph.operators import conflicts, curation, graph, integrity, jobs, lifecycle, normalise, passes, reports
from loomgraph.plans.catalogue import query
from loomgraph.plans.graph_queries import BUILT, ELECTED, GROUPED, LIST, SAID, _built, _classified, _merged
from loomgraph.sources import snapshot


@query(f"WITH {BUILT} SELECT id, coalesce(node_type, 'bare') AS node_type FROM nodes")
def oG1_node_rows(t):
    return _built(t)[0].select("id", F.coalesce("node_type", F.lit("bare")).alias("node_type"))


@query(f"WITH {BUILT} SELECT src, dst, edge_type, phase FROM edges")
def oG1_edge_rows(t):
    return _built(t)[1].select("src", "dst", "edge_type", "phase")


@query(f"WITH {BUILT} SELECT src, dst, arg_max(CASE phase WHEN 1 THEN 'assertion' WHEN 7 THEN 'spatial' ELSE 'structural' END, phase) AS edge_category, count(*) FILTER (WHERE phase = 6) > 0 AS with_constraint, count(*) AS n FROM edges GROUP BY 1, 2")
def oG1_attribute_rows(t):
    return graph.collapse_all(_built(t)[1]).select("src", "dst", "edge_category", F.col("hard_constraint").isNotNull().alias("with_constraint"), "n")


@query(f"WITH {SAID} SELECT a AS item_a_id, b AS item_b_id, classification FROM p")
def oN11_pair_rows(t):
    return _classified(t)["pairs"].select("item_a_id", "item_b_id", "classification")


@query(f"WITH {GROUPED} SELECT id, CASE WHEN id IN (SELECT id FROM d) THEN 'conflicted' ELSE status END AS status FROM kg_process")
def oN13_status_rows(t):
    return conflicts.divergence(t.kg_process)["items"].select("id", "status")


@query(f"WITH {ELECTED} SELECT k.id, CASE WHEN e.id <> e.canonical THEN 'merged' ELSE k.status END AS status FROM kg_entities k LEFT JOIN e ON e.id = k.id")
def oV6_entity_rows(t):
    return _merged(t)["entities"].select("id", "status")


@query("SELECT 'assertions' AS item_type, id, CASE WHEN source_model = 'm1' THEN 'deprecated' ELSE status END AS status FROM kg_assertions UNION ALL SELECT 'process', id, CASE WHEN source_model = 'm1' THEN 'deprecated' ELSE status END FROM kg_process")
def oP6_status_rows(t):
    tables, _ = lifecycle.purge_tables({"assertions": t.kg_assertions, "process": t.kg_process}, "m1", "source_model")
    return tables["assertions"].select(F.lit("assertions").alias("item_type"), "id", "status").unionByName(tables["process"].select(F.lit("process").alias("item_type"), "id", "status"))


@query("SELECT id, CASE predicate WHEN 'feeds' THEN 'supports' ELSE predicate END AS predicate FROM kg_assertions")
def oN5_rows(t):
    mapped = t.rows([("feeds", "supports"), ("contains", "nonsense")], "predicate string, canonical string")
    return normalise.map_predicates(t.kg_assertions, mapped, CORE_PREDICATES, "llm:fake")[0].select("id", "predicate")


@query("SELECT doc_id, lang AS model, source AS entity_name FROM documents WHERE NOT coalesce(lang = 'en' AND doc_id < 100, false)")
def oX9_kept_rows(t):
    cache = t.documents.select("doc_id", F.col("lang").alias("model"), F.col("source").alias("entity_name"), F.col("doc_id").alias("cached_at"))
    return integrity.clear_cache(cache, "en", before=100).select("doc_id", "model", "entity_name")


@query("WITH m AS (SELECT 'P' || p_partkey AS loser, 'P' || (p_partkey - 1) AS winner FROM part WHERE p_partkey % 5 = 0), f AS (SELECT m.* FROM m JOIN kg_entities w ON w.id = winner JOIN kg_entities l ON l.id = loser) SELECT id, CASE WHEN id IN (SELECT loser FROM f) THEN 'merged' ELSE status END AS status FROM kg_entities")
def oP13_merge(t):
    return curation.merge_names(t.kg_entities, t.kg_aliases, _losers(t))[0].select("id", "status")


@query("WITH m AS (SELECT 'P' || p_partkey AS loser, 'P' || (p_partkey - 1) AS winner FROM part WHERE p_partkey % 5 = 0) SELECT entity_id, alias FROM kg_aliases UNION ALL SELECT winner, l.name FROM m JOIN kg_entities w ON w.id = winner JOIN kg_entities l ON l.id = loser")
def oP13_aliases(t):
    return curation.merge_names(t.kg_entities, t.kg_aliases, _losers(t))[1].select("entity_id", "alias")


def _losers(t):
    return t.part.where("p_partkey % 5 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("loser"), F.concat(F.lit("P"), F.col("p_partkey") - 1).alias("winner"))


@query("SELECT a.id AS item_id, a.source_model AS reviewer FROM kg_assertions a WHERE a.status = 'accepted' AND a.id IN (SELECT id FROM kg_assertions WHERE predicate = 'requires')")
def oP8_decisions(t):
    decisions = t.kg_assertions.where("status = 'accepted'").select(F.col("id").alias("item_id"), F.col("source_model").alias("reviewer"))
    return lifecycle.decisions_for(decisions, t.kg_assertions.where("predicate = 'requires'"))


@query("SELECT DISTINCT item_a_id, item_b_id FROM (SELECT vec_id AS item_a_id, vec_id + j AS item_b_id FROM (SELECT vec_id, unnest([1, 3]) AS j FROM embeddings)) WHERE item_a_id IN (SELECT vec_id FROM embeddings WHERE label = 2) OR item_b_id IN (SELECT vec_id FROM embeddings WHERE label = 2)")
def oR3_pairs(t):
    pairs = t.embeddings.select(F.col("vec_id").alias("item_a_id"), F.explode(F.array(F.lit(1), F.lit(3))).alias("j")).select("item_a_id", (F.col("item_a_id") + F.col("j")).alias("item_b_id"))
    return lifecycle.pairs_for(pairs, t.embeddings.where("label = 2").select(F.col("vec_id").alias("id")))


@query(f"WITH c AS (SELECT id, statement, unnest({LIST.format('child_ids')}) AS child FROM kg_abstractions) SELECT DISTINCT id, statement FROM c WHERE child IN (SELECT id FROM kg_antipatterns)")
def oN9_parents(t):
    nodes = t.kg_abstractions.withColumn("child_ids", decode_list(F.col("child_ids")))
    return normalise.parents(nodes, t.kg_antipatterns.select("id")).select("id", "statement")


@query("SELECT id FROM kg_abstractions WHERE status = 'proposed'")
def oN9_proposed(t):
    return normalise.proposed(t.kg_abstractions).select("id")


@query("SELECT label AS model, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY 1")
def oX6_foreign(t):
    return integrity.foreign_vectors(t.embeddings.withColumnRenamed("label", "model"), 3)


@query("""WITH i AS (SELECT id, status FROM kg_constraints), p AS (SELECT 'K' || o_orderkey AS item_a_id, 'K' || (o_orderkey + 2) AS item_b_id FROM orders WHERE o_orderkey % 3 = 0),
n AS (SELECT item_a_id AS id FROM p UNION SELECT item_b_id FROM p) SELECT id, CASE WHEN status = 'conflicted' AND id NOT IN (SELECT id FROM n) THEN 'proposed' ELSE status END AS status FROM i""")
def oX_repaired(t):
    pairs = t.orders.where("o_orderkey % 3 = 0").select(F.concat(F.lit("K"), "o_orderkey").alias("item_a_id"), F.concat(F.lit("K"), F.col("o_orderkey") + 2).alias("item_b_id"))
    return integrity.repair(t.kg_constraints.select("id", "status"), pairs)[0]


@query("SELECT sha256('antipattern|P' || p_partkey || '|' || trim(p_name) || '|m') AS id, trim(p_name) AS name, 'P' || p_partkey AS subject_id, 'proposed' AS status FROM part WHERE p_partkey % 4 <> 0")
def oE7_antipatterns(t):
    answers = t.part.select(F.concat(F.lit("P"), "p_partkey").alias("subject_id"), F.when(F.col("p_partkey") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), F.lit(0.61235).alias("confidence"), F.lit("m").alias("source_model"))
    return passes.antipatterns(answers).select("id", "name", "subject_id", "status")


@query("SELECT sha256('pattern|' || k.id || '|' || p_name || '|m') AS id, k.id AS subject_id, p_name AS name, p_type AS problem, p_brand AS solution FROM part JOIN kg_entities k ON k.id = CASE WHEN p_partkey % 3 = 0 THEN 'C' ELSE 'P' END || p_partkey WHERE k.entity_type IN ('component', 'space', 'system') AND p_partkey % 7 <> 0")
def oE8_patterns(t):
    kind = F.when(F.col("p_partkey") % 3 == 0, "C").otherwise("P")
    answers = t.part.select(F.concat(kind, "p_partkey").alias("subject_id"), F.concat("p_name", F.lit(" ")).alias("name"), F.col("p_type").alias("problem"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_brand")).alias("solution"), F.lit(0.5).alias("confidence"), F.lit("m").alias("source_model"))
    return passes.patterns(answers, t.kg_entities).select("id", "subject_id", "name", "problem", "solution")


@query("SELECT id AS entity_id FROM kg_entities WHERE id NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_partkey % 2 = 0)")
def oER_outstanding(t):
    units = t.kg_entities.select(F.col("id").alias("entity_id"))
    start = t.rows([], "pass_number string, entity_id string, model string, status string")
    half = t.part.where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"))
    progress = passes.completed(passes.completed(start, half, "3", "m"), half, "3", "m")  # done twice, marked once
    progress = passes.completed(progress, units, "4", "m").unionByName(passes.completed(start, units, "3", "other"))
    return passes.outstanding(units, progress, "3", "m")


@query("WITH m AS (SELECT 'Ifc' || p_brand AS name, p_partkey AS seq FROM part WHERE p_partkey % 2 = 0) SELECT name, min(seq) AS seq, 'ifc_class' AS entity_type FROM m GROUP BY 1")
def oE12_schema(t):
    mentions = t.part.select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "Ifc").otherwise("Not"), "p_brand").alias("name"), F.col("p_type").alias("description"), F.col("p_partkey").alias("seq"))
    return passes.schema_classes(mentions, t.kg_entities)[1].select("name", "seq", "entity_type")


@query("SELECT 'assertion' AS kind, id, concat_ws(' | ', predicate, nullif(status, 'accepted')) AS text FROM kg_assertions UNION ALL SELECT 'constraint', id, constraint_type || ': ' || rule FROM kg_constraints UNION ALL SELECT 'pattern', id, name || ': ' || left(problem, 120) FROM kg_patterns")
def oN10_texts(t):
    a = t.kg_assertions.select(F.lit("assertion").alias("kind"), "id", assertion_text(F.col("predicate"), F.when(F.col("status") == "accepted", "").otherwise(F.col("status"))).alias("text"))
    c = t.kg_constraints.select(F.lit("constraint").alias("kind"), "id", constraint_text(F.col("constraint_type"), F.col("rule")).alias("text"))
    return a.unionByName(c).unionByName(t.kg_patterns.select(F.lit("pattern").alias("kind"), "id", pattern_text(F.col("name"), F.col("problem")).alias("text")))


@query("""WITH n AS (SELECT DISTINCT p_type AS name FROM part), e AS (SELECT name FROM kg_patterns) SELECT name, status FROM kg_patterns UNION ALL SELECT name, 'accepted' FROM n WHERE name NOT IN (SELECT name FROM e)""")
def oS8_patterns(t):
    new = t.part.groupBy(F.col("p_type").alias("name")).agg(F.lit("*").alias("confidence"), F.lit("").alias("section"), F.min("p_brand").alias("problem"), F.min("p_brand").alias("solution")).withColumn("related_pattern_names", F.array(F.lit("x")))
    have = t.kg_patterns.select("id", "name", F.array(F.lit("c")).alias("context"), "problem", "solution", F.array(F.lit("x")).alias("related_pattern_names"), "confidence", "status", "knowledge_origin", "source_model")
    return curation.import_patterns(have, new)[0].select("name", "status")


@query("""WITH a AS (SELECT entity_id, alias FROM kg_aliases), n AS (SELECT DISTINCT 'P' || p_partkey AS entity_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' ' || p_partkey ELSE p_type END AS alias FROM part WHERE p_partkey % 9 <> 0)
SELECT * FROM a UNION ALL SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.entity_id = n.entity_id AND lower(trim(a.alias)) = lower(trim(n.alias)))""")
def oR2_aliases(t):
    alias = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.concat("p_brand", F.lit(" "), "p_partkey"))).otherwise(F.col("p_type"))
    new = t.part.select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"), F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(alias).alias("alias"), F.col("p_partkey").alias("seq"))
    return curation.add_aliases(t.kg_aliases.select("entity_id", "alias", "seq"), new).select("entity_id", "alias")


SPACES = """s AS (SELECT 'N' || n_nationkey AS space, ['kitchen', 'living', 'circulation', 'toilet', 'stair', 'retail', 'attic'][1 + n_nationkey % 7] AS space_type FROM nation),
b AS (SELECT 'N' || s_nationkey AS space, s_suppkey AS k, ['IfcCovering', 'IfcWindow', 'IfcDoor', 'IfcWall', 'IfcFan'][1 + s_suppkey % 5] AS ifc_class, ['Tiles', 'carpet', 'wool insulation', 'vinyl', 'wood'][1 + (s_suppkey // 5) % 5] AS material FROM supplier),
f AS (SELECT s.space, s.space_type, coalesce(list(DISTINCT lower(material)) FILTER (ifc_class = 'IfcCovering'), []) AS floor, count(*) FILTER (ifc_class = 'IfcWindow') AS windows, count(*) FILTER (ifc_class = 'IfcDoor') AS doors FROM s LEFT JOIN b ON b.space = s.space GROUP BY 1, 2),
o AS (SELECT unnest(['Flooring', 'Anti-slip Flooring', 'Waterproof Flooring', 'Windows', 'Entrance Door', 'Ventilation System', 'Foundation', 'Insulation', 'Ceiling', 'Skylight']) AS object),
x AS (SELECT space, space_type, object, CASE object WHEN 'Flooring' THEN len(floor) > 0 WHEN 'Anti-slip Flooring' THEN list_has_any(floor, ['tiles', 'concrete', 'stone', 'vinyl', 'screed', 'terrazzo', 'ceramic', 'epoxy', 'resin', 'linoleum']) WHEN 'Waterproof Flooring' THEN list_has_any(floor, ['tiles', 'concrete', 'stone', 'vinyl', 'ceramic', 'epoxy', 'resin', 'membrane', 'linoleum'])
  WHEN 'Windows' THEN windows > 0 WHEN 'Entrance Door' THEN doors > 0 WHEN 'Ventilation System' THEN (SELECT count(*) FROM b WHERE ifc_class = 'IfcFan') > 0 WHEN 'Foundation' THEN false WHEN 'Insulation' THEN (SELECT count(*) FROM b WHERE ifc_class = 'IfcWall' AND contains(lower(material), 'insulation')) > 0 END AS holds FROM f, o WHERE space_type <> 'attic'),
y AS (SELECT space, space_type, object, CASE WHEN holds THEN 'PASS' WHEN NOT holds THEN 'FAIL' ELSE 'UNCHECKED' END AS outcome FROM x),
g AS (SELECT space_type, object, min(outcome) AS outcome FROM y GROUP BY 1, 2 HAVING min(outcome) = max(outcome))"""


@query(f"WITH {SPACES} SELECT space_type, object, NULL AS space, outcome FROM g UNION ALL SELECT space_type, object, space, outcome FROM y WHERE (space_type, object) NOT IN (SELECT space_type, object FROM g)")
def oX8_report(t):
    """Nations as spaces, suppliers as what bounds them, against ten requirements of each usage that is known."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    spaces = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("space"), F.concat(pick(["Kitchen", "LIVING", "circulation", "toilet", "stair", "retail", "attic"], F.col("n_nationkey") % 7), F.lit("-x")).alias("usage"), F.col("n_name").alias("name"))
    seen = t.supplier.select(F.concat(F.lit("N"), "s_nationkey").alias("space"), F.col("s_suppkey").alias("element"), pick(["IfcCovering", "IfcWindow", "IfcDoor", "IfcWall", "IfcFan"], F.col("s_suppkey") % 5).alias("ifc_class"), pick(["Tiles", "carpet", "wool insulation", "vinyl", "wood"], F.expr("s_suppkey div 5 % 5")).alias("material"))
    layers = seen.select("element", "material")
    objects = ["Flooring", "Anti-slip Flooring", "Waterproof Flooring", "Windows", "Entrance Door", "Ventilation System", "Foundation", "Insulation", "Ceiling", "Skylight"]
    asked = t.rows([(entity, "requires", o, 0.9) for entity in reports.USAGES.values() for o in objects], "entity string, predicate string, object string, confidence double")
    rows = reports.check(reports.space_facts(spaces, seen.drop("material"), layers), asked, reports.model_facts(seen.select("element", "ifc_class"), layers))
    return rows.select("space_type", "object", "space", "outcome")


@query(f"""WITH l AS (SELECT DISTINCT a.id, subject_id, predicate, coalesce(s.name, subject_id) AS subject, coalesce(o.name, object_id) AS object, CAST(substr(object_id, 2) AS BIGINT) % 10 AS v FROM kg_assertions a LEFT JOIN kg_entities s ON s.id = subject_id LEFT JOIN kg_entities o ON o.id = object_id WHERE a.status IN ('accepted', 'proposed')),
g AS (SELECT subject_id, v, min(id) AS cluster, list(id ORDER BY id) AS ids, string_agg('  ' || nth || '. ' || subject || ' ' || predicate || ' ' || object, chr(10) ORDER BY id) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, v ORDER BY id) AS nth FROM l) GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT subject_id, cluster, array_to_string(ids, ',') AS children, prompt FROM g""")
def oN18_compress(t):
    """A dry run over all subjects: assertions whose objects share a vector are near, others are not."""
    vectors = t.embeddings.groupBy(F.col("label").cast("long").alias("v")).agg(F.min_by("embedding", "vec_id").alias("vector"))  # one for each label
    v = (F.substring("object_id", 2, 20).cast("long") % 10).alias("v")
    rows = t.kg_assertions.select("id", "subject_id", "object_id", "predicate", "status", v).withColumns({"rationale": F.lit(""), "conditions": F.array().cast("array<string>"), "seq": F.lit(0)})
    made = jobs.compress(rows, vectors, lambda made: made, dry=True, cap=None, entities=t.kg_entities, by="v")
    return made.select("subject_id", "cluster", F.array_join("child_ids", ",").alias("children"), "prompt")


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(12)), chr(12))) AS piece, unnest(generate_series(0, len(string_split(replace(text, chr(10), chr(12)), chr(12))) - 1)) AS page FROM documents),
e AS (SELECT doc_id, max(page) AS last_page FROM p GROUP BY 1)
SELECT doc_id, doc_id || '_p' || (page // 5 * 5 + 1) || '-' || least(page // 5 * 5 + 5, last_page + 1) AS chunk_id, (page // 5 * 5 + 1)::INTEGER AS first, least(page // 5 * 5 + 5, last_page + 1)::INTEGER AS last, sha256(string_agg(piece, chr(10) ORDER BY page)) AS text_sha256
FROM p JOIN e USING (doc_id) WHERE trim(regexp_replace(piece, '\s+', ' ', 'g')) <> '' GROUP BY doc_id, page // 5, last_page""")
def oS9_chunks(t):
    """Lines as pages, five to a chunk; blank ones are left out, their numbers count."""
    docs = t.documents.select("doc_id", F.translate("text", "\n", "\f").alias("text"))
    return snapshot.page_chunks(docs).select("doc_id", "chunk_id", "first", "last", F.sha2("text", 256).alias("text_sha256"))


KINDS = {"click": "exception", "view": "context_limitation", "purchase": "potential_error", "error": "scope_restriction"}


@query("""WITH f AS (SELECT 'U' || user_id AS id, CASE event_type WHEN 'click' THEN 'exception' WHEN 'view' THEN 'context_limitation' WHEN 'purchase' THEN 'potential_error' WHEN 'error' THEN 'scope_restriction' ELSE 'other' END AS kind, event_id % 3 AS model, value, props, event_id FROM events),
d AS (SELECT id, kind, props, arg_min(value, event_id) AS value FROM f GROUP BY 1, 2, 3), n AS (SELECT id, kind, count(DISTINCT model) AS models FROM f GROUP BY 1, 2),
m AS (SELECT id, kind, any_value(models) AS models, max(value) AS best, count(*) AS details FROM d JOIN n USING (id, kind) GROUP BY 1, 2), u AS (SELECT DISTINCT 'U' || user_id AS id, user_id FROM events WHERE user_id % 4 <> 0)
SELECT id, CASE WHEN id IN (SELECT id FROM m WHERE kind = 'potential_error' AND models >= 2 AND best >= 100) THEN 'conflicted' ELSE 'accepted' END AS status,
  1 + coalesce((SELECT details FROM m WHERE m.id = u.id AND kind = 'exception' AND best >= 100), 0)::INTEGER AS exceptions, coalesce((SELECT details FROM m WHERE m.id = u.id AND kind = 'context_limitation' AND best >= 100), 0)::INTEGER AS applicability FROM u""")
def oE11_applied(t):
    """Users as statements, three of four there; what events say of them as findings."""
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in KINDS.items()], F.lit("other"))
    found = t.events.select(F.concat(F.lit("U"), "user_id").alias("item_id"), kind.alias("finding_type"), (F.col("event_id") % 3).alias("model"), F.col("value").alias("confidence"), F.col("props").alias("detail"), F.col("event_id").alias("seq"))
    rows = t.events.where("user_id % 4 <> 0").select(F.concat(F.lit("U"), "user_id").alias("id")).distinct().withColumns({"status": F.lit("accepted"), "exceptions": F.array(F.lit("before")), "applicability": F.array().cast("array<string>")})
    done = passes.apply_findings(rows, passes.findings(found, 100))["assertions"]
    return done.select("id", "status", F.size("exceptions").alias("exceptions"), F.size("applicability").alias("applicability"))
