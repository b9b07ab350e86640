"""Queries of knowledge tools, extraction passes, curation and snapshots on the projected tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.scalars import CORE_PREDICATES, DECREASE_WORDS, INCREASE_WORDS, decode_list, direction_named
from loomgraph.operators import curation, integrity, knowledge, normalise, passes, reports
from loomgraph.plans.catalogue import JOINS, NAMED, RANK, RESOLVED, query
from loomgraph.plans.graph_queries import LIST, LIVE
from loomgraph.sources import snapshot


@query(f"SELECT subject_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, {RANK}, id)::INTEGER AS rank FROM kg_constraints WHERE confidence >= 0.6 AND status <> 'proposed' AND subject_id IN (SELECT id FROM kg_entities WHERE status <> 'merged')) WHERE rank <= 5")
def oQ4_constraints(t):
    return knowledge.constraints(t.kg_constraints, t.kg_entities, t.kg_entities.where("status <> 'merged'"), 5, 0.6).select("subject_id", "id", "rank")


@query(f"SELECT subject_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, {RANK}, id)::INTEGER AS rank FROM kg_antipatterns WHERE subject_id IN (SELECT id FROM kg_entities WHERE status <> 'merged')) WHERE rank <= 20")
def oQ5_failure_modes(t):
    return knowledge.constraints(t.kg_antipatterns, t.kg_entities, t.kg_entities.where("status <> 'merged'"), 20, 0.0, True).select("subject_id", "id", "rank")


@query(f"WITH f AS (SELECT id, unnest({LIST.format('force_ids')}) AS force, generate_subscripts({LIST.format('force_ids')}, 1) AS pos FROM kg_patterns) SELECT f.id, string_agg(coalesce(k.name, f.force), '|' ORDER BY pos) AS forces FROM f LEFT JOIN kg_forces k ON k.id = f.force GROUP BY f.id")
def oQ6_pattern_forces(t):
    rows = t.kg_patterns.withColumns({c: decode_list(F.col(c)) for c in ("force_ids", "force_descriptions")})
    return knowledge.pattern_forces(rows, t.kg_forces).select("id", F.array_join("forces", "|").alias("forces"))


@query(f"SELECT entity_id, id, name, direction, rank FROM (SELECT e AS entity_id, *, row_number() OVER (PARTITION BY e ORDER BY confidence DESC, {RANK}, id)::INTEGER AS rank FROM (SELECT *, unnest({LIST.format('affects')}) AS e FROM kg_forces WHERE confidence >= 0.5 AND status <> 'proposed') WHERE e IN (SELECT id FROM kg_entities)) WHERE rank <= 20")
def oQ7_acting_forces(t):
    return knowledge.acting_forces(t.kg_forces.withColumn("affects", decode_list(F.col("affects"))), t.kg_entities, 20, 0.5)


@query(f"WITH r AS ({RESOLVED}) SELECT 'entity_not_found' AS error, alias AS query FROM (SELECT CASE WHEN seq % 3 = 0 THEN 'no ' || alias ELSE alias END AS alias FROM kg_aliases) q LEFT JOIN r ON r.key = lower(trim(q.alias)) WHERE r.entity_id IS NULL")
def oQ14_not_found(t):
    asked = t.kg_aliases.select(F.when(F.col("seq") % 3 == 0, F.concat(F.lit("no "), "alias")).otherwise(F.col("alias")).alias("name"))
    return knowledge.not_found(asked, t.kg_entities, t.kg_aliases)


@query("SELECT id, subject_id FROM kg_assertions WHERE predicate = 'supports' AND knowledge_origin = 'physical'")
def oQ15_repository(t):
    return reports.by_repository(t.kg_assertions, predicate="supports", origin="physical").select("id", "subject_id")


@query(f"SELECT a.id, '  ' || coalesce(s.name, a.subject_id) || ' —[' || a.predicate || ']→ ' || coalesce(o.name, a.object_id) || chr(10) || '    confidence=' || printf('%.2f', a.confidence) || '  origin=' || a.knowledge_origin || '  status=' || a.status AS text FROM kg_assertions a {JOINS}")
def oQE_text(t):
    return reports.text(knowledge.with_names(t.kg_assertions, t.kg_entities, "subject", "object"), "assertion").select("id", "text")


FORMS = """CASE WHEN {k} LIKE '%ies' AND length({k}) > 4 THEN [left({k}, -3) || 'y'] WHEN {k} LIKE '%ses' AND length({k}) > 4 THEN [left({k}, -2)] WHEN {k} LIKE '%es' AND length({k}) > 4 THEN [left({k}, -1), left({k}, -2)]
WHEN {k} LIKE '%s' AND {k} NOT LIKE '%ss' AND length({k}) > 3 THEN [left({k}, -1)] WHEN {k} LIKE '%y' AND length({k}) > 2 THEN [{k} || 's', left({k}, -1) || 'ies'] ELSE [{k} || 's'] END"""
WORDY = "(SELECT 'P' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN string_split(p_name, ' ')[1] WHEN 1 THEN string_split(p_name, ' ')[1] || 's' ELSE upper(string_split(p_name, ' ')[1]) END AS name, p_partkey AS seq, CASE WHEN p_partkey % 20 = 19 THEN 'merged' ELSE 'proposed' END AS status FROM part)"


@query(f"""WITH e AS {WORDY}, x AS (SELECT id AS entity_id, lower(name) AS key, 0 AS late, seq FROM e WHERE status <> 'merged' UNION ALL SELECT entity_id, lower(alias), 1, a.seq FROM kg_aliases a WHERE entity_id IN (SELECT id FROM e WHERE status <> 'merged')),
l AS (SELECT key, arg_max(entity_id, (late, seq)) AS id FROM x GROUP BY key), f AS (SELECT key, arg_min(entity_id, (late, seq)) AS id FROM (SELECT entity_id, late, seq, unnest({FORMS.format(k='key')}) AS key FROM x) GROUP BY key)
SELECT coalesce(l.key, f.key) AS key, coalesce(l.id, f.id) AS entity_id FROM l FULL JOIN f ON l.key = f.key""")
def oE3a_lookup(t):
    """Parts by the first word of their names, in singular, plural and capitals: exact keys, the last of equals, before forms, the first of them."""
    word = F.element_at(F.split("p_name", " "), 1)
    k = F.col("p_partkey") % 3
    e = t.part.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.when(k == 0, word).when(k == 1, F.concat(word, F.lit("s"))).otherwise(F.upper(word)).alias("name"), F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 20 == 19, "merged").otherwise("proposed").alias("status"), F.lit("component").alias("entity_type"))
    return passes.lookup(e, t.kg_aliases).select("key", "entity_id")


CASES = ["uses", "axes", "pies", "y", "ses", "activities", "processes", "cores", "glass", "gas", "bus", "pile", "activity", "by", "s"]


@query(f"WITH w AS (SELECT unnest({CASES}) AS word) SELECT word, unnest({FORMS.format(k='word')}) AS form FROM w")
def oE3b_short_forms(t):
    from loomgraph.functions.scalars import word_forms

    return t.rows([(w,) for w in CASES], "word string").select("word", F.explode(word_forms(F.col("word"))).alias("form"))


@query("WITH a AS (SELECT 'P' || p_partkey AS id, p_name AS name, p_partkey AS seq FROM part), n AS (SELECT lower(trim(name)) AS key, seq, 0 AS late, name FROM a UNION ALL SELECT lower(trim(p_brand)), p_partkey, 1, p_brand FROM part) SELECT arg_min(name, (late, seq)) AS name, CASE WHEN min(late) = 0 THEN 'component' ELSE 'space' END AS entity_type FROM n WHERE key NOT IN (SELECT lower(trim(p_type)) FROM part) AND key NOT IN (SELECT lower(p_brand) FROM part WHERE p_partkey % 9 = 0) GROUP BY key")
def oE1_discover(t):
    answers = t.part.select(F.col("p_name").alias("name"), F.lit("component").alias("entity_type"), F.col("p_partkey").alias("seq"))
    seeds = t.part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("seq"))
    have = t.part.select(F.col("p_type").alias("name")).unionByName(t.part.where("p_partkey % 9 = 0").select(F.col("p_brand").alias("name")))
    return passes.discover(answers, have, seeds).select("name", "entity_type")


@query("SELECT relation, count(*) AS n, relation = 'near' AS pending FROM (SELECT 'P' || l_partkey AS s, 'S' || l_suppkey AS o, CASE l_linenumber % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'above' ELSE 'contains' END AS relation FROM lineitem WHERE l_suppkey % 5 <> 0) GROUP BY 1")
def oE4_spatial(t):
    k = F.col("l_linenumber") % 3
    answers = t.lineitem.select(F.concat(F.lit("P"), "l_partkey").alias("subject_id"), F.when(k == 0, "near").when(k == 1, "above").otherwise("contains").alias("relation"), F.col("l_suppkey").alias("k"), F.lit(0.5).alias("confidence"), F.lit("m").alias("source_model"))
    answers = answers.join(t.supplier.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 5 == 0, F.lit(" ")).otherwise(F.upper("s_name")).alias("object")), "k")
    rows, pending = passes.spatial(answers, t.kg_entities, passes.lookup(t.kg_entities.where("entity_type = 'system'"), t.kg_aliases.limit(0)))
    known = pending.select(F.col("value").alias("relation"), F.lit(True).alias("pending"))
    return rows.groupBy("relation").agg(F.count("*").alias("n")).join(known, "relation", "left").select("relation", "n", F.coalesce("pending", F.lit(False)).alias("pending"))


@query("""WITH a AS (SELECT 'do ' || event_type AS p, CASE WHEN event_id % 4 = 0 THEN 'do ' || event_type ELSE 'Check ' || (user_id % 7) END AS s, value > 50 AS hard, 'm' || (event_id % 2) AS model, event_id AS seq, CASE WHEN event_id % 10 = 9 THEN ' ' ELSE props END AS why FROM events),
g AS (SELECT lower(p) AS predecessor, lower(s) AS successor, model AS source_model, arg_min(hard, seq) AS hard_constraint, count(*) AS n, count(*) FILTER (WHERE hard) AS h FROM a WHERE trim(why) <> '' AND lower(p) <> lower(s) GROUP BY 1, 2, 3)
SELECT predecessor, successor, source_model, hard_constraint, CASE WHEN hard_constraint THEN n - h ELSE h END AS divergent FROM g""")
def oE5_process(t):
    successor = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("do "), "event_type")).otherwise(F.concat(F.lit("Check "), F.col("user_id") % 7))
    answers = t.events.select(F.concat(F.lit("do "), "event_type").alias("predecessor"), successor.alias("successor"), (F.col("value") > 50).alias("hard_constraint"), F.concat(F.lit("m"), F.col("event_id") % 2).alias("source_model"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 10 == 9, " ").otherwise(F.col("props")).alias("rationale"))
    done = passes.process(answers, t.kg_entities)
    name = done["entities"].select("id", F.lower("name").alias("name"))
    key = ["predecessor_id", "successor_id", "source_model"]
    rows = done["relations"].join(done["divergences"], key, "left")
    rows = rows.join(name.withColumnsRenamed({"id": "predecessor_id", "name": "predecessor"}), "predecessor_id").join(name.withColumnsRenamed({"id": "successor_id", "name": "successor"}), "successor_id")
    return rows.select("predecessor", "successor", "source_model", "hard_constraint", F.coalesce("divergent", F.lit(0)).cast("long").alias("divergent"))


@query("SELECT 'C' || o_custkey AS subject_id, trim(o_orderpriority) AS rule, count(*) AS n FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY 1, 2")
def oE6_constraints(t):
    answers = t.orders.select(F.concat(F.lit("C"), "o_custkey").alias("subject_id"), F.when(F.col("o_orderkey") % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("rule"), F.lit("soft").alias("constraint_type"), F.lit(0.61237).alias("confidence"), F.lit("m").alias("source_model"))
    return passes.constraints(answers).groupBy("subject_id", "rule").agg(F.count("*").alias("n"))


def _words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"SELECT p_partkey, d AS direction, len(list_filter(CASE WHEN d = 'increase' THEN {_words(INCREASE_WORDS)} ELSE {_words(DECREASE_WORDS)} END, lambda w: contains(lower(p_name || ' ' || x), w))) > 0 AS passes FROM (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN 'Smore heat' WHEN 1 THEN 'LESS noise' WHEN 2 THEN 'plain' ELSE 'unlimited' END AS x, unnest(['increase', 'decrease']) AS d FROM part)")
def oE9a_vocabulary(t):
    k = F.col("p_partkey") % 4
    rows = t.part.select("p_partkey", F.concat_ws(" ", "p_name", F.when(k == 0, "Smore heat").when(k == 1, "LESS noise").when(k == 2, "plain").otherwise("unlimited")).alias("name"), F.explode(F.array(F.lit("increase"), F.lit("decrease"))).alias("direction"))
    return rows.select("p_partkey", "direction", direction_named(F.col("name"), F.col("direction")).alias("passes"))


@query("""WITH a AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Increased ' WHEN 1 THEN 'Plain ' ELSE 'More ' END || p_type AS name, p_partkey % 2 = 0 AS up, p_name || ' ' || p_partkey AS own FROM part),
o AS (SELECT * FROM a WHERE CASE WHEN up THEN contains(lower(name), 'increased') OR contains(lower(name), 'more') OR contains(lower(name), 'improved') ELSE false END)
SELECT o.name, CASE WHEN k.id IS NULL THEN 'N1' ELSE k.id || '|N1' END AS affects, 1 + CASE WHEN k.id IS NULL THEN 1 ELSE 0 END AS pending FROM o LEFT JOIN kg_entities k ON k.id = 'P' || p_partkey AND k.status <> 'merged'""")
def oE9_forces(t):
    k, own = F.col("p_partkey") % 3, F.concat_ws(" ", "p_name", "p_partkey")
    first = t.nation.where("n_nationkey = 1").select(F.col("n_name").alias("nation"))
    answers = t.part.crossJoin(first).select(  # one row
        F.concat(F.lit("S"), F.lit(1)).alias("subject_id"), F.concat(F.when(k == 0, "Increased ").when(k == 1, "Plain ").otherwise("More "), "p_type").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "increase").otherwise("decrease").alias("direction"),
        F.array(own, F.lit(" "), F.lit("nobody at all"), F.concat(F.lit(" "), F.upper("nation"))).alias("affects"), F.lit(0.5).alias("confidence"), F.lit("m").alias("source_model"), F.col("p_partkey").alias("seq"))
    done = passes.forces(answers, t.kg_entities, passes.lookup(t.kg_entities, t.kg_aliases.limit(0)))
    pending = done["pending_entities"].groupBy(F.col("source_force_id").alias("id")).agg(F.count("*").cast("int").alias("pending"))
    return done["forces"].join(pending, "id").select("name", F.array_join("affects", "|").alias("affects"), "pending")


@query(f"""WITH n AS (SELECT a.*, coalesce(s.name, subject_id) AS sn, coalesce(o.name, object_id) AS obn, CASE WHEN applicability LIKE '[%' THEN {LIST.format('applicability')} ELSE [] END AS ap, row_number() OVER (PARTITION BY subject_id ORDER BY run, a.id) AS nth FROM kg_assertions a LEFT JOIN kg_entities s ON s.id = subject_id LEFT JOIN kg_entities o ON o.id = object_id WHERE a.status IN ('accepted', 'proposed'))
SELECT subject_id, ((nth - 1) // 20)::INTEGER AS batch, count(*) AS n, sha256(string_agg('[' || id || '] ' || sn || ' ' || predicate || ' ' || obn || CASE WHEN len(ap) > 0 THEN chr(10) || '  applicability: ' || array_to_string(ap, '; ') ELSE '' END, chr(10) || chr(10) ORDER BY nth)) AS text_sha256 FROM n GROUP BY 1, 2""")
def oE11_prompts(t):
    none = F.array().cast("array<string>")
    rows = knowledge.with_names(t.kg_assertions, t.kg_entities, "subject", "object").withColumns({"applicability": decode_list(F.col("applicability")), "conditions": none, "exceptions": none, "seq": F.col("run")})
    return passes.prompts(rows).select("subject_id", "batch", "n", F.sha2("text", 256).alias("text_sha256"))


@query("""WITH u AS (SELECT 'U' || user_id AS item_id, event_type AS finding_type, props AS detail, arg_min(value, event_id) AS confidence, min(event_id) AS seq FROM events GROUP BY 1, 2, 3),
m AS (SELECT 'U' || user_id AS item_id, event_type AS finding_type, count(DISTINCT event_id % 3) AS models FROM events GROUP BY 1, 2)
SELECT u.item_id, u.finding_type, any_value(models) AS models, arg_max(detail, (confidence, -seq)) AS detail, max(confidence) AS confidence, string_agg(detail, ';' ORDER BY seq) AS details, max(confidence) >= 150 AS applied FROM u JOIN m USING (item_id, finding_type) GROUP BY 1, 2""")
def oE11_findings(t):
    rows = t.events.select(F.concat(F.lit("U"), "user_id").alias("item_id"), F.col("event_type").alias("finding_type"), (F.col("event_id") % 3).alias("model"), F.col("value").alias("confidence"), F.col("props").alias("detail"), F.col("event_id").alias("seq"))
    return passes.findings(rows, 150).select("item_id", "finding_type", "models", "detail", "confidence", F.array_join("details", ";").alias("details"), "applied")


@query(f"""WITH r AS ({RESOLVED}), q AS (SELECT s_name AS subject, CASE s_suppkey % 3 WHEN 0 THEN 'feeds' ELSE 'supports' END AS predicate, CASE WHEN s_suppkey % 4 = 0 THEN 'missing' ELSE 'asia' END AS object FROM supplier)
SELECT subject, CASE WHEN predicate = 'feeds' THEN 'unknown_predicate' WHEN b.entity_id IS NULL THEN 'object_not_found' ELSE 'accepted' END AS outcome, CASE WHEN predicate <> 'feeds' AND b.entity_id IS NOT NULL THEN sha256(a.entity_id || '|' || predicate || '|' || b.entity_id || '|human') END AS id FROM q LEFT JOIN r a ON a.key = lower(trim(subject)) LEFT JOIN r b ON b.key = lower(trim(object))""")
def oP12_add(t):
    asked = t.supplier.select(F.col("s_name").alias("subject"), F.when(F.col("s_suppkey") % 3 == 0, "feeds").otherwise("supports").alias("predicate"), F.when(F.col("s_suppkey") % 4 == 0, "missing").otherwise("asia").alias("object"))
    return curation.add(asked, t.kg_entities, t.kg_aliases).select("subject", "outcome", "id")


@query("SELECT id, NOT is_entrance AS is_entrance, CASE WHEN entity_type <> 'space' THEN 'not_a_space' END AS warning FROM kg_entities WHERE seq % 5 = 0 UNION ALL SELECT id, is_entrance, NULL FROM kg_entities WHERE seq % 5 <> 0")
def oP14_entrance(t):
    return curation.set_entrance(t.kg_entities, t.kg_entities.where("seq % 5 = 0").select("id")).select("id", "is_entrance", "warning")


@query("SELECT a.id, coalesce(s.name, subject_id) AS subject FROM kg_assertions a LEFT JOIN kg_entities s ON s.id = subject_id WHERE source_model = 'm2' AND (subject_id IN (SELECT id FROM kg_entities WHERE seq % 10 = 3) OR object_id IN (SELECT id FROM kg_entities WHERE seq % 10 = 3))")
def oP15_ground_truth(t):
    human = t.kg_assertions.withColumn("source_model", F.when(F.col("source_model") == "m2", "human").otherwise(F.col("source_model")))
    return curation.ground_truth(human, t.kg_entities, t.kg_entities.where("seq % 10 = 3")).select("id", "subject")


EXPORTS = {"constraints": "kg_constraints", "patterns": "kg_patterns", "antipatterns": "kg_antipatterns"}


def _store(t):
    return {"entities": t.kg_entities, "forces": t.kg_forces, "assertions": t.kg_assertions} | {k: getattr(t, v) for k, v in EXPORTS.items()}


@query(" UNION ALL ".join(f"SELECT '{k}' AS item_type, r.id, coalesce(e.name, r.subject_id, '') AS subject FROM {v} r LEFT JOIN kg_entities e ON e.id = r.subject_id AND e.status <> 'merged' WHERE r.status IN ('accepted', 'conflicted')" for k, v in (EXPORTS | {"assertions": "kg_assertions"}).items()))
def oS1_all(t):
    out = None
    for name, rows in snapshot.export_all(_store(t), ("accepted", "conflicted")).items():
        if "subject" in rows.columns:
            part = rows.select(F.lit(name).alias("item_type"), "id", "subject")
            out = part if out is None else out.unionByName(part)
    return out


@query("""WITH x AS (SELECT 'constraints' AS item_type, id, subject_id, seq FROM kg_constraints UNION ALL SELECT 'patterns', id, subject_id, seq FROM kg_patterns UNION ALL SELECT 'antipatterns', id, subject_id, seq FROM kg_antipatterns),
y AS (SELECT x.*, subject_id IN (SELECT id FROM kg_entities) AS known, seq % 3 = 0 AS there FROM x) SELECT item_type, count(*) FILTER (WHERE NOT there AND (known OR item_type <> 'constraints')) AS added, count(*) FILTER (WHERE there OR NOT (known OR item_type <> 'constraints')) AS skipped FROM y GROUP BY 1""")
def oS3_all(t):
    """A whole snapshot imported into a store that has every third row; entities are all there, so that names resolve."""
    store = _store(t)
    new = {k: v for k, v in snapshot.export_all(store).items() if k in EXPORTS}
    have = {k: (v.where("seq % 3 = 0") if k in EXPORTS else v) for k, v in store.items()}
    return snapshot.import_all(have, new)[1]


@query(f"WITH q AS (SELECT id, name, unnest(list_distinct({LIST.format('related_pattern_names')})) AS ref FROM kg_patterns), i AS (SELECT lower(trim(name)) AS key, id, seq FROM kg_patterns WHERE status <> 'deprecated'), f AS (SELECT q.id, q.ref, arg_min(i.id, i.seq) AS found FROM q LEFT JOIN i ON i.key = lower(trim(q.ref)) AND i.id <> q.id GROUP BY 1, 2) SELECT id, ref AS name FROM f WHERE found IS NULL")
def oN2_pending(t):
    """Related patterns: no pattern is its own, so what names only itself stays pending."""
    rows = t.kg_patterns.withColumns({"names": decode_list(F.col("related_pattern_names")), "ids": F.array().cast("array<string>")})
    return normalise.fill_references(rows.select("id", "names", "ids"), rows.select("id", "name", "seq", "status"), "names", "ids", others_only=True)[1]


@query("WITH e AS (SELECT lower(name) AS key, arg_max(id, seq) AS id FROM kg_entities WHERE status <> 'merged' GROUP BY 1), p AS (SELECT 'F' || s_suppkey AS f, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE lower(s_name) END AS n FROM supplier) SELECT f AS id, len(from_json(k.affects, '[\"VARCHAR\"]')) + CASE WHEN e.id IS NULL THEN 0 ELSE 1 END AS affected, e.id IS NULL AS pending FROM p JOIN kg_forces k ON k.id = p.f LEFT JOIN e ON e.key = p.n")
def oN3_pending(t):
    pending = t.supplier.select(F.when(F.col("s_suppkey") % 3 == 0, "unknown").otherwise(F.upper("s_name")).alias("entity_name"), F.concat(F.lit("F"), "s_suppkey").alias("source_force_id"))
    forces, rest = normalise.fill_pending_entities(t.kg_forces.withColumn("affects", decode_list(F.col("affects"))), pending, passes.lookup(t.kg_entities, t.kg_aliases.limit(0)))
    left = rest.select(F.col("source_force_id").alias("id"), F.lit(True).alias("pending"))
    return forces.join(left, "id", "left").select("id", F.size("affects").alias("affected"), F.coalesce("pending", F.lit(False)).alias("pending"))


@query("SELECT CASE predicate WHEN 'feeds' THEN 'supports' ELSE predicate END AS predicate, count(*) AS n FROM kg_assertions GROUP BY 1")
def oN5_mapped(t):
    mapped = t.rows([("feeds", "supports"), ("contains", "nonsense")], "predicate string, canonical string")
    return normalise.map_predicates(t.kg_assertions, mapped, CORE_PREDICATES, "llm:fake")[0].groupBy("predicate").agg(F.count("*").alias("n"))


@query(f"WITH l AS (SELECT * FROM kg_assertions WHERE {LIVE}), g AS (SELECT subject_id FROM l GROUP BY 1 HAVING count(*) >= 3), c AS (SELECT subject_id, predicate, count(*) AS n, min(id) AS first, max(id) AS last FROM l WHERE subject_id IN (SELECT subject_id FROM g) GROUP BY 1, 2 HAVING count(*) >= 3) SELECT subject_id, predicate AS cluster, n::INTEGER AS n, first, last FROM c ORDER BY subject_id, cluster LIMIT 400")
def oN6_abstractions(t):
    """Clusters are the predicates of a subject here; the queue has room for 400."""
    rows = t.kg_assertions.select("id", "subject_id", "object_id", "predicate", "status").withColumns({"rationale": F.lit(""), "conditions": F.array().cast("array<string>"), "seq": F.lit(0)})
    made = normalise.abstractions(rows, t.kg_assertions.select("id", F.col("predicate").alias("cluster")).distinct(), 100, 500, entities=t.kg_entities)
    return made.select("subject_id", "cluster", F.size("child_ids").alias("n"), F.array_min("child_ids").alias("first"), F.array_max("child_ids").alias("last"))


@query(f"SELECT 'patterns with force references' AS what, count(*) AS n FROM kg_patterns UNION ALL SELECT 'force references', count(*) FROM kg_patterns UNION ALL SELECT 'pattern references', 2 * count(*) FROM kg_patterns UNION ALL SELECT 'predicates outside the core', count(DISTINCT predicate) FROM kg_assertions WHERE predicate = 'feeds' UNION ALL SELECT 'groups to abstract', count(*) FROM (SELECT 1 FROM kg_assertions WHERE {LIVE} GROUP BY subject_id HAVING count(*) >= 3) UNION ALL SELECT 'rows to abstract', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM kg_assertions WHERE {LIVE} GROUP BY subject_id HAVING count(*) >= 3)")
def oR5_todo(t):
    rows = t.kg_patterns.withColumns({c: decode_list(F.col(c)) for c in ("force_descriptions", "related_pattern_names")})
    return normalise.todo(rows, t.kg_assertions, CORE_PREDICATES)


@query("SELECT 'force' AS item_type, id, CASE WHEN status = 'conflicted' OR direction = 'increase' OR direction = 'decrease' THEN 'confidence' END AS broken FROM kg_forces WHERE confidence > 1 UNION ALL SELECT 'process_relation', id, 'rationale' FROM kg_process")
def oR4_validators(t):
    force = integrity.invalid_rows(t.kg_forces, integrity.validators("force")).select(F.lit("force").alias("item_type"), "id", "broken")
    rows = t.kg_process.withColumns({"confidence": F.lit(0.8), "knowledge_origin": F.lit("engineering"), "rationale": F.lit(" ")})
    return force.unionByName(integrity.invalid_rows(rows, integrity.validators("process_relation")).select(F.lit("process_relation").alias("item_type"), "id", "broken"))


@query("WITH c AS (SELECT lang AS model, source AS entity_name, sha256(text) AS prompt_hash, doc_id AS cached_at FROM documents) SELECT model, entity_name, prompt_hash, cached_at FROM c WHERE model = 'en' AND cached_at >= 50 ORDER BY cached_at DESC, prompt_hash LIMIT 20")
def oX9_list(t):
    cache = t.documents.select(F.col("lang").alias("model"), F.col("source").alias("entity_name"), F.sha2("text", 256).alias("prompt_hash"), F.col("doc_id").alias("cached_at"))
    return integrity.cache_rows(cache, "en", since=50)


@query("SELECT lang AS model, count(*) AS n FROM documents WHERE NOT (lang = 'en' AND doc_id < 100) OR lang IS NULL GROUP BY 1")
def oX9_clear(t):
    cache = t.documents.select(F.col("lang").alias("model"), F.col("source").alias("entity_name"), F.col("doc_id").alias("cached_at"))
    return integrity.clear_cache(cache, "en", before=100).groupBy("model").agg(F.count("*").alias("n"))
