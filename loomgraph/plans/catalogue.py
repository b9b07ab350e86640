"""One query per operator on the projected tables, and the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import decode_list, has_any_word, in_context, review_threshold, word_forms
from loomgraph.operators import clustering, graph, integrity, knowledge, lifecycle, normalise
from loomgraph.plans.projection import table, view, with_views
from loomgraph.session import Scratch, shared_dir
from loomgraph.sources import snapshot, store
from loomgraph.streaming import arrivals, transitions

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder: projected views by kg_ name, others as they are."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name) if name.startswith("kg_") else table(self.spark, self.sf_dir, name)

    def rows(self, data: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(data, schema)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


RANK = "CASE knowledge_origin WHEN 'physical' THEN 0 WHEN 'engineering' THEN 1 WHEN 'architectural' THEN 2 WHEN 'cultural' THEN 3 ELSE 99 END"
NAMED = "coalesce(s.name, a.subject_id) AS subject, a.predicate, coalesce(o.name, a.object_id) AS object"
JOINS = "LEFT JOIN kg_entities s ON s.id = a.subject_id LEFT JOIN kg_entities o ON o.id = a.object_id"
ASKED = ["Supplier#000000001", " supplier#000000002 ", "AFRICA", "brand#11 7", "Brand#13 3", "nobody", "Customer#000000009", "ASIA"]
RESOLVED = """
SELECT key, arg_min(entity_id, prio * 10000000000000 + seq) AS entity_id FROM (
  SELECT lower(trim(name)) AS key, id AS entity_id, 0 AS prio, seq FROM kg_entities WHERE status <> 'merged'
  UNION ALL SELECT lower(alias), entity_id, 1, a.seq FROM kg_aliases a WHERE entity_id IN (SELECT id FROM kg_entities WHERE status <> 'merged')) u GROUP BY key"""


@query(f"WITH r AS ({RESOLVED}) SELECT name, entity_id FROM (SELECT unnest({ASKED}) AS name) q LEFT JOIN r ON r.key = lower(trim(q.name))")
def oQ1_resolve(t):
    return knowledge.resolve(t.rows([(x,) for x in ASKED], "name string"), t.kg_entities, t.kg_aliases)


@query(f"WITH r AS ({RESOLVED}) SELECT alias, r.entity_id FROM kg_aliases q LEFT JOIN r ON r.key = lower(trim(q.alias))")
def oQ1_resolve_all(t):
    return knowledge.resolve(t.kg_aliases.select("alias"), t.kg_entities, t.kg_aliases, "alias")


@query("SELECT id, name, status FROM kg_entities WHERE name ILIKE 'cold%'")
def oQ1b_resolve_ilike(t):
    return knowledge.resolve_like(t.kg_entities, "cold%").select("id", "name", "status")


@query("SELECT id, status FROM kg_entities WHERE name = 'ASIA'")
def oQ1d_exact(t):
    return t.kg_entities.where("name = 'ASIA'").select("id", "status")


@query(f"SELECT a.id, {NAMED}, a.status FROM kg_assertions a {JOINS} WHERE a.predicate IN ('requires', 'depends_on') AND a.subject_id IN (SELECT id FROM kg_entities WHERE status <> 'merged')")
def oQ2_requirements(t):
    return knowledge.requirements(t.kg_assertions, t.kg_entities, t.kg_entities.where("status <> 'merged'")).select("id", "subject", "predicate", "object", "status")


@query(f"SELECT a.id, {NAMED} FROM kg_assertions a {JOINS} WHERE a.predicate = 'depends_on' AND (a.subject_id IN ('S1','S2','S3','S4','S5') OR a.object_id IN ('S1','S2','S3','S4','S5'))")
def oQ3_dependencies(t):
    ids = t.rows([(f"S{i}",) for i in range(1, 6)], "id string")
    return knowledge.dependencies(t.kg_assertions, t.kg_entities, ids).select("id", "subject", "predicate", "object")


@query(f"SELECT subject_id, id, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, {RANK}, id)::INTEGER AS rank FROM kg_assertions WHERE confidence >= 0.7 AND status <> 'proposed') WHERE rank <= 3")
def oQ4_ranked_topk(t):
    return knowledge.ranked(knowledge.shared_filter(t.kg_assertions, 0.7), 3, "subject_id").select("subject_id", "id", "confidence", "rank")


@query(f"SELECT id, confidence, knowledge_origin FROM kg_assertions WHERE confidence >= 0.6 ORDER BY confidence DESC, {RANK}, id LIMIT 20")
def oQ5_best(t):
    return knowledge.ranked(knowledge.shared_filter(t.kg_assertions, 0.6, True), 20).select("id", "confidence", "knowledge_origin")


def _supplier_lists(t):
    rows = t.lineitem.groupBy("l_partkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey"))).alias("keys"))
    return rows.select(F.concat(F.lit("P"), "l_partkey").alias("id"), F.transform("keys", lambda k: F.when(k % 7 == 0, F.concat(F.lit("X"), k)).otherwise(F.concat(F.lit("S"), k))).alias("affects"))


LISTS = "(SELECT DISTINCT 'P' || l_partkey AS id, l_suppkey AS k, CASE WHEN l_suppkey % 7 = 0 THEN 'X' ELSE 'S' END || l_suppkey AS item FROM lineitem)"


@query(f"SELECT l.id, string_agg(coalesce(e.name, l.item), '|' ORDER BY l.k) AS names FROM {LISTS} l LEFT JOIN kg_entities e ON e.id = l.item GROUP BY l.id")
def oQ6_force_names(t):
    return knowledge.member_names(_supplier_lists(t), t.kg_entities, "affects")


@query(f"SELECT id FROM {LISTS} WHERE item = 'S3'")
def oQ7_forces_membership(t):
    return _supplier_lists(t).where(F.array_contains("affects", "S3")).select("id")


@query("SELECT coalesce(s.name, r.subject_id) AS subject, r.relation, coalesce(o.name, r.object_id) AS object FROM kg_spatial r LEFT JOIN kg_entities s ON s.id = r.subject_id LEFT JOIN kg_entities o ON o.id = r.object_id WHERE r.subject_id IN (SELECT id FROM kg_entities) OR r.object_id IN (SELECT id FROM kg_entities)")
def oQ8_spatial(t):
    return knowledge.touching(t.kg_spatial, t.kg_entities, t.kg_entities.select("id")).select("subject", "relation", "object")


@query("""WITH RECURSIVE w AS (SELECT DISTINCT src AS start, src AS node, 0 AS depth FROM kg_process_dag
UNION SELECT w.start, d.dst, w.depth + 1 FROM w JOIN kg_process_dag d ON d.src = w.node WHERE w.depth < 50) SELECT start, node, min(depth)::INTEGER AS depth FROM w GROUP BY start, node""")
def oQ9_process_levels(t):
    dag = t.kg_process_dag
    return graph.reachable(dag, dag.select(F.col("src").alias("start"), F.col("src").alias("node")), 50)


@query()
def oQ9_process_around(t):
    """From every order, in both directions; oQ9_process_levels goes forward only."""
    dag = t.kg_process_dag
    nodes = dag.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.around(dag, nodes.select(F.col("node").alias("start"), "node"), 50)


@query("""WITH RECURSIVE w AS (SELECT src AS node, 0 AS level FROM kg_process_dag WHERE src NOT IN (SELECT dst FROM kg_process_dag)
UNION ALL SELECT d.dst, w.level + 1 FROM w JOIN kg_process_dag d ON d.src = w.node) SELECT node, max(level)::INTEGER AS level FROM w GROUP BY node""")
def oQ9_topo_levels(t):
    return graph.levels(t.kg_process_dag)


COS = "round(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))), 6)"


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, v.label, {COS.format(a='q.embedding', b='v.embedding')} AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS n FROM s WHERE score >= 0.1) SELECT query_id, item_id, score FROM r WHERE n <= 10 AND label <> 3""")
def oQ10_search(t):
    v = t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
    q = v.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return knowledge.search(q, v.select("item_id", "vector"), v.where("label <> 3"), 10, 0.1)


@query("""WITH p AS (SELECT DISTINCT 'P' || p_partkey AS entity_id, p_brand AS ifc_class, p_type AS property_name FROM part WHERE p_partkey % 3 <> 0)
SELECT entity_id, ifc_class, string_agg(property_name, '|' ORDER BY property_name) AS properties, 'curated' AS source FROM p GROUP BY 1, 2
UNION ALL SELECT id, 'Any', entity_type || '-default', 'default' FROM kg_entities WHERE id NOT IN (SELECT entity_id FROM p)""")
def oQ11_psets(t):
    psets = t.part.where("p_partkey % 3 <> 0").select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"), F.col("p_brand").alias("ifc_class"), F.col("p_type").alias("property_name"))
    kinds = ("component", "system", "activity", "space", "material", "ifc_class")
    return knowledge.property_sets(psets, t.kg_entities, t.rows([(k, "Any", f"{k}-default") for k in kinds], "entity_type string, ifc_class string, properties string"))


@query(f"""WITH r AS ({RESOLVED}), q AS (SELECT s_name AS subject, 'protects_from' AS predicate, CASE WHEN s_suppkey % 4 = 0 THEN 'missing' ELSE 'AFRICA' END AS object FROM supplier),
x AS (SELECT q.*, a.entity_id AS subject_id, b.entity_id AS object_id FROM q LEFT JOIN r a ON a.key = lower(trim(subject)) LEFT JOIN r b ON b.key = lower(trim(object)))
SELECT subject, predicate, object, subject_id, object_id, CASE WHEN subject_id IS NULL THEN 'subject_not_found' WHEN object_id IS NULL THEN 'object_not_found' ELSE 'proposed' END AS outcome,
CASE WHEN subject_id IS NOT NULL AND object_id IS NOT NULL THEN sha256(subject_id || '|' || predicate || '|' || object_id) END AS id FROM x""")
def oQ12_propose(t):
    asked = t.supplier.select(F.col("s_name").alias("subject"), F.lit("protects_from").alias("predicate"), F.when(F.col("s_suppkey") % 4 == 0, "missing").otherwise("AFRICA").alias("object"))
    return knowledge.propose(asked, t.kg_entities, t.kg_aliases)


@query("SELECT id, json_array_length(CASE WHEN applicability LIKE '[%' THEN applicability ELSE '[]' END)::INTEGER AS entries FROM kg_assertions WHERE applicability IN ('[]', 'not json') OR lower(applicability) LIKE '%residential%'")
def oQB_context(t):
    rows = t.kg_assertions.withColumn("a", decode_list(F.col("applicability")))
    return rows.where(in_context(F.col("a"), " Residential ")).select("id", F.size("a").alias("entries"))


SINGLE = "status = 'proposed' AND evaluated AND knowledge_origin IN ('physical', 'engineering') AND cpc >= 0.85 AND framings >= 3"
GROUPS = "SELECT {key}, count(DISTINCT source_model) AS models, round(avg(confidence), 6) AS mean, sum(CAST(confidence AS DECIMAL(18, 9))) AS total, bool_or(knowledge_origin IN ('physical', 'engineering')) AS hard, count(*) AS n FROM {rows} WHERE status = 'proposed' AND evaluated GROUP BY {key}"
WINS = "CASE WHEN hard THEN models >= 2 AND total >= CAST(0.8 AS DECIMAL(18, 9)) * n ELSE models >= 3 AND total >= CAST(0.9 AS DECIMAL(18, 9)) * n END"
FLIPPED = "(SELECT * REPLACE (CASE WHEN linenumber_ % 2 = 0 THEN 'proposed' ELSE status END AS status) FROM (SELECT *, CAST(string_split(id, '-')[4] AS INT) AS linenumber_ FROM kg_assertions))"


def _evaluated(t):
    """kg_assertions with more rows proposed, so that promotion has work on any scale."""
    even = F.element_at(F.split("id", "-"), 4).cast("int") % 2 == 0
    return t.kg_assertions.withColumn("status", F.when(even, "proposed").otherwise(F.col("status")))


@query(f"SELECT id, source_model FROM {FLIPPED} WHERE {SINGLE}")
def oP1_single_promo(t):
    return lifecycle.promote_single(_evaluated(t)).select("id", "source_model")


@query(f"WITH f AS {FLIPPED}, g AS ({GROUPS.format(key='subject_id, predicate', rows='(SELECT * FROM f WHERE NOT (' + SINGLE + '))')}) SELECT subject_id, predicate, models, mean, n FROM g WHERE {WINS}")
def oP2_multi_promo(t):
    rows = _evaluated(t)
    rest = rows.join(lifecycle.promote_single(rows).select("id"), "id", "left_anti")
    return lifecycle.promote_groups(rest, ["subject_id", "predicate"]).select("subject_id", "predicate", "models", "mean", "n")


@query(f"""WITH f AS {FLIPPED}, one AS (SELECT id, source_model AS reviewer FROM f WHERE {SINGLE}), rest AS (SELECT * FROM f WHERE id NOT IN (SELECT id FROM one)),
g AS ({GROUPS.format(key='subject_id, predicate, object_id', rows='rest')}), w AS (SELECT * FROM g WHERE {WINS}),
a AS (SELECT * FROM one UNION ALL SELECT r.id, 'consensus' FROM rest r JOIN w USING (subject_id, predicate, object_id) WHERE r.status = 'proposed' AND r.evaluated)
SELECT reviewer, count(*) AS decisions, count(*) AS log_rows FROM a GROUP BY reviewer""")
def oP5_side_effects(t):
    rows = _evaluated(t)
    accepted = lifecycle.promote(rows)[1]
    decisions, log = lifecycle.status_log(Scratch(rows, "accepted")(accepted))  # both come from one written delta
    return decisions.groupBy("reviewer").agg(F.count("*").alias("decisions")).join(log.groupBy(F.col("changed_by").alias("reviewer")).agg(F.count("*").alias("log_rows")), "reviewer")


@query("SELECT 'assertions' AS \"table\", status AS old_status, count(*) AS n FROM kg_assertions WHERE source_model = 'm1' AND status <> 'deprecated' GROUP BY 2 UNION ALL SELECT 'process', status, count(*) FROM kg_process WHERE source_model = 'm1' AND status <> 'deprecated' GROUP BY 2")
def oP6_purge(t):
    return lifecycle.purge({"assertions": t.kg_assertions, "process": t.kg_process}, "m1")


@query("""WITH h AS (SELECT item_id, true AS is_initial, NULL AS old_status, 'proposed' AS new_status, min(changed_at) AS changed_at, -1 AS id FROM kg_log GROUP BY item_id UNION ALL SELECT item_id, false, old_status, new_status, changed_at, id FROM kg_log)
SELECT item_id, old_status, new_status, changed_at, row_number() OVER (PARTITION BY item_id ORDER BY is_initial DESC, changed_at, id)::INTEGER AS step FROM h""")
def oP7_history(t):
    return lifecycle.history(t.kg_log).select("item_id", "old_status", "new_status", "changed_at", "step")


@query("SELECT event_type AS value, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def oP9_pending_upsert(t):
    rows = t.events.select(F.col("event_type").alias("value"), "ts", "event_id")
    half = rows.where("event_id % 2 = 0").groupBy("value").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return lifecycle.pending_upsert(half, rows.where("event_id % 2 <> 0"))


@query("SELECT n, least(50, round_even(5 + n * 0.005::DOUBLE, 0))::INTEGER AS threshold FROM (SELECT unnest(range(0, 12001, 100)) AS n)")
def oP10_threshold(t):
    return t.spark.range(0, 12001, 100).select(F.col("id").alias("n"), review_threshold(F.col("id")).alias("threshold"))


@query("SELECT 'U' || user_id AS value, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 7 ORDER BY n DESC, value LIMIT 20")
def oP11_queue(t):
    pending = t.events.groupBy(F.concat(F.lit("U"), "user_id").alias("value")).agg(F.count("*").alias("n"))
    return lifecycle.review_queue(pending, 400)


@query("SELECT id, name FROM (SELECT 'P' || p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def oE1_dedup_first(t):
    rows = t.part.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    return normalise.first_by_name(rows).select("id", "name")


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), f AS (SELECT word, unnest(
CASE WHEN word LIKE '%ies' AND length(word) > 4 THEN [left(word, -3) || 'y'] WHEN word LIKE '%ses' AND length(word) > 4 THEN [left(word, -2)] WHEN word LIKE '%es' AND length(word) > 4 THEN [left(word, -1), left(word, -2)]
WHEN word LIKE '%s' AND word NOT LIKE '%ss' AND length(word) > 3 THEN [left(word, -1)] WHEN word LIKE '%y' AND length(word) > 2 THEN [word || 's', left(word, -1) || 'ies'] ELSE [word || 's'] END) AS form FROM w) SELECT word, form FROM f""")
def oE3b_forms(t):
    words = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return words.select("word", F.explode(word_forms(F.col("word"))).alias("form"))


FIRST = "PARTITION BY predecessor_id, successor_id, source_model"


@query(f"""SELECT id, predecessor_id, successor_id, source_model, hard_constraint, n, divergent::BIGINT AS divergent FROM (SELECT *, row_number() OVER (w ORDER BY seq, id) AS nth, count(*) OVER w AS n, sum(CASE WHEN hard_constraint <> first_says THEN 1 ELSE 0 END) OVER w AS divergent
FROM (SELECT *, first_value(hard_constraint) OVER ({FIRST} ORDER BY seq, id) AS first_says FROM kg_process) WINDOW w AS ({FIRST})) WHERE nth = 1""")
def oE5_first_wins(t):
    return integrity.first_wins(t.kg_process)


WORDS = ["more", "rise", "anti", "less", "red"]


@query(f"SELECT p_partkey, len(list_filter({WORDS}, lambda w: contains(lower(p_name), w))) > 0 AS passes FROM part")
def oE9a_direction(t):
    return t.part.select("p_partkey", has_any_word(F.col("p_name"), WORDS).alias("passes"))


@query("SELECT conv_id, batch::INTEGER AS batch, count(*) AS n, max(turn) AS last_turn FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch FROM conversations) GROUP BY 1, 2")
def oE11_batches(t):
    return integrity.batches(t.conversations, "conv_id", ["turn"], 3).groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


@query("SELECT 'U' || user_id AS item_id, event_type AS finding_type, count(DISTINCT event_id % 3) AS models, max(value) AS confidence, count(DISTINCT props) AS details, max(value) >= 50 AS applied FROM events GROUP BY 1, 2")
def oE11_merge(t):
    rows = t.events.select(F.concat(F.lit("U"), "user_id").alias("item_id"), F.col("event_type").alias("finding_type"), (F.col("event_id") % 3).alias("model"), F.col("value").alias("confidence"), F.col("props").alias("detail"))
    return integrity.merge_findings(rows, 50)


@query("SELECT doc_id, (i)::INTEGER AS chunk, length(substr(text, (i * 1000 + 1)::BIGINT, 1000))::INTEGER AS chars FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1000.0)::INTEGER)) AS i FROM documents WHERE length(text) > 0)")
def oE12_chunks(t):
    return integrity.chunks(t.documents.select("doc_id", "text")).select("doc_id", "chunk", F.length("piece").alias("chars"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {COS.format(a='a.embedding', b='b.embedding')} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS.format(a='a.embedding', b='b.embedding')} >= 0.25")
def oV1_cosine_pairs(t):
    v = _vectors(t)
    return normalise.similar_pairs(v, v, 0.25)


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("""WITH d AS (SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM kg_assertions UNION ALL SELECT object_id FROM kg_assertions WHERE object_id <> subject_id) GROUP BY id),
m AS (SELECT p_name AS cluster, 'P' || p_partkey AS id, p_partkey AS seq, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON d.id = 'P' || p_partkey)
SELECT id, cluster, first_value(id) OVER (PARTITION BY cluster ORDER BY degree DESC, seq) AS canonical FROM m""")
def oV6_election(t):
    members = t.part.select(F.col("p_name").alias("cluster"), F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_partkey").alias("seq"))
    return normalise.elect(members, normalise.degrees(t.kg_assertions)).select("id", "cluster", "canonical")


@query(f"""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {COS.format(a='a.embedding', b='b.embedding')} >= 0.3),
w AS (SELECT a AS node, a AS other FROM p UNION SELECT w.node, p.b FROM w JOIN p ON p.a = w.other) SELECT node, min(other) AS component FROM w GROUP BY node""")
def oV4_components(t):
    return graph.components(normalise.similar_links(_vectors(t), 0.3))


@query()
def oV4_clusters(t):
    return clustering.average_linkage(_vectors(t), 0.7)


@query()
def oV7_lap(t):
    rows = t.embeddings.select(F.col("label").alias("entity"), (F.col("vec_id") % 3).cast("int").alias("framing"), F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    return clustering.match_framings(rows, 0.2).withColumn("consistency", F.round("consistency", 6))


@query(f"""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), y AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS mean FROM y GROUP BY 1),
s AS (SELECT v.vec_id AS id, c.label AS best, {COS.format(a='v.embedding', b='c.mean')} AS score FROM embeddings v CROSS JOIN c),
m AS (SELECT id, max({{'score': score, 'best': best}}) AS m FROM s GROUP BY id) SELECT id, m.best AS best, m.score AS score, CASE WHEN m.score >= 0.3 THEN 'auto' WHEN m.score >= 0.15 THEN 'ambiguous' ELSE 'pending' END AS band FROM m""")
def oN4_bands(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return normalise.bands(normalise.best_match(v.select("id", "vector"), normalise.centroids(v)), 0.3, 0.15)


@query("SELECT l_partkey, l_orderkey, l_linenumber, i.id AS item_id FROM (SELECT l_partkey, l_orderkey, l_linenumber, ' ' || upper(p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey) r LEFT JOIN (SELECT lower(trim(p_name)) AS key, arg_min('P' || p_partkey, p_partkey) AS id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) i ON i.key = lower(trim(r.name))")
def oN1_references(t):
    refs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_partkey", "l_orderkey", "l_linenumber", F.concat(F.lit(" "), F.upper("p_name")).alias("name"))
    items = t.part.where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    return normalise.resolve_references(refs, items).select("l_partkey", "l_orderkey", "l_linenumber", "item_id")


@query()
def oN1_references_similar(t):
    """By name and else by cosine; oN1_references and its SQL go by name only. Part p has vector p modulo their number."""
    vectors = t.embeddings.select(F.col("vec_id").alias("at"), F.col("embedding").alias("vector"))
    parts = t.part.crossJoin(vectors.agg(F.count("*").alias("n"))).withColumn("at", F.expr("p_partkey % n")).join(vectors, "at", "left")
    refs = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_partkey", "l_orderkey", "l_linenumber", F.concat(F.lit(" "), F.upper("p_name")).alias("name"), "vector")
    items = parts.where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"), "vector")
    return normalise.resolve_references(refs, items).select("l_partkey", "l_orderkey", "l_linenumber", "item_id")


CHILDREN = "(SELECT subject_id AS node, * FROM kg_assertions)"


@query(f"SELECT node, knowledge_origin AS origin, count(*) AS n FROM {CHILDREN} GROUP BY 1, 2")
def oN7_origins(t):
    return normalise.origins(t.kg_assertions.withColumn("node", F.col("subject_id")))


@query(f"SELECT node, origin, n FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, origin) AS r FROM (SELECT node, knowledge_origin AS origin, count(*) AS n FROM {CHILDREN} GROUP BY 1, 2)) WHERE r = 1")
def oN8_majority(t):
    return normalise.majority_origin(normalise.origins(t.kg_assertions.withColumn("node", F.col("subject_id"))))


@query("SELECT predecessor_id, successor_id, count(DISTINCT source_model) AS models, count(*) AS n, arg_min(id, (seq, id)) AS first FROM kg_process WHERE status IN ('accepted', 'proposed') GROUP BY 1, 2 HAVING count(DISTINCT source_model) >= 2 AND count(DISTINCT hard_constraint) > 1")
def oN13_divergence(t):
    return normalise.process_divergence(t.kg_process)


@query("""WITH RECURSIVE r AS (SELECT src AS a, dst AS b FROM kg_cycle WHERE src <> dst UNION SELECT r.a, c.dst FROM r JOIN kg_cycle c ON c.src = r.b WHERE c.src <> c.dst)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1""")
def oN14_scc(t):
    return graph.strong_components(t.kg_cycle)


@query(f"SELECT node, count(*) AS n, count(*) FILTER (WHERE status IN ('conflicted', 'deprecated')) AS bad FROM {CHILDREN} GROUP BY node HAVING bool_or(status = 'conflicted') AND 2 * count(*) FILTER (WHERE status IN ('conflicted', 'deprecated')) > count(*)")
def oN15_cascade(t):
    return normalise.cascade(t.kg_assertions.withColumn("node", F.col("subject_id")))


@query("""WITH g AS (SELECT DISTINCT subject_id, predicate FROM kg_assertions WHERE run % 50 = 0), r AS (SELECT DISTINCT subject_id, predicate, 1 AS hit FROM kg_assertions WHERE run % 50 <> 0)
SELECT count(*) AS total, count(hit) AS matched, round(count(hit)::DOUBLE / count(*), 6) AS ratio FROM g LEFT JOIN r USING (subject_id, predicate)""")
def oN19_coverage(t):
    rows = t.kg_assertions
    return normalise.coverage(rows.where("run % 50 = 0"), rows.where("run % 50 <> 0"), ["subject_id", "predicate"])


EDGES = "(SELECT subject_id AS src, object_id AS dst, 'assertion' AS edge_type, 0 AS phase, 0::BIGINT AS seq FROM kg_assertions UNION ALL SELECT predecessor_id, successor_id, 'precedes', 5, seq FROM kg_process UNION ALL SELECT subject_id, object_id, relation, 6, 0 FROM kg_spatial)"


def _edges(t):
    return graph.typed_edges([("assertion", 0, t.kg_assertions.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))), ("precedes", 5, t.kg_process.select(F.col("predecessor_id").alias("src"), F.col("successor_id").alias("dst"), "seq"))]).unionByName(
        t.kg_spatial.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.col("relation").alias("edge_type"), F.lit(6).alias("phase"), F.lit(0).cast("long").alias("seq")))


@query(f"SELECT edge_type, count(*) AS n, count(DISTINCT src) AS sources FROM {EDGES} GROUP BY 1")
def oG1_edges(t):
    return _edges(t).groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


@query(f"SELECT src, dst, arg_max(edge_type, (phase, seq, edge_type)) AS edge_type, count(*) AS n FROM {EDGES} GROUP BY 1, 2")
def oG1_collapsed(t):
    return graph.collapse(_edges(t))


@query("""WITH RECURSIVE e AS (SELECT object_id AS src, subject_id AS dst FROM kg_spatial WHERE relation = 'accessible_from'), w AS (SELECT id FROM kg_entities WHERE is_entrance UNION SELECT e.dst FROM w JOIN e ON e.src = w.id)
SELECT id, name FROM kg_entities WHERE entity_type = 'space' AND status <> 'merged' AND id NOT IN (SELECT id FROM w)""")
def oG3_unreachable(t):
    spaces = t.kg_entities.where("entity_type = 'space' AND status <> 'merged'")
    edges = t.kg_spatial.where("relation = 'accessible_from'").select(F.col("object_id").alias("src"), F.col("subject_id").alias("dst"))
    return graph.unreachable(spaces.select("id", "name"), edges, spaces.where("is_entrance").select("id"))


ENDS = "(SELECT subject_id AS node FROM kg_assertions UNION ALL SELECT object_id FROM kg_assertions)"


@query(f"WITH top AS (SELECT node FROM {ENDS} GROUP BY node ORDER BY count(*) DESC, node LIMIT 300) SELECT subject_id AS src, object_id AS dst, count(*) AS n FROM kg_assertions WHERE subject_id IN (SELECT node FROM top) AND object_id IN (SELECT node FROM top) GROUP BY 1, 2")
def oG7_top_degree(t):
    edges = t.kg_assertions.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
    return graph.top_subgraph(edges, 300).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN d >= 50 THEN 50 WHEN d >= 30 THEN 30 WHEN d >= 25 THEN 25 WHEN d >= 20 THEN 20 WHEN d >= 15 THEN 15 WHEN d >= 10 THEN 10 WHEN d >= 5 THEN 5 ELSE 0 END AS bin, count(*) AS n FROM (SELECT node, count(*) AS d FROM {ENDS} GROUP BY node) GROUP BY 1")
def oG9_histogram(t):
    return graph.histogram(graph.degree(t.kg_assertions.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))))


TRADE = "(SELECT 'N' || s_nationkey AS src, 'N' || c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _trade(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy(F.concat(F.lit("N"), "s_nationkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    return rows.withColumn("mean", F.avg("n").over(Window.partitionBy())).where("n > mean * 1.1").select("src", "dst")


BUSY = f"(SELECT src, dst FROM (SELECT *, avg(n) OVER () AS mean FROM {TRADE}) WHERE n > mean * 1.1)"


@query(f"SELECT least(x.r_name, y.r_name) AS section_a, greatest(x.r_name, y.r_name) AS section_b, count(*) AS n FROM {BUSY} e JOIN nation a ON e.src = 'N' || a.n_nationkey JOIN nation b ON e.dst = 'N' || b.n_nationkey JOIN region x ON x.r_regionkey = a.n_regionkey JOIN region y ON y.r_regionkey = b.n_regionkey WHERE x.r_name <> y.r_name GROUP BY 1, 2")
def oG12_cross(t):
    sections = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.col("r_name").alias("section"))
    return graph.cross_sections(_trade(t), sections)


@query(f"WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {BUSY} WHERE src <> dst), c AS (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b) SELECT node, count(*) AS triangles FROM (SELECT unnest([a, b, c]) AS node FROM c) GROUP BY node")
def oG13_triangles(t):
    return graph.triangles(_trade(t))


@query()
def oG10_betweenness(t):
    return graph.betweenness(_trade(t))


@query()
def oG11_communities(t):
    return graph.communities(_trade(t))


STATUS = " , ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in integrity.STATUSES)
TOTAL = "count(*) FILTER (WHERE status IN ('proposed', 'accepted', 'deprecated', 'conflicted')) AS total"


@query(" UNION ALL ".join(f"SELECT '{n}' AS item_type, {STATUS}, {TOTAL} FROM kg_{n}" for n in ("entities", "assertions", "process")))
def oX1_status(t):
    return integrity.status_counts({"entities": t.kg_entities, "assertions": t.kg_assertions, "process": t.kg_process})


PAIRS = "(SELECT min(id) AS item_a_id, max(id) AS item_b_id FROM kg_assertions WHERE confidence >= 0.7 GROUP BY subject_id, predicate HAVING count(*) > 1)"


def _pairs(t):
    return t.kg_assertions.where("confidence >= 0.7").groupBy("subject_id", "predicate").agg(F.min("id").alias("item_a_id"), F.max("id").alias("item_b_id"), F.count("*").alias("n")).where("n > 1").select("item_a_id", "item_b_id")


@query(f"SELECT id FROM kg_assertions WHERE status = 'conflicted' AND id NOT IN (SELECT item_a_id FROM {PAIRS} UNION SELECT item_b_id FROM {PAIRS})")
def oX3_orphans(t):
    return integrity.orphaned_conflicted(t.kg_assertions, _pairs(t)).select("id")


@query(f"SELECT item_a_id, item_b_id FROM {PAIRS} WHERE item_a_id IN (SELECT id FROM kg_assertions WHERE status = 'deprecated') OR item_b_id IN (SELECT id FROM kg_assertions WHERE status = 'deprecated')")
def oX5_stale(t):
    return integrity.stale_pairs(_pairs(t), t.kg_assertions)


@query(f"SELECT count(DISTINCT id) AS depth FROM (SELECT item_a_id AS id FROM {PAIRS} UNION SELECT item_b_id FROM {PAIRS})")
def oX10_depth(t):
    return integrity.queue_depth(_pairs(t))


@query("""WITH f AS (SELECT s_nationkey AS place, 'stock' AS requirement, sum(s_acctbal) AS value FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS place, 'demand' AS requirement, count(*)::DOUBLE AS value FROM customer GROUP BY 1),
a AS (SELECT * FROM f UNION ALL SELECT * FROM c), g AS (SELECT DISTINCT place, requirement, least FROM (SELECT DISTINCT place FROM a), (VALUES ('stock', 20000.0), ('demand', 60.0), ('power', 1.0)) n(requirement, least))
SELECT requirement, CASE WHEN value IS NULL THEN 'UNCHECKED' WHEN value >= least THEN 'PASS' ELSE 'FAIL' END AS outcome, count(*) AS n FROM g LEFT JOIN a USING (place, requirement) GROUP BY 1, 2""")
def oX8_compliance(t):
    stock = t.supplier.groupBy(F.col("s_nationkey").alias("place")).agg(F.sum("s_acctbal").alias("value")).withColumn("requirement", F.lit("stock"))
    demand = t.customer.groupBy(F.col("c_nationkey").alias("place")).agg(F.count("*").cast("double").alias("value")).withColumn("requirement", F.lit("demand"))
    return integrity.compliance(stock.unionByName(demand), {"stock": 20000, "demand": 60, "power": 1})


@query("SELECT model, count(*) AS entries, sum(octet_length(encode(response)))::BIGINT AS bytes, count(DISTINCT sha256(response)) AS distinct_responses FROM kg_cache GROUP BY 1")
def oX9_cache(t):
    return integrity.cache_stats(t.kg_cache)


@query("SELECT p_partkey, CASE WHEN p_size > 25 AND p_retailprice < 1000 THEN 'size,price' WHEN p_size > 25 THEN 'size' ELSE 'price' END AS broken FROM part WHERE p_size > 25 OR p_retailprice < 1000")
def oR4_invalid(t):
    return integrity.invalid_rows(t.part, {"size": F.col("p_size") <= 25, "price": F.col("p_retailprice") >= 1000}).select("p_partkey", "broken")


@query("SELECT a.id, coalesce(s.name, a.subject_id) AS subject_id, coalesce(o.name, a.object_id) AS object_id FROM kg_assertions a LEFT JOIN kg_entities s ON s.id = a.subject_id AND s.status <> 'merged' LEFT JOIN kg_entities o ON o.id = a.object_id AND o.status <> 'merged'")
def oS1_export(t):
    return snapshot.export_names(t.kg_assertions.select("id", "subject_id", "object_id"), t.kg_entities, "subject_id", "object_id")


@query("WITH n AS (SELECT name, arg_max(id, seq) AS id FROM kg_entities GROUP BY name), q AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'S' || s_suppkey ELSE 'gone' END AS ref FROM supplier) SELECT s_suppkey, ref, coalesce(n.id, e.id) AS ref_resolved FROM q LEFT JOIN n ON n.name = q.ref LEFT JOIN kg_entities e ON e.id = q.ref")
def oS3_import_resolve(t):
    k = F.col("s_suppkey") % 3
    refs = t.supplier.select("s_suppkey", F.when(k == 0, F.col("s_name")).when(k == 1, F.concat(F.lit("S"), "s_suppkey")).otherwise("gone").alias("ref"))
    return snapshot.import_names(refs, t.kg_entities, "ref").select("s_suppkey", "ref", "ref_resolved")


@query("SELECT id FROM kg_entities WHERE status <> 'merged' AND NOT (seq % 3 = 0)")
def oS5_missing_vectors(t):
    have = t.kg_entities.where("seq % 3 = 0").select(F.col("id").alias("item_id"), F.sha2("name", 256).alias("content_hash"))
    return snapshot.missing_vectors(t.kg_entities, have).select("id")


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<h[1-6]>'))::INTEGER AS headings, len(regexp_extract_all(html, '<p>'))::INTEGER AS paragraphs, len(regexp_extract_all(html, 'href=\"'))::INTEGER AS links FROM pages")
def oS7_pages(t):
    return snapshot.page_fields(t.pages)


@query("SELECT date_trunc('hour', ts) AS start, event_type AS new_status, count(*) AS n FROM events GROUP BY 1, 2")
def oT1_window_counts(t):
    return transitions.window_counts(t.kg_log).select(F.col("start").cast("timestamp_ntz").alias("start"), "new_status", "n")


@query("SELECT 'U' || user_id AS item_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def oT2_latest(t):
    return transitions.latest(t.kg_log)


@query()
def oT3_stream(t):
    """Clicks as a stream in order of arrival, in three starts on one checkpoint, with late and repeated rows: counts by hour and kind."""
    events = t.clicks.select(F.col("click_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("arrived_at").cast("timestamp").alias("arrived"), "kind", "value")
    return arrivals.replay(events, f"{shared_dir(t.spark)}/loomgraph-stream-{uuid.uuid4().hex}")


@query()
def oT4_changes(t):
    """The last state of every client, its changes streamed into a versioned store."""
    return arrivals.replay_changes(t.client_changes, f"{shared_dir(t.spark)}/loomgraph-changes-{uuid.uuid4().hex}")


@query()
def oS13_store(t):
    """Entities after a version of four tables, an upsert by which proposed ones that an accepted assertion names are accepted, and a writer that died."""
    versions = store.Store(t.spark, f"{shared_dir(t.spark)}/loomgraph-store-{uuid.uuid4().hex}")
    versions.commit({"entities": store.keyed(t.kg_entities.withColumn("revision", F.lit(0))), "assertions": t.kg_assertions, "aliases": t.kg_aliases, "spatial": t.kg_spatial}, keys={"entities": ["id"]})
    old = versions.read()
    named = old["assertions"].where("status = 'accepted'").select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    risen = store.live(old["entities"]).where("status = 'proposed'").join(named, "id", "left_semi").withColumn("status", F.lit("accepted")).withColumn("revision", F.lit(1))
    versions.upsert("entities", risen, ["revision"])
    try:
        versions.commit({"entities": t.kg_entities.withColumn("status", F.when(F.rand(1) >= 0, F.raise_error(F.lit("died"))).otherwise("lost")), "assertions": t.kg_assertions.limit(0)})
    except Exception as error:  # the writer's; readers do not see it
        if "died" not in str(error):
            raise
    return store.live(versions.read()["entities"]).select("id", "name", "status", "revision")


from loomgraph.plans import graph_queries, row_queries, store_queries  # noqa: E402, F401  (they add their queries)
