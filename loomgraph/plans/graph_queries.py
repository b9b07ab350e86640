"""Queries of graph building, sequences, conflicts and merges on the projected tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.scalars import decode_list, pattern_section, slug
from loomgraph.operators import conflicts, graph, lifecycle, normalise, similarity
from loomgraph.plans.catalogue import BUSY, COS, JOINS, NAMED, _trade, query

LIVE = "status IN ('accepted', 'proposed')"
LIST = "from_json({}, '[\"VARCHAR\"]')"
BUILT = f"""
n AS (SELECT id, 'entity' AS node_type, 0 AS since FROM kg_entities UNION ALL SELECT id, 'assertion', 1 FROM kg_assertions WHERE {LIVE} UNION ALL SELECT id, 'abstraction_node', 2 FROM kg_abstractions WHERE {LIVE}
  UNION ALL SELECT id, 'pattern', 3 FROM kg_patterns WHERE {LIVE} UNION ALL SELECT id, 'force', 4 FROM kg_forces WHERE {LIVE} UNION ALL SELECT id, 'antipattern', 5 FROM kg_antipatterns WHERE {LIVE}),
c AS (SELECT id AS src, unnest({LIST.format('child_ids')}) AS dst FROM kg_abstractions WHERE {LIVE}),
nodes AS (SELECT * FROM n UNION ALL SELECT DISTINCT dst, NULL, 2 FROM c WHERE dst NOT IN (SELECT id FROM n)),
f AS (SELECT id AS src, unnest({LIST.format('affects')}) AS dst FROM kg_forces WHERE {LIVE}),
raw AS (SELECT subject_id AS src, object_id AS dst, predicate AS edge_type, 1 AS phase FROM kg_assertions WHERE {LIVE} UNION ALL SELECT src, dst, 'aggregates', 2 FROM c
  UNION ALL SELECT id, subject_id, 'applies_to', 3 FROM kg_patterns WHERE {LIVE} UNION ALL SELECT src, dst, 'acts_on', 4 FROM f UNION ALL SELECT id, subject_id, 'applies_to', 5 FROM kg_antipatterns WHERE {LIVE}
  UNION ALL SELECT predecessor_id, successor_id, 'precedes', 6 FROM kg_process WHERE {LIVE} UNION ALL SELECT subject_id, object_id, relation, 7 FROM kg_spatial),
k AS (SELECT id, min(since) AS since FROM nodes GROUP BY id),
edges AS (SELECT raw.* FROM raw JOIN k a ON a.id = src AND a.since <= phase JOIN k b ON b.id = dst AND b.since <= phase)"""


def _built(t):
    decoded = lambda df, c: df.withColumn(c, decode_list(F.col(c)))
    return graph.build({
        "entities": t.kg_entities, "assertions": t.kg_assertions, "abstractions": decoded(t.kg_abstractions, "child_ids"), "patterns": t.kg_patterns, "forces": decoded(t.kg_forces, "affects"),
        "antipatterns": t.kg_antipatterns, "process": t.kg_process, "spatial": t.kg_spatial.withColumn("status", F.lit("accepted"))})


@query(f"WITH {BUILT} SELECT coalesce(node_type, 'bare') AS node_type, count(*) AS n, count(DISTINCT id) AS ids FROM nodes GROUP BY 1")
def oG1_nodes(t):
    return _built(t)[0].groupBy(F.coalesce("node_type", F.lit("bare")).alias("node_type")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query(f"WITH {BUILT} SELECT phase, edge_type, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY 1, 2")
def oG1_built_edges(t):
    return _built(t)[1].groupBy("phase", "edge_type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


@query(f"WITH {BUILT}, one AS (SELECT src, dst, max(phase) AS last, max(phase) FILTER (WHERE phase = 6) AS six FROM edges GROUP BY 1, 2) SELECT last AS phase, count(*) AS pairs, count(six) AS with_constraint FROM one GROUP BY 1")
def oG1_attributes(t):
    phases = {"assertion": 1, "spatial": 7}
    one = graph.collapse_all(_built(t)[1])
    kind = F.when(F.col("edge_type") == "aggregates", 2).when(F.col("edge_type") == "acts_on", 4).when(F.col("edge_type") == "precedes", 6)
    kind = F.coalesce(kind, *[F.when(F.col("edge_category") == c, n) for c, n in phases.items()], F.when(F.col("src").startswith("T"), 3).otherwise(5))
    return one.groupBy(kind.cast("int").alias("phase")).agg(F.count("*").alias("pairs"), F.count("hard_constraint").alias("with_constraint"))


@query("""WITH RECURSIVE e AS (SELECT subject_id AS a, object_id AS b FROM kg_spatial UNION ALL SELECT object_id, subject_id FROM kg_spatial), w AS (SELECT 'R0' AS id UNION SELECT e.b FROM w JOIN e ON e.a = w.id) SELECT id, entity_type FROM kg_entities WHERE id IN (SELECT id FROM w)""")
def oG2_subgraph(t):
    edges = t.kg_spatial.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
    return graph.subgraph(t.kg_entities, edges, t.kg_entities.where("id = 'R0'").select("id"))[0].select("id", "entity_type")


@query("""WITH c AS (SELECT o_custkey, 'O' || o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT a.id AS start, count(*) AS n, string_agg(b.id, '>' ORDER BY b.place) AS sequence, false AS has_cycle, max(abs(a.place - b.place)) >= 50 AS truncated FROM c a JOIN c b USING (o_custkey) WHERE a.n > 1 AND abs(a.place - b.place) <= 50 GROUP BY a.id""")
def oG4_sequences(t):
    rows = graph.sequences(t.kg_process_dag, None, t.kg_entities.select("id", "name"))
    return rows.select("start", "n", F.array_join("sequence", ">").alias("sequence"), "has_cycle", "truncated")


SLUG = "replace(replace(replace(replace(lower({}), ' ', '-'), '''', ''), ',', ''), '.', '')"
BOOK = f"""p AS (SELECT p_partkey AS number, {SLUG.format("p_name || ' ' || p_partkey")} AS slug, p_name || ' ' || p_partkey AS name FROM part),
r AS (SELECT number AS x, number + 1 AS y, 0 AS late FROM p UNION ALL SELECT number, number + 7, 0 FROM p UNION ALL SELECT number, number + 3, 1 FROM p UNION ALL SELECT number, number + 7, 1 FROM p),
e AS (SELECT least(x, y) AS src, greatest(x, y) AS dst, min(late) AS late FROM r WHERE y IN (SELECT number FROM p) GROUP BY 1, 2)"""


@query(f"WITH {BOOK} SELECT src, dst, CASE late WHEN 0 THEN 'book' ELSE 'store' END AS source FROM e")
def oG8_pattern_graph(t):
    names = t.part.select(F.col("p_partkey").alias("number"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"))
    at = lambda k: names.select((F.col("number") - k).alias("number"), F.col("name").alias(f"plus{k}"))
    rows = names.join(at(1), "number", "left").join(at(7), "number", "left").join(at(3), "number", "left")
    # references by slug in the book, by name in the store; what is not there is left out
    book = rows.select("number", slug(F.col("name")).alias("slug"), "name", F.array_compact(F.array(slug(F.col("plus1")), F.col("plus7"), F.lit("gone"))).alias("lower"))
    return graph.pattern_graph(book, rows.select("name", F.array_compact(F.array("plus3", "plus7")).alias("refs")))


@query("SELECT p_partkey AS node, CASE WHEN p_partkey BETWEEN 1 AND 94 THEN 'Town and Country' WHEN p_partkey BETWEEN 95 AND 204 THEN 'Buildings' WHEN p_partkey BETWEEN 205 AND 253 THEN 'Construction' ELSE 'Unknown' END AS section FROM part")
def oR12_sections(t):
    return t.part.select(F.col("p_partkey").alias("node"), pattern_section(F.col("p_partkey")).alias("section"))


@query("WITH d AS (SELECT node, count(*) AS d FROM (SELECT subject_id AS node FROM kg_assertions UNION ALL SELECT object_id FROM kg_assertions) GROUP BY node) SELECT count(*)::BIGINT AS nodes, min(d) AS least, max(d) AS most, round(sum(d) / count(*), 6) AS mean, list_sort(list(d))[count(*) // 2 + 1] AS median FROM d")
def oG9_stats(t):
    return graph.degree_stats(graph.degree(t.kg_assertions.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))))


@query("SELECT node, count(*) AS degree FROM (SELECT subject_id AS node FROM kg_assertions UNION ALL SELECT object_id FROM kg_assertions) GROUP BY node ORDER BY degree, node LIMIT 15")
def oG9_tail(t):
    return graph.hubs(graph.degree(t.kg_assertions.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))), least=True)


@query(f"""WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {BUSY} WHERE src <> dst), x AS (SELECT a, b FROM e JOIN nation p ON a = 'N' || p.n_nationkey JOIN nation q ON b = 'N' || q.n_nationkey WHERE p.n_regionkey <> q.n_regionkey)
SELECT node, count(*) AS degree FROM (SELECT unnest([a, b]) AS node FROM x) GROUP BY node ORDER BY degree DESC, node LIMIT 15""")
def oG12_cross_degree(t):
    sections = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.col("n_regionkey").alias("section"))
    return graph.cross_degree(_trade(t), sections)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {BUSY} WHERE src <> dst), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
w AS (SELECT DISTINCT a AS start, a AS node, 0 AS depth FROM s UNION SELECT w.start, s.b, w.depth + 1 FROM w JOIN s ON s.a = w.node WHERE w.depth < 25),
d AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2), comp AS (SELECT start AS node, min(node) AS component FROM d GROUP BY 1), big AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1),
far AS (SELECT max(depth)::INTEGER AS diameter, round(avg(depth), 6) AS mean_path FROM d JOIN comp ON comp.node = d.start WHERE component = (SELECT component FROM big) AND depth > 0),
k AS (SELECT a AS node, count(*) AS deg FROM s GROUP BY 1), tri AS (SELECT x.a AS node, count(*) AS n FROM s x JOIN s y ON x.a = y.a AND x.b < y.b JOIN s z ON z.a = x.b AND z.b = y.b GROUP BY 1),
cl AS (SELECT round(avg(CASE WHEN deg > 1 THEN coalesce(n, 0) * 2.0::DOUBLE / (deg * (deg - 1)) ELSE 0 END), 6) AS clustering FROM k LEFT JOIN tri USING (node))
SELECT (SELECT count(*) FROM k) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) * 2 / ((SELECT count(*) FROM k) * ((SELECT count(*) FROM k) - 1)), 6) AS density, clustering, (SELECT count(DISTINCT component) FROM comp) AS components, diameter, mean_path FROM cl, far""")
def oG13_measures(t):
    return graph.measures(_trade(t))


ITEMS = "(SELECT vec_id AS id, embedding, CASE WHEN vec_id % 5 = 4 THEN 'deprecated' ELSE 'proposed' END AS status, vec_id % 3 = 0 AS evaluated FROM embeddings)"


def _items(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 5 == 4, "deprecated").otherwise("proposed").alias("status"), (F.col("vec_id") % 3 == 0).alias("evaluated"))


@query(f"""WITH p AS (SELECT a.id AS a, b.id AS b, a.evaluated AS done, {COS.format(a='a.embedding', b='b.embedding')} AS score FROM {ITEMS} a JOIN {ITEMS} b ON a.id < b.id AND NOT (a.evaluated AND b.evaluated) AND a.status = 'proposed' AND b.status = 'proposed')
SELECT CASE WHEN done THEN b ELSE a END AS item_a_id, CASE WHEN done THEN a ELSE b END AS item_b_id, score FROM p WHERE score >= 0.3 AND NOT ((b - a) % 7 = 0 AND b - a <= 140)""")
def oN10_candidates(t):
    """Candidates over all labels. Known pairs: ids that differ by 7, 14, ... 140, written the other way round."""
    known = t.embeddings.select(F.col("vec_id").alias("item_b_id"), F.explode(F.sequence(F.lit(7), F.lit(140), F.lit(7))).alias("k"))
    known = known.select((F.col("item_b_id") + F.col("k")).alias("item_a_id"), "item_b_id")
    return conflicts.candidates(_items(t), t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), known, 0.3)


SAID = f"""q AS (SELECT id AS a, id + j AS b, (3 * id + j) % 5 AS r FROM (SELECT id, unnest([1, 2, 5]) AS j FROM {ITEMS}) WHERE id + j IN (SELECT vec_id FROM embeddings)),
p AS (SELECT a, b, CASE r WHEN 0 THEN 'contradictory' WHEN 1 THEN 'unrelated' WHEN 2 THEN 'duplicate' ELSE 'contradictory' END AS classification FROM q WHERE r <> 3)"""


def _classified(t):
    rows = t.embeddings.select(F.col("vec_id").alias("item_a_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("j")).select("item_a_id", (F.col("item_a_id") + F.col("j")).alias("item_b_id"), ((F.col("item_a_id") * 3 + F.col("j")) % 5).alias("r"))
    rows = rows.join(t.embeddings.select(F.col("vec_id").alias("item_b_id")), "item_b_id", "left_semi")
    said = F.when(F.col("r") == 0, "contradictory").when(F.col("r") == 1, "odd").when(F.col("r") == 2, " Duplicate").when(F.col("r") == 4, "CONTRADICTORY")
    return conflicts.apply_classes(_items(t), rows.select("item_a_id", "item_b_id", said.alias("classification")), "assertion", conflicted=10, cap=150)


@query(f"WITH {SAID} SELECT classification, count(*) AS n, min(a) AS first FROM p GROUP BY 1")
def oN11_pairs(t):
    return _classified(t)["pairs"].groupBy("classification").agg(F.count("*").alias("n"), F.min("item_a_id").alias("first"))


@query(f"""WITH {SAID}, h AS (SELECT id, min(a) AS turn FROM (SELECT a, unnest([a, b]) AS id FROM p WHERE classification = 'contradictory') GROUP BY id), m AS (SELECT h.id, turn, status FROM h JOIN {ITEMS} i ON i.id = h.id WHERE status <> 'deprecated'),
x AS (SELECT max(turn) AS edge, count(*) AS n FROM (SELECT turn FROM m ORDER BY turn, id LIMIT 140)) SELECT id AS item_id, status AS old_status, 'conflicted' AS new_status FROM m, x WHERE n < 140 OR turn <= edge""")
def oN12_capped_log(t):
    return _classified(t)["log"].select("item_id", "old_status", "new_status")


GROUPED = f"""g AS (SELECT predecessor_id, successor_id FROM kg_process WHERE {LIVE} GROUP BY 1, 2 HAVING count(DISTINCT source_model) > 1 AND count(DISTINCT hard_constraint) > 1),
d AS (SELECT p.id, p.status, row_number() OVER (PARTITION BY predecessor_id, successor_id ORDER BY seq, id) AS nth, first_value(id) OVER w AS first, nth_value(id, 2) OVER w AS second FROM kg_process p JOIN g USING (predecessor_id, successor_id) WHERE {LIVE}
  WINDOW w AS (PARTITION BY predecessor_id, successor_id ORDER BY seq, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {GROUPED} SELECT id AS item_a_id, CASE WHEN id = first THEN second ELSE first END AS item_b_id FROM d")
def oN13_pairs(t):
    return conflicts.divergence(t.kg_process)["pairs"].select("item_a_id", "item_b_id")


@query(f"WITH {GROUPED} SELECT CASE WHEN id IN (SELECT id FROM d) THEN 'conflicted' ELSE status END AS status, count(*) AS n FROM kg_process GROUP BY 1")
def oN13_statuses(t):
    return conflicts.divergence(t.kg_process)["items"].groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT predecessor_id AS s, successor_id AS d FROM kg_loops WHERE {LIVE} AND predecessor_id <> successor_id), r AS (SELECT s AS a, d AS b FROM e UNION SELECT r.a, e.d FROM r JOIN e ON e.s = r.b),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1)
SELECT l.id AS item_id, l.status AS old_status, 'conflicted' AS new_status FROM kg_loops l JOIN c p ON p.node = predecessor_id JOIN c q ON q.node = successor_id AND p.component = q.component WHERE {LIVE}""")
def oN14_marked(t):
    return conflicts.cycles(t.kg_loops)["log"].select("item_id", "old_status", "new_status")


@query("""WITH c AS (SELECT subject_id AS id, count(*) + CASE WHEN e.seq % 2 = 0 THEN 1 ELSE 0 END AS n, count(*) FILTER (WHERE a.status IN ('conflicted', 'deprecated')) AS bad, any_value(e.status) AS status FROM kg_assertions a JOIN kg_entities e ON e.id = a.subject_id GROUP BY 1, e.seq)
SELECT id AS item_id, status AS old_status, 'conflicted' AS new_status FROM c WHERE status <> 'deprecated' AND 2 * bad > n""")
def oN15_marked(t):
    """Abstractions: parts with all their assertions as children, and one that does not exist for every other part."""
    children = t.kg_assertions.groupBy(F.col("subject_id").alias("id")).agg(F.collect_list("id").alias("own"))
    nodes = t.kg_entities.join(children, "id").select("id", "status", F.when(F.col("seq") % 2 == 0, F.concat("own", F.array(F.lit("gone")))).otherwise(F.col("own")).alias("child_ids"))
    return conflicts.cascade(nodes, t.kg_assertions)["log"].select("item_id", "old_status", "new_status")


@query(f"SELECT 'assertions' AS item_type, count(*) FILTER (WHERE {LIVE} AND NOT evaluated) AS unevaluated FROM kg_assertions UNION ALL SELECT 'constraints', count(*) FILTER (WHERE {LIVE} AND NOT evaluated) FROM kg_constraints UNION ALL SELECT 'divergence', count(*) FROM (SELECT 1 FROM kg_process WHERE {LIVE} GROUP BY predecessor_id, successor_id HAVING count(DISTINCT source_model) > 1 AND count(DISTINCT hard_constraint) > 1)")
def oR5_conflicts(t):
    return conflicts.counters({"assertions": t.kg_assertions, "constraints": t.kg_constraints}, t.kg_process)


ELECTED = """d AS (SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM kg_assertions UNION ALL SELECT object_id FROM kg_assertions WHERE object_id <> subject_id) GROUP BY id),
m AS (SELECT p_name AS cluster, 'P' || p_partkey AS id, p_partkey AS seq, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON d.id = 'P' || p_partkey), e AS (SELECT id, first_value(id) OVER (PARTITION BY cluster ORDER BY degree DESC, seq) AS canonical FROM m)"""


def _merged(t):
    members = t.part.select(F.col("p_name").alias("cluster"), F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_partkey").alias("seq"))
    return normalise.merge(t.kg_entities, t.kg_aliases, t.kg_assertions, normalise.elect(members, normalise.degrees(t.kg_assertions)))


@query(f"WITH {ELECTED} SELECT coalesce(e.canonical, a.subject_id) AS subject_id, count(*) AS n FROM kg_assertions a LEFT JOIN e ON e.id = a.subject_id GROUP BY 1")
def oV6_merge(t):
    return _merged(t)["assertions"].groupBy("subject_id").agg(F.count("*").alias("n"))


@query(f"WITH {ELECTED} SELECT CASE WHEN e.id <> e.canonical THEN 'merged' ELSE k.status END AS status, count(*) AS n, (SELECT count(*) FROM e WHERE id <> canonical) + (SELECT count(*) FROM kg_aliases) AS aliases FROM kg_entities k LEFT JOIN e ON e.id = k.id GROUP BY 1")
def oV6_merged_entities(t):
    done = _merged(t)
    return done["entities"].groupBy("status").agg(F.count("*").alias("n")).crossJoin(done["aliases"].agg(F.count("*").alias("aliases")))  # one row


@query("SELECT 'assertions' AS item_type, CASE WHEN source_model = 'm1' THEN 'deprecated' ELSE status END AS status, count(*) AS n, 0 AS logged FROM kg_assertions GROUP BY 1, 2 UNION ALL SELECT 'process', CASE WHEN source_model = 'm1' THEN 'deprecated' ELSE status END, count(*), 0 FROM kg_process GROUP BY 1, 2 UNION ALL SELECT 'assertions', 'log', 0, count(*) FROM kg_assertions WHERE source_model = 'm1' AND status <> 'deprecated' UNION ALL SELECT 'process', 'log', 0, count(*) FROM kg_process WHERE source_model = 'm1' AND status <> 'deprecated'")
def oP6_tables(t):
    tables, log = lifecycle.purge_tables({"assertions": t.kg_assertions, "process": t.kg_process}, "m1", "source_model")
    out = log.groupBy("item_type").agg(F.lit("log").alias("status"), F.lit(0).cast("long").alias("n"), F.count("*").alias("logged"))
    for name, df in tables.items():
        out = out.unionByName(df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(name).alias("item_type"), "status", "n", F.lit(0).cast("long").alias("logged")))
    return out


@query("""WITH r AS (SELECT * FROM kg_constraints WHERE status = 'proposed' AND evaluated), g AS (SELECT subject_id, rule, constraint_type FROM r GROUP BY 1, 2, 3 HAVING CASE WHEN bool_or(knowledge_origin IN ('physical', 'engineering')) THEN count(DISTINCT source_model) >= 2 AND sum(CAST(confidence AS DECIMAL(18, 9))) >= CAST(0.8 AS DECIMAL(18, 9)) * count(*)
  ELSE count(DISTINCT source_model) >= 3 AND sum(CAST(confidence AS DECIMAL(18, 9))) >= CAST(0.9 AS DECIMAL(18, 9)) * count(*) END) SELECT r.id, 'consensus' AS reviewer FROM r JOIN g USING (subject_id, rule, constraint_type)""")
def oP3_constraints(t):
    return lifecycle.promote_type(t.kg_constraints, "constraint")


@query(f"SELECT a.id, {NAMED}, a.status FROM kg_assertions a {JOINS} WHERE a.status IN ('accepted', 'proposed') AND a.confidence >= 0.7 AND (a.subject_id IN ('P1', 'P2') OR a.object_id IN ('S3', 'P2'))")
def oQ13_assertions(t):
    from loomgraph.operators.reports import assertion_query

    ids = t.rows([("P1",), ("P2",), ("S3",)], "id string")
    return assertion_query(t.kg_assertions, t.kg_entities, ids, 0.7, True).select("id", "subject", "predicate", "object", "status")


NEW = f"""(SELECT vec_id AS id, embedding, label = 7 AS new FROM embeddings WHERE vec_id % 5 <> 4)"""


def _delta(t):
    """Items of label 7 came after the last batch and are not evaluated; all that are proposed are live."""
    live = t.embeddings.where("vec_id % 5 <> 4").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return live.where("label = 7"), live


@query(f"""WITH p AS (SELECT a.id AS a, b.id AS b, {COS.format(a='a.embedding', b='b.embedding')} AS score FROM {NEW} a JOIN {NEW} b ON a.new AND a.id <> b.id AND (NOT coalesce(b.new, false) OR a.id < b.id))
SELECT a, b, score FROM p WHERE score >= 0.4""")
def oN10_delta(t):
    """Each item that came new against all live ones."""
    return similarity.delta_pairs(*_delta(t), 0.4)


@query()
def oN10_work(t):
    """What oN10_delta meets and scores, beside the square of the live items."""
    return similarity.work(*_delta(t), 0.4)


def _loops(t):
    return t.kg_loops.where(F.col("status") == "proposed").select(F.col("predecessor_id").alias("src"), F.col("successor_id").alias("dst"))


@query()
def oG13_diameter(t):
    """Of the graph of all loops, from few sources."""
    return graph.diameter(_loops(t))


@query()
def oG13_loops(t):
    """All measures of that graph."""
    return graph.measures(_loops(t))


@query()
def oG10_loops(t):
    """Betweenness of its nodes."""
    return graph.betweenness(_loops(t))
