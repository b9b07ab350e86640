import itertools
import random

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from loomgraph.functions.scalars import review_threshold
from loomgraph.operators import auction, clustering, graph, knowledge, lifecycle, normalise
from loomgraph.plans import catalogue
from loomgraph.sources import snapshot


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_strong_components(spark):
    got = graph.strong_components(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "f"), ("f", "e"), ("x", "a")]))
    assert {(r["node"], r["component"]) for r in got.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "e"), ("f", "e")}


def test_levels_and_cycles(spark):
    dag = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]
    assert {r["node"]: r["level"] for r in graph.levels(edges(spark, dag)).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert not graph.has_cycle(edges(spark, dag))
    assert graph.has_cycle(edges(spark, [*dag, ("d", "b")]))


def test_around_goes_both_ways_and_fifty_steps(spark):
    path = [(f"n{i}", f"n{i + 1}") for i in range(60)]
    start = spark.createDataFrame([("n5", "n5"), ("n60", "n60")], "start string, node string")
    got = {(r["start"], r["node"]): r["depth"] for r in graph.around(edges(spark, path), start).collect()}
    assert got == {(f"n{s}", f"n{i}"): abs(i - s) for s in (5, 60) for i in range(61) if abs(i - s) <= 50}


def test_process_around_starts_everywhere(spark):
    near = {}
    for r in catalogue.Tables(spark, SF).kg_process_dag.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    want = set()
    for s in near:
        depth, ahead = {s: 0}, [s]
        for x in ahead:
            for y in near[x] - depth.keys() if depth[x] < 50 else ():
                depth[y] = depth[x] + 1
                ahead.append(y)
        want |= {(s, x, d) for x, d in depth.items()}
    rows = catalogue.QUERIES["oQ9_process_around"](spark, SF).collect()
    assert {(r["start"], r["node"], r["depth"]) for r in rows} == want and len(rows) == len(want)


def test_components_of_a_long_path(spark):
    n = 40
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (200, 201), (None, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 100: 100, 200: 200, 201: 200}
    assert graph.components(e.limit(0)).count() == 0


def test_betweenness_of_a_path(spark):
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(edges(spark, [("a", "b"), ("b", "c")])).collect()}
    assert got.get("b") == 1.0 and not got.get("a")


def test_collapse_last_phase_wins(spark):
    e = spark.createDataFrame([("a", "b", "precedes", 5, 0), ("a", "b", "above", 6, 0)], "src string, dst string, edge_type string, phase int, seq long")
    assert graph.collapse(e).first()["edge_type"] == "above"


def test_assignment_is_optimal():
    rng = random.Random(3)
    for n, m in [(1, 1), (3, 3), (2, 4), (4, 2), (5, 5)]:
        c = np.array([[rng.random() for _ in range(m)] for _ in range(n)])
        got = sum(c[i, j] for i, j in clustering.assignment(c))
        small, big = (c, m) if n <= m else (c.T, n)
        assert abs(got - min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(big), len(small)))) < 1e-9


def test_linkage_of_two_near_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [0.99, 0.14]), (3, [0.0, 1.0])]
    got = {r["id"]: r["cluster"] for r in clustering.average_linkage(spark.createDataFrame(v, "id long, vector array<double>"), 0.04).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_similar_pairs_without_a_block(spark):
    rng = np.random.default_rng(1)
    v = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    df = spark.createDataFrame(v, "id long, vector array<double>")
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(v, 2) if cos(a, b) >= 0.6}
    assert {(r["a"], r["b"]) for r in normalise.similar_pairs(df, df, 0.6, blocks=3).collect()} == want


def test_a_table_meets_itself_once(spark):
    rng = np.random.default_rng(4)
    v = [(i, rng.normal(size=3).tolist()) for i in rng.permutation(60).tolist()] + [(70, None), (71, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])] + [(80 + i, [0.0, 2.0]) for i in range(9)]
    df, twin = (spark.createDataFrame(v, "id long, vector array<double>") for _ in range(2))
    for blocks in (1, 4):
        found = normalise.similar_pairs(df, df, 0.8, blocks=blocks)
        plain = lambda rows: sorted(map(tuple, rows.collect()))
        assert plain(found) == plain(normalise.similar_pairs(df, twin, 0.8, blocks=blocks)) and found.count() > 90
        links = normalise.similar_links(df, 0.8, blocks=blocks)
        assert links.count() <= blocks * len(v) and plain(graph.components(links)) == plain(graph.components(found))
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "id long, vector array<double>")
    assert normalise.similar_links(copies, 0.9, blocks=2).count() <= 600  # of 44,850 pairs
    assert {r["component"] for r in graph.components(normalise.similar_links(copies, 0.9, blocks=2)).collect()} == {0}


def global_pairs(spark, least):
    rows = catalogue.Tables(spark, SF).embeddings.collect()
    v = np.array([r["embedding"] for r in rows], float)
    score = np.round((v / np.linalg.norm(v, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
    return rows, score, {(rows[i]["vec_id"], rows[j]["vec_id"]) for i, j in np.argwhere(score >= least) if rows[i]["vec_id"] < rows[j]["vec_id"]}


def test_global_pairs_and_components_cross_labels(spark):
    rows, _, want = global_pairs(spark, 0.25)
    label = {r["vec_id"]: r["label"] for r in rows}
    assert {(r["a"], r["b"]) for r in catalogue.QUERIES["oV1_cosine_pairs"](spark, SF).collect()} == want
    assert any(label[a] != label[b] for a, b in want)
    near = global_pairs(spark, 0.3)[2]
    comp = {i: i for p in near for i in p}
    for a, b in near:
        low, high = sorted((comp[a], comp[b]))
        comp = {k: low if c == high else c for k, c in comp.items()}
    assert {r["node"]: r["component"] for r in catalogue.QUERIES["oV4_components"](spark, SF).collect()} == comp


def plain_linkage(vectors, threshold, strict=True):
    """One merge after another of the two nearest clusters, from all distances."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    dist, groups = 1 - unit @ unit.T, [[i] for i in range(len(vectors))]
    while len(groups) > 1:
        d, x, y = min((dist[np.ix_(groups[x], groups[y])].mean(), x, y) for x, y in itertools.combinations(range(len(groups)), 2))
        if not (d < threshold or (not strict and d <= threshold)):
            break
        groups[x] += groups.pop(y)
    return {i: min(g) for g in groups for i in g}


def test_global_clusters_are_average_linkage_of_all(spark):
    rows = sorted(global_pairs(spark, 0.3)[0], key=lambda r: r["vec_id"])
    want = plain_linkage(np.array([r["embedding"] for r in rows[:120]], float), 0.7)
    df = spark.createDataFrame([(i, r["embedding"]) for i, r in enumerate(rows[:120])], "id long, vector array<float>")
    for block in (7, 40, 4096):
        assert {r["id"]: r["cluster"] for r in clustering.average_linkage(df, 0.7, block=block).collect()} == want
    whole, parts = ({r["id"]: r["cluster"] for r in clustering.average_linkage(df, 0.8, block=b).collect()} for b in (4096, 16))
    assert whole == parts and len(set(whole.values())) < len(set(want.values()))
    assert len(catalogue.QUERIES["oV4_clusters"](spark, SF).collect()) == len(rows)


def test_linkage_of_copies_and_odd_vectors(spark):
    v = [(i, [1.0, 0.0]) for i in range(40)] + [(i, [2.0, 0.0]) for i in range(40, 60)] + [(60, [0.0, 0.0]), (61, None), (62, [1.0, None]), (63, [float("nan"), 1.0]), (64, [1.0, 0.0, 0.0]), (65, [5.0, 0.0, 0.0]), (66, [])]
    df = spark.createDataFrame(v, "id long, vector array<double>")
    for block in (1, 4096):
        got = clustering.average_linkage(df, 0.3, block=block).collect()
        assert {r["id"]: r["cluster"] for r in got} == {**dict.fromkeys(range(60), 0), 60: 60, 61: 61, 62: 62, 63: 63, 64: 64, 65: 64, 66: 66} and len(got) == len(v)
    assert clustering.average_linkage(df.limit(0), 0.3).count() == 0


def test_search_answers_every_hundredth_vector(spark):
    rows, score, _ = global_pairs(spark, 0.25)
    want = []
    for i, r in enumerate(rows):
        if r["vec_id"] % 100 == 0:
            best = sorted((-score[i, j], rows[j]["vec_id"], j) for j in range(len(rows)) if score[i, j] >= 0.1)[:10]
            want += [(r["vec_id"], item) for _, item, j in best if rows[j]["label"] != 3]
    assert sorted((r["query_id"], r["item_id"]) for r in catalogue.QUERIES["oQ10_search"](spark, SF).collect()) == sorted(want)


def test_search_takes_queries_in_blocks(spark):
    v = catalogue.Tables(spark, SF).embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    q = v.where("item_id < 40").select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"))
    whole, parts = (sorted(map(tuple, knowledge.search(q, v, v, 5, 0.1, bound=b).collect())) for b in (10_000, 7))
    assert whole == parts and {r[0] for r in whole} == set(range(40))


def test_search_with_ties_and_odd_vectors(spark):
    v = [(i, [1.0, 0.0]) for i in range(30)] + [(30, [0.0, 0.0]), (31, None), (32, [None, 1.0]), (33, [1.0, 0.0, 0.0]), (34, [3.0, 4.0]), (35, [float("nan"), 1.0]), (36, []), (None, [1.0, 0.0])]
    df = spark.createDataFrame(v, "item_id long, vector array<double>").repartition(3)
    q = df.where("item_id in (3, 30, 31, 33, 34, 36)").selectExpr("item_id query_id", "vector query_vector")
    for block in (5, 4096):
        found = knowledge.search(q, df, df, 4, 0.0, bound=2, block=block)
        assert "CoGroupsInArrow" in found._jdf.queryExecution().toString()  # products of blocks, no pair of rows is joined
        got = {i: sorted((-r["score"], r["item_id"]) for r in found.where(f"query_id = {i}").collect()) for i in (3, 30, 31, 33, 34, 36)}
        assert got == {3: [(-1.0, 0), (-1.0, 1), (-1.0, 2)], 30: [(0.0, 0), (0.0, 1), (0.0, 2)], 31: [], 33: [(-1.0, 33)], 34: [(-1.0, 34), (-0.6, 0), (-0.6, 1)], 36: [(0.0, 36)]}  # the vector without id takes a place, and is then not live
    assert knowledge.search(q.limit(0), df, df).count() == knowledge.search(q, df.limit(0), df).count() == 0


def test_best_match_of_many_candidates(spark):
    v = [(i, [1.0, 0.001 * i]) for i in range(10_050)]
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.5])], "id long, vector array<double>")
    got = normalise.best_match(rows, spark.createDataFrame(v, "id long, vector array<double>")).collect()
    assert {r["id"]: (r["best"], r["score"]) for r in got} == {1: (10_049, round(10.049 / (1 + 10.049**2) ** 0.5, 6)), 2: (501, 1.0)}


def test_bands_meet_all_centroids(spark):
    rows = global_pairs(spark, 0.25)[0]
    by = {}
    for r in rows:
        by.setdefault(r["label"], []).append(r["embedding"])
    mean = {k: np.mean(np.array(v, float), axis=0) for k, v in by.items()}
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    want = {r["vec_id"]: max((cos(r["embedding"], m), k) for k, m in mean.items()) for r in rows}
    got = catalogue.QUERIES["oN4_bands"](spark, SF).collect()
    assert {r["id"]: (r["score"], r["best"]) for r in got} == want
    assert all(r["band"] == ("auto" if r["score"] >= 0.3 else "ambiguous" if r["score"] >= 0.15 else "pending") for r in got)


def test_references_by_name_then_by_cosine(spark):
    items = spark.createDataFrame([("a", "Light", 1, [1.0, 0.0]), ("b", "Noise", 2, [0.0, 1.0]), ("c", "noise", 3, [0.0, 1.0]), ("d", "Void", 4, None)], "id string, name string, seq long, vector array<double>")
    refs = [(1, " NOISE ", [1.0, 0.0]), (2, "daylight", [1.0, 0.3]), (3, "far", [1.0, 1.0]), (4, "din", [0.1, 2.0]), (5, "zero", [0.0, 0.0]), (6, "none", None), (7, "din", [0.1, 2.0])]
    got = normalise.resolve_references(spark.createDataFrame(refs, "pos long, name string, vector array<double>"), items).collect()
    assert {r["pos"]: r["item_id"] for r in got} == {1: "b", 2: "a", 3: None, 4: "b", 5: None, 6: None, 7: "b"} and len(got) == 7


def test_references_take_all_lines(spark):
    rows = catalogue.QUERIES["oN1_references_similar"](spark, SF)
    assert rows.count() == catalogue.Tables(spark, SF).lineitem.count() and rows.where("l_linenumber > 1 and item_id is not null").count() > 0


def test_pairs_of_odd_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0, 0.0, 0.0]), (7, [5.0, 0.0, 0.0])]
    df = spark.createDataFrame(v, "id long, vector array<double>")
    assert sorted(map(tuple, normalise.similar_pairs(df, df, 0.5, blocks=2).collect())) == [(1, 2, 1.0), (6, 7, 1.0)]
    assert normalise.similar_pairs(df, df, 0.0, blocks=2).count() == 21


def test_promotion_rules(spark):
    cols = "id string, subject_id string, predicate string, object_id string, knowledge_origin string, status string, source_model string, confidence double, cpc double, framings int, evaluated boolean"
    base = lambda i, s, o, m, c, cpc=0.0: (i, s, "requires", "x", o, "proposed", m, c, cpc, 3, True)
    rows = [base("1", "a", "physical", "m", 0.5, 0.85), base("2", "b", "physical", "m", 0.5, 0.84), base("3", "c", "physical", "m1", 0.85), base("4", "c", "physical", "m2", 0.85), base("5", "d", "cultural", "m1", 0.95), base("6", "d", "cultural", "m2", 0.95), base("7", "e", "physical", "m1", 0.75), base("8", "e", "physical", "m2", 0.75)]
    after, accepted = lifecycle.promote(spark.createDataFrame(rows, cols))
    assert {r["id"] for r in accepted.collect()} == {"1", "3", "4"}
    assert {r["id"] for r in after.where("status = 'accepted'").collect()} == {"1", "3", "4"}
    assert lifecycle.promote(after, enabled=False)[1].count() == 0


def test_threshold_rounds_half_to_even(spark):
    assert spark.range(1).select(review_threshold(F.lit(300))).first()[0] == 6


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", ["a"]), ("2", [])], "id string, tags array<string>")
    snapshot.save_store({"t": rows}, f"file://{tmp_path}/store")
    assert sorted(map(tuple, snapshot.load_store(spark, f"file://{tmp_path}/store")["t"].collect())) == sorted(map(tuple, rows.collect()))
    new = spark.createDataFrame([("2", ["n"]), ("3", None), ("", None)], rows.schema)
    assert {r["id"]: r["tags"] for r in snapshot.upsert(rows, new).collect()} == {"1": ["a"], "2": [], "3": None}
    assert {r["id"]: r["tags"] for r in snapshot.upsert(rows, new, replace=True).collect()} == {"1": ["a"], "2": ["n"], "3": None}
    snapshot.write_csv(rows, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 2


def test_match_framings_against_all_permutations(spark):
    rng = np.random.default_rng(8)
    rows, item = [], 0
    for entity, counts in {"e1": (3, 3, 4), "e2": (1, 4), "e3": (2,), None: (2, 3)}.items():
        for framing, n in enumerate(counts):
            for _ in range(n):
                rows.append((entity, framing, item, rng.normal(size=4).tolist()))
                item += 1
    rows.append(("e3", 1, item, [0.0, 0.0, 0.0, 0.0]))  # a vector without direction is like nothing
    threshold = 0.3

    def cos(x, y):
        a, b = np.linalg.norm(x), np.linalg.norm(y)
        return float(np.dot(x, y) / (a * b)) if a and b else 0.0

    want = {}
    for entity in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == entity]
        vector, group = {r[2]: r[3] for r in mine}, {r[2]: {r[2]} for r in mine}
        for f, g in itertools.combinations(sorted({r[1] for r in mine}), 2):
            a, b = ([r[2] for r in mine if r[1] == k] for k in (f, g))
            if len(a) > len(b):
                a, b = b, a
            best = max(itertools.permutations(b, len(a)), key=lambda p: sum(cos(vector[x], vector[y]) for x, y in zip(a, p, strict=True)))
            for x, y in zip(a, best, strict=True):
                if cos(vector[x], vector[y]) >= threshold:
                    both = group[x] | group[y]
                    group.update(dict.fromkeys(both, both))
        for i, members in group.items():
            pairs = [cos(vector[x], vector[y]) for x, y in itertools.combinations(sorted(members), 2)]
            want[i] = (entity, min(members), len(members), sum(pairs) / len(pairs) if pairs else None)
    df = spark.createDataFrame(rows, "entity string, framing int, item long, vector array<double>")
    got = {r["item"]: r for r in clustering.match_framings(df, threshold).collect()}
    assert got.keys() == want.keys() and any(w[2] > 2 for w in want.values())
    for i, (entity, grp, size, mean) in want.items():
        assert (got[i]["entity"], got[i]["grp"], got[i]["size"]) == (entity, grp, size)
        assert got[i]["consistency"] is None if mean is None else abs(got[i]["consistency"] - mean) < 1e-9


def test_auction_total_equals_the_hungarian_one(spark):
    rng = np.random.default_rng(3)
    sides = {10: rng.normal(size=(7, 3)), 11: rng.normal(size=(8, 3)), 12: np.repeat(rng.normal(size=(2, 3)), 3, axis=0), 13: rng.normal(size=(1, 3))}
    unit = {k: v / np.linalg.norm(v, axis=1, keepdims=True) for k, v in sides.items()}
    unit[10][4] = 0  # like nothing
    rows = [(100 * k + n, k, None if not v.any() else v.tolist()) for k, m in unit.items() for n, v in enumerate(m)]
    members = spark.createDataFrame(rows, "node long, side long, v array<double>")
    pairs = [(0, 10, 11), (1, 11, 10), (2, 10, 12), (3, 13, 12), (4, 10, 99)]
    got = auction.assign(members, spark.createDataFrame(pairs, "pid long, side_a long, side_b long"), block=3, known=6, quantum=10**5).collect()
    for pid, a, b in pairs[:4]:
        mine = [(r["a"] - 100 * a, r["b"] - 100 * b) for r in got if r["pid"] == pid]
        sim = unit[a] @ unit[b].T
        assert len(mine) == min(sim.shape) == len({x for x, _ in mine}) == len({y for _, y in mine})
        assert abs(sum(sim[p] for p in mine) - sum(sim[p] for p in clustering.assignment(-sim))) < 1e-4
    assert all(r["pid"] < 4 for r in got)


def test_lots_of_bidders_outbid_one_another(spark):
    vectors = {0: [[1.0, 0.0], [0.8, 0.6], [0.6, 0.8]], 1: [[0.96, 0.28], [0.6, 0.8], [0.0, 1.0]]}
    members = spark.createDataFrame([(10 * k + n, k, v) for k, side in vectors.items() for n, v in enumerate(side)], "node long, side long, v array<double>")
    got = auction.assign(members, spark.createDataFrame([(7, 0, 1)], "pid long, side_a long, side_b long"), lot=1, quantum=25).collect()
    sim = np.array(vectors[0]) @ np.array(vectors[1]).T
    best = sum(np.rint(25 * sim[p]) for p in clustering.assignment(-np.rint(25 * sim)))
    assert sum(np.rint(25 * sim[r["a"], r["b"] - 10]) for r in got) == best and len(got) == 3


def test_large_entities_are_matched_as_small_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(e, f, 100 * f + n, rng.normal(size=3).tolist()) for e in ("e1", None) for f, many in ((0, 4), (1, 5), (2, 3)) for n in range(many)]
    rows = [(e, f, k, v) for k, (e, f, _, v) in enumerate(rows)] + [("e1", 0, 900, None), ("e2", None, 901, [1.0, 0.0]), ("e2", 1, 902, [2.0])]
    df = spark.createDataFrame(rows, "entity string, framing int, item long, vector array<double>")
    small, large = ({r["item"]: r for r in clustering.match_framings(df, 0.5, small=n, block=4, known=5).collect()} for n in (1000, 1))
    assert small.keys() == large.keys() == {r[2] for r in rows} and any(r["size"] > 1 for r in small.values())
    for i, r in small.items():
        assert (r["entity"], r["grp"], r["size"]) == (large[i]["entity"], large[i]["grp"], large[i]["size"])
        assert (r["consistency"] is None) == (large[i]["consistency"] is None) and abs((r["consistency"] or 0) - (large[i]["consistency"] or 0)) < 1e-9


def test_framings_of_large_entities_meet_in_pairs_without_an_auction(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("e", f, n, rng.normal(size=4).tolist()) for n, f in enumerate(rng.permutation([0] * 9 + [1] * 7 + [None] * 8))]
    df = spark.createDataFrame([(e, None if f is None else int(f), n, v) for e, f, n, v in rows], "entity string, framing int, item long, vector array<double>")
    whole = clustering.match_framings(df, 0.5, small=24).collect()
    monkeypatch.setattr(auction, "assign", lambda *_: pytest.fail("an auction"))
    parts = clustering.match_framings(df, 0.5, small=9).collect()
    plain = lambda found: sorted((r["item"], r["grp"], r["size"], round(r["consistency"] or 0, 9)) for r in found)
    assert plain(whole) == plain(parts) and any(r["size"] == 3 for r in whole)


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(7)
    for n, m in ((1, 1), (1, 3), (3, 1), (5, 5), (4, 7), (7, 4), (0, 2)):
        for cost in (rng.normal(size=(n, m)), rng.integers(0, 3, size=(n, m)).astype(float), np.zeros((n, m))):
            got = clustering.assignment(cost)
            short, long = sorted((n, m))
            c = cost if n <= m else cost.T
            best = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(long), short))
            assert len(got) == short == len({i for i, _ in got}) == len({j for _, j in got}) and got == sorted(got)
            assert abs(sum(cost[p] for p in got) - best) < 1e-9


def test_reachable_where_ways_meet(spark):
    e = [(1, 2), (2, 3), (3, 4), (4, 2), (1, 5), (5, 4), (6, 1), (7, 7), (4, 8)]
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)

    def depths(s, both=False):
        ways = {x: set(y) for x, y in near.items()}
        if both:
            for a, b in e:
                ways.setdefault(b, set()).add(a)
        d, order = {s: 0}, [s]
        for x in order:
            for y in ways.get(x, ()):
                if y not in d:
                    d[y] = d[x] + 1
                    order.append(y)
        return {(s, n, k) for n, k in d.items()}

    df = edges(spark, *[e])
    start = spark.createDataFrame([(n, n) for n in range(1, 9)], "start long, node long")
    assert {tuple(r) for r in graph.reachable(df, start).collect()} == set().union(*(depths(s) for s in range(1, 9)))
    assert {tuple(r) for r in graph.around(df, start, 50).collect()} == set().union(*(depths(s, True) for s in range(1, 9)))
    assert {tuple(r) for r in graph.around(df, start, 1).collect()} == {t for s in range(1, 9) for t in depths(s, True) if t[2] <= 1}
    two = spark.createDataFrame([("s", 6), ("s", 3)], "start string, node long")
    assert {(r["node"], r["depth"]) for r in graph.reachable(df, two).collect()} == {(6, 0), (3, 0), (1, 1), (4, 1), (2, 2), (5, 2), (8, 2)}
