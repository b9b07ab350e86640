"""Operators on small tables with the edges that their docstrings name."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import conflicts, curation, graph, integrity, jobs, knowledge, lifecycle, normalise, passes, provider, reports
from loomgraph.sources import snapshot

ENTITY = "id string, name string, entity_type string, status string, is_entrance boolean, seq long"
ASSERTION = "id string, subject_id string, predicate string, object_id string, confidence double, knowledge_origin string, status string, source_model string, evaluated boolean, seq long"


@pytest.fixture(scope="module")
def entities(spark):
    rows = [("e1", "Roof", "component", "accepted", False, 1), ("e2", "Walls", "component", "proposed", False, 2), ("e3", "Hall", "space", "accepted", True, 3), ("e4", "Old roof", "component", "merged", False, 4), ("e5", "IfcDoor", "ifc_class", "proposed", False, 5)]
    return spark.createDataFrame(rows, ENTITY)


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([("e1", "Covering", 1), ("e4", "Ancient", 2)], "entity_id string, alias string, seq long")


def column(df, c):
    return sorted(r[c] for r in df.collect())


def pairs(df, *cs):
    return sorted(tuple(r[c] for c in cs) for r in df.collect())


def test_contradictions_move_items_until_the_cap(spark):
    items = spark.createDataFrame([(f"i{k}", "deprecated" if k == 3 else "proposed", k == 9) for k in range(10)], "id string, status string, evaluated boolean")
    said = spark.createDataFrame([("i0", "i1", "contradictory"), ("i1", "i0", "duplicate"), ("i0", "i2", " Complementary"), ("i2", "i3", "CONTRADICTORY"), ("i4", "i5", "contradictory"), ("i6", "i7", "what"), ("i8", "i9", None)], "item_a_id string, item_b_id string, classification string")
    done = conflicts.apply_classes(items, said, "assertion")
    assert pairs(done["pairs"], "item_a_id", "item_b_id", "classification") == [("i0", "i1", "contradictory"), ("i0", "i2", "complementary"), ("i2", "i3", "contradictory"), ("i4", "i5", "contradictory"), ("i6", "i7", "unrelated")]
    assert column(done["log"], "item_id") == ["i0", "i1", "i2", "i4", "i5"]
    assert column(done["items"].where("status = 'conflicted'"), "id") == ["i0", "i1", "i2", "i4", "i5"]
    assert done["items"].where("not evaluated").count() == 1  # the deprecated one is not looked at
    # the queue is looked at before each item: the third fills it within its turn, later turns are paused
    assert column(conflicts.apply_classes(items, said, "assertion", cap=3)["log"], "item_id") == ["i0", "i1", "i2"]
    assert conflicts.apply_classes(items, said, "assertion", conflicted=3, cap=3)["log"].count() == 0
    cut = conflicts.apply_classes(items, said, "assertion", limit=2)
    assert cut["pairs"].count() == 2 and column(cut["items"].where("evaluated"), "id") == ["i0", "i9"]


def test_the_whole_conflict_batch(spark):
    a = [(f"a{k}", "s", "requires", f"o{k}", 0.9, "physical", "proposed", f"m{k % 2}", False, k) for k in range(4)] + [("h1", "s", "requires", "x", 0.9, "physical", "proposed", "m0", True, 5), ("h2", "s", "requires", "x", 0.9, "physical", "proposed", "m1", True, 6)]
    a = spark.createDataFrame(a, ASSERTION).withColumns({"cpc": F.lit(0.1), "framings": F.lit(1)})
    process = spark.createDataFrame([("p1", "x", "y", True, "m0", "proposed", 1), ("p2", "x", "y", False, "m1", "proposed", 2), ("p3", "u", "v", True, "m0", "proposed", 3), ("p4", "v", "u", True, "m0", "accepted", 4), ("p5", "w", "w", True, "m0", "proposed", 5)], "id string, predecessor_id string, successor_id string, hard_constraint boolean, source_model string, status string, seq long")
    nodes = spark.createDataFrame([("n1", "proposed", ["a0", "a1", "gone"]), ("n2", "proposed", ["a0", "a2", "gone"]), ("n3", "deprecated", ["a0"])], "id string, status string, child_ids array<string>")
    none = spark.createDataFrame([], "item_a_id string, item_a_type string, item_b_id string, item_b_type string, classification string")
    log = spark.createDataFrame([], "item_id string, item_type string, old_status string, new_status string, changed_at timestamp, changed_by string")
    vectors = spark.createDataFrame([("a0", [1.0, 0.0]), ("a1", [1.0, 0.1]), ("a2", [0.0, 1.0]), ("a3", [-1.0, 0.0])], "id string, vector array<double>")
    tables = {"assertions": a, "process": process, "abstractions": nodes, "pairs": none, "log": log}
    out = conflicts.batch(tables, {"assertions": vectors}, lambda c: c.withColumn("classification", F.lit("contradictory")))
    assert pairs(out["assertions"], "id", "status") == [("a0", "conflicted"), ("a1", "conflicted"), ("a2", "proposed"), ("a3", "proposed"), ("h1", "accepted"), ("h2", "accepted")]
    assert pairs(out["process"], "id", "status") == [("p1", "conflicted"), ("p2", "conflicted"), ("p3", "conflicted"), ("p4", "conflicted"), ("p5", "proposed")]
    assert pairs(out["abstractions"], "id", "status") == [("n1", "conflicted"), ("n2", "proposed"), ("n3", "deprecated")]
    assert pairs(out["pairs"], "item_a_id", "item_b_id") == [("a0", "a1"), ("p1", "p2"), ("p2", "p1")]
    assert column(out["log"], "item_id") == ["a0", "a1", "h1", "h2", "n1", "p1", "p2", "p3", "p4"]
    assert pairs(out["decisions"], "item_id", "decision") == [("h1", "accept"), ("h2", "accept"), ("p1", "defer"), ("p2", "defer")]
    assert pairs(lifecycle.pairs_for(out["pairs"], spark.createDataFrame([("p1",)], "id string")), "item_a_id") == [("p1",), ("p2",)]
    assert lifecycle.decisions_for(out["decisions"], spark.createDataFrame([("h1",), ("a0",)], "id string")).count() == 1


def test_means_are_not_rounded(spark):
    rows = [(f"{k}", "s", "requires", "o", c, "physical", "proposed", f"m{k}", True, k) for k, c in enumerate((0.7999996, 0.7999996))]
    assert lifecycle.promote_groups(spark.createDataFrame(rows, ASSERTION), ["subject_id"]).count() == 0


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, dst string")


def test_sequences_name_cycles_and_cuts(spark):
    names = spark.createDataFrame([(x, x.upper()) for x in "abcdxyz"], "id string, name string")
    e = edges(spark, ("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"))
    rows = {r["start"]: r for r in graph.sequences(e, spark.createDataFrame([(x,) for x in ("b", "x", "d", "s")], "start string"), names).collect()}
    assert rows["b"]["sequence"] == ["A", "B", "C"] and not rows["b"]["has_cycle"] and not rows["b"]["truncated"] and rows["b"]["entity"] == "B"
    assert rows["x"]["has_cycle"] and rows["x"]["cycle"] == "Y -> Z -> Y" and rows["x"]["n"] == 3
    assert rows["d"]["sequence"] == ["D"] and not rows["d"]["has_cycle"]
    assert rows["s"]["has_cycle"] and rows["s"]["cycle"] == "s -> s"
    short = graph.sequences(e, spark.createDataFrame([("a",)], "start string"), names, 1).first()
    assert short["sequence"] == ["A", "B"] and short["truncated"]
    text = reports.sequence_text(graph.sequences(e, spark.createDataFrame([("b",)], "start string"), names)).first()["text"]
    assert "  2. ● B" in text and "  1. → A" in text


def test_a_spatial_edge_hides_that_something_precedes(spark):
    e = spark.createDataFrame([("a", "b", "precedes", 6, 0, None, True), ("a", "b", "above", 7, 0, None, None), ("b", "c", "precedes", 6, 0, None, True)], "src string, dst string, edge_type string, phase int, seq long, assertion_id string, hard_constraint boolean").withColumn("edge_category", F.lit("x"))
    assert pairs(graph.precedes(e), "src", "dst") == [("b", "c")]
    assert graph.collapse_all(e).where("src = 'a'").first()["hard_constraint"] is True


def test_betweenness_of_a_random_graph(spark):
    rng = random.Random(5)
    e = [(a, b) for a, b in combinations("abcdefgh", 2) if rng.random() < 0.35]
    near = {x: {b if a == x else a for a, b in e if x in (a, b)} for x in sorted({x for p in e for x in p})}

    def paths(s, t):
        found, ahead = [], [[s]]
        while ahead and not found:
            found = [p for p in ahead if p[-1] == t]
            ahead = [[*p, y] for p in ahead for y in near[p[-1]] if y not in p]
        return found

    want = dict.fromkeys(near, 0.0)
    for s, t in combinations(near, 2):
        all_ = paths(s, t)
        for v in near:
            if v not in (s, t) and all_:
                want[v] += sum(v in p for p in all_) / len(all_)
    scale = 2 / ((len(near) - 1) * (len(near) - 2))
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(edges(spark, *e)).collect()}
    assert got == pytest.approx({v: w * scale for v, w in want.items()}, abs=1e-5)


def test_communities_of_two_cliques(spark):
    e = [(a + x, b + x) for x in "12" for a, b in combinations("abcd", 2)] + [("a1", "a2")]
    place = graph.communities(edges(spark, *e))
    assert pairs(place, "node", "community") == sorted((a + x, "a" + x) for x in "12" for a in "abcd")
    assert graph.modularity(edges(spark, *e), place) == pytest.approx(12 / 13 - 2 * (13 / 26) ** 2)


def test_curation_of_settings_names_and_entrances(spark, entities, aliases):
    config = curation.new_config(spark, {"log_format": "json"})
    assert curation.get_config(config, "log_format") == "json" and curation.get_config(config, "nothing") is None
    config, warning = curation.set_config(config, "query_max_results", "5")
    assert warning is None and curation.get_config(config, "query_max_results") == "5"
    config, warning = curation.set_config(config, "odd", "x")
    assert "odd" in warning and curation.set_config(config, "odd", None)[0].count() == len(curation.DEFAULTS)
    assert curation.list_config(config).first()["key"] == "api_enabled"
    merged, more = curation.merge_names(entities, aliases, spark.createDataFrame([("e2", "e1"), ("e1", "e1"), ("e3", "nobody")], "loser string, winner string"))
    assert column(merged.where("status = 'merged'"), "id") == ["e2", "e4"] and ("e1", "Walls") in pairs(more, "entity_id", "alias")
    assert pairs(curation.add_aliases(aliases, spark.createDataFrame([("e1", " covering ", 3), ("e1", "Lid", 4), ("e1", " ", 5)], aliases.schema)), "alias") == [("Ancient",), ("Covering",), ("Lid",)]
    marked = curation.set_entrance(entities, spark.createDataFrame([("e1",), ("e3",)], "id string"), True)
    assert pairs(marked.where("warning is not null"), "id", "is_entrance") == [("e1", True)]
    assert pairs(knowledge.resolve(spark.createDataFrame([("ancient",), ("COVERING ",), ("old roof",)], "name string"), entities, aliases), "name", "entity_id") == [("COVERING ", "e1"), ("ancient", None), ("old roof", None)]
    assert column(knowledge.resolve_like(entities, "%roof%"), "id") == ["e1", "e4"] and column(knowledge.resolve_like(entities, "%roof%", merged=False), "id") == ["e1"]


def test_patterns_are_inserted_updated_or_skipped(spark):
    have = spark.createDataFrame([("1", "A", "old", "old", "human", 0.5), ("2", "B", "old", "old", "human", 0.5)], "id string, name string, problem string, solution string, source_model string, confidence double")
    new = spark.createDataFrame([("A", "**", "S", "p", "s", ["x"], True), ("B", "*", "S", "p", "s", [], False), ("C", "*", "", "p", "s", [], False)], "name string, confidence string, section string, problem string, solution string, related_pattern_names array<string>, paraphrased boolean")
    rows, counts = curation.import_patterns(have, new, F.col("paraphrased"), "model")
    assert pairs(rows, "name", "problem", "source_model", "confidence") == [("A", "p", "model", 0.5), ("B", "old", "human", 0.5), ("C", "p", "model", 0.8)]
    assert dict(pairs(counts, "outcome", "n")) == {"inserted": 1, "updated": 1, "skipped": 1}


def test_property_sets_are_seeded_once(spark, entities, aliases):
    seed = spark.createDataFrame([("covering", "IfcRoof", "Pitch"), ("nobody", "X", "Y")], "entity_name string, ifc_class string, property_name string")
    empty = spark.createDataFrame([], "entity_id string, ifc_class string, property_name string, source_model string")
    one = curation.seed_psets(empty, seed, entities, aliases)
    assert pairs(one, "entity_id", "property_name") == [("e1", "Pitch")]
    own = one.unionByName(spark.createDataFrame([("e2", "W", "Z", "human")], one.schema))
    assert curation.seed_psets(own, seed, entities, aliases).count() == 2 and curation.seed_psets(own, seed, entities, aliases, force=True).count() == 2


def test_passes_write_what_answers_give(spark, entities, aliases):
    names = passes.lookup(entities, aliases)
    assert dict(pairs(names.where("key in ('wall', 'walls', 'roofs', 'covering', 'ancient', 'old roof')"), "key", "entity_id")) == {"wall": "e2", "walls": "e2", "roofs": "e1", "covering": "e1"}
    groups = spark.createDataFrame([("e1", 1, 2, "requires", "Wall", 0.8), ("e1", 1, 1, "depends_on", "walls", 0.60001), ("e1", 2, 3, "requires", "Roof", 0.5), ("e1", 3, 4, "requires", " ", 0.5), ("e1", 4, 5, "requires", "void", 0.5)], "subject_id string, grp long, seq long, predicate string, object string, confidence double").withColumns({"knowledge_origin": F.lit("physical"), "rationale": F.lit(""), "source_model": F.lit("m"), "consistency": F.lit(0.9), "size": F.lit(2)})
    assert pairs(passes.assertions(groups, names), "predicate", "object_id", "confidence", "framings") == [("depends_on", "e2", 0.7, 2)]
    anti = spark.createDataFrame([("e1", " Leak ", 0.123456, "m"), ("e1", " ", 0.5, "m"), ("e1", None, 0.5, "m")], "subject_id string, name string, confidence double, source_model string")
    assert pairs(passes.antipatterns(anti), "name", "confidence", "status") == [("Leak", 0.1235, "proposed")]
    pat = spark.createDataFrame([("e1", "A", "p", " s ", 0.5, "m"), ("e1", "B", " ", "s", 0.5, "m"), ("e5", "C", "p", "s", 0.5, "m")], "subject_id string, name string, problem string, solution string, confidence double, source_model string")
    assert pairs(passes.patterns(pat, entities), "name", "solution") == [("A", "s")]
    mentions = spark.createDataFrame([("IfcDoor", "", 1), ("IFCDOOR", "", 2), ("IfcWall", "w", 3), ("Ifcwall", "", 4), ("Door", "", 5)], "name string, description string, seq long")
    rows, new = passes.schema_classes(mentions, entities)
    assert pairs(new, "name", "description", "knowledge_origin") == [("IfcWall", "w", "schema")] and rows.where("entity_id = 'e5'").count() == 1 and rows.count() == 3
    assert pairs(passes.mentioned_classes(spark.createDataFrame([(1, "an IfcSlab and IfcSlab. xIfcNo")], "doc_id long, text string")), "name") == [("IfcSlab",), ("IfcSlab",)]


def test_findings_change_items(spark):
    rows = spark.createDataFrame([(i, "proposed", ["known"], []) for i in "abcd"], "id string, status string, exceptions array<string>, applicability array<string>")
    said = [("a", "exception", "known", 0.9, "m1", 1), ("a", "exception", "new", 0.8, "m1", 2), ("a", "exception", "new", 0.99, "m2", 3), ("b", "context_limitation", "office", 0.7, "m1", 4), ("c", "potential_error", "wrong", 0.9, "m1", 5), ("c", "potential_error", "bad", 0.95, "m2", 6), ("d", "potential_error", "wrong", 0.9, "m1", 7), ("d", "scope_restriction", "here", 0.9, "m1", 8), ("b", "exception", "weak", 0.5, "m1", 9), ("gone", "exception", "x", 0.9, "m1", 10)]
    done = passes.apply_findings(rows, passes.findings(spark.createDataFrame(said, "item_id string, finding_type string, detail string, confidence double, model string, seq long")))
    got = {r["id"]: r for r in done["assertions"].collect()}
    assert got["a"]["exceptions"] == ["known", "new"] and got["b"]["applicability"] == ["office"] and got["b"]["exceptions"] == ["known"]
    assert [got[i]["status"] for i in "abcd"] == ["proposed", "proposed", "conflicted", "proposed"]
    assert pairs(done["decisions"], "item_id", "rationale", "reviewer") == [("c", "bad", "m2"), ("d", "scope_restriction: here", "m1")]
    assert column(done["log"], "item_id") == ["c"] and dict(pairs(done["outcomes"], "outcome", "n")) == {"exception": 1, "context_limitation": 1, "conflicted": 1, "logged": 2, "deferred": 1, "missing": 1}


def test_passes_resume(spark, entities):
    progress = spark.createDataFrame([("3", "e1", "m", "completed"), ("3", "e2", "m", "failed"), ("10a", "__global__", "m", "completed")], "pass_number string, entity_id string, model string, status string")
    units = entities.select(F.col("id").alias("entity_id"))
    left = passes.outstanding(units, progress, "3", "m")
    assert column(left, "entity_id") == ["e2", "e3", "e4", "e5"]
    done = passes.completed(progress, left, "3", "m")
    assert passes.outstanding(units, done, "3", "m").isEmpty() and passes.completed(done, left, "3", "m").count() == done.count()
    assert pairs(passes.statuses(progress), "pass_number", "done") == [("10a", True), ("10b", False), ("10c", False)]
    assert passes.reset(progress, ("10a",)).count() == 2
    assert passes.counts(entities, entities, "r", "before").first()[2:] == (5, 5)
    tables = {"progress": progress, "embeddings": units}
    ran = []
    step = lambda n: lambda t: ran.append(n) or t
    out, did = jobs.normalise(tables, {n: step(n) for n in ("10a", "10b", "10c")}, "m", lambda t: t)
    assert did == ["10b", "10c"] == ran and jobs.normalise(out, {"10b": step("10b")}, "m", lambda t: t)[1] == []
    again, did = jobs.normalise(out, {"10a": step("10a")}, "m", lambda t: t, again=True)
    assert did == ["10a"] and again["embeddings"].isEmpty()


def test_jobs_run_in_order_and_alone(tmp_path, spark, entities, monkeypatch):
    assert jobs.steps(["x", "y"], ["11", "12", "2", "1", "10"]) == [("1", "x"), ("1", "y"), ("2", None), ("10", None), ("12", "x"), ("12", "y"), ("11", "x"), ("11", "y")]
    counts = iter([(1, 2), (3, 4)])
    ledger = jobs.extract(["x"], ["1"], lambda n, m: None, lambda: next(counts))
    assert ledger["steps"] == [("1", "x")] and ledger["entities_after"] == 3
    with jobs.exclusive(f"{tmp_path}/lock"):
        with pytest.raises(RuntimeError, match="locked"), jobs.exclusive(f"{tmp_path}/lock"):
            pass
    with jobs.exclusive(f"{tmp_path}/lock"):
        pass
    (tmp_path / "pointer").write_text("there\n")
    assert jobs.store_path("flag", {}) == "flag" and jobs.store_path(None, {"LOOMGRAPH_STORE": "env"}) == "env"
    assert jobs.store_path(None, {}, f"{tmp_path}/pointer") == "there" and jobs.store_path(None, {}, f"{tmp_path}/none") == "store"
    assert jobs.size_warning(entities, 5) is None and "5 nodes" in jobs.size_warning(entities, 4)


def test_providers_are_routed_and_retried(spark):
    assert provider.route("ollama/small") == ("ollama", "small") and provider.route("other")[0] == "openai" and provider.route("claude-x")[0] == "anthropic"
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return "done"

    assert provider.with_retry(flaky, sleep=waits.append) == "done" and 0.9 <= waits[0] <= 1.1 and 1.8 <= waits[1] <= 2.2
    refused = type("Refused", (Exception,), {"status_code": 401})
    with pytest.raises(provider.FatalError):
        provider.with_retry(lambda: (_ for _ in ()).throw(refused()), sleep=waits.append)
    asked = type("Asked", (Exception,), {"response": type("R", (), {"headers": {"Retry-After": "7"}})()})
    with pytest.raises(asked):
        provider.with_retry(lambda: (_ for _ in ()).throw(asked()), sleep=waits.append)
    assert waits[-2:] == [7.0, 7.0]
    rows = spark.createDataFrame([(" YES",), ("dunno",), (None,)], "a string")
    assert [r[0] for r in rows.select(provider.chosen(F.col("a"), ["no", "yes"])).collect()] == ["yes", "no", "no"]
    fake = provider.Fake({("s", "Roof"): {"x": 1}}, {"q": "B "})
    assert fake.extract("p", "s", "Roof") == {"x": 1} and fake.classify("q", ["a", "b"]) == "b"
    with pytest.raises(KeyError):
        fake.extract("p", "s", None)
    prompts = spark.createDataFrame([("m", "one"), ("m", "two"), ("m", "two")], "model string, prompt string")
    cache = prompts.limit(1).select("model", F.sha2("prompt", 256).alias("prompt_hash"), F.lit("kept").alias("response"))
    answers, new = provider.cached(prompts, cache, str.upper)
    assert pairs(answers, "prompt", "response") == [("one", "kept"), ("two", "TWO"), ("two", "TWO")] and new.count() == 1
    assert snapshot.put_cache(cache, new).count() == 2 and snapshot.get_cache(snapshot.put_cache(cache, new), prompts).where("response is null").isEmpty()
    p = spark.createDataFrame([("A", "p", "s", False, "h"), ("B", "p", "s", True, "h")], "name string, problem string, solution string, paraphrased boolean, source_model string")
    assert pairs(provider.paraphrase(p, lambda t: t.split("\n")[1] * 2, "m"), "name", "problem", "source_model") == [("A", "pp", "m"), ("B", "p", "h")]
    c = spark.createDataFrame([("c1234567890", "e1", "no leaks", "hard")], "id string, subject_id string, rule string, constraint_type string")
    a = spark.createDataFrame([("a1", "e1", "requires", "e2", "accepted"), ("a2", "e2", "requires", "e1", "accepted"), ("a3", "e1", "requires", "e1", "accepted"), ("a4", "e1", "requires", "e2", "proposed")], "id string, subject_id string, predicate string, object_id string, status string")
    checked = provider.check_constraints(c, a, lambda t: "PASS")
    assert column(checked, "assertion_id") == ["a1", "a2", "a3"] and "[c1234567]" in checked.first()["prompt"]


def test_the_index_embeds_only_what_changed(spark, entities):
    embed = lambda df, c: provider.embed(df, c)
    none = spark.createDataFrame([], "item_id string, model string, content_hash string, vector array<double>")
    first = snapshot.build_index(entities, none, embed)
    assert column(first, "item_id") == ["e1", "e2", "e3", "e5"]
    renamed = entities.withColumn("name", F.when(F.col("id") == "e1", "Lid").otherwise(F.col("name")))
    assert snapshot.missing_vectors(renamed, first).count() == 1 and snapshot.build_index(renamed, first, embed).count() == 4
    assert integrity.foreign_vectors(first, "other").first()["n"] == 4
    assert np.isclose(np.linalg.norm(provider.hashed_vector("roof")), 1) and not provider.hashed_vector("  ").any()


def test_references_are_filled_in_order(spark):
    items = spark.createDataFrame([("f1", "Noise", "accepted", 1), ("f2", "noise", "accepted", 2), ("f3", "Daylight", "accepted", 3), ("f4", "Gone", "deprecated", 4)], "id string, name string, status string, seq long")
    owners = spark.createDataFrame([("p1", [" NOISE ", "light", "gone", ""], ["f3"]), ("p2", [], []), ("f1", ["noise", "daylight"], [])], "id string, names array<string>, ids array<string>")
    vectors = spark.createDataFrame([("light", [1.0, 0.1]), ("daylight", [1.0, 0.0]), ("noise", [0.0, 1.0]), ("gone", [0.7, 0.7])], "key string, vector array<double>")
    rows, pending = normalise.fill_references(owners, items, "names", "ids", vectors, others_only=True)
    got = {r["id"]: (r["names"], r["ids"]) for r in rows.collect()}
    assert got == {"p1": ([], ["f3", "f1"]), "p2": ([], []), "f1": ([], ["f2", "f3"])}
    assert pairs(pending, "id", "name") == [("p1", "gone")]
    same, none = normalise.fill_references(owners, items.limit(0), "names", "ids")
    assert pairs(same, "id", "names") == pairs(owners, "id", "names") and none.isEmpty()


def test_predicates_are_mapped_by_bands_and_answers(spark):
    a = spark.createDataFrame([(p,) for p in ("needs", "touches", "odd", "kept", "requires")], "predicate string")
    at = lambda x: [float(np.cos(x)), float(np.sin(x))]
    vectors = spark.createDataFrame([("requires", at(0.0)), ("connects_to", at(1.5)), ("needs", at(0.1)), ("touches", at(0.7)), ("odd", at(4.0))], "key string, vector array<double>")
    core = ("requires", "connects_to")
    early = spark.createDataFrame([("kept", "requires")], "from_predicate string, to_predicate string")
    said = spark.createDataFrame([("touches", " Connects_To "), ("odd", "requires")], "predicate string, answer string")
    plan = normalise.predicate_plan(a, vectors, core, early, said, "m")
    assert pairs(plan, "predicate", "canonical", "how") == [("kept", "requires", "mapped"), ("needs", "requires", "embedding"), ("odd", None, "pending"), ("touches", "connects_to", "llm:m")]
    assert ("touches", None, "pending") in pairs(normalise.predicate_plan(a, vectors, core), "predicate", "canonical", "how")


def test_abstractions_pass_their_judge(spark):
    made = spark.createDataFrame([("n1", ["a"], "p"), ("n2", ["b"], "p")], "id string, child_ids array<string>, prompt string")
    said = spark.createDataFrame([("n1", "S", "r", 0.9), ("n2", "T", "r", 0.9)], "id string, statement string, abstraction_rationale string, confidence double")
    verdict = spark.createDataFrame([("n1", " YES ")], "id string, verdict string")
    rows = normalise.accept_abstractions(made, said, verdict, "m", "other")
    assert column(rows, "id") == ["n2"] and normalise.accept_abstractions(made, said, verdict, "m", "m").count() == 2
    assert column(normalise.parents(rows, spark.createDataFrame([("b",), ("c",)], "id string")), "id") == ["n2"] and normalise.proposed(rows).count() == 1


def test_ground_truth_is_covered_exactly_or_nearly(spark):
    row = lambda i, o, m, s="accepted": (i, "s", "requires", o, 1.0, "human", s, m, True, 1)
    truth = spark.createDataFrame([row("t1", "a", "human"), row("t2", "b", "human"), row("t3", "c", "human")], ASSERTION)
    rows = spark.createDataFrame([row("r1", "a", "m"), row("r2", "x", "m"), row("r3", "c", "m", "proposed")], ASSERTION)
    vectors = spark.createDataFrame([("t2", [1.0, 0.1]), ("t3", [0.0, 1.0]), ("r1", [-1.0, 0.0]), ("r2", [1.0, 0.0])], "id string, vector array<double>")
    coverage, unmatched = normalise.verify(truth, rows, vectors)
    assert coverage.first()[:] == (3, 2, 0.666667, False) and column(unmatched, "id") == ["t3"]
    assert normalise.verify(truth.limit(0), rows)[0].first()["passed"]


def test_snapshots_round_trip_by_name(spark, entities):
    a = spark.createDataFrame([("a1", "e1", "requires", "e2", 0.9, "physical", "accepted", "m", True, 1), ("a2", "e4", "requires", "zz", 0.9, "physical", "proposed", "m", True, 2)], ASSERTION)
    anti = spark.createDataFrame([("x1", "Leak", None, "accepted", 0.5, "physical", "m")], "id string, name string, subject_id string, status string, confidence double, knowledge_origin string, source_model string")
    out = snapshot.export_all({"entities": entities, "assertions": a, "antipatterns": anti})
    assert pairs(out["assertions"], "subject", "object") == [("Roof", "Walls"), ("e4", "zz")] and out["antipatterns"].first()["subject"] == ""
    empty = {"entities": entities.limit(0), "assertions": a.limit(0), "antipatterns": anti.limit(0)}
    new = out | {"entities": out["entities"].unionByName(spark.createDataFrame([("", "x", "space", "proposed")], "id string, name string, entity_type string, status string"))}
    back, counts = snapshot.import_all(empty, new)
    assert {r["item_type"]: (r["added"], r["skipped"]) for r in counts.collect()} == {"entities": (5, 1), "assertions": (1, 1), "antipatterns": (1, 0)}
    assert pairs(back["assertions"], "id", "subject_id", "object_id", "source_model", "seq") == [("a1", "e1", "e2", "imported", None)]
    twice, counts = snapshot.import_all(back, new)
    assert counts.agg(F.sum("added")).first()[0] == 0 and twice["entities"].count() == 5


def test_dates_fall_back(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05+02:00",), ("2024-01-02 03:04:05",), ("nonsense",), (None,)], "d string")
    got = rows.select(scalars.format_date(scalars.parse_date(F.col("d"), F.lit("2000-01-01").cast("timestamp")))).collect()
    assert [r[0] for r in got] == ["2024-01-02T01:04:05", "2024-01-02T03:04:05", "2000-01-01T00:00:00", "2000-01-01T00:00:00"]
    texts = rows.limit(1).select(scalars.assertion_text(F.lit("requires"), F.lit(""), F.array(F.lit("a"), F.lit("b"))), scalars.constraint_text(F.lit("hard"), F.lit("r")), scalars.pattern_text(F.lit("n"), F.lit("x" * 200))).first()
    assert texts[0] == "requires | a; b" and texts[1] == "hard: r" and texts[2] == "n: " + "x" * 120


def test_pages_are_chunked_and_patterns_read(spark):
    docs = spark.createDataFrame([("d", "\f".join(["one", " ", "three", "four", "five", "six"])), ("blank", " \f ")], "doc_id string, text string")
    assert pairs(snapshot.page_chunks(docs), "chunk_id", "text") == [("d_p1-5", "one\nthree\nfour\nfive"), ("d_p6-6", "six")]
    html = '<h2>Towns</h2><details class="pattern" id="gate"><summary>53 Main Gate**</summary><div class="pattern-content"><p class="higher-patterns">see <a href="#town">12 Town*</a></p><p><strong>Problem:</strong> No <strong>edge</strong>.</p><p>More.</p><p><strong>Solution:</strong> Mark it.</p><p class="lower-patterns"><a href="#door">110 Door</a></p></div></details><p>after</p>'
    row = snapshot.pattern_rows(spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id long, html string")).collect()
    assert len(row) == 1 and row[0].asDict() == {"page_id": 1, "number": 53, "slug": "gate", "name": "Main Gate", "confidence": "**", "section": "Towns", "problem": "No edge.\nMore.", "solution": "Mark it.", "higher": ["town"], "lower": ["door"], "related_pattern_names": ["Town", "Door"]}


def test_stores_refuse_other_versions(spark, tmp_path, entities):
    path = f"file://{tmp_path}/store"
    nodes, e = graph.build({"entities": entities, "assertions": spark.createDataFrame([("a1", "e1", "requires", "e2", 0.9, "physical", "accepted", "m", True, 1), ("a2", "e1", "requires", "e9", 0.9, "physical", "accepted", "m", True, 2)], ASSERTION)})
    assert nodes.count() == 7 and pairs(e, "src", "dst", "assertion_id") == [("e1", "e2", "a1")]
    snapshot.save_store({"nodes": nodes, "edges": e}, path)
    assert snapshot.load_store(spark, path)["nodes"].count() == 7
    manifest = tmp_path / "store" / "versions" / "1.json"
    (manifest.parent / "2.json").write_text(manifest.read_text().replace('"format": 1', '"format": 2'))
    with pytest.raises(ValueError, match="format 2"):
        snapshot.load_store(spark, path)
    (tmp_path / "names").write_text("Roof\n\n  Wall \n")
    assert column(snapshot.read_names(spark, f"file://{tmp_path}/names"), "name") == ["Roof", "Wall"]


def test_integrity_is_checked_and_repaired(spark):
    items = spark.createDataFrame([("a", "conflicted"), ("b", "conflicted"), ("c", "deprecated")], "id string, status string")
    found = spark.createDataFrame([("a", "x"), ("a", "c")], "item_a_id string, item_b_id string")
    rows, left = integrity.repair(items, found)
    assert pairs(rows, "id", "status") == [("a", "conflicted"), ("b", "proposed"), ("c", "deprecated")] and pairs(left, "item_b_id") == [("x",)]
    items.createOrReplaceTempView("seen_view")
    assert integrity.view_exists(spark, "seen_view") and not integrity.view_exists(spark, "no_such_view")
    pending = spark.createDataFrame([("d", "validation_failure"), ("e", "unresolved_ref")], "description string, failure_type string")
    assert column(integrity.failed_references(pending), "description") == ["d"]


def test_the_service_answers_by_name(spark, entities, aliases):
    a = spark.createDataFrame([("a1", "e1", "requires", "e2", 0.9, "physical", "accepted", "m", True, 1), ("a2", "e3", "requires", "e1", 0.95, "cultural", "accepted", "m", True, 2), ("a3", "e1", "requires", "e3", 0.99, "physical", "proposed", "m", True, 3)], ASSERTION)
    forces = spark.createDataFrame([("f1", "More light", "increase", ["e1"], 0.5, "accepted", "physical", "why")], "id string, name string, direction string, affects array<string>, confidence double, status string, knowledge_origin string, rationale string")
    s = reports.Service({"entities": entities, "aliases": aliases, "assertions": a, "forces": forces, "constraints": a, "antipatterns": a, "edges": edges(spark, ("e1", "e2")).withColumn("edge_type", F.lit("precedes"))})
    assert s.ready() and [r["id"] for r in s.query("assertion", " COVERING").collect()] == ["a2", "a1"]
    assert s.query("assertion", "roof", include_proposed=True).count() == 3
    assert s.query("force", "Roof").first()["id"] == "f1" and s.query("process", "Roof").first()["sequence"] == ["Roof", "Walls"]
    assert s.query("constraint", "nobody").first().asDict() == {"error": "entity_not_found", "query": "nobody"}
    with pytest.raises(ValueError, match="unknown type"):
        s.query("pattern", "roof")
    assert reports.text(forces, "force").first()["text"] == "  [INCREASE] More light\n    confidence=0.50  origin=physical  status=accepted\n    rationale: why"
    asked = spark.createDataFrame([("Roof", "likes", "Hall", "r", None, None), ("Roof", "x", "none", "r", 0.9, "physical")], "subject string, predicate string, object string, rationale string, confidence double, origin string")
    assert pairs(knowledge.proposed_rows(asked, entities, aliases), "subject_id", "object_id", "confidence", "knowledge_origin", "status") == [("e1", "e3", 0.7, "architectural", "proposed")]
    with pytest.raises(ValueError, match="knowledge_origin"):
        reports.by_repository(entities, origin="physical")


def test_compliance_rules(spark):
    spaces = spark.createDataFrame([("s1", "Kitchen - main", ""), ("s2", "", "My Kitchen 2"), ("s3", "attic", "")], "space string, usage string, name string")
    bounds = spark.createDataFrame([("s1", "c1", "IfcCovering"), ("s1", "w1", "IfcWindow"), ("s2", "c2", "IfcCovering"), ("s2", "d1", "IfcDoor")], "space string, element string, ifc_class string")
    layers = spark.createDataFrame([("c1", "Tiles"), ("c2", "Carpet"), ("x", "Wool insulation")], "element string, material string")
    elements = spark.createDataFrame([("x", "IfcWall"), ("v", "IfcValve")], "element string, ifc_class string")
    needs = spark.createDataFrame([("Kitchen", "requires", o, 0.9) for o in ("Flooring", "Anti-slip Flooring", "Windows", "Plumbing System", "Heating System", "Insulation", "Ceiling")], "entity string, predicate string, object string, confidence double")
    rows = reports.check(reports.space_facts(spaces, bounds, layers), needs, reports.model_facts(elements, layers))
    got = {(r["object"], r["space"]): (r["outcome"], r["detail"]) for r in rows.collect()}
    assert got["Flooring", None][0] == "PASS" and got["Anti-slip Flooring", "s1"] == ("PASS", "approved material: tiles") and got["Anti-slip Flooring", "s2"][0] == "FAIL"
    assert got["Windows", "s1"] == ("PASS", "1 window(s)") and got["Windows", "s2"] == ("FAIL", "no windows found")
    assert got["Plumbing System", None][0] == "PASS" and got["Heating System", None][0] == "FAIL" and got["Insulation", None][0] == "PASS" and got["Ceiling", None][0] == "UNCHECKED"
    assert dict(pairs(reports.totals(rows), "outcome", "n")) == {"PASS": 5, "FAIL": 3, "UNCHECKED": 1} and reports.failures(rows).count() == 3
