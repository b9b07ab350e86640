"""Graph operators over edge tables (src, dst): construction, reachability, levels, cycles, degrees, triangles, betweenness.

Loops keep their frontier in written tables of the shared folder, so lineage stays short and lost executors are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from loomgraph.functions.scalars import pattern_section, slug
from loomgraph.operators import pieces
from loomgraph.operators.components import components
from loomgraph.operators.leveling import longest
from loomgraph.session import Scratch, ship


#: Rows that the layers or distances of one part of the sources hold, about.
ROWS = 50_000_000


def typed_edges(parts: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """(src, dst, edge_type, phase, seq) of several edge tables in the order of their phases."""
    out = None
    for kind, phase, df in parts:
        part = df.select("src", "dst", F.lit(kind).alias("edge_type"), F.lit(phase).alias("phase"), F.col("seq") if "seq" in df.columns else F.lit(0).cast("long").alias("seq"))
        out = part if out is None else out.unionByName(part)
    return out


def collapse(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst): the last written one names the type."""
    return edges.groupBy("src", "dst").agg(F.max_by("edge_type", F.struct("phase", "seq", "edge_type")).alias("edge_type"), F.count("*").alias("n"))


def reachable(edges: DataFrame, start: DataFrame, max_depth: int = 1_000_000) -> DataFrame:
    """(start, node, depth) of everything reachable from start (columns start, node), breadth first; start itself at 0.

    A node that one edge leads to is new when its only predecessor was, unless it is where the search began; so only nodes
    that several edges lead to are compared with what was found before, and only with those.
    """
    save = Scratch(edges, "reach")
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    met = save(step.groupBy("next").agg(F.count("*").alias("n")).where("n > 1").select(F.col("next").alias("at")))
    crossed = not met.isEmpty()
    step = save(step.join(met, F.col("next").eqNullSafe(F.col("at")), "left").select("node", "next", F.coalesce(F.lit(crossed) & (F.col("at").isNotNull() | F.col("next").isNull()), F.lit(False)).alias("many")))
    roots = save(start.select("start", "node").distinct().withColumns({"depth": F.lit(0), "many": F.lit(True)}))
    kinds = dict(roots.dtypes)
    own = kinds["start"] == kinds["node"] and roots.where(~F.col("start").eqNullSafe(F.col("node"))).isEmpty()  # every start begins at itself
    frontier = found = known = roots
    for depth in range(1, max_depth + 1):
        ahead = frontier.select("start", "node").join(step, "node").select("start", F.col("next").alias("node"), "many")
        one = ahead.where("not many").select("start", "node")
        new = one.where(~F.col("node").eqNullSafe(F.col("start"))) if own else one.join(roots, ["start", "node"], "left_anti")
        new = new.withColumn("many", F.lit(False))
        if crossed:
            several = ahead.where("many").select("start", "node").distinct().join(known, ["start", "node"], "left_anti")
            new = new.unionByName(several.withColumn("many", F.lit(True)))
        frontier = save(new.select("start", "node", F.lit(depth).alias("depth"), "many"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        known = known.unionByName(frontier.where("many")) if crossed else known
    return found.select("start", "node", "depth")


def around(edges: DataFrame, start: DataFrame, max_depth: int = 50) -> DataFrame:
    """(start, node, depth) of everything within max_depth steps of start (columns start, node) along edges in either direction."""
    save = Scratch(edges, "around")
    return _layers(save(_both(edges).distinct()), start.select("start", "node").distinct(), save, max_depth)


def unreachable(nodes: DataFrame, edges: DataFrame, entrances: DataFrame) -> DataFrame:
    """nodes (id) that no entrance (id) leads to."""
    seen = reachable(edges, entrances.select(F.lit(0).alias("start"), F.col("id").alias("node"))).select(F.col("node").alias("id"))
    return nodes.join(seen, "id", "left_anti")


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from a source, for nodes that no cycle blocks. Nodes on or behind cycles are missing."""
    return longest(edges)


def has_cycle(edges: DataFrame) -> bool:
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(levels(edges), "node", "left_anti").limit(1).count() > 0


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for strongly connected components of two nodes or more, named by their smallest node.

    Trim nodes without a way in or out, colour the rest by the largest node that reaches them, and take for each root of
    a colour what reaches back within the colour; repeat on what is left. Self-loops are no cycles here.
    """
    save = Scratch(edges, "scc")
    rest = save(edges.where("src <> dst").select("src", "dst").distinct())
    out = None
    while True:
        size = -1
        while (n := rest.count()) not in (size, 0):
            size = n
            trimmed = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            rest = save(trimmed.join(trimmed.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if n == 0:
            break
        colour = save(rest.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            pushed = rest.join(colour, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "colour").unionByName(colour)
            new = save(pushed.groupBy("node").agg(F.max("colour").alias("colour")))
            moved = new.join(colour.withColumnRenamed("colour", "old"), "node").where("colour <> old").limit(1).count()
            colour = new
            if not moved:
                break
        inside = rest.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("node = colour").select(F.col("colour").alias("start"), "node")
        found = save(reachable(back, roots).select(F.col("start").alias("colour"), "node"))
        named = found.join(found.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1"), "colour").select("node", "component")
        out = named if out is None else out.unionByName(named)
        gone = found.select("node")
        rest = save(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return out if out is not None else rest.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges, a self-loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def top_subgraph(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the k nodes of highest degree."""
    top = F.broadcast(degree(edges).orderBy(F.col("degree").desc(), "node").limit(k).select("node"))
    return edges.join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(top.withColumnRenamed("node", "dst"), "dst", "left_semi")


def histogram(degrees: DataFrame, bins=(0, 5, 10, 15, 20, 25, 30, 50)) -> DataFrame:
    low = F.lit(bins[0])
    for b in bins[1:]:
        low = F.when(F.col("degree") >= b, F.lit(b)).otherwise(low)
    return degrees.groupBy(low.alias("bin")).agg(F.count("*").alias("n"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles) by joining edges directed from lower to higher degree, which bounds the fan-out of hubs."""
    e = undirected(edges)
    d = degree(e)
    o = e.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    o = o.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedges = o.join(o.select("u", F.col("v").alias("w")), "u").where("v < w")
    closed = wedges.join(e.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"], "left_semi")
    return closed.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def cross_sections(edges: DataFrame, sections: DataFrame) -> DataFrame:
    """(section_a, section_b, n): edges between different sections (node, section), unordered."""
    a, b = sections.select(F.col("node").alias("src"), F.col("section").alias("x")), sections.select(F.col("node").alias("dst"), F.col("section").alias("y"))
    rows = edges.join(a, "src").join(b, "dst").where("x <> y")
    return rows.groupBy(F.least("x", "y").alias("section_a"), F.greatest("x", "y").alias("section_b")).agg(F.count("*").alias("n"))


def twins(e: DataFrame, save: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members, both) of undirected edges whose nodes with the same neighbours are one: members (node, rep), both (src, dst, ms, md).

    Twins are no neighbours of one another, are two steps apart, and are as far as one another from all else, so distances
    and shortest paths of one speak for all. rep is the smallest of them, ms and md say how many nodes src and dst stand
    for. Sums of hashes propose twins and a join of their edges with those of rep proves them, so no neighbourhood is
    gathered. No two of what is left are twins.
    """
    both = save(_both(e))
    hashes = [F.sum(F.xxhash64("dst", F.lit(seed)).cast("decimal(20,0)")).alias(f"h{seed}") for seed in (1, 2)]
    marks = save(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"), *hashes))
    key = ["k", "h1", "h2"]
    guess = save(marks.join(marks.groupBy(*key).agg(F.min("node").alias("rep")), key).where("node <> rep").select("node", "rep", "k"))
    own = guess.join(both, F.col("node") == F.col("src")).select("node", "rep", "k", "dst")
    shared = own.join(both.select(F.col("src").alias("rep"), "dst"), ["rep", "dst"]).groupBy("node", "rep", "k").agg(F.count("*").alias("same"))
    proven = shared.where("same = k").select("node", "rep")
    members = save(marks.select("node").join(proven, "node", "left").select("node", F.coalesce("rep", "node").alias("rep")))
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    heads = save(sizes.select(F.col("rep").alias("node"), "n"))
    thin = both.join(heads.select(F.col("node").alias("src"), F.col("n").alias("ms")), "src").join(heads.select(F.col("node").alias("dst"), F.col("n").alias("md")), "dst")
    return members, save(thin.select("src", "dst", "ms", "md"))


def betweenness(edges: DataFrame, parts: int | None = None, rows: int = ROWS) -> DataFrame:
    """(node, betweenness), normalised, undirected, by Brandes' accumulation as joins: layers outward from every source, then back.

    Nodes with the same neighbours count as one that stands for all of them (twins): it is one source, weighs as many as
    it stands for, and its twins, two steps away, add what they owe to its neighbours. A layer holds (source, node, paths)
    and is written. Sources go in parts, so many that the layers of one hold about rows rows; after each part the sums so
    far are folded into one table and its layers are deleted. A layer is told from what was seen by the two layers before
    it. Nodes that lie on no shortest path have 0. Without twins this is all sources times all edges.
    """
    save = Scratch(edges, "between")
    members, both = twins(save(undirected(edges)), save)
    n = members.count()
    nodes = save(members.groupBy(F.col("rep").alias("node")).agg(F.count("*").alias("m")))
    heads = nodes.count()
    parts = parts or max(1, -(-heads * heads // rows))
    degrees = both.groupBy(F.col("src").alias("at")).agg(F.sum("md").alias("k"))
    # from a node to each of its m - 1 twins all k paths pass one neighbour each
    aside = both.join(degrees, F.col("src") == F.col("at")).select(F.col("dst").alias("node"), (F.col("ms") * (F.col("ms") - 1.0) / F.col("k")).alias("part"))
    total = save(nodes.select("node", F.lit(0.0).alias("part")).unionByName(aside).groupBy("node").agg(F.sum("part").alias("part")))
    weight = nodes.select(F.col("node").alias("source"), "m")
    for p in range(parts):
        own = Scratch(edges, "between-part")
        mine = nodes.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == p)
        layers = [own(mine.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))]
        while True:
            seen = layers[-1].select("source", "node")
            seen = seen.unionByName(layers[-2].select("source", "node")) if len(layers) > 1 else seen
            through = F.col("paths") * (F.col("ms") if len(layers) > 1 else 1)  # the source is one node, without its twins
            ahead = layers[-1].join(both, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum(through).alias("paths"))
            layer = own(ahead.join(seen, ["source", "node"], "left_anti"))
            if layer.isEmpty():
                break
            layers.append(layer)
        below = layers[-1].withColumn("dep", F.lit(0.0))
        gained = total
        for layer in reversed(layers[:-1]):
            gained = gained.unionByName(below.join(weight, "source").select("node", (F.col("dep") * F.col("m")).alias("part")))
            up = below.select("source", F.col("node").alias("w"), F.col("paths").alias("more"), "dep").join(both, F.col("w") == F.col("src")).select("source", F.col("dst").alias("node"), "more", "dep", "ms")
            gains = up.join(layer, ["source", "node"]).groupBy("source", "node").agg(F.sum(F.col("ms") * F.col("paths") / F.col("more") * (1 + F.col("dep"))).alias("dep"))
            below = own(layer.join(gains, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep")))
        total = save(gained.groupBy("node").agg(F.sum("part").alias("part")))
        save.drop(save.n - 1)
        own.clear()
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return members.join(total.withColumnRenamed("node", "rep"), "rep").select("node", F.round(F.col("part") * scale, 6).alias("betweenness"))


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) by the Louvain method, named by the smallest node: nodes move to where modularity gains most, then
    communities become nodes, until nothing gains.

    In a round, a community takes part in one move at most, the best by gain and then by node, so the gains of a round add
    up and every round raises modularity; that ends it, and makes it the same on every run.
    """
    save = Scratch(edges, "louvain")
    e = undirected(edges).withColumn("w", F.lit(1.0))
    e = save(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    whole = e.agg(F.sum("w")).first()[0] or 1.0
    place = save(e.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    while True:
        degrees = e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
        com = save(degrees.withColumn("c", F.col("node")))
        moved = False
        while True:
            size = com.groupBy(F.col("c").alias("of")).agg(F.sum("k").alias("size"))
            toward = e.where("src <> dst").join(com.select(F.col("node").alias("dst"), F.col("c").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("w").alias("w"))
            rows = toward.join(com, "node").join(size, F.col("to") == F.col("of")).drop("of")
            own = rows.where("to = c").select("node", F.col("w").alias("w0"))
            home = size.select(F.col("of").alias("c"), F.col("size").alias("size0"))
            rows = rows.where("to <> c").join(own, "node", "left").join(home, "c")
            gain = F.col("w") - F.coalesce("w0", F.lit(0.0)) - F.col("k") * (F.col("size") - F.col("size0") + F.col("k")) / F.lit(whole)
            best = rows.withColumn("gain", F.round(gain, 9)).where("gain > 0").groupBy("node", "c").agg(F.max(F.struct("gain", F.col("to"))).alias("m"))
            best = save(best.select("node", "c", F.col("m.to").alias("to"), F.col("m.gain").alias("gain")))
            ends = best.select(F.explode(F.array("c", "to")).alias("at"), "node", "gain").groupBy("at").agg(F.max(F.struct("gain", "node")).alias("top"))
            first = best.join(ends.select(F.col("at").alias("c"), F.col("top.node").alias("n1")), "c").join(ends.select(F.col("at").alias("to"), F.col("top.node").alias("n2")), "to").where("node = n1 and node = n2")
            new = save(com.join(first.select("node", "to"), "node", "left").select("node", "k", F.coalesce("to", "c").alias("c")))
            if best.isEmpty():
                break
            com, moved = new, True
        if not moved:
            break
        place = save(place.join(com.select(F.col("node").alias("community"), "c"), "community").select("node", F.col("c").alias("community")))
        ends = com.select("node", "c")
        e = save(e.join(ends.withColumnsRenamed({"node": "src", "c": "a"}), "src").join(ends.withColumnsRenamed({"node": "dst", "c": "b"}), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    names = place.groupBy("community").agg(F.min("node").alias("name"))
    return place.join(names, "community").select("node", F.col("name").alias("community"))


def modularity(edges: DataFrame, place: DataFrame) -> float:
    """How much denser than by chance the communities (node, community) of undirected edges are."""
    e = undirected(edges)
    com = place.select("node", "community")
    both = e.join(com.withColumnsRenamed({"node": "src", "community": "a"}), "src").join(com.withColumnsRenamed({"node": "dst", "community": "b"}), "dst")
    m, inside = both.agg(F.count("*"), F.count_if(F.col("a") == F.col("b"))).first()
    squares = degree(e).join(com, "node").groupBy("community").agg(F.sum("degree").alias("k")).agg(F.sum(F.col("k").cast("double") * F.col("k"))).first()[0]
    return inside / m - squares / (2 * m) ** 2 if m else 0.0


def allowed(min_status: str = "proposed") -> list[str]:
    """The statuses that a graph is built from."""
    return ["accepted"] if min_status == "accepted" else ["accepted", "proposed"]


def build(tables: dict[str, DataFrame], min_status: str = "proposed") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a store: nodes (id, node_type, name, status), edges (src, dst, edge_type, edge_category, phase, seq, assertion_id, hard_constraint).

    tables: entities (all statuses), assertions, abstractions (child_ids), patterns, forces (affects), antipatterns, process,
    spatial. Phases add edges in that order; the ends of an edge must be nodes of its phase or an earlier one, except that
    abstractions make bare nodes of children that are none. Missing tables add nothing.
    """
    ok = F.col("status").isin(allowed(min_status))
    t = {k: (v if k == "entities" else v.where(ok)) for k, v in tables.items()}
    text = lambda df, *names: next((F.col(n) for n in names if n in df.columns), F.lit(None)).cast("string")
    seq = lambda df: (F.col("seq") if "seq" in df.columns else F.lit(0)).cast("long")
    parts = [(t["entities"], "entity", 0)] + [(t[k], kind, phase) for k, kind, phase in (("assertions", "assertion", 1), ("abstractions", "abstraction_node", 2), ("patterns", "pattern", 3), ("forces", "force", 4), ("antipatterns", "antipattern", 5)) if k in t]
    nodes = None
    for df, kind, phase in parts:
        part = df.select("id", F.lit(kind).alias("node_type"), text(df, "name", "predicate", "statement").alias("name"), "status", F.lit(phase).alias("phase"))
        nodes = part if nodes is None else nodes.unionByName(part)
    none = {"assertion_id": F.lit(None).cast("string"), "hard_constraint": F.lit(None).cast("boolean")}

    def edge(df: DataFrame, src, dst, kind, category: str, phase: int, **more) -> DataFrame:
        extra = none | more
        return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), kind.alias("edge_type"), F.lit(category).alias("edge_category"), F.lit(phase).alias("phase"), seq(df).alias("seq"), *[c.alias(n) for n, c in extra.items()])

    edges = []
    if "assertions" in t:
        edges.append(edge(t["assertions"], "subject_id", "object_id", F.col("predicate"), "assertion", 1, assertion_id=F.col("id")))
    if "abstractions" in t:
        children = t["abstractions"].select("id", F.posexplode("child_ids").alias("seq", "child"))
        edges.append(edge(children, "id", "child", F.lit("aggregates"), "structural", 2))
        bare = children.select(F.col("child").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
        nodes = nodes.unionByName(bare.select("id", *[F.lit(None).cast("string").alias(c) for c in ("node_type", "name", "status")], F.lit(2).alias("phase")))
    for k, phase in (("patterns", 3), ("antipatterns", 5)):
        if k in t:
            edges.append(edge(t[k].where("subject_id is not null"), "id", "subject_id", F.lit("applies_to"), "structural", phase))
    if "forces" in t:
        edges.append(edge(t["forces"].select("id", F.posexplode("affects").alias("seq", "affected")), "id", "affected", F.lit("acts_on"), "structural", 4))
    if "process" in t:
        edges.append(edge(t["process"], "predecessor_id", "successor_id", F.lit("precedes"), "structural", 6, hard_constraint=F.col("hard_constraint")))
    if "spatial" in t:
        edges.append(edge(t["spatial"], "subject_id", "object_id", F.col("relation"), "spatial", 7))
    all_ = edges[0]
    for e in edges[1:]:
        all_ = all_.unionByName(e)
    known = nodes.groupBy("id").agg(F.min("phase").alias("since"))
    for end in ("src", "dst"):
        all_ = all_.join(known.select(F.col("id").alias(end), F.col("since").alias(f"_{end}")), end).where(F.col(f"_{end}") <= F.col("phase")).drop(f"_{end}")
    return nodes.drop("phase"), all_.select("src", "dst", "edge_type", "edge_category", "phase", "seq", "assertion_id", "hard_constraint")


def collapse_all(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): every attribute as the last edge that had it wrote it, so a later edge hides the type of an earlier one."""
    when = F.struct("phase", "seq", "edge_type", F.coalesce("assertion_id", F.lit("")))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(c)
    return edges.groupBy("src", "dst").agg(*[last(c) for c in ("edge_type", "edge_category", "assertion_id", "hard_constraint")], F.count("*").alias("n"))


def precedes(edges: DataFrame) -> DataFrame:
    """(src, dst) that still precede one another once a pair has one edge: a spatial edge on the same pair hides it."""
    return (collapse_all(edges) if "phase" in edges.columns else edges).where("edge_type = 'precedes'").select("src", "dst")


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the undirected components that hold seeds (id): whole components, with all edges between their nodes."""
    comps = components(edges, "src", "dst")
    mine = comps.join(seeds.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("component").distinct()
    ids = comps.join(mine, "component", "left_semi").select(F.col("node").alias("id")).unionByName(seeds.select("id")).distinct()
    return nodes.join(ids, "id", "left_semi"), edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")


def sequences(edges: DataFrame, start: DataFrame | None, names: DataFrame, max_depth: int = 50, small: int = pieces.SMALL) -> DataFrame:
    """start, entity, n, sequence, has_cycle, cycle, truncated for each start (start): what it precedes and what precedes it, in order.

    sequence holds names, ordered by the longest path from a source and then by id; every edge points forward in it. With a
    cycle among what was reached, the order is by id and cycle names one. truncated: something lies at max_depth. A start
    without edges is its own sequence. names: id, name; an unknown id is its own name. Without start, every end of an edge
    is one. Connected pieces of at most small nodes without a cycle are solved in one task each, many to a task; only the others
    are searched layer by layer.
    """
    kind = edges.select(F.array("src", "dst").alias("ends")).schema["ends"].dataType.elementType
    if not isinstance(kind, AtomicType):
        return _sequences_by_layers(edges, _ends(edges).withColumnRenamed("node", "start") if start is None else start, names, max_depth)
    ship(edges.sparkSession)
    solved, rest = pieces.whole(edges, Scratch(edges, "pieces"), small)
    asked = None if start is None else Scratch(edges, "asked")(start.select("start").distinct())
    out = pieces.sequences(solved, asked, names, max_depth)
    left = _ends(rest).withColumnRenamed("node", "start") if asked is None else asked.join(solved.select(F.col("node").alias("start")), "start", "left_anti")
    return out if left.isEmpty() else out.unionByName(_sequences_by_layers(rest, left, names, max_depth))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _sequences_by_layers(edges: DataFrame, start: DataFrame, names: DataFrame, max_depth: int) -> DataFrame:
    """sequences by a search from all starts at once, layer by layer."""
    save = Scratch(edges, "sequence")
    step = save(edges.select("src", "dst").distinct())
    asked = start.select("start").distinct()
    found = save(around(step, asked.select("start", F.col("start").alias("node")), max_depth))
    inside = found.select("start", F.col("node").alias("src")).join(step, "src").join(found.select("start", F.col("node").alias("dst")), ["start", "dst"])
    order = save(levels(step.where("src <> dst")))
    loops = step.where("src = dst").select(F.col("src").alias("node"))
    blocked = step.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(order.select("node"), "node", "left_anti").unionByName(loops)
    unsure = found.join(blocked, "node", "left_semi").select("start").distinct()
    # only starts near a cycle are looked at one by one: nodes are (start, node) there
    pair = lambda c: F.struct("start", F.col(c).alias("node"))
    own = save(inside.join(unsure, "start", "left_semi").select(pair("src").alias("src"), pair("dst").alias("dst")))
    rounds = strong_components(own)
    ring = rounds.groupBy("component").agg(F.count("*").alias("n")).groupBy("component.start").agg(F.min("component").alias("component"))
    members = rounds.join(ring, "component").select("node", "component")
    lap = own.join(members.withColumnsRenamed({"node": "src", "component": "a"}), "src").join(members.withColumnsRenamed({"node": "dst", "component": "b"}), "dst").where("a = b").where("src <> dst")
    lap = lap.groupBy("src").agg(F.min("dst").alias("dst"))  # one way on from each node of the ring: it leads round
    single = own.where("src = dst").select(F.col("src.start").alias("start"), F.col("src.node").alias("src"), F.col("dst.node").alias("dst"))
    turns = lap.select(F.col("src.start").alias("start"), F.col("src.node").alias("src"), F.col("dst.node").alias("dst")).unionByName(single)
    label = names.select(F.col("id").alias("node"), "name")
    turns = turns.join(label.withColumnsRenamed({"node": "src", "name": "from_name"}), "src", "left").withColumn("from_name", F.coalesce("from_name", F.col("src").cast("string")))
    text = turns.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "from_name"))).alias("ways"))
    kind = dict(start.dtypes)["start"]
    text = text.select("start", "ways").mapInPandas(_laps, f"start {kind}, cycle string")
    shown = found.join(order, "node", "left").join(label, "node", "left").withColumn("name", F.coalesce("name", F.col("node").cast("string")))
    shown = shown.join(text.select("start", "cycle"), "start", "left")
    rank = F.when(F.col("cycle").isNull(), F.coalesce("level", F.lit(0))).otherwise(0)
    out = shown.groupBy("start").agg(F.array_sort(F.collect_list(F.struct(rank.alias("level"), "node", "name"))).alias("all"), F.first("cycle").alias("cycle"), (F.max("depth") >= max_depth).alias("truncated"), F.count("*").alias("n"))
    out = out.join(label.withColumnsRenamed({"node": "start", "name": "entity"}), "start", "left")
    return out.select("start", F.coalesce("entity", F.col("start").cast("string")).alias("entity"), "n", F.transform("all", lambda x: x["name"]).alias("sequence"), F.col("cycle").isNotNull().alias("has_cycle"), "cycle", "truncated")


def _laps(frames):
    """A cycle as text for each start, found by following its ways from the smallest node until a node comes again."""
    import pandas as pd

    for frame in frames:
        out = []
        for start, ways in zip(frame["start"], frame["ways"], strict=True):
            to = {w["src"]: (w["dst"], w["from_name"]) for w in ways}
            at, path = ways[0]["src"], []
            while at in to and at not in path:
                path.append(at)
                at = to[at][0]
            ring = [to[x][1] for x in path[path.index(at) :]] if at in path else [to[x][1] for x in path]
            out.append((start, " -> ".join([*ring, ring[0]])))
        yield pd.DataFrame(out, columns=["start", "cycle"])


def pattern_graph(patterns: DataFrame, related: DataFrame) -> DataFrame:
    """(src, dst, source): undirected edges between patterns (number, slug, name, lower: slugs), from the book, then from related (name, refs).

    A reference is a slug or a name. The book's edges come first, a pair has one edge, and what resolves to nothing or to
    itself is left out.
    """
    by = patterns.select("slug", "number").unionByName(patterns.select(slug(F.col("name")).alias("slug"), "number")).groupBy("slug").agg(F.min("number").alias("number"))
    book = patterns.select(F.col("number").alias("x"), F.explode("lower").alias("ref"), F.lit(0).alias("late"))
    stored = related.join(by, slug(F.col("name")) == F.col("slug")).select(F.col("number").alias("x"), F.explode("refs").alias("ref"), F.lit(1).alias("late"))
    to = by.select(F.col("slug").alias("to_slug"), F.col("number").alias("y"))
    flat = book.unionByName(stored)
    exact = flat.join(to, F.col("ref") == F.col("to_slug"), "left").drop("to_slug")
    named = to.withColumnsRenamed({"to_slug": "to_name", "y": "z"})
    found = exact.join(named, slug(F.col("ref")) == F.col("to_name"), "left").select("x", F.coalesce("y", "z").alias("y"), "late").where("y is not null and x <> y")
    one = found.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.min("late").alias("late"))
    return one.select("src", "dst", F.when(F.col("late") == 0, "book").otherwise("store").alias("source"))


def sections(numbers: DataFrame, column: str = "number") -> DataFrame:
    return numbers.select(F.col(column).alias("node"), pattern_section(F.col(column)).alias("section"))


def hubs(degrees: DataFrame, k: int = 15, least: bool = False) -> DataFrame:
    """The k nodes of highest degree, or of lowest, of equals the smaller node."""
    return degrees.orderBy(F.col("degree") if least else F.col("degree").desc(), "node").limit(k)


def degree_stats(degrees: DataFrame) -> DataFrame:
    """One row: nodes, least, most, mean and median degree; of an even number the upper middle one."""
    ranked = degrees.groupBy("degree").agg(F.count("*").alias("n"))  # a row for each degree that occurs
    upto = ranked.withColumn("upto", F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return upto.agg(F.sum("n").alias("nodes"), F.min("degree").alias("least"), F.max("degree").alias("most"), F.round(F.sum(F.col("degree") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("degree"))).alias("median"))


def cross_degree(edges: DataFrame, sections: DataFrame, k: int = 15) -> DataFrame:
    """(node, degree): the k nodes with most edges into other sections."""
    a, b = sections.select(F.col("node").alias("src"), F.col("section").alias("x")), sections.select(F.col("node").alias("dst"), F.col("section").alias("y"))
    across = undirected(edges).join(a, "src").join(b, "dst").where("x <> y")
    return hubs(degree(across.select("src", "dst")), k)


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """(node, coefficient): closed pairs among the neighbours of a node; 0 with fewer than two."""
    d = degree(undirected(edges))
    rows = d.join(triangles(edges), "node", "left")
    return rows.select("node", F.when(F.col("degree") > 1, F.coalesce("triangles", F.lit(0)) * 2 / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("coefficient"))


def _both(e: DataFrame) -> DataFrame:
    return e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def depths(both: DataFrame, sources: DataFrame, save: Scratch) -> DataFrame:
    """(start, node, depth) from each of sources (node), breadth first along both, an edge table of both directions."""
    return _layers(both, sources.select(F.col("node").alias("start"), "node").distinct(), save)


def _layers(both: DataFrame, start: DataFrame, save: Scratch, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth) from start (start, node), breadth first along both, an edge table of both directions.

    What is new in a layer is told by the two layers before it: a neighbour lies one nearer, as far, or one farther.
    """
    layer = save(start.withColumn("depth", F.lit(0)))
    found, before, depth = layer, layer.limit(0), 0
    while depth != max_depth and not layer.isEmpty():
        depth += 1
        seen = layer.select("start", "node").unionByName(before.select("start", "node"))
        ahead = layer.select("start", F.col("node").alias("src")).join(both.select("src", "dst"), "src").select("start", F.col("dst").alias("node")).distinct()
        before, layer = layer, save(ahead.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(layer)
    return found


def eccentricities(both: DataFrame, sources: DataFrame, nodes: int, rows: int = ROWS) -> DataFrame:
    """(node, m, eccentricity, total, reached) of sources (node): the greatest and the summed distances, and how many nodes they are to.

    both: edges of twins(). A source speaks for the m nodes that it stands for; its own twins are two steps away. Sources
    go in parts, so many that the distances of one are about rows rows; those of a part are deleted after it. nodes: how
    many rows a source reaches at most.
    """
    out = Scratch(both, "far")
    n = sources.count()
    parts = max(1, -(-n * nodes // rows))
    weight = out(both.select("src", "ms").distinct())
    done = []
    for p in range(parts):
        own = Scratch(both, "far-part")
        mine = sources.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == p)
        far = depths(both, mine, own).join(weight, F.col("node") == F.col("src"))
        sums = far.groupBy(F.col("start").alias("node")).agg(F.max("depth").alias("deep"), F.sum(F.col("depth") * F.col("ms")).alias("sum"), F.sum("ms").alias("all"), F.max(F.when(F.col("depth") == 0, F.col("ms"))).alias("m"))
        done.append(out(sums.select("node", "m", F.when(F.col("m") > 1, F.greatest("deep", F.lit(2))).otherwise(F.col("deep")).alias("eccentricity"), (F.col("sum") + 2 * (F.col("m") - 1)).alias("total"), (F.col("all") - 1).alias("reached"))))
        own.clear()
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole


def largest(e: DataFrame, save: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node) of the largest component of undirected edges, the one of the smallest node among equals, and (node, component) of all."""
    comps = save(components(e, "src", "dst"))
    top = comps.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "component").limit(1)
    return save(comps.join(F.broadcast(top.select("component")), "component", "left_semi").select("node")), comps


def diameter(edges: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row: diameter of the largest component, and sources, the number of nodes from which distances were taken.

    Nodes with the same neighbours are one (twins), two steps apart. Two sweeps, from a hub to a farthest node and from there to its farthest, give a lower bound; a node half way between
    is the root. Nodes at depth i from it are no more than 2i apart from any of depth i or less, so layers are
    looked at from the outermost inward, until what was found is more than twice the depth of the next one. Exact, and
    mostly after a few layers, where all distances would be the square of the nodes. No edges: 0 and no sources.
    """
    save = Scratch(edges, "diameter")
    e = save(undirected(edges))
    inside, _ = largest(e, save)
    _, all_ = twins(e, save)
    both = save(all_.join(inside.withColumnRenamed("node", "src"), "src", "left_semi"))
    n, most = both.agg(F.count_distinct("src"), F.max("ms")).first()
    spark = edges.sparkSession
    one = lambda rows_: rows_.first()
    kind = dict(inside.dtypes)["node"]
    if not n:
        return spark.createDataFrame([(0, 0)], "diameter int, sources int")
    at = lambda node: save(depths(both, spark.createDataFrame([(node,)], f"node {kind}"), save).select("node", "depth"))
    hub = one(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k")).orderBy(F.col("k").desc(), "node"))["node"]
    a = one(at(hub).orderBy(F.col("depth").desc(), "node"))["node"]
    from_a = at(a)
    b, low = one(from_a.orderBy(F.col("depth").desc(), "node"))
    from_b = at(b)
    middle = from_a.join(from_b.withColumnRenamed("depth", "back"), "node").where((F.col("depth") + F.col("back") == low) & (F.col("depth") == low // 2))
    layers = at(one(middle.orderBy("node"))["node"])
    i = layers.agg(F.max("depth")).first()[0]
    low, taken = max(low, i, 2 if most > 1 else 0), 4
    while low < 2 * i:
        fringe = layers.where(F.col("depth") == i).select("node")
        best, count = eccentricities(both, fringe, n, rows).agg(F.max("eccentricity"), F.count("*")).first()
        low, taken, i = max(low, best), taken + count, i - 1
    return spark.createDataFrame([(low, taken)], "diameter int, sources int")


def measures(edges: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row: nodes, edges, density, clustering (mean), components, and diameter and mean path of the largest component.

    Distances go breadth first from every node of that component, of nodes with the same neighbours from one (twins), in
    parts of about rows distances that are added up and deleted. Where only the diameter is wanted, diameter() takes far fewer sources.
    """
    save = Scratch(edges, "measures")
    e = save(undirected(edges))
    inside, comps = largest(e, save)
    members, both = twins(e, save)
    heads = save(inside.join(members.where("node = rep"), "node", "left_semi"))
    far = eccentricities(both, heads, heads.count(), rows).agg(F.max(F.when(F.col("eccentricity") > 0, F.col("eccentricity"))).alias("diameter"), F.round(F.try_divide(F.sum(F.col("m") * F.col("total")), F.sum(F.col("m") * F.col("reached"))), 6).alias("mean_path"))
    n = comps.agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components"))
    rows_ = n.crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(clustering_coefficient(e).agg(F.round(F.avg("coefficient"), 6).alias("clustering"))).crossJoin(far)  # one row each
    return rows_.select("nodes", "edges", F.round(F.try_divide(F.col("edges") * 2, F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density"), "clustering", "components", "diameter", "mean_path")


__all__ = ["allowed", "around", "betweenness", "build", "clustering_coefficient", "collapse", "collapse_all", "communities", "components", "cross_degree", "cross_sections", "degree", "degree_stats", "depths", "diameter", "eccentricities", "has_cycle", "histogram", "hubs", "levels", "measures", "modularity", "pattern_graph", "precedes", "reachable", "sections", "sequences", "strong_components", "subgraph", "top_subgraph", "triangles", "twins", "typed_edges", "undirected", "unreachable"]
