"""Connected pieces of a graph with the levels of their nodes, each piece in one task, and sequences found where a piece lies.

What lies together is found by tasks as they read the edges (leveling); pieces that share a node are then joined, and meet
in one task if they are small. Only pieces that are large or hold a cycle are left to rounds over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.operators.components import components
from loomgraph.operators.leveling import DEPTH, STRETCH, _pieces, _stretch_levels
from loomgraph.operators.normalise import BROADCAST_ROWS
from loomgraph.session import Scratch

#: Nodes of a piece that a task solves, and entries of sequences in one of its batches, about.
SMALL = 1_000
PAIRS = 1_000_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _together(batches: Iterator[pa.RecordBatch], solve: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """solve of whole pieces: they lie one after another, and the last one of a batch may go on in the next."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        if not len(t):
            continue
        piece = t["piece"].to_numpy()
        cut = int(np.searchsorted(piece, piece[-1]))
        if cut:
            yield from solve(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None:
        yield from solve(held)


def _levelled(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows (piece, node, next) of whole pieces, a node in one row or more, as one row a node with its level."""
    ahead, nodes, piece = t["next"].combine_chunks(), t["node"].combine_chunks(), t["piece"].to_numpy()
    both = pa.concat_arrays([nodes, pc.list_flatten(ahead)]).dictionary_encode()
    names, places = both.dictionary, both.indices.to_numpy()
    own = places[: len(t)]
    src = np.repeat(own, pc.list_value_length(ahead).to_numpy(zero_copy_only=False))
    level, to, begin, _ = _stretch_levels(src, places[len(t) :], len(names), len(names) + 1)
    of = np.empty(len(names), np.int64)
    of[own] = piece
    yield pa.RecordBatch.from_arrays([names, pa.array(of), pa.array(level, mask=level < 0), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), names.take(pa.array(to)))], ["node", "piece", "level", "next"])


def whole(edges: DataFrame, save: Scratch, small: int = SMALL, stretch: int = STRETCH, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(solved, rest): rows (node, piece, level, next) of whole pieces of at most small nodes without a cycle, and edges (src, dst) of the others.

    A piece with an edge that has a null end is one of the others. level: edges of the longest path from a source.
    """
    seen = Observation()
    kind = edges.select(F.array("src", "dst").alias("ends")).schema["ends"].dataType.elementType
    edges = edges.select(F.col("src").cast(kind), F.col("dst").cast(kind))
    open_end = F.col("src").isNull() | F.col("dst").isNull()
    found = save(_pieces(edges.observe(seen, F.count_if(open_end).alias("open")).where(~open_end), stretch, depth))
    name = dict(found.dtypes)["node"]
    mark = F.xxhash64("node")
    shared = save(found.groupBy(mark.alias("m")).agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high").select("m", "low"))
    rows = found.select("node", "piece", "level", "next")
    if not shared.isEmpty():
        # A hash that two nodes share joins pieces without need; a joined piece is still whole.
        links = save(found.select("piece", mark.alias("m")).join(_few(shared), "m").select("piece", "low").distinct())
        moved = _few(save(components(links, "piece", "low").select(F.col("node").alias("of"), "component")))
        joined = save(rows.join(moved, F.col("piece") == F.col("of")).select("node", F.col("component").alias("piece"), "level", "next"))
        large = save(joined.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") > small).select("piece"))
        meet = joined.join(large, "piece", "left_anti").select("piece", "node", "next").repartition("piece").sortWithinPartitions("piece")
        met = meet.mapInArrow(lambda batches: _together(batches, _levelled), f"node {name}, piece long, level int, next array<{name}>")
        left = joined.join(large, "piece", "left_semi").select("node", "piece", F.lit(None).cast("int").alias("level"), "next")
        rows = rows.join(moved, F.col("piece") == F.col("of"), "left_anti").unionByName(save(met)).unionByName(left)
    bad = rows.groupBy("piece").agg(F.count("*").alias("n"), F.bool_or(F.col("level").isNull()).alias("blocked")).where((F.col("n") > small) | F.col("blocked")).select("piece")
    if seen.get["open"]:
        ends = edges.where(open_end).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        bad = bad.unionByName(rows.join(ends, "node", "left_semi").select("piece")).distinct()
    bad = save(bad)
    apart = _few(bad)
    rest = rows.join(apart, "piece", "left_semi").select(F.col("node").alias("src"), F.explode("next").alias("dst"))
    rest = rest.unionByName(edges.where(open_end)) if seen.get["open"] else rest
    return rows.join(apart, "piece", "left_anti"), rest


def _reached(src: np.ndarray, dst: np.ndarray, n: int, starts: np.ndarray, max_depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What starts reach within max_depth edges in either direction, a row each, and whether something lies at max_depth."""
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.argsort(a, kind="stable")
    to, begin = b[order], np.searchsorted(a[order], np.arange(n + 1))
    seen, cut = np.zeros((len(starts), n), bool), np.full(len(starts), max_depth <= 0)
    flat, now = seen.reshape(-1), np.arange(len(starts)) * n + starts
    flat[now] = True
    for depth in range(1, max_depth + 1):
        row, at = np.divmod(now, n)
        out = begin[at + 1] - begin[at]
        ends = np.repeat(row * n, out) + to[np.repeat(begin[at] - np.cumsum(out) + out, out) + np.arange(out.sum())]
        now = np.unique(ends[~flat[ends]])
        if not len(now):
            break
        flat[now] = True
        if depth == max_depth:
            cut[now // n] = True
    return seen, cut


def sequences(solved: DataFrame, asked: DataFrame | None, names: DataFrame, max_depth: int, pairs: int = PAIRS) -> DataFrame:
    """graph.sequences of those of asked (start), or of all nodes, that are in solved; a piece's rows, names and starts meet in one task."""
    kind, label = dict(solved.dtypes)["node"], names.where("id is not null and name is not null").select(F.col("id").alias("of"), "name")
    at, every = solved.select("piece", "node"), asked is None
    none = {"level": F.lit(None).cast("int"), "next": F.lit(None).cast(f"array<{kind}>"), "name": F.lit(None).cast("string"), "start": F.lit(every)}
    rows = solved.withColumns({c: none[c] for c in ("name", "start")})
    rows = rows.unionByName(at.join(label, F.col("node") == F.col("of")).select("piece", "node", "name").withColumns({c: none[c] for c in ("level", "next", "start")}))
    if not every:
        mine = at.join(asked.select(F.col("start").alias("of")), F.col("node") == F.col("of"), "left_semi")
        rows = rows.unionByName(mine.withColumns({c: none[c] for c in ("level", "next", "name")} | {"start": F.lit(True)}))

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        held = t.filter(pc.is_valid(t["level"]))
        held = held.take(pc.sort_indices(held, [("piece", "ascending"), ("level", "ascending"), ("node", "ascending")]))
        nodes, piece = held["node"].combine_chunks(), held["piece"].to_numpy()
        said, on = nodes.cast(pa.string()), np.full(len(nodes), every)
        for c in ("name", "start"):
            more = t.filter(pc.and_(pc.is_null(t["level"]), pc.is_valid(t["name"]) if c == "name" else t["start"]))
            if len(more) and not (c == "start" and every):
                place = pc.index_in(more["node"].combine_chunks(), value_set=nodes).to_numpy()
                on[place] |= c == "start"
                if c == "name":
                    of = np.full(len(nodes), -1)
                    of[place] = np.arange(len(place))
                    said = pc.coalesce(more["name"].combine_chunks().take(pa.array(of, mask=of < 0)), said)
        cuts = np.concatenate([np.flatnonzero(np.diff(piece, prepend=piece[0] - 1)), [len(piece)]])
        ahead = held["next"].combine_chunks()
        to = pc.index_in(pc.list_flatten(ahead), value_set=nodes).to_numpy()
        begin = np.concatenate([[0], np.cumsum(pc.list_value_length(ahead).to_numpy(zero_copy_only=False))])
        # a node reaches all of a piece of at most max_depth nodes, in fewer steps
        size = np.diff(cuts)
        near = np.flatnonzero((np.repeat(size, size) <= max_depth) & on)
        first, n = np.repeat(cuts[:-1], size)[near], np.repeat(size, size)[near]
        upto = np.cumsum(n)
        at = 0
        while at < len(near):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + pairs)))
            k = n[at:end]
            entries = np.repeat(first[at:end] - np.cumsum(k) + k, k) + np.arange(k.sum())
            yield batch(nodes, said, near[at:end], k, entries, np.zeros(end - at, bool))
            at = end
        for a, b in zip(cuts[:-1][size > max_depth], cuts[1:][size > max_depth], strict=True):
            mine = a + np.flatnonzero(on[a:b])
            src = np.repeat(np.arange(b - a), np.diff(begin[a : b + 1]))
            for some in np.array_split(mine, max(1, -(-len(mine) * (b - a) // pairs))):
                seen, cut = _reached(src, to[begin[a] : begin[b]] - a, b - a, some - a, max_depth)
                yield batch(nodes, said, some, seen.sum(1), a + np.nonzero(seen)[1], cut)

    def batch(nodes: pa.Array, said: pa.Array, starts: np.ndarray, n: np.ndarray, entries: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), said.take(pa.array(entries)))
        starts = pa.array(starts)
        return pa.RecordBatch.from_arrays([nodes.take(starts), said.take(starts), pa.array(n.astype(np.int64)), lists, pa.array(cut)], ["start", "entity", "n", "sequence", "truncated"])

    rows = rows.select("piece", "node", "level", "next", "name", "start").repartition("piece").sortWithinPartitions("piece")
    out = rows.mapInArrow(lambda batches: _together(batches, solve), f"start {kind}, entity string, n long, sequence array<string>, truncated boolean")
    return out.select("start", "entity", "n", "sequence", F.lit(False).alias("has_cycle"), F.lit(None).cast("string").alias("cycle"), "truncated")
