"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

1. A scan turns every whole text into its set of shingle hashes and keeps a prefix of the set in hash order. Two linked
   sets share at least need(size) shingles of their prefixes, not just one, so the shingles that few other prefixes hold
   decide: of those that some other prefix holds, each set keeps all but its need - 1 most frequent ones. Passages that
   thousands of documents share drop out, and a set that shares less than need has no partner at all.
2. Light sets, up to a boundary size, meet on the 2-element subsets of what they keep; heavy sets meet every set in the
   inverted lists of single shingles. The boundary is where the two costs, summed over the sets, are least.
3. Sets that meet, directly or through others, form a crowd; linked sets are always in one. A crowd that has fewer pairs
   than its meeting places together (near copies) is verified as a whole, a looser one place by place. Pairs that sizes
   allow are verified on the whole sets, by matrix products over blocks of BLOCK sets, so neither a frequent shingle nor
   a large group of near copies is gathered in one task.
4. Groups of more than a block are verified in two steps: each block by itself with a few pivots of the group, which
   connects near copies in proportion to their number; then only blocks that do not belong to one component meet.

Equal sets are one set throughout. The result is the components of the links; no pair is lost, none is listed.
Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh, lean, small, table, written
from loomgraph.operators.components import components
from loomgraph.session import shared_dir, ship

WORDS = 4
PERCENT = 85
BLOCK = 128
SHINGLES = 1_000_000
PIVOTS = 4
PAIRS_A_ROW = 50
KNOWN_WORDS = 300_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Whole texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "replace").translate(_LOWER).split()  # bytes.split: space and \t..\r
        if not tokens:
            return np.zeros(0, np.int64)
        if len(tokens) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64).view(np.int64)
        known, out = self.known, []
        for t in tokens:
            h = known.get(t)
            if h is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                h = known[t] = xxhash.xxh3_64_intdigest(t)
            out.append(h)
        w = np.array(out, np.uint64)
        h = w[: len(w) - self.words + 1].copy()
        for i in range(1, self.words):
            h ^= h >> np.uint64(29)
            h = h * _MUL + w[i : len(w) - self.words + 1 + i]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def set_id(shingles: bytes) -> int:
    return xxhash.xxh3_64_intdigest(shingles) - (1 << 63)


def least_overlap(n, percent: int):
    """Shingles that a set of n shares with any partner at least."""
    return (percent * n + 99) // 100


def spare(n, percent: int):
    """Shingles that linked sets share in their prefixes, by their size; grows with it."""
    return np.minimum(least_overlap(n, percent), 2 + n // 8)


def _scan(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            texts, n, sid, offsets, prefix = batch.column(1), [], [], [0], []
            for i in range(batch.num_rows):
                s = shingle(texts[i].as_py())
                k = len(s)
                low = least_overlap(k, percent)
                p = k - low + int(spare(k, percent)) if low < k or k * 100 // percent > k else 0  # else linked with its equals only
                n.append(k)
                sid.append(set_id(s.tobytes()) if k else None)
                prefix.append(s[:p])
                offsets.append(offsets[-1] + p)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefix or [np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), lists], names=["doc_id", "own", "n", "sid", "prefix"])

    return run


def _whole(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sets = [shingle(batch.column(0)[i].as_py()).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["sid", "shingles"])

    return run


def _need(n: Column, percent: int) -> Column:
    """spare() of the smallest partner that a set of n can have: valid for every partner."""
    low = F.floor((n * percent + 99) / 100).cast("long")
    return F.least(F.floor((low * percent + 99) / 100).cast("long"), F.lit(2) + F.floor(low / 8).cast("long"))


def frequent(postings: DataFrame, buckets: int = 32, counters: int = 256, least: int = 2_000) -> DataFrame:
    """(t, f): shingles found to be very frequent, at most buckets * counters, with a count that all sets agree on."""
    top = postings.groupBy(F.pmod(F.col("t"), F.lit(buckets)).alias("bucket")).agg(F.expr(f"approx_top_k(t, {counters}, {counters})").alias("top"))
    return top.select(F.explode("top").alias("x")).where(F.col("x.count") >= least).select(F.col("x.item").alias("t"), F.col("x.count").alias("f"))


def keepers(sets: DataFrame, percent: int) -> DataFrame:
    """(sid, n, light, heavy): the shingles a set is found by, rarest first: two or more of light or one of heavy are shared with any partner.

    Any order of shingles serves as long as all sets use it. Very frequent shingles get their places from a broadcast
    list, all others are counted in ordinary windows, which stay small without them.
    """
    postings = sets.select("sid", F.explode("prefix").alias("t"))
    marked = postings.join(F.broadcast(written(frequent(postings), "frequent")), "t", "left")
    counted = marked.where("f is null").select("sid", "t", F.count("*").over(Window.partitionBy("t")).alias("f")).where("f > 1")
    shared = counted.unionByName(marked.where("f is not null").select("sid", "t", "f"))
    mine = shared.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("mine"))
    found = mine.join(sets.select("sid", "n"), "sid")
    room = F.size("mine") - _need(F.col("n"), percent)
    found = found.withColumn("room", room.cast("int")).where("room >= 0")
    return found.select("sid", "n", F.slice("mine", 1, F.col("room") + 2).alias("light"), F.slice("mine", 1, F.col("room") + 1).alias("heavy"))


def boundary(kept: DataFrame, percent: int) -> int:
    """The largest size of light sets: where subsets of the light and lists of the heavy cost least together.

    Costs are in rows: a light set makes a row for each subset. A heavy set makes one for each list it is in, and meets as
    many sets as its longest list holds; a pair in a block product costs about a PAIRS_A_ROWth of a shuffled row.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    subsets = F.size("light") * (F.size("light") - 1) / 2
    lists = F.size("heavy") + F.aggregate("heavy", F.lit(0).cast("long"), lambda s, x: F.greatest(s, x["f"])) / PAIRS_A_ROW
    rows = sorted((r["step"], r["most"], r["s"], r["l"]) for r in kept.groupBy(step.alias("step")).agg(F.max("n").alias("most"), F.sum(subsets).alias("s"), F.sum(lists).alias("l")).collect())
    best, at = None, 0
    for k in range(len(rows) + 1):
        limit = rows[k - 1][1] if k else 0
        cost = sum(r[2] for r in rows[:k]) + sum(r[3] for r in rows if r[1] >= least_overlap(limit + 1, percent))
        if best is None or cost < best:
            best, at = cost, limit
    return at


def places(kept: DataFrame, limit: int, percent: int) -> DataFrame:
    """(place, sid, n): where sets meet."""
    pairs = F.flatten(F.transform("light", lambda x, i: F.transform(F.slice("light", i + 2, F.size("light")), lambda y: F.xxhash64(x["t"], y["t"]))))
    light = kept.where(F.col("n") <= limit).select(F.explode(pairs).alias("place"), "sid", "n")
    heavy = kept.where(F.col("n") >= least_overlap(limit + 1, percent)).select(F.explode(F.transform("heavy", lambda x: x["t"])).alias("place"), "sid", "n")
    return light.unionByName(heavy)


def crowds(members: DataFrame, folder: str) -> DataFrame:
    """(sid, n, crowd): the connected groups of sets that meet."""
    least = members.groupBy("place").agg(F.min("sid").alias("a"), F.count("*").alias("g")).where("g > 1")
    meetings = members.join(least, "place").where("a <> sid").select("a", F.col("sid").alias("b")).distinct()
    found = components(written(meetings, "meetings"), folder=folder).select(F.col("node").alias("sid"), F.col("component").alias("crowd"))
    return members.select("sid", "n").distinct().join(found, "sid")


def groups(members: DataFrame, crowd: DataFrame) -> DataFrame:
    """(crowd, sid, n): the groups of sets within which all links lie, each crowd whole or place by place, by cost.

    A crowd is what meetings connect; where these run on and on, it has far more pairs than its places have. Then its
    places are its groups, those with the same members once. Costs are squares of sizes, as pairs are verified in blocks.
    """
    rows = members.join(crowd.select("sid", "crowd"), "sid")
    key = F.xxhash64("sid")
    place = rows.groupBy("place").agg(F.first("crowd").alias("crowd"), F.count("*").alias("g"), F.sum(F.pmod(key, F.lit(1 << 31))).alias("x"), F.bit_xor(key).alias("y"))
    place = written(place.where("g > 1").groupBy("crowd", "g", "x", "y").agg(F.min("place").alias("place")), "meeting-places")
    cost = place.groupBy("crowd").agg(F.sum(F.col("g").cast("double") * F.col("g")).alias("by_place"))
    size = crowd.groupBy("crowd").agg(F.count("*").alias("size"))
    loose = size.where(F.col("size") > BLOCK).join(cost, "crowd").where(F.col("by_place") < F.col("size").cast("double") * F.col("size")).select("crowd")
    loose = small(written(loose, "loose"))
    whole = crowd.join(loose, "crowd", "left_anti").select("crowd", "sid", "n")
    if loose.isEmpty():
        return whole
    apart = place.join(loose, "crowd", "left_semi").select("place")
    return whole.unionByName(members.join(apart, "place").select(F.col("place").alias("crowd"), "sid", "n"))


def size_band(n: Column, percent: int) -> Column:
    """Bands of sizes: linked sets are in the same one or in neighbouring ones."""
    return F.floor(F.log(n) / F.lit(1.0001 * np.log(100 / percent))).cast("int")


def blocks_of(count: Column, shingles: Column) -> Column:
    """Blocks for a number of sets with that many shingles: about BLOCK sets and about SHINGLES shingles in each."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles / SHINGLES)).cast("int")


def divided(group: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (crowd, sid, n) of groups that fit into a block, and those of larger ones."""
    size = group.groupBy("crowd").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    fits = (F.col("size") <= BLOCK) & (F.col("weight") <= SHINGLES)
    sized = group.join(size.select("crowd", fits.alias("fits")), "crowd")
    return sized.where("fits").drop("fits"), sized.where("not fits").drop("fits")


def packed(few: DataFrame) -> DataFrame:
    """(unit, crowd, block, sid, n): groups that fit into a block, some to a unit."""
    all_of = few.agg(F.count("*").alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("weight")).first()
    packs = max(1, all_of["sets"] // 500, all_of["weight"] // (4 * SHINGLES))
    unit = F.concat(F.lit("p"), F.pmod(F.xxhash64("crowd"), F.lit(packs)).cast("string"))
    return few.select(unit.alias("unit"), "crowd", F.lit("").alias("block"), "sid", "n")


def by_pivots(many: DataFrame, percent: int) -> DataFrame:
    """(unit, crowd, block, sid, n): each block of a large group by itself, with the pivots of its band and of those beside it.

    Pivots are the PIVOTS sets of a band that come first by hash. They tie together what blocks have in common, so a
    group of near copies is connected after this, at a cost in proportion to its size.
    """
    banded = many.withColumn("band", size_band(F.col("n"), percent))
    bands = small(written(banded.groupBy("crowd", "band").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks")), "bands"))
    name = lambda band, x: F.concat_ws(".", F.lit("q"), F.col("crowd").cast("string"), F.col(band).cast("string"), F.col(x).cast("string"))
    own = banded.join(bands, ["crowd", "band"]).withColumn("x", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    key = F.xxhash64("sid", F.lit("pivot"))
    pivots = banded.groupBy("crowd", "band", F.pmod(key, F.lit(PIVOTS)).alias("salt")).agg(F.min(F.struct(key.alias("h"), "sid", "n")).alias("p"))
    reach = pivots.select("crowd", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "p.sid", "p.n")
    sent = reach.join(bands, ["crowd", "band"]).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = own.select(name("band", "x").alias("unit"), "crowd", "sid", "n").unionByName(sent.select(name("band", "x").alias("unit"), "crowd", "sid", "n"))
    return rows.distinct().select("unit", "crowd", F.lit("").alias("block"), "sid", "n")


def still_apart(many: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(unit, crowd, block, sid, n): blocks of large groups that meet after links were found by pivots: none of one component meet.

    found has (sid, component). What a component has in a band of a group is in blocks of its own; where that is less
    than half a block, sets go into mixed blocks, which meet all. Only bands that sizes allow to link meet.
    """
    sets = many.withColumn("band", size_band(F.col("n"), percent)).join(found, "sid", "left")
    of = ["crowd", "band", "component"]
    label = F.coalesce(F.col("component").cast("string"), F.lit(""))
    large = sets.where("component is not null").groupBy(*of).agg(F.count("*").alias("c")).where(F.col("c") * 2 >= BLOCK).select(*of, label.alias("label"))
    sets = written(sets.join(small(written(large, "settled")), of, "left").select("crowd", "sid", "n", "band", F.coalesce("label", F.lit("")).alias("label")), "labelled")
    parts = small(written(sets.groupBy("crowd", "band", "label").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks")), "parts"))
    own = sets.join(parts, ["crowd", "band", "label"]).withColumn("x", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    others = parts.select("crowd", F.col("band").alias("band2"), F.col("label").alias("label2"), F.col("blocks").alias("blocks2"))
    own = own.withColumn("band2", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    meets = own.join(others, ["crowd", "band2"]).where("label <> label2 or label = ''").withColumn("x2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    name = lambda *c: F.concat_ws(".", *[F.col(k).cast("string") for k in c])
    mine, other = name("band", "label", "x"), name("band2", "label2", "x2")
    unit = F.concat_ws("/", F.lit("r"), F.col("crowd").cast("string"), F.least(mine, other), F.greatest(mine, other))
    return meets.select(unit.alias("unit"), "crowd", mine.alias("block"), "sid", "n")


def link_pairs(sets: list[np.ndarray], blocks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Linked pairs (places in sets) that connect what is connected; with several blocks, only pairs between blocks and within single ones."""
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.r_[False, flat[1:] != flat[:-1]]) if len(flat) else flat
    several = np.bincount(column)[column] > 1  # shingles of one set only count for nothing here
    column, owner = column[several], owner[several]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 8_192
    for start in range(0, int(column.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(column, [start, start + width])
        m = np.zeros((len(sets), min(width, int(column[-1]) + 1 - start)), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        both += m @ m.T
    both = np.rint(both).astype(np.int64)
    link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    if len(set(blocks.tolist())) > 1:
        link &= blocks[:, None] != blocks[None, :]
    root = list(range(len(sets)))

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(link, 1)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[a] = b
            out.append((int(i), int(j)))
    return out


def _verify(percent: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in part.groupby("crowd", sort=False):
            sid, blocks = rows["sid"].to_numpy(), rows["block"].to_numpy()
            sets = [np.frombuffer(b, np.int64) for b in rows["shingles"]]
            out += [(sid[i], sid[j]) for i, j in link_pairs(sets, blocks, percent)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, own (a hash of its text), n (size of its set), sid, and what its component has of all
    rows: component_id (its smallest doc_id), first (doc_id and own of the row that stays for it, ids before none) and rows.

    sid and what follows are null where there are no shingles.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    scan = rows.mapInArrow(lean(_scan(words, percent)), "doc_id long, own long, n long, sid long, prefix array<long>")
    scanned = written(scan, "sets")
    links = written(set_links(docs, scanned, words, percent), "links")
    comps = components(links, folder=shared_dir(spark))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")
    by_set = scanned.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), F.min(order).alias("first"), F.count("*").alias("rows"))
    named = by_set.join(comps.withColumnRenamed("node", "sid"), "sid", "left")
    named = written(named.select("sid", "least", "first", "rows", F.coalesce("component", "sid").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("first"), F.sum("rows").alias("rows"))
    sets = named.select("sid", "component").join(least, "component").select(F.col("sid").alias("of"), "component_id", "first", "rows")
    return scanned.select("doc_id", "own", "n", "sid").join(sets, F.col("sid") == F.col("of"), "left").drop("of")


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Null and empty texts have no shingles and are linked with nothing. Texts of equal sets are linked. Repeated rows each
    get a row. Other columns of docs play no part; an empty table gives no rows.
    """
    rows = grouped(docs, words, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def set_links(docs: DataFrame, scanned: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links between different sets, enough of them to connect every component."""
    sets = scanned.where(F.size("prefix") > 0).groupBy("sid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    kept = written(keepers(sets, percent), "kept")
    members = written(places(kept, boundary(kept, percent), percent), "places")
    crowd = written(crowds(members, shared_dir(docs.sparkSession)), "crowds")
    whole = whole_sets(docs, scanned, crowd.select("sid"), words)
    few, many = divided(written(groups(members, crowd), "groups"))
    few, many = written(few, "few"), written(many, "many")

    def verified(work: DataFrame) -> DataFrame:
        return written(work.join(whole, "sid").groupBy("unit").applyInPandas(_verify(percent), "a long, b long"), "verified")

    links = verified(packed(few))
    if many.isEmpty():
        return links
    near = verified(by_pivots(many, percent))
    found = written(components(near, folder=shared_dir(docs.sparkSession)).withColumnRenamed("node", "sid"), "found")
    return links.unionByName(near).unionByName(verified(still_apart(many, found, percent)))


def whole_sets(docs: DataFrame, scanned: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(sid, shingles) of the needed sets, from one document of each, as a written table."""
    holder = scanned.join(needed, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    key = small(written(holder.select(F.col("doc_id").alias("holder")).distinct(), "holders"))
    rows = docs.select("doc_id", "text").join(key, F.col("doc_id").eqNullSafe(F.col("holder")), "left_semi").select("text")
    found = rows.mapInArrow(lean(_whole(words)), "sid long, shingles binary")  # the set of a row, which an id that is not unique may not tell
    return written(found.join(needed, "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles")), "whole")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of texts that are linked, directly or not: that of the smallest doc_id.

    Rows are told apart by id and text, so rows that share an id, or have none, are judged by their own texts; a row with
    an id goes before one without. Of repeated rows one stays. Null and empty texts are linked with nothing and all stay.
    Columns of docs may have any name; an empty table gives no rows.
    """
    rows = grouped(docs, words, percent).where("rows > 1").select("doc_id", "own", F.struct("doc_id", "own").eqNullSafe(F.struct("first.doc_id", "first.own")).alias("stays"))
    pairs = written(rows.groupBy("doc_id", "own").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "near-gone")
    name = [fresh(docs, c) for c in ("near_doc", "near_own", "near_key")]
    keyed = docs.withColumn(name[2], F.xxhash64("text"))

    def of(part: DataFrame, how: str) -> DataFrame:
        return keyed.join(part, F.col("doc_id").eqNullSafe(F.col(name[0])) & F.col(name[2]).eqNullSafe(F.col(name[1])), how)

    pairs = pairs.withColumnsRenamed({"doc_id": name[0], "own": name[1]})
    stay = of(small(pairs.select(*name[:2])), "left_anti").drop(name[2])
    again = pairs.where("stays").select(*name[:2])
    if again.isEmpty():
        return stay
    return stay.unionByName(of(again, "left_semi").dropDuplicates(["doc_id", name[2]]).drop(name[2]))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
