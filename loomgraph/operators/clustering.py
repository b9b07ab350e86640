"""Average-linkage clusters in rounds over blocks, and optimal matching between framings, routed by size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import auction
from loomgraph.operators.components import components
from loomgraph.session import Scratch, ship

#: Rows that the last step holds as a matrix in one task. In the rounds before it a task holds two parts of up to eight times as many.
BLOCK = 4096
#: Clusters of a tight group that one task merges; it holds no matrix of them.
TIGHT = 32_768
#: The place of no row.
_NONE = np.iinfo(np.int64).max


def linkage(sums: np.ndarray, sizes: np.ndarray, threshold: float, strict: bool) -> np.ndarray:
    """Labels of average-linkage clusters of clusters, given as sums of unit vectors and sizes, by chains of nearest neighbours.

    A label is the place of a cluster's first member. A cluster whose nearest neighbour is beyond the threshold is
    finished: no merge of others brings them nearer.
    """
    mean, size = sums / sizes[:, None], sizes.astype(float)
    dist = 1 - np.clip(np.round(mean @ mean.T, 12), -1, 1)
    np.fill_diagonal(dist, np.inf)
    labels, live, chain = np.arange(len(sums)), np.ones(len(sums), bool), []
    while live.any():
        if not chain:
            chain = [int(live.argmax())]
        a = chain[-1]
        b = int(dist[a].argmin())
        if not (dist[a, b] < threshold or (not strict and dist[a, b] <= threshold)):
            live[a], dist[a], dist[:, a] = False, np.inf, np.inf
            chain.pop()
        elif len(chain) > 1 and dist[a, chain[-2]] <= dist[a, b]:
            low, high = sorted((a, chain[-2]))
            dist[low] = dist[:, low] = (size[low] * dist[low] + size[high] * dist[high]) / (size[low] + size[high])
            size[low] += size[high]
            dist[low, low], dist[high], dist[:, high], live[high] = np.inf, np.inf, np.inf, False
            labels[labels == high] = low
            chain = chain[:-2]
        else:
            chain.append(b)
    return labels


def chains(sums: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """labels of linkage up to the threshold, itself included, with the sums and sizes of the clusters at their labels; no matrix is held."""
    labels, at = np.arange(len(sums)), np.arange(len(sums))
    sums, sizes = sums.copy(), sizes.astype(float)
    s, n, mean, live, chain = sums, sizes, sums / sizes[:, None], np.ones(len(sums), bool), []
    while live.any():
        if 2 * live.sum() < len(live) and len(live) > 64:
            chain = (np.cumsum(live) - 1)[chain].tolist()
            at, mean, live = at[live], mean[live], live[live]
        if not chain:
            chain = [int(live.argmax())]
        a = chain[-1]
        row = 1 - np.clip(np.round(mean @ mean[a], 12), -1, 1)
        row[~live] = row[a] = np.inf
        b = int(row.argmin())
        if not row[b] <= threshold:
            live[a] = False
            chain.pop()
        elif len(chain) > 1 and (row[chain[-2]] <= row[b] or b in chain):
            low, high = sorted((a, chain[-2]))
            x, y = at[low], at[high]
            s[x] += s[y]
            n[x] += n[y]
            mean[low], live[high] = s[x] / n[x], False
            labels[labels == y] = x
            chain = chain[:-2]
        else:
            chain.append(b)
    return labels, sums, sizes


def unit(vector: str):
    """vector over its norm; null where it has none (zero, null or not finite)."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # bound as a lambda's variable, the norm is taken once for a row and not once for each component
    over = lambda n: F.when((n > 0) & (n < float("inf")), F.transform(vector, lambda x: x.cast("double") / n))
    return F.get(F.transform(F.array(norm), over), F.lit(0))


class _Best:
    """The nearest neighbour found so far of each row of a part: its cosine, and its place in the part at."""

    def __init__(self, n: int):
        self.cos, self.at = np.full(n, -np.inf), np.full(n, _NONE)

    def take(self, a: np.ndarray, b: np.ndarray, cos: np.ndarray) -> None:
        """Neighbours b of rows a with their cosines; of equal cosines the least place is kept."""
        order = np.lexsort((b, -cos, a))
        a, b, cos = a[order], b[order], cos[order]
        first = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
        a, b, cos = a[first], b[first], cos[first]
        better = (cos > self.cos[a]) | ((cos == self.cos[a]) & (b < self.at[a]))
        self.cos[a[better]], self.at[a[better]] = cos[better], b[better]


def _best_of_products(u: np.ndarray, v: np.ndarray, threshold: float, same: bool, run: int = 128) -> tuple[_Best, _Best]:
    """The nearest of v for each row of u, and of u for each of v, within the threshold; if same, u is v and each pair is met once.

    Products in single precision tell which pairs may be the nearest, by the maxima of runs; only these are scored in
    double precision, or all of a piece where many are.
    """
    step, width = 4 * run, 16 * run
    slack = (u.shape[1] + 4) * 6e-8 + 1e-9
    of_u = _Best(len(u))
    of_v = of_u if same else _Best(len(v))
    low_u, low_v = (np.concatenate([w, np.zeros((-len(w) % run, w.shape[1]))]).astype(np.float32) for w in (u, v))  # whole runs
    room = np.empty(step * width, np.float32)
    for start in range(0, len(u), step):
        for at in range(start // width * width if same else 0, len(v), width):
            x, y = low_u[start : start + step], low_v[at : at + width]
            raw = np.matmul(x, y.T, out=room[: len(x) * len(y)].reshape(len(x), len(y)))
            raw[len(u) - start :], raw[:, len(v) - at :] = -np.inf, -np.inf
            if same and at < start + step:
                raw[np.arange(at, at + len(y))[None, :] <= np.arange(start, start + len(x))[:, None]] = -np.inf
            hits = []
            for axis, best, begin in ((1, of_u, start), (0, of_v, at)):
                runs = raw.reshape(len(x), -1, run) if axis else raw.reshape(-1, run, len(y))
                tops = runs.max(2).T if axis else runs.max(1)
                least = np.maximum(best.cos[begin : begin + raw.shape[1 - axis]], 1 - threshold) - slack
                top = tops.max(0)[: len(least)]
                on = np.flatnonzero(top >= least)
                floor = np.maximum(least[on], top[on] - 2 * slack).astype(np.float32) - np.float32(1e-6)
                g, q = np.nonzero(tops[:, on] >= floor)
                piece = runs[on[q], g] if axis else runs[g, :, on[q]]
                k, c = np.nonzero(piece >= floor[q][:, None])
                near, far = on[q[k]], g[k] * run + c
                hits.append((near, far) if axis else (far, near))
            a, b = (np.concatenate(side) for side in zip(*hits, strict=True))
            if not len(a):
                continue
            if len(a) * 16 > raw.size:
                cos = u[start : start + step] @ v[at : at + width].T
                a, b = np.nonzero(raw >= 1 - threshold - slack - 1e-6)
                cos = cos[a, b]
            else:
                a, b = np.divmod(np.unique(a * raw.shape[1] + b), raw.shape[1])
                cos = np.einsum("ij,ij->i", u[start + a], v[at + b])
            cos = np.clip(np.round(cos, 12), -1, 1)
            ok = 1 - cos <= threshold
            a, b, cos = start + a[ok], at + b[ok], cos[ok]
            of_u.take(a, b, cos)
            of_v.take(b, a, cos)
    return of_u, of_v


def _tiles(live: DataFrame, parts: int, run: Callable[[bool, list[pa.Array], list[np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run of each two parts of live (cluster, s, n), of one length of vectors, in a task: whether they are one part, names and means of each."""
    place = F.pmod(F.xxhash64("cluster"), F.lit(parts)).cast("int")
    rows = live.select(F.size("s").alias("dim"), place.alias("p"), "cluster", F.transform("s", lambda x: x / F.col("n")).alias("mean"))
    dealt = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.select("dim", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") <= F.col("q")).alias("first"), "cluster", "mean")

    def tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        same, dim = key[1] == key[2], key[0].as_py()
        sides = [t] if same else [t.filter(t["first"]), t.filter(pc.invert(t["first"]))]
        if not all(len(side) for side in sides):
            return
        del t
        sides = [side.take(pc.sort_indices(side["cluster"])) for side in sides]  # places are in the order of names
        names = [side["cluster"].combine_chunks() for side in sides]
        yield from run(same, names, [pc.list_flatten(side["mean"].combine_chunks()).to_numpy().reshape(len(side), dim) for side in sides])

    keys = ["dim", "i", "j"]
    # Tiles are few and long: with more partitions than tiles, few lie together in one.
    return dealt.repartition(2 * parts * (parts + 1), *keys).groupBy(*keys).applyInArrow(tile, schema)


def _links_of_products(u: np.ndarray, v: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """For each row of u and then, if not same, of v, the least place of the rows that pairs within the threshold connect it with.

    Products are in single precision, so a pair a little beyond the threshold may connect as well; none within is missed.
    """
    from loomgraph.operators.normalise import merged

    step, width, shift = 512, 2048, 0 if same else len(u)
    least = np.float32(1 - threshold - (u.shape[1] + 4) * 6e-8 - 1e-6)
    low_u, low_v = u.astype(np.float32), v.astype(np.float32)
    root = np.arange(shift + len(v))
    for start in range(0, len(u), step):
        for at in range(start // width * width if same else 0, len(v), width):
            raw = low_u[start : start + step] @ low_v[at : at + width].T
            if raw.max() >= least:
                a, b = np.nonzero(raw >= least)
                root = merged(root, start + a, shift + at + b)
    return root


def _tight(live: DataFrame, save: Scratch, threshold: float, parts: int, most: int) -> DataFrame | None:
    """(old, new, s, n) of the clusters that have another within the threshold, merged up to it: s and n of those that stay, or None if there are none.

    Average linkage brings no cluster nearer than the nearest two of its members, so what pairs within the threshold connect
    merges up to it without regard to the rest: a task does this for a group of at most most clusters. Many near copies, which
    merge one after another, thus need no round each. Larger groups are left out.
    """
    kind = dict(live.dtypes)["cluster"]

    def run(same: bool, names: list[pa.Array], means: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        root = _links_of_products(means[0], means[-1], threshold, same)
        at, ids = np.flatnonzero(root != np.arange(len(root))), pa.concat_arrays(names)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), ids.take(pa.array(root[at]))], ["a", "b"])

    links = save(_tiles(live, parts, run, f"a {kind}, b {kind}"))
    if links.isEmpty():
        return None

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cluster", ignore_index=True)
        labels, s, n = chains(np.array(part["s"].tolist(), float), part["n"].to_numpy(), threshold)
        stays = labels == np.arange(len(labels))
        return pd.DataFrame({"old": part["cluster"], "new": part["cluster"].to_numpy()[labels], "s": [x if on else None for x, on in zip(s, stays, strict=True)], "n": n.astype(int)})

    group = save(components(links).select(F.col("node").alias("cluster"), "component"))
    size = group.groupBy("component").agg(F.count("*").alias("k")).where(F.col("k") <= most).select("component")
    return save(live.join(group.join(size, "component"), "cluster").groupBy("component").applyInPandas(merge, f"old {kind}, new {kind}, s array<double>, n long"))


def _nearest(live: DataFrame, threshold: float, strict: bool, parts: int) -> DataFrame:
    """(cluster, other) of live (cluster, s, n): the neighbour of least distance within the threshold, the smaller name of equals.

    Each pair is scored once, in the task of its two parts, so both ends see the same number; a task returns the best of
    each of its rows.
    """
    kind = dict(live.dtypes)["cluster"]

    def run(same: bool, names: list[pa.Array], means: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = _best_of_products(means[0], means[-1], threshold, same)
        for best, mine, others in zip(found, names, reversed(names), strict=False):
            on = np.flatnonzero(best.at < _NONE)
            yield pa.RecordBatch.from_arrays([mine.take(pa.array(on)), pa.array(1 - best.cos[on]), others.take(pa.array(best.at[on]))], ["cluster", "d", "other"])

    found = _tiles(live, parts, run, f"cluster {kind}, d double, other {kind}")
    near = found.where(F.col("d") < threshold if strict else F.col("d") <= threshold)
    return near.groupBy("cluster").agg(F.min(F.struct("d", "other")).alias("best")).select("cluster", "best.other")


def average_linkage(items: DataFrame, threshold: float, strict: bool = True, block: int = BLOCK) -> DataFrame:
    """(id, cluster): exact average-linkage clusters of items (id, vector) by cosine distance, named by their smallest id.

    Merging stops at the threshold (below it if strict). A cluster is its size and the sum of its unit vectors, whose
    products give the mean distance of two clusters, so no cluster is gathered. Equal vectors are one cluster from the
    start, and what lies within an eighth of the threshold merges up to it first, group by group. In each round all pairs that are each other's nearest merge at once, which leads to the same clusters as one
    merge after another; a cluster without neighbour within the threshold is finished. When at most block clusters are
    left, one task does the rest. Among equal distances the smaller names merge first. A vector that is null, zero or
    holds what is null or not finite stays alone, and vectors of different lengths never merge.
    """
    ship(items.sparkSession)
    save = Scratch(items, "linkage")
    rows = save(items.select("id", unit("vector").alias("v")))
    kind = dict(rows.dtypes)["id"]
    groups = save(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    live = save(groups.select(F.col("rep").alias("cluster"), F.transform("v", lambda x: x * F.col("n")).alias("s"), "n"))
    roots = save(groups.select("rep", F.col("rep").alias("cluster")))

    def moved(roots: DataFrame, merges: DataFrame) -> DataFrame:
        """roots after merges (old, new)."""
        return save(roots.join(merges, F.col("cluster") == F.col("old"), "left").select("rep", F.coalesce("new", "cluster").alias("cluster")))

    parts = lambda left: max(-(-left // (8 * block)), min(8, -(-left // block)))
    if (left := live.count()) > block and (near := _tight(live, save, threshold / 8, parts(left), TIGHT)) is not None:
        roots = moved(roots, near.where("old <> new").select("old", "new"))
        live = save(live.join(near.select(F.col("old").alias("cluster")), "cluster", "left_anti").unionByName(near.where("old = new").select(F.col("new").alias("cluster"), "s", "n")))
    while (left := live.count()) > block:
        near = save(_nearest(live, threshold, strict, parts(left)))
        if near.isEmpty():
            live = live.limit(0)
            break
        both = near.groupBy(F.least("cluster", "other").alias("new"), F.greatest("cluster", "other").alias("old")).agg(F.count("*").alias("ends"))
        merges = save(both.where("ends = 2").select("old", "new"))
        stay = live.join(near.select("cluster"), "cluster", "left_semi").join(merges, F.col("cluster") == F.col("old"), "left")
        pairs = stay.groupBy(F.coalesce("new", "cluster").alias("cluster")).agg(F.collect_list("s").alias("s"), F.sum("n").alias("n"))
        summed = F.when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise(F.zip_with(F.get("s", F.lit(0)), F.get("s", F.lit(1)), lambda x, y: x + y))
        live = save(pairs.select("cluster", summed.alias("s"), "n"))
        roots = moved(roots, merges)

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cluster", ignore_index=True)
        labels = linkage(np.array(part["s"].tolist(), float), part["n"].to_numpy(float), threshold, strict)
        return pd.DataFrame({"old": part["cluster"], "new": part["cluster"].to_numpy()[labels]})

    rest = live.withColumn("dim", F.size("s")).groupBy("dim").applyInPandas(finish, f"old {kind}, new {kind}")
    named = save(groups.join(moved(roots, rest), "rep"))
    alone = named.where("n = 1").select(F.col("rep").alias("id"), "cluster")
    # A vector that many rows share is a hot key: its rows are dealt over salts.
    salts = 16
    copies = named.where("n > 1").select("v", "cluster", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    many = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(copies, ["v", "salt"]).select("id", "cluster")
    return alone.unionByName(many).unionByName(rows.where("v is null").select("id", F.col("id").alias("cluster")))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of least total cost: rows bid for columns by what their second best leaves, and shortest augmenting paths place the rest."""
    turned = cost.shape[0] > cost.shape[1]
    c = np.ascontiguousarray(cost.T) if turned else cost
    n, m = c.shape
    u, v, match, of = np.zeros(n), np.zeros(m), np.full(m, -1), np.full(n, -1)
    r, better, way = np.empty(m), np.empty(m, bool), np.zeros(m, int)
    todo, bids = list(range(n - 1, -1, -1)), 4 * n if m > 1 else 0  # ties could bid without end
    while todo and bids:
        bids -= 1
        i = todo.pop()
        np.subtract(c[i], v, out=r)
        j = int(r.argmin())
        least, r[j] = r[j], np.inf
        k = int(r.argmin())
        if least == r[k] and match[j] >= 0:
            if match[k] >= 0:
                continue
            j = k
        u[i] = r[k] if r[k] < np.inf else least
        v[j] -= u[i] - least
        was, match[j], of[i] = match[j], i, j
        if was >= 0:
            of[was] = -1
            todo.append(was)
    for start in np.flatnonzero(of < 0):
        least, price, i, low = np.full(m, np.inf), v.copy(), start, 0.0
        rows, cols, at = [], [], []
        while True:
            np.subtract(c[i], price, out=r)
            r += low - u[i]
            np.less(r, least, out=better)
            np.copyto(least, r, where=better)
            np.copyto(way, i, where=better)
            j = int(least.argmin())
            low = least[j]
            cols.append(j)
            at.append(low)
            least[j], price[j] = np.inf, -np.inf
            if match[j] < 0:
                break
            i = match[j]
            rows.append(i)
        u[start] += low
        u[rows] += low - np.array(at[:-1])
        v[cols] -= low - np.array(at)
        i = -1
        while i != start:
            i = way[j]
            match[j] = i
            of[i], j = j, of[i]
    pairs = list(enumerate(of.tolist()))
    return sorted((b, a) for a, b in pairs) if turned else pairs


def match_framings(rows: DataFrame, threshold: float = 0.70, small: int = 6144, block: int = BLOCK, known: int = 256) -> DataFrame:
    """rows (entity, framing, item, vector) to (entity, item, grp, size, consistency).

    Framings are matched pairwise by optimal assignment on cosine; matches that reach the threshold join groups; the
    consistency of a group is the mean pairwise cosine, null for one member. A group is named by its first item in the
    order of framing and item, nulls first. Entities are routed by size: those of at most small rows are matched in one task each; of
    larger ones each pair of framings of at most small rows is a task, and the pairs with a larger framing go together
    through the rounds of an auction. A vector that is null, zero or holds what is null or not finite has the cosine 0
    with all; shorter vectors count as filled up with zeros.
    """
    ship(rows.sparkSession)
    save = Scratch(rows, "framings")
    kinds = dict(rows.dtypes)
    e, i = kinds["entity"], kinds["item"]
    rows = save(rows.select("entity", "framing", "item", unit("vector").alias("vector")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["framing", "item"], na_position="first").reset_index(drop=True)
        v = np.zeros((len(part), max([1, *(len(x) for x in part["vector"] if x is not None)])))
        for row, x in zip(v, part["vector"], strict=True):
            if x is not None:
                row[: len(x)] = x
        sim = v @ v.T
        root = np.arange(len(part))
        by = [g.index.to_numpy() for _, g in part.groupby("framing", dropna=False)]
        for x in range(len(by)):
            for y in range(x + 1, len(by)):
                for i, j in assignment(-sim[np.ix_(by[x], by[y])]):
                    a, b = by[x][i], by[y][j]
                    if sim[a, b] >= threshold:
                        root[root == max(root[a], root[b])] = min(root[a], root[b])
        out = []
        for r in np.unique(root):
            at = np.flatnonzero(root == r)
            mean = float(sim[np.ix_(at, at)][np.triu_indices(len(at), 1)].mean()) if len(at) > 1 else None
            out += [(part["entity"][i], part["item"][i], part["item"][at[0]], len(at), mean) for i in at]
        return pd.DataFrame(out, columns=["entity", "item", "grp", "size", "consistency"])

    sizes = save(rows.groupBy(F.col("entity").alias("e")).agg(F.count("*").alias("n")))
    routed = rows.join(sizes, F.col("entity").eqNullSafe(F.col("e")))
    near = routed.where(F.col("n") <= small).select("entity", "framing", "item", "vector")
    near = near.groupBy("entity").applyInPandas(run, f"entity {e}, item {i}, grp {i}, size int, consistency double")
    if sizes.where(F.col("n") > small).isEmpty():
        return near
    return near.unionByName(_match_large(routed.where(F.col("n") > small).select("entity", "framing", "item", "vector"), save, threshold, small, block, known))


def _match_large(rows: DataFrame, save: Scratch, threshold: float, small: int, block: int, known: int) -> DataFrame:
    """match_framings of rows whose vectors are unit vectors or null, without gathering an entity or a group."""
    nodes = save(rows.withColumn("node", F.monotonically_increasing_id()))
    framings = save(nodes.groupBy("entity", "framing").agg(F.min("node").alias("side"), F.count("*").alias("n")))
    a, b = framings.alias("a"), framings.alias("b")
    pairs = save(a.join(b, F.col("a.entity").eqNullSafe(F.col("b.entity")) & (F.col("a.side") < F.col("b.side"))).select(F.col("a.side").alias("side_a"), F.col("b.side").alias("side_b"), F.greatest("a.n", "b.n").alias("n")).withColumn("pid", F.monotonically_increasing_id()))
    side = nodes.alias("n").join(framings.alias("f"), F.col("n.entity").eqNullSafe(F.col("f.entity")) & F.col("n.framing").eqNullSafe(F.col("f.framing")))
    members = save(side.select("node", "side", F.col("vector").alias("v")))
    found = _match_pairs(members, pairs.where(F.col("n") <= small))
    large = pairs.where(F.col("n") > small).drop("n")
    if not large.isEmpty():
        found = found.unionByName(auction.assign(members, large, block, known).select("a", "b"))
    found = save(found)
    vectors = members.select("node", "v")
    both = found.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("u")), "a").join(vectors.select(F.col("node").alias("b"), F.col("v").alias("w")), "b")
    cosine = F.coalesce(F.aggregate(F.zip_with("u", "w", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    links = save(both.where(cosine >= threshold).select("a", "b"))
    root = components(links).select(F.col("node"), "component")
    named = save(nodes.join(root, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # The sum of unit vectors tells the mean of all pairs: its square less the members' own squares, over k (k - 1).
    summed = named.select("component", F.posexplode("vector").alias("at", "x")).groupBy("component", "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    square = summed.groupBy("component").agg((F.sum(F.col("s") * F.col("s")) - F.sum("q")).alias("cross"))
    first = F.min(F.struct("framing", "item")).getField("item").alias("grp")
    group = named.groupBy("component").agg(first, F.count("*").cast("int").alias("size")).join(square, "component", "left")
    mean = F.when(F.col("size") > 1, F.coalesce("cross", F.lit(0.0)) / (F.col("size") * (F.col("size") - 1.0))).alias("consistency")
    return named.join(group, "component").select("entity", "item", "grp", "size", mean)


def _match_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): the assignment of largest total cosine of members (node, side, v) for each of pairs (pid, side_a, side_b), one task each."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = (s.sort_values("node", ignore_index=True) for s in (x, y))
        width = max([1, *(len(v) for s in (x, y) for v in s["v"] if v is not None)])
        u, w = auction.matrix(x["v"], width), auction.matrix(y["v"], width)
        # With the smaller side as rows the matrix is not copied.
        best = assignment(-u @ w.T) if len(u) <= len(w) else [(i, j) for j, i in assignment(-w @ u.T)]
        return pd.DataFrame({"a": x["node"].to_numpy()[[i for i, _ in best]], "b": y["node"].to_numpy()[[j for _, j in best]]})

    one, other = (pairs.join(members, F.col(f"side_{s}") == F.col("side")).select(*[F.col(c).alias(c) for c in ("pid", "node", "v")]) for s in "ab")
    return one.groupBy("pid").cogroup(other.groupBy("pid")).applyInPandas(run, "a long, b long")


def group_labels(v: np.ndarray, n: np.ndarray, threshold: float, strict: bool) -> np.ndarray:
    """The place of the first member of its cluster for each row of a group, in the order of ids: unit vectors end to end, and their lengths."""
    first, at = np.arange(len(n)), np.concatenate([[0], np.cumsum(n)])
    for size in np.unique(n[n > 0]):
        mine = np.flatnonzero(n == size)
        u = v[at[mine][:, None] + np.arange(size)] if len(mine) < len(n) else v.reshape(len(n), size)
        seen: dict = {}
        of = np.array([seen.setdefault(x.tobytes(), len(seen)) for x in u + 0.0]) if threshold > 0 else np.arange(len(u))  # equal vectors are one from the start
        _, head, count = np.unique(of, return_index=True, return_counts=True)
        first[mine] = mine[head[linkage(u[head] * count[:, None], count.astype(float), threshold, strict)[of]]]
    return first


def linkage_by_group(items: DataFrame, threshold: float = 0.25, strict: bool = False, small: int = BLOCK) -> DataFrame:
    """(grp, id, cluster): average-linkage clusters within each group of items (grp, id, vector), named by their smallest id.

    Groups are routed by size: those of at most small rows lie together, many to a task; a larger one goes
    through the rounds over blocks, so there are no more of these than rows divided by small. The meaning is that of
    average_linkage in either case. A group of one row is its own cluster; a null group is a group.
    """
    ship(items.sparkSession)
    save = Scratch(items, "groups")
    rows = save(items.select("grp", "id", unit("vector").alias("v")))
    size = rows.groupBy("grp").agg(F.count("*").alias("n"))
    large = [r["grp"] for r in size.where(F.col("n") > small).select("grp").collect()]  # fewer than rows / small
    kinds = dict(rows.dtypes)
    schema = f"grp {kinds['grp']}, id {kinds['id']}, cluster {kinds['id']}"

    def run(batches):
        """Groups lie together and in the order of ids; the last one of a batch may go on in the next."""
        import pyarrow as pa
        import pyarrow.compute as pc

        def found(t):
            g, v = pc.rank(t["grp"], null_placement="at_start", tiebreaker="min").to_numpy(), t["v"].combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(v).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
            to, at = np.concatenate([[0], np.cumsum(sizes)]), np.arange(len(g))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a + 1:
                    at[a:b] = a + group_labels(flat[to[a] : to[b]], sizes[a:b], threshold, strict)
            ids = t["id"].combine_chunks()
            return pa.RecordBatch.from_arrays([t["grp"].combine_chunks(), ids, ids.take(pa.array(at))], ["grp", "id", "cluster"])

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not len(t):
                continue
            g = pc.rank(t["grp"], null_placement="at_start", tiebreaker="min").to_numpy()
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
            if cut:
                yield found(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield found(rest)

    mine = F.col("grp")
    near = rows.join(F.broadcast(size.where(F.col("n") > small).select(F.col("grp").alias("big"))), mine.eqNullSafe(F.col("big")), "left_anti") if large else rows
    out = near.repartition("grp").sortWithinPartitions("grp", "id").mapInArrow(run, schema)
    for grp in large:
        one = items.where(mine.eqNullSafe(F.lit(grp)))
        out = out.unionByName(average_linkage(one.select("id", "vector"), threshold, strict, small).select(F.lit(grp).cast(kinds["grp"]).alias("grp"), "id", "cluster"))
    return out
