"""A Merkle manifest of a dataset: digests, proofs and their verification, by postorder traversal of aligned blocks.

Every row is a leaf; runs of WIDTH consecutive nodes become one, until a tree has one node. Positions come from a range
sort, so no tree is gathered. A block is WIDTH^DEPTH consecutive leaves of a tree, aligned, so a subtree of its own: its
traversal descends to the leaves, returns the digest of each subtree, and on the way back appends to the leaves a
subtree contains the siblings of that subtree. The roots of the blocks are the leaves of the next traversal, spread over
the cluster in the same way, until each tree is one node; the trees' roots are the leaves of a last tree over all.
Proofs go the other way: the path of a block's root goes to its block alone, once, and a leaf's path is what its block's
traversal appended and then the path of the block. Siblings are thus never stored per leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import ascii_lower, small, table
from loomgraph.session import Scratch, ship

WIDTH = 8
#: Levels of a block: 8^4 leaves.
DEPTH = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every third row, by the CRC of its id, is tampered with before it is verified.
TAMPER = 3

NODE = "tree string, pos long, digest string"
PATH = "tree string, pos long, path array<struct<left:string,right:string>>, subroot string, root string"
PROOF = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, fields=FIELDS, by: str = "lang", tamper: int = TAMPER) -> DataFrame:
    """tree, doc_id, digest of the row, and the digest of its tampered form, null where nothing was tampered with.

    The tree is the value of by after a blank, so that null, as the empty text, sorts first.
    """
    digest = lambda text: F.sha2(F.concat(*[encoded(text if f == "text" else F.col(f)) for f in fields]), 256)
    low = F.sha2(F.concat(*[encoded(ascii_lower(F.col("text")) if f == "text" else F.col(f)) for f in fields]), 256)
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(tamper)) == 0, F.lit(False))
    tree = F.coalesce(F.concat(F.lit(" "), F.col(by)), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), F.when(hit, low).alias("tampered"))


def placed(rows: DataFrame, keep: Scratch, *order: str) -> DataFrame:
    """rows (tree, ...) with pos, the place in the tree from 0 in the order of the columns given, nulls first.

    A range sort, written; then the rows of each tree in each part are counted, and the sums over the parts before lie
    beside the rows of a part. Rows that are equal in the order are parted by a number, so that none fills a part.
    """
    by = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order)]
    spread = rows.withColumn("nth", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    parted = spread.repartitionByRange(*by, F.col("nth")).drop("nth").sortWithinPartitions(*by)
    done = keep(parted.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    counts = done.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # parts and trees are in order: no more rows than both together
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return done.join(small(starts), ["tree", "part"]).withColumn("pos", (F.col("at") + F.col("shift")).cast("long")).drop("part", "at", "shift")


class Block(NamedTuple):
    """What the traversal of a block gives: its digest, and for each leaf the siblings left and right at every level."""

    digest: str
    paths: list[list[tuple[str, str]]]


def traverse(digests: list[str], depth: int, width: int = WIDTH, paths: bool = True) -> Block:
    """The subtree of depth levels over the digests, in postorder: children first, then their siblings to what they contain."""
    out: list[list[tuple[str, str]]] = [[] for _ in digests] if paths else []

    def visit(first: int, level: int) -> str:
        if level == 0:
            return digests[first]
        step = width ** (level - 1)
        starts = range(first, min(first + step * width, len(digests)), step)
        parts = [visit(a, level - 1) for a in starts]
        if paths:
            for i, a in enumerate(starts):
                beside = "".join(parts[:i]), "".join(parts[i + 1 :])
                for leaf in out[a : a + step]:
                    leaf.append(beside)
        return sha("".join(parts))

    return Block(visit(0, depth), out)


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its path lead to."""
    for left, right in path:
        digest = sha(left + digest + right)
    return digest


def height(n: Column, width: int = WIDTH, depth: int = DEPTH) -> Column:
    """Levels until n nodes are one, depth at most."""
    level = F.lit(depth)
    for k in range(depth - 1, -1, -1):
        level = F.when(n <= width**k, F.lit(k)).otherwise(level)
    return level


def blocks(nodes: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """nodes with block, the number of their block in the tree, and levels, its depth: less where a tree is smaller than a block."""
    trees = small(nodes.groupBy("tree").agg((F.max("pos") + 1).alias("nodes")))
    return nodes.join(trees, "tree").withColumn("levels", height(F.col("nodes"), width, depth)).withColumn("block", F.expr(f"pos div {width**depth}")).drop("nodes")


def climbed(nodes: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """The roots of the blocks of nodes, as the nodes of the next traversal."""

    def climb(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        root = traverse(rows["digest"].tolist(), int(rows["levels"].iloc[0]), width, paths=False).digest
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "digest": [root]})

    asked = blocks(nodes, depth, width).select("tree", "block", "pos", "digest", "levels")
    return asked.groupBy("tree", "block").applyInPandas(climb, NODE)


def _as_pairs(path) -> list[tuple[str, str]]:
    return [(p["left"], p["right"]) for p in path]


def descended(nodes: DataFrame, above: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """The path of each node up to the root, from those of the blocks' roots above."""

    def descend(rows: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        block = traverse(rows["digest"].tolist(), int(rows["levels"].iloc[0]), width)
        rest = _as_pairs(tops["path"].iloc[0])
        paths = [[{"left": a, "right": b} for a, b in own + rest] for own in block.paths]
        return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "path": paths, "subroot": tops["subroot"].iloc[0], "root": tops["root"].iloc[0]})

    asked = blocks(nodes, depth, width).select("tree", "block", "pos", "digest", "levels")
    tops = above.withColumnRenamed("pos", "block")
    return asked.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInPandas(descend, PATH)


def proven(nodes: DataFrame, above: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """A row of PROOF for each leaf, from the paths of the blocks' roots above."""

    def prove(rows: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        digests = rows["digest"].tolist()
        block = traverse(digests, int(rows["levels"].iloc[0]), width)
        top = _as_pairs(tops["path"].iloc[0])
        tail = "".join(a + b for a, b in top)
        root = tops["root"].iloc[0]
        proofs = [sha("".join(a + b for a, b in own) + tail) for own in block.paths]
        claimed = [d if t is None else t for d, t in zip(digests, rows["tampered"], strict=True)]
        folded = [fold(d, own + top) for d, own in zip(claimed, block.paths, strict=True)]
        return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": digests, "subroot": tops["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    asked = blocks(nodes, depth, width).select("tree", "block", "pos", F.col("doc_id").cast("string").alias("doc_id"), "digest", "tampered", "levels")  # pandas has no whole numbers beside nulls
    tops = above.withColumnRenamed("pos", "block")
    proofs = asked.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInPandas(prove, PROOF)
    return proofs.withColumn("doc_id", F.col("doc_id").cast("long"))


def _single(nodes: DataFrame) -> bool:
    """Whether every tree of nodes is one node."""
    return nodes.where(F.col("pos") > 0).isEmpty()


def _rounds(nodes: DataFrame, keep: Scratch, depth: int, width: int) -> Iterator[DataFrame]:
    """nodes, the roots of their blocks, of the blocks of these, and so on until every tree is one node."""
    yield nodes
    while not _single(nodes):
        nodes = keep(climbed(nodes, depth, width))
        yield nodes


def manifest(docs: DataFrame, by: str = "lang", depth: int = DEPTH, width: int = WIDTH, tamper: int = TAMPER) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs.

    A tree for each value of by, in which leaves ascend by doc_id, nulls first and equal ids by their digests; equal rows
    are leaves beside one another, each with its own proof. A null field is encoded as such, an empty text as 0 bytes;
    a row without doc_id is not tampered with. A tree of one leaf has it as its subroot, and a single tree's subroot is
    the root, with an empty proof if it is a leaf. Other columns of docs play no part; an empty table gives no rows.
    Texts are hashed where they lie; only ids and digests are sorted and grouped.
    """
    spark = ship(docs.sparkSession)
    keep = Scratch(docs, "merkle")
    below = keep(placed(keep(leaves(docs, by=by, tamper=tamper)), keep, "doc_id", "digest"))
    levels = list(_rounds(below, keep, depth, width))
    subroots = levels[-1].select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"))
    tops = keep(placed(subroots, keep, "name"))
    upper = list(_rounds(tops, keep, depth, width))
    root = upper[-1].select(F.lit("").alias("tree"), "pos", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    paths = root
    for nodes in reversed(upper[:-1]):
        paths = keep(descended(nodes, paths, depth, width))
    paths = tops.select("pos", F.col("name").alias("tree"), F.col("digest").alias("own")).join(paths.drop("tree"), "pos").select("tree", F.lit(0).cast("long").alias("pos"), "path", F.col("own").alias("subroot"), "root")
    paths = keep(paths)
    for nodes in reversed(levels[1:-1]):
        paths = keep(descended(nodes, paths, depth, width))
    return proven(below, paths, depth, width)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS k, *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
l AS (SELECT k, doc_id, lang,
  sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
  sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), coalesce(strlen(low) || ':' || low, '-'))) AS tampered
  FROM e),
b AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))) AS t),
c AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda r, x: xor(r >> 8, t[1 + (xor(r, x) & 255)])), 4294967295) % 3 = 0 AS hit
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), b),
p AS (SELECT l.*, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
up(tree, level, pos, n, digest) AS (
  SELECT tree, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 8, n),
s AS (SELECT tree, digest FROM up WHERE n = 1),
over(level, pos, n, digest) AS (
  SELECT 0, tree, (SELECT count(*) FROM s), digest FROM s
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY level, pos // 8, n),
runs AS (SELECT tree, level, pos // 8 AS run, list(digest ORDER BY pos) AS d FROM up WHERE n > 1 GROUP BY ALL),
tops AS (SELECT level, pos // 8 AS run, list(digest ORDER BY pos) AS d FROM over WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT p.k, r.level, array_to_string(r.d[: p.pos // (8 ** r.level)::BIGINT % 8], '') AS a, array_to_string(r.d[p.pos // (8 ** r.level)::BIGINT % 8 + 2 :], '') AS b
  FROM p JOIN runs r ON r.tree = p.tree AND r.run = p.pos // (8 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT p.k, 1000 + t.level, array_to_string(t.d[: p.tree // (8 ** t.level)::BIGINT % 8], ''), array_to_string(t.d[p.tree // (8 ** t.level)::BIGINT % 8 + 2 :], '')
  FROM p JOIN tops t ON t.run = p.tree // (8 ** (t.level + 1))::BIGINT),
paths AS (SELECT k, list(struct_pack(a := a, b := b) ORDER BY level) AS path FROM steps GROUP BY k),
f(k, i, path, digest) AS (
  SELECT p.k, 0, coalesce(path, []), CASE WHEN hit THEN tampered ELSE leaf END FROM p LEFT JOIN paths USING (k) LEFT JOIN c USING (doc_id)
  UNION ALL
  SELECT k, i + 1, path, sha256(path[i + 1].a || digest || path[i + 1].b) FROM f WHERE i < len(path))
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x.a || x.b), 'string_agg', ''), '')) AS proof_sha256,
  f.digest AS folded_root, f.digest = r.digest AS verified
FROM p JOIN s USING (tree) JOIN f ON f.k = p.k AND f.i = len(f.path) CROSS JOIN (SELECT digest FROM over WHERE n = 1) r
"""
