"""The manifest against a plain version that builds whole trees, and against SQL."""

import hashlib
import re
import zlib

import pytest
from compare import SF, duck, same

from loomgraph.llm import manifest, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos string, digest string, at string, part string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def code(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """Levels of a tree, the last of one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, i):
    for level in levels[:-1]:
        run = i // 8 * 8
        yield "".join(level[run:i]), "".join(level[i + 1 : run + 8])
        i //= 8


def plain(rows):
    trees = {}
    for r in rows:
        leaf = h("".join(code(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
        text = r["text"]
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
            text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        forged = h("".join(code(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, forged, r["doc_id"]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {t: climb([x[2] for x in sorted(trees[t])]) for t in names}
    top = climb([levels[t][-1][0] for t in names])
    out = []
    for place, t in enumerate(names):
        for i, (_, _, leaf, forged, doc_id) in enumerate(sorted(trees[t])):
            path = [*beside(levels[t], i), *beside(top, place)]
            at = forged
            for a, b in path:
                at = h(a + at + b)
            root = top[-1][0]
            out.append((doc_id, leaf, levels[t][-1][0], root, h("".join(a + b for a, b in path)), at, at == root))
    return out


def rows_of(df):
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("depth", "langs"), [(1, 70), (2, 3)])
def test_manifest(spark, depth, langs):
    rows = [(i * 3, f"Text {i} É {'Word ' * (i % 5)}" if i % 7 else None if i % 2 else "", None if i % langs == 0 else f"l{'é' * (i % 2)}{i % langs}", None if i % 4 else f"s{i % 3}", i if i % 6 else None, *["x"] * 5) for i in range(640)]
    rows += [(None, "No id", "l1", "s", 1, *["x"] * 5), (None, None, None, None, None, *["x"] * 5), *[rows[5]] * 3, (9007199254740993, "Far", "l1", None, None, *["x"] * 5), (-3, "Minus", "l1", None, None, *["x"] * 5), (0, "B " * 9000, "alone", None, None, *["x"] * 5)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = rows_of(manifest.manifest(docs, depth=depth))
    assert got == sorted(plain(docs.collect()), key=repr)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 9])
def test_few_leaves(spark, n):
    docs = spark.createDataFrame([(i, "One", "en", "s", 3, *["x"] * 5) for i in range(n)], SCHEMA)
    assert rows_of(manifest.manifest(docs, depth=1)) == sorted(plain(docs.collect()), key=repr)


def test_manifest_against_sql_and_plain(spark):
    df = queries.QUERIES["op12_manifest"](spark, SF)
    same(df, queries.SQL["op12_manifest"], duck())
    assert rows_of(df) == sorted(plain(spark.read.parquet(f"{SF}/documents.parquet").collect()), key=repr)


def test_a_proof_says_where_a_leaf_stands():
    leaves = [h(str(i)) for i in range(70)]
    root, paths = manifest.traverse(leaves, 3)
    assert all(manifest.fold(leaf, path) == root for leaf, path in zip(leaves, paths, strict=True))
    assert manifest.fold(leaves[0], paths[1]) != root and manifest.traverse(leaves[::-1], 3).digest != root
