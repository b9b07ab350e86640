"""Exact top-k search by a bit-sliced index.

Components are quantised to integers, and a block of rows is kept as bit slices: for each dimension and each bit, one
bitmap over the rows. The scores of a query against a whole block are then sums of bitmaps: slices are added by
carry-save bitmap arithmetic, weighted by the bits of the query, into the slices of the score. The k best rows come
from the most significant score slice downward; rows that tie at the boundary lie in id order, so the first are taken
exactly. A task searches the blocks it reads one after another and keeps the k best of each query; the k best of the
tasks' answers are the k best of all. The bitmaps stay where they were written: queries go to them, in waves of bounded
size, so nothing of the index is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import lean, save, table, written
from loomgraph.session import ship

K = 5
SCALE = 256
BLOCK_ROWS = 16_384
#: Bytes of query vectors that are broadcast at a time, and rows of the index that go to Python together.
WAVE = 32_000_000
INDEX_ROWS = 8

INDEX = "dims int, n int, low long, bits int, ids binary, slices binary"
QUERIES = "dims int, ids binary, weights binary"
ANSWERS = "place long, query_id long, vec_id long, score long"


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, ids, integers) of up to rows vectors of one length each."""
    held: dict = {}
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = batch.column(1)
        widths = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(widths)])
        for dims in np.unique(widths):
            at = np.flatnonzero(widths == dims)
            got = held.setdefault(int(dims), [[], [], 0])
            got[0].append(ids[at])
            got[1].append(flat[starts[at][:, None] + np.arange(dims)])
            got[2] += len(at)
            while got[2] >= rows:
                i, v = np.concatenate(got[0]), np.concatenate(got[1])
                yield int(dims), i[:rows], v[:rows]
                got[:] = [[i[rows:]], [v[rows:]], len(i) - rows]
    for dims, (i, v, n) in held.items():
        if n:
            yield dims, np.concatenate(i), np.concatenate(v)


def _index(rows: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, ids, v in _blocks(batches, rows):
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            low = int(v.min(initial=0))
            bits = max(1, int(v.max(initial=0) - low).bit_length())
            slices = np.zeros((dims, bits, -(-len(ids) // 64)), "<u8")
            row = np.zeros(slices.shape[2] * 64, np.uint64)
            for d in range(dims):  # a dimension at a time, so that the unpacked bits stay small
                row[: len(ids)] = (v[:, d] - low).astype(np.uint64)
                planes = ((row >> np.arange(bits, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
                slices[d] = np.packbits(planes, axis=1, bitorder="little").view("<u8")
            yield pa.RecordBatch.from_pylist([{"dims": dims, "n": len(ids), "low": low, "bits": bits, "ids": ids.tobytes(), "slices": slices.tobytes()}], _arrow(INDEX))

    return build


def _queries(rows: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, ids, v in _blocks(batches, rows):
            yield pa.RecordBatch.from_pylist([{"dims": dims, "ids": ids.tobytes(), "weights": v.tobytes()}], _arrow(QUERIES))

    return build


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def add_slices(columns: dict[int, list[np.ndarray]]) -> np.ndarray:
    """The sum of bitmaps, columns[w] holding those that count 2^w, as slices from the least significant.

    Full adders take three bitmaps of a weight to one of it and one of the next, many at a time; zero bitmaps fill up.
    """
    out, w = [], 0
    while columns:
        parts = columns.pop(w, [])
        if parts:
            stack = np.concatenate(parts)
            while len(stack) > 1:
                third = len(stack) // 3
                if third == 0:
                    a, b = stack
                    columns.setdefault(w + 1, []).append((a & b)[None])
                    stack = (a ^ b)[None]
                    break
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                columns.setdefault(w + 1, []).append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            out.append(stack[0])
        else:
            out.append(None)
        w += 1
        if w > 128:
            raise OverflowError("scores beyond 128 bits")
    return out


def top_rows(sums: list, valid: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best rows, from the most significant slice downward; of rows that tie, the first."""
    sure, tied = np.zeros_like(valid), valid
    for s in reversed(sums):
        ones = tied & s if s is not None else np.zeros_like(valid)
        n = int(np.bitwise_count(sure | ones).sum())
        if n >= k:
            tied = ones
        else:
            sure, tied = sure | ones, tied & ~s if s is not None else tied
    best = _places(sure)
    return np.concatenate([best, _places(tied)[: max(0, k - len(best))]])


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(block: dict, qids: np.ndarray, weights: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(place, query_id, vec_id, score) of the k best rows of the block for each query."""
    ids = np.frombuffer(block["ids"], np.int64)
    dims, bits, low = block["dims"], block["bits"], block["low"]
    words = -(-len(ids) // 64)
    plus = np.frombuffer(block["slices"], "<u8").reshape(dims, bits, words)
    both = np.stack([plus, ~plus])  # the complement, (2^bits - 1) - u, for negative weights
    every = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view("<u8")
    for place, (qid, q) in enumerate(zip(qids.tolist(), weights, strict=True)):
        columns: dict[int, list[np.ndarray]] = {}
        size = np.abs(q)
        for i in range(int(size.max(initial=0)).bit_length()):
            at = np.flatnonzero((size >> i) & 1)
            if not len(at):
                continue
            picked = both[(q[at] < 0).astype(int), at]
            for j in range(bits):
                columns.setdefault(i + j, []).append(picked[:, j])
        sums = add_slices(columns)
        own = slice(np.searchsorted(ids, qid, "left"), np.searchsorted(ids, qid, "right"))
        valid = every.copy()
        for p in range(own.start, own.stop):
            valid[p >> 6] &= ~np.uint64(1 << (p & 63))
        rows = top_rows(sums, valid, k)
        constant = low * int(q.sum()) - ((1 << bits) - 1) * int(size[q < 0].sum())
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        score = [constant] * len(rows)
        for w, s in enumerate(sums):
            if s is not None:
                score = [x + (int(b) << w) for x, b in zip(score, (s[word] >> bit) & np.uint64(1), strict=True)]
        for r, x in zip(rows.tolist(), score, strict=True):
            yield place, qid, int(ids[r]), x


def _search(shared, k: int):
    """The k best of all blocks of a task for each query of the wave: shared holds (first place, dims, ids, weights) of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(c)[i].as_py() for c in ("dims", "bits", "low", "ids", "slices")}
                for first, dims, qids, weights in shared.value:
                    if dims != block["dims"]:
                        continue
                    w = np.frombuffer(weights, np.int64).reshape(-1, dims) if dims else np.zeros((len(qids) // 8, 0), np.int64)
                    for place, qid, vec_id, score in search_block(block, np.frombuffer(qids, np.int64), w, k):
                        best.setdefault(first + place, []).append((-score, vec_id, qid))
                for place, found in best.items():
                    if len(found) > k:
                        best[place] = sorted(found)[:k]
        rows = [(place, qid, vec_id, -score) for place, found in best.items() for score, vec_id, qid in found]
        for start in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[start : start + 100_000], strict=True)], schema=_arrow(ANSWERS))

    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * x) of each component; rows without an id, and vectors that are null or hold a null or non-finite component, take no part."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def build_index(vectors: DataFrame, rows: int = BLOCK_ROWS, scale: int = SCALE) -> str:
    """The path of the bit-sliced index, a table of a row per block."""
    return save(quantised(vectors, scale).mapInArrow(lean(_index(rows)), INDEX), "bit-slices")


def _fit(vectors: DataFrame, scale: int) -> None:
    """Raises ValueError where scores could leave 64 bits: most dimensions times the square of the largest component."""
    x = F.transform("embedding", lambda v: F.when(~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))), F.abs(v.cast("double"))))
    r = vectors.agg(F.max(F.array_max(x)).alias("most"), F.max(F.size("embedding")).alias("dims")).first()
    if r["most"] is not None and ((r["most"] * scale + 1) ** 2) * r["dims"] >= 2.0**63:
        raise ValueError(f"components up to {r['most']:g} in {r['dims']} dimensions: their integer inner products may not fit 64 bits")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, rows: int = BLOCK_ROWS, wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors with the largest integer inner product for each row of queries.

    Ties go to the smaller vec_id. Rows with the query's own vec_id are not among its answers, and vectors of another
    length are not comparable. Fewer than k candidates give fewer rows, none give none. A repeated query row is
    answered each time, a repeated candidate is as many candidates. Vectors that are null or hold a null or non-finite
    component take no part; components so large that a score might not fit 64 bits raise a ValueError before any search.
    """
    spark = ship(vectors.sparkSession)
    _fit(vectors, scale)
    _fit(queries, scale)
    index = build_index(vectors, rows, scale)
    asked = written(quantised(queries, scale).mapInArrow(lean(_queries(512)), QUERIES), "queries")
    own = spark.newSession()  # with a setting of its own: a row of the index holds megabytes
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(INDEX_ROWS))
    blocks = own.read.schema(INDEX).parquet(index)
    answers: list[str] = []
    place, held, size = 0, [], 0

    def answer() -> None:
        shared = spark.sparkContext.broadcast(held)
        found = blocks.mapInArrow(lean(_search(shared, k)), ANSWERS)
        answers.append(save(found, "answers"))
        shared.unpersist()

    for r in asked.toLocalIterator():  # blocks of queries, a wave of them at a time
        held.append((place, r["dims"], bytes(r["ids"]), bytes(r["weights"])))
        place, size = place + len(r["ids"]) // 8, size + len(r["weights"])
        if size >= wave:
            answer()
            held, size = [], 0
    if held:
        answer()
    found = spark.read.schema(ANSWERS).parquet(*answers) if answers else spark.createDataFrame([], ANSWERS)
    best = Window.partitionBy("place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
