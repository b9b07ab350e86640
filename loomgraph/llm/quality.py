"""Quality classification by co-training two views of a document.

One view is the content (what byte pairs the text is made of, how it repeats itself), the other the metadata (language,
source, length, and the layout of the page: lines, words, cases, symbols). Both start from a bounded sample of labelled
documents. In each round every document that is not in that sample is scored by both views, and those that one view is
sure of, all of them, teach the other: executors add up the moments of the sure documents of either class, and the other
view takes a step on labels and pseudo-labels together. Then both are calibrated on labelled documents that they have
not seen, and the calibrated views are combined into one score for every document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomgraph.llm.common import fresh, lean, slices, table
from loomgraph.session import ship

#: Bound on the labelled sample that classifiers are fitted to: the smallest hashes of their ids. Pseudo-labels have no bound.
LABELLED = 4_000
ROUNDS = 2
SURE = 0.97
PAIRS = 128
LANGS, SOURCES, SHAPES = 16, 32, 11
CONTENT, METADATA = PAIRS + 3, LANGS + SOURCES + SHAPES
#: Sums over documents are kept in units of 1/GRID, as integers, so that no order of adding changes them.
GRID = 1 << 16
_KIND = np.zeros(256, np.int64)
for _kinds, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\v\f"), 1):
    _KIND[np.frombuffer(_chars, np.uint8)] = _kinds
_KIND[128:] = 5


def views(text: str | None, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a document.

    Content: shares of hashed byte pairs (as roots), their entropy, words like the one before, and different words.
    Metadata: hashed language and source, and the layout of the page in numbers.
    """
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int64)
    words, lines, n = text.split(), text.split("\n"), max(1, len(text))
    a, b = np.zeros(CONTENT, np.float32), np.zeros(METADATA, np.float32)
    if len(raw) > 1:
        share = np.bincount((raw[:-1] * 31 + raw[1:] * 7) % PAIRS, minlength=PAIRS) / (len(raw) - 1)
        a[:PAIRS] = np.sqrt(share)
        a[PAIRS] = -(share[share > 0] * np.log(share[share > 0])).sum() / math.log(PAIRS)
    if len(words) > 1:
        a[PAIRS + 1] = sum(map(str.__eq__, words, words[1:])) / (len(words) - 1)
        a[PAIRS + 2] = len(set(words)) / len(words)
    b[zlib.crc32((lang or "").encode("utf-8", "replace")) % LANGS] = 1
    b[LANGS + zlib.crc32((source or "").encode("utf-8", "replace")) % SOURCES] = 1
    kinds = np.bincount(_KIND[raw], minlength=6) / max(1, len(raw))
    b[LANGS + SOURCES :] = (math.log1p(len(text)) / 5, math.log1p(len(lines)) / 3, math.log1p(n / len(lines)) / 5, math.log1p(len(words) / len(lines)) / 4, n / max(1, len(words)) / 10, len(set(lines)) / len(lines), len(max(words, key=len, default="")) / 50, *kinds[[0, 2, 3, 4]])
    return a, b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """A ridge logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        z = self.design(x)
        self.penalty = np.r_[1e-3, np.full(z.shape[1] - 1, ridge)]
        self.weights = np.zeros(z.shape[1])
        for _ in range(12):
            step = np.linalg.solve(self.curvature(z), self.slope(z, y))
            self.weights = self.weights - step
            if np.abs(step).max() < 1e-6:
                break

    def design(self, x: np.ndarray) -> np.ndarray:
        """Features with a constant, standardised; far out ones are cut off, so that a strange document cannot rule a sum."""
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.spread, -20, 20)])

    def curvature(self, z: np.ndarray) -> np.ndarray:
        p = _sigmoid(z @ self.weights)
        return (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(self.penalty)

    def slope(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        return z.T @ (_sigmoid(z @ self.weights) - y) + self.penalty * self.weights

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weights, -30, 30)


def _arrays(part: pa.RecordBatch, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    both = [views(*x) for x in zip(*(part.column(i).to_pylist() for i in at), strict=True)]
    return np.array([x[0] for x in both]).reshape(-1, CONTENT), np.array([x[1] for x in both]).reshape(-1, METADATA)


def _sample(docs: DataFrame, labels: DataFrame, labelled: int) -> list[tuple]:
    """(place, id, label, content, metadata) of the labelled sample. Ids are chosen first, texts never leave the executors."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("labelled_id"), F.col("quality").cast("int").alias("y"))
    known = known.groupBy("labelled_id").agg(F.min("y").alias("y"))
    picked = known.withColumn("place", F.md5(F.concat(F.lit("quality:"), F.col("labelled_id").cast("string")))).orderBy("place").limit(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                a, b = _arrays(part, [3, 4, 5])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(a.tolist(), pa.list_(pa.float32())), pa.array(b.tolist(), pa.list_(pa.float32()))], names=["place", "id", "y", "a", "b"])

    rows = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled_id")).select("place", F.col("doc_id").cast("string").alias("id"), "y", "text", "lang", "source")
    found = rows.mapInArrow(lean(run), "place string, id string, y int, a array<float>, b array<float>")
    one = found.groupBy("place", "id", "y").agg(F.min(F.struct("a", "b")).alias("x"))  # a row for each id, however often it is repeated
    return sorted((r["place"], r["id"], r["y"], r["x"]["a"], r["x"]["b"]) for r in one.collect())


def _lessons(docs: DataFrame, models: list[Linear], taken: set[str]) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """For each view and pseudo-label: how many documents the other view is sure of, and the sums of their moments and slopes.

    Every document but the labelled sample counts. A partition sends a row for each pair of features; these are added up
    by Spark, so the driver sees as many numbers as the views have pairs of features.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast((models, taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views_, known = shared.value
        sums: dict = {}
        for batch in batches:
            for part in slices(batch):
                x = _arrays(part, [1, 2, 3])
                free = np.array([i not in known for i in part.column(0).to_pylist()])
                p = [_sigmoid(m.logit(v)) for m, v in zip(views_, x, strict=True)]
                for v, m in enumerate(views_):
                    for y in (0, 1):
                        sure = free & ((p[1 - v] >= SURE) if y else (p[1 - v] <= 1 - SURE))
                        if sure.any():
                            z = m.design(x[v][sure])
                            got = sums.setdefault((v, y), [0, np.zeros((z.shape[1], z.shape[1])), np.zeros(z.shape[1])])
                            got[0] += len(z)
                            got[1] += z.T @ z
                            got[2] += z.T @ (p[v][sure] - y)
        for (v, y), (n, square, slope) in sums.items():
            i, j = np.triu_indices(len(slope))
            value = np.rint(np.r_[n, square[i, j] * GRID, slope * GRID]).astype(np.int64)
            keys = np.r_[-1, i * 1000 + j, 1_000_000 + np.arange(len(slope))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), 2 * v + y), pa.int32()), pa.array(keys, pa.int32()), pa.array(value, pa.int64())], names=["lesson", "k", "x"])

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text", "lang", "source").mapInArrow(lean(run), "lesson int, k int, x long")
    out: dict = {}
    for r in rows.groupBy("lesson", "k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        key = divmod(r["lesson"], 2)
        n, square, slope = out.setdefault(key, [0, *(np.zeros(s) for s in ((len(models[key[0]].weights),) * 2, len(models[key[0]].weights)))])
        if r["k"] < 0:
            out[key][0] = int(r["x"])
        elif r["k"] < 1_000_000:
            i, j = divmod(r["k"], 1000)
            square[i, j] = square[j, i] = float(r["x"]) / GRID
        else:
            slope[r["k"] - 1_000_000] = float(r["x"]) / GRID
    return out


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict:
    """Both views' classifiers, their calibration and the weights that combine them; taught: pseudo-labels of each round."""
    rows = _sample(docs, labels, labelled)
    if len({r[2] for r in rows}) < 2:  # nothing to tell apart: everything gets the one label there is
        return {"constant": float(rows[0][2]) if rows else 1.0}
    x = [np.array([r[k] for r in rows], float) for k in (3, 4)]
    y = np.array([r[2] for r in rows], float)
    tune = np.arange(len(y)) % 4 == 0
    if len(set(y[tune])) < 2 or len(set(y[~tune])) < 2:
        tune = np.zeros(len(y), bool)
    models = [Linear(v[~tune], y[~tune]) for v in x]
    weight = [(y[~tune] == k).sum() for k in (0, 1)]
    taught = []
    for _ in range(rounds):
        lessons = _lessons(docs, models, {r[1] for r in rows})
        taught.append({k: v[0] for k, v in lessons.items()})
        for v, m in enumerate(models):
            z = m.design(x[v][~tune])
            curve, slope = m.curvature(z), m.slope(z, y[~tune])
            for k in (0, 1):
                n, square, g = lessons.get((v, k), (0, 0.0, 0.0))
                share = min(1.0, float(weight[k]) / n) if n else 0.0  # pseudo-labels of a class weigh no more than its labels
                curve = curve + share * square / 4  # the curvature's upper bound, so that the step cannot overshoot
                slope = slope + share * g
            m.weights = m.weights - np.linalg.solve(curve, slope)
    use = tune if tune.any() else np.ones(len(y), bool)
    logits = [m.logit(v[use]) for m, v in zip(models, x, strict=True)]
    scales = [Linear(z[:, None] / 10, y[use], 0.1) for z in logits]
    calibrated = np.array([s.logit(z[:, None] / 10) for s, z in zip(scales, logits, strict=True)]).T
    return {"models": models, "scales": scales, "both": Linear(calibrated / 10, y[use], 0.1), "taught": taught}


def score(model: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(a), model["constant"])
    z = np.array([s.logit(m.logit(x)[:, None] / 10) for m, s, x in zip(model["models"], model["scales"], (a, b), strict=True)]).T
    return _sigmoid(model["both"].logit(z / 10))


def classify(docs: DataFrame, labels: DataFrame, model: dict | None = None, into: str = "quality_score", **options) -> DataFrame:
    """docs with the column into, the probability of quality 1; one row for each row of docs.

    Null text counts as empty, null language and source as values of their own. A row without an id is scored like any
    other, and is never in the labelled sample; of repeated ids one counts as labelled. Without labels of both kinds all
    scores are the one label, or 1. A column into in docs is replaced. An empty table gives no rows.
    """
    spark = ship(docs.sparkSession)
    docs = docs.drop(into)
    shared = spark.sparkContext.broadcast(train(docs, labels, **options) if model is None else model)
    names = docs.columns
    at = [names.index(c) for c in ("text", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(shared.value, *_arrays(part, at)), pa.float64())], names=[*names, into])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns of docs, whatever their names; nulls, repeats and empty tables as in classify."""
    own = fresh(docs, "quality_score")
    return classify(docs, labels, into=own).where(F.col(own) >= threshold).drop(own)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
