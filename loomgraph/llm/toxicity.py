"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary documents and one on toxic ones, and every window of a document is
compressed with either behind the same context. What the toxic dictionary saves tells how much the window is like toxic
text. How many windows save more than calibrated amounts goes into a logistic score.

Trained on whole documents, both dictionaries would hold what is frequent, and that is the same ordinary language. So what
both classes share is taken out of the toxic documents first: of their words those are left that hold a segment which toxic
text has far too often for chance. The toxic dictionary is trained on that residue and stands behind the content of the
ordinary one, so that shared language costs the same with either. Both are raw-content dictionaries.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import lean, slices, table
from loomgraph.session import ship

#: Bounds on the training sample: so many labelled documents of each class (the smallest hashes of their ids), and bytes of all.
SAMPLE = 1_500
SAMPLE_BYTES = 64_000_000
WINDOW = 16
LEVEL, MATCH = 11, 4
#: Bytes of the ordinary dictionary and of what the toxic one has besides, and of the context before each window.
CONTENT, SPECIAL = 8_192, 16_384
CONTEXT = 16
STEPS = (1, 2, 3, 4, 5, 6, 8)
FOLDS = 5
#: A segment needs so many toxic documents, and of the segments kept at most this share may be there by chance.
HANDFUL = 5
RATE = 0.001
#: Bytes of a word that is held whole.
LONG = 40


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def _subs(word: bytes) -> Iterator[bytes]:
    for i in range(len(word) - 3):
        for j in range(i + 4, min(len(word), i + 10) + 1):
            yield word[i:j]


def _often(counts: Counter, least: int) -> Counter:
    """Segments of the words that are counted least times or more. Hashed counts come first, so that rare segments are never held."""
    rough = np.zeros(1 << 22, np.int64)
    for w, n in counts.items():
        rough[list({hash(x) & 0x3FFFFF for x in _subs(w)})] += n
    wide = rough >= least
    seen: Counter = Counter()
    for w, n in counts.items():
        for x in {x for x in _subs(w) if wide[hash(x) & 0x3FFFFF]}:
            seen[x] += n
    return Counter({x: n for x, n in seen.items() if n >= least})


def _significant(seen: Counter, also: Counter, scale: float) -> set:
    """Segments that toxic text has too often for chance: Chernoff bounds of the binomial tail, false discoveries kept below RATE."""
    q = scale / (1 + scale)
    keys = list(seen)
    t, o = np.array([seen[x] for x in keys], float), np.array([also[x] for x in keys], float)
    n = t + o
    tail = -(t * np.log(t / (n * q)) + np.where(o > 0, o * np.log(np.maximum(o, 1) / (n * (1 - q))), 0))
    tail = np.where(t > n * q, tail, 0.0)
    order = np.argsort(tail, kind="stable")
    good = np.flatnonzero(tail[order] <= np.log(RATE * np.arange(1, len(keys) + 1) / max(1, len(keys))))
    return {keys[i] for i in order[: good[-1] + 1]} if len(good) else set()


def telling(toxic: Counter, ordinary: Counter, scale: float) -> set:
    """Segments that HANDFUL toxic documents have, far more than ordinary ones and too many for chance. toxic, ordinary: documents by word."""
    seen = _often(toxic, HANDFUL)
    if not seen:
        return set()
    also: Counter = Counter()
    for w, n in ordinary.items():
        for x in {x for x in _subs(w) if x in seen}:
            also[x] += n
    return {x for x in _significant(seen, also, scale) if seen[x] > 12 * (also[x] + 0.5) * scale}


def residue(docs: list[list[bytes]], segments: set) -> list[bytes]:
    """What is left of each document (its words) when only words with a telling segment stay; documents without any are left out."""
    kept: dict[bytes, bytes] = {}
    for w in {w for ws in docs for w in ws}:
        found = [x for x in _subs(w) if x in segments]
        if found:
            kept[w] = _near(w, max(found, key=len))
    rest = (b" ".join(kept[w] for w in ws if w in kept) for ws in docs)
    return [r + b" " for r in rest if len(r) >= 8]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that zstandard trains on the samples; where they are too few for it, the samples themselves."""
    import zstandard

    try:
        raw = zstandard.train_dictionary(size, samples, k=40, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    start = raw.find(b"\x01\0\0\0\x04\0\0\0\x08\0\0\0")  # the first offsets, which stand between the tables and the content
    return raw[start + 12 :] if start >= 0 else b"".join(samples)[-size:]


def _near(word: bytes, segment: bytes) -> bytes:
    """The word, or of a long unspaced run what is around the segment."""
    at = word.index(segment)
    return word if len(word) <= LONG else word[max(0, at - 8) : at + len(segment) + 8]


def _counted(texts: list[list[bytes]]) -> Counter:
    """Documents by word, but no more than the word has different neighbours: copies of a document are no further evidence."""
    docs: Counter = Counter()
    near = defaultdict(set)
    for ws in texts:
        docs.update(set(ws))
        for before, w, after in zip([b"", *ws], ws, [*ws[1:], b""]):
            near[w].add(hash((before, after)))
    return Counter({w: min(n, len(near[w])) for w, n in docs.items()})


FEATURES = 2 * len(STEPS) + 1


class Model:
    """What the executors need: two dictionaries and the logistic weights, a few tens of kilobytes."""

    def __init__(self, ordinary: bytes, toxic: bytes, context: bytes):
        self.parts, self.weights = (ordinary, toxic, context), np.zeros(FEATURES + 1)
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        self.made = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def compressors(self):
        import zstandard

        if self.made is None:
            out = []
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
            for content in self.parts[:2]:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress)
            self.made = out
        return self.made

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window: whole words, WINDOW bytes or little more."""
        ordinary, toxic = self.compressors()
        context, out, held, size = self.parts[2], [], [], 0
        for w in words(text):
            held.append(w)
            size += len(w) + 1
            if size >= WINDOW:
                x = context + b" ".join(held) + b" "
                out.append(len(ordinary(x)) - len(toxic(x)))
                held, size = [], 0
        if held:
            x = context + b" ".join(held) + b" "
            out.append(len(ordinary(x)) - len(toxic(x)))
        return np.array(out, np.int64)

    def features(self, text: str | None) -> np.ndarray:
        """Logarithms of the share and of the number of windows that save STEPS bytes, and of the number of all."""
        saved = self.savings(text)
        count = np.array([(saved >= k).sum() for k in STEPS])
        return np.r_[np.log((count + 0.02) / (len(saved) + 4.0)), np.log(count + 0.1), np.log(len(saved) + 1.0)]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.spread @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[str | None, int]], share: float | None = None) -> Model:
    """A model of (text, toxic) rows. The dictionaries learn from two thirds, the thresholds are calibrated on the rest.

    share: how much of all labelled text is toxic. The classes are weighed half way between that and equal shares, so
    that a toxic document is seldom missed and an ordinary one seldom accused.
    """
    rows = [(t, y) for t, y in rows if t and t.strip()]
    learn, tune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    texts = [[words(t) for t, y in learn if y == k] for k in (0, 1)]
    count = [_counted(x) for x in texts]
    size = [1 + sum(len(w) for ws in x for w in ws) for x in texts]
    context = b" ".join(w for w, _ in sorted(count[0].items(), key=lambda x: (x[1], x[0]))[-CONTEXT:])[-CONTEXT:]
    common = dictionary([b" ".join(ws) for ws in texts[0]], CONTENT)
    special = dictionary(residue(texts[1], telling(count[1], count[0], size[1] / size[0])), SPECIAL)
    model = Model(common + b" " + context + b" " * 8, common + b" " + special + b" " + context + b" " * 8, context)
    if tune and len({y for _, y in tune}) == 2:
        x, y = np.array([model.features(t) for t, _ in tune]), np.array([y for _, y in tune], float)
        model.mean, model.spread = x.mean(0), x.std(0) + 1e-6
        z = np.hstack([np.ones((len(x), 1)), (x - model.mean) / model.spread])
        heavy = ((y.mean() if share is None else share) + 0.5) / 2
        w, own = np.zeros(z.shape[1]), np.where(y == 1, heavy / y.sum(), (1 - heavy) / (1 - y).sum())
        for _ in range(50):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (own * (p - y)) + 1e-3 * np.r_[0, w[1:]]
            h = (z * (own * p * (1 - p))[:, None]).T @ z + 1e-3 * np.diag(np.r_[1e-6, np.ones(len(w) - 1)])
            w = w - np.linalg.solve(h, g)
        model.weights = w
    else:
        model.weights[0] = -5.0 if not any(y for _, y in rows) else 5.0
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod FOLDS is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most sample documents of each class and most bytes in all, none of them held out, in order of a hash of their ids.

    A text that does not fit what is left of the bytes is passed over, and the next ones are looked at. Repeated rows
    of a document count once; different texts under one id are each taken, and a null text is an empty one. Ids and
    lengths are looked at first; only the texts chosen leave the executors.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic", F.md5(F.concat(F.lit("tox:"), F.col("doc_id").cast("string"))).alias("place"))
    picked = None
    for y in (0, 1):
        part = usable.where(F.col("toxic") == y).orderBy("place").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    print_ = F.xxhash64("text").alias("print")
    size = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "place", F.octet_length("text").cast("long").alias("bytes"), print_).distinct()
    chosen, total = [], 0
    for r in sorted(size.collect(), key=lambda r: (r["place"], r["toxic"], r["bytes"], r["print"])):  # a row for each text of the documents picked
        if total + r["bytes"] <= most:
            total += r["bytes"]
            chosen.append((r["doc_id"], r["toxic"], r["place"], r["print"]))
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, place string, print long")
    rows = texts.join(F.broadcast(ids.drop("print").distinct()), "doc_id").withColumn("print", print_).join(F.broadcast(ids.select("place", "toxic", "print")), ["place", "toxic", "print"]).select("place", "text", "toxic").distinct().collect()
    return [(r["text"], int(r["toxic"])) for r in sorted(rows, key=lambda r: (r["place"], r["text"], r["toxic"]))]


def toxic_share(labels: DataFrame) -> float | None:
    """The share of label 1 among the labels that may be learned from."""
    return labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of whole texts, one row for each row of docs, repeated ones too.

    Null and empty texts have no windows and get the score of none. Equal texts get equal scores, as nothing but the text
    counts; other columns of docs play no part. An empty table gives no rows.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in (p for batch in batches for p in slices(batch)):
            texts = part.column(1)
            x = np.array([own.features(texts[i].as_py()) for i in range(part.num_rows)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = train(training_rows(docs, labels), toxic_share(labels))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
