"""SentencePiece encoding and decoding: a Viterbi search driven by an Aho-Corasick automaton over the pieces.

The automaton reads a text once. At each end position its output links give every piece that ends there, longest
first, and each relaxes the best score of that position. A character that no piece covers falls back to its UTF-8
bytes. Where no piece has a space after another character, the best path is made of the best paths of the chunks
"spaces, then other characters", so chunks are encoded once per worker and looked up after that.

Spaces stand for the model's space mark and the text is not normalised, so decoding gives back the exact text; a
literal space mark in a text goes by its bytes. The model's scores are taken as they are: the path of the highest sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import lean, table
from loomgraph.session import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Chunks that a task remembers with their ids; twice as many at most.
KEPT = 40_000


def load_pieces(path: str = MODEL) -> dict:
    """Pieces, scores and byte ids of a model file; read on the driver, about a megabyte."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    bytes_ = {int(m.id_to_piece(i)[1:-1], 16): i for i in ids if m.is_byte(i)}
    plain = [(m.id_to_piece(i).replace(MARK, " "), i, m.get_score(i)) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return {"plain": plain, "bytes": bytes_}


class Codec:
    def __init__(self, pieces: dict, kept: int = KEPT):
        import ahocorasick

        self.byte_ids, self.kept = pieces["bytes"], kept
        self.new: dict[str, bytes] = {}  # chunks seen lately, and those before: when new is full it becomes old
        self.old: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i, score in pieces["plain"]:
            self.automaton.add_word(text, (len(text), i, score))
        self.automaton.make_automaton()
        self.penalty = min((s for *_, s in pieces["plain"]), default=0.0) - 10
        self.single = {t for t, *_ in pieces["plain"] if len(t) == 1}
        self.out = {i: text.encode() for text, i, _ in pieces["plain"]} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        inner = any(" " in t.lstrip(" ") for t, *_ in pieces["plain"])
        self.chunks = (lambda t: [t]) if inner else re.compile(" *[^ ]+| +").findall

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best path. Of equal scores the longest last piece wins; bytes come last."""
        n = len(text)
        if self.single.issuperset(text):  # every position has a piece that ends there, better than any bytes
            best, back = [0.0] + [-1e300] * n, [None] * (n + 1)
            for end, piece in self.automaton.iter(text):
                length, _, own = piece
                end += 1
                score = best[end - length] + own
                if score > best[end]:
                    best[end], back[end] = score, piece
            ids, end = [], n
            while end:
                length, i, _ = back[end]
                ids.append(i)
                end -= length
            ids.reverse()
            return ids
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        found = self.automaton.iter(text)
        hit = next(found, None)
        for end in range(1, n + 1):
            score, step = -1e300, None
            while hit is not None and hit[0] == end - 1:
                length, i, own = hit[1]
                if (s := best[end - length] + own) > score:
                    score, step = s, (length, i)
                hit = next(found, None)
            raw = text[end - 1].encode("utf-8", "surrogatepass")
            if (s := best[end - 1] + self.penalty * len(raw)) > score:
                score, step = s, (1, raw)
            best[end], back[end] = score, step
        ids, end = [], n
        while end:
            length, i = back[end]
            ids += [i] if isinstance(i, int) else [self.byte_ids[b] for b in reversed(i)]
            end -= length
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        out, new, old = [], self.new, self.old
        for chunk in self.chunks(text):
            got = new.get(chunk)
            if got is None:
                got = old.get(chunk)
                if got is None:
                    got = np.array(self.viterbi(chunk), np.int32).tobytes()
                if len(chunk) <= 64:
                    if len(new) >= self.kept:
                        self.old, self.new = new, {}
                        new, old = self.new, self.old
                    new[chunk] = got
            out.append(got)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        return b"".join([out.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


def _share(spark: SparkSession, path: str):
    ship(spark)
    return spark.sparkContext.broadcast(load_pieces(path))


def _added(batch: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def _ids(codec: Codec, texts: pa.Array) -> pa.Array:
    """The ids of texts, null for null."""
    rows = [codec.encode(t.as_py()) if t.is_valid else None for t in texts]
    offsets = np.concatenate([[0], np.cumsum([0 if r is None else len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array([r is None for r in rows], pa.bool_()))


def _texts(codec: Codec, ids: pa.Array) -> pa.Array:
    return pa.array([codec.decode(r.values.to_numpy()) if r.is_valid else None for r in ids], pa.string())


def encode(docs: DataFrame, path: str = MODEL, text: str = "text", into: str = "pieces") -> DataFrame:
    """docs and the ids of their texts, array<int>; one row for each row of docs, repeated ones too.

    A null text gives null, an empty text an empty array, an empty table no rows. A column of docs named like the new one
    is replaced; all others are passed through and play no part.
    """
    docs = docs.drop(into)
    shared, at = _share(docs.sparkSession, path), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for part in _parts(batch, at):
                yield _added(part, _ids(codec, part.column(at)), into)

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, path: str = MODEL, pieces: str = "pieces", into: str = "decoded") -> DataFrame:
    """coded and the texts of its ids; one row for each row of coded, repeated ones too.

    Ids that stand for no text (controls) give nothing, null gives null, an empty table no rows. A column of coded named
    like the new one is replaced.
    """
    coded = coded.drop(into)
    shared, at = _share(coded.sparkSession, path), coded.columns.index(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for part in _parts(batch, at):
                yield _added(part, _texts(codec, part.column(at)), into)

    return coded.mapInArrow(lean(run), T.StructType([*coded.schema.fields, T.StructField(into, T.StringType())]))


def _parts(batch: pa.RecordBatch, at: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some megabytes of the column, a row at least."""
    sizes = np.diff(batch.column(at).offsets.to_numpy()) if pa.types.is_list(batch.column(at).type) else np.diff(np.frombuffer(batch.column(at).buffers()[1], np.int32)[batch.column(at).offset :][: batch.num_rows + 1])
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def token_rows(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, pieces and whether decoding them gives the text back; encoded and decoded in one pass, by one worker for each task."""
    docs = docs.select("doc_id", "text")
    shared = _share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for part in _parts(batch, 1):
                ids = _ids(codec, part.column(1))
                same = [a == b for a, b in zip(part.column(1).to_pylist(), _texts(codec, ids).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(same, pa.bool_())], names=["doc_id", "pieces", "exact"])

    return docs.mapInArrow(lean(run), T.StructType([docs.schema["doc_id"], T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())]))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), F.crc32(F.array_join("pieces", " ").cast("binary")).alias("pieces_crc32"), "exact")
