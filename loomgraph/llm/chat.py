"""Chat formatting: a hidden Markov model over lines recovers who speaks, then turns are rendered canonically.

States are the roles. A line shows its speaker marker, its length and whether it asks; a new message and a marker let
the role change, other lines stay with it. Viterbi finds the best roles of a whole conversation, however long: a
conversation is cut into pieces of CHUNK turns, each is summed up by its best scores from any role to any role, the
small summaries are chained to fix the roles at the seams, and every piece is decoded between its seams. The model's
counts are taken over all labelled turns but those held out, on the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import lean, small, table, written
from loomgraph.session import ship

#: Turns of a piece of a conversation; a piece in which turns repeat or have no number is cut by a hash of the text too.
CHUNK = 512
FINE = 1 << 16
#: What would end a turn or begin one in rendered text is written with a backslash when it is text.
FORGED = re.compile(r"<(\\*)\|im_(start|end)")
ROLES = ("assistant", "system", "user")
#: Speaker markers at the start of a line, by what they stand for (fixed values).
MARKERS = {"user": ("user", "human", "you", "question", "q"), "assistant": ("assistant", "ai", "bot", "model", "answer", "a"), "system": ("system", "instructions", "context")}
_WHO = {w: k for k, ws in MARKERS.items() for w in ws}
_MARK = re.compile(r"^\s*(?:<\|im_start\|>\s*(\w+)\s*$|(?:\*\*|#+\s*|\[|<\|?)?(" + "|".join(sorted(_WHO, key=len, reverse=True)) + r")(?:\*\*|\]|\|?>)?\s*[:>]\s*)", re.I)


def marker(line: str) -> tuple[str, str]:
    """The speaker a line names, or none, and the line without it."""
    m = _MARK.match(line)
    who = _WHO.get((m[1] or m[2]).lower()) if m else None
    return (who, line[m.end() :]) if who else ("none", line)


def seen(line: str) -> tuple[str, int, bool]:
    who, rest = marker(line)
    return who, min(12, len(rest).bit_length()), rest.rstrip().endswith("?")


class Hmm:
    """Log probabilities by counts with one added: start, message to message, and what lines show.

    start, step: counts by role, and by role and next role; shows: counts by what is shown (marker, size of line, question,
    size of message), role and value.
    """

    def __init__(self, start_counts: dict, step_counts: dict, shown: dict, roles=ROLES):
        self.roles = roles
        at = {r: i for i, r in enumerate(roles)}
        n = len(roles)
        start, step = np.ones(n), np.ones((n, n))
        for r, count in start_counts.items():
            start[at[r]] += count
        for (r, then), count in step_counts.items():
            step[at[r], at[then]] += count
        shows = [[Counter() for _ in roles] for _ in range(4)]
        for (k, r, v), count in shown.items():
            shows[k][at[r]][v] += count
        self.start, self.step = np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True))
        values = ([*MARKERS, "none"], range(13), (False, True), range(13))

        def share(k: int, counts: Counter, role: str, v, n: int) -> float:
            # a speaker's own marker is likely, another's is not, however few lines of the role there are
            prior = 1 / n if k else 0.2 if v == role else 0.01 if v in MARKERS else 0.78
            return (counts[v] + 20 * prior) / (sum(counts.values()) + 20)

        self.shows = [{v: np.log([share(k, c, r, v, len(vs)) for c, r in zip(cs, roles, strict=True)]) for v in vs} for k, (vs, cs) in enumerate(zip(values, shows, strict=True))]
        self.stay = np.log(np.where(np.eye(n) > 0, 1 - 1e-6 * (n - 1), 1e-6))
        self.open = np.log(np.full((n, n), 1 / n))

    def lines(self, text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(change, emission) of each line of a message."""
        text = text or ""
        out = []
        for i, line in enumerate(text.split("\n")):
            who, size, asks = seen(line)
            shown = self.shows[0][who] + 0.1 * (self.shows[1][size] + self.shows[2][asks])
            if i == 0:
                shown = shown + self.shows[3][min(12, len(text).bit_length())]
            out.append((self.step if i == 0 else self.open if who != "none" else self.stay, shown))
        return out

    def advance(self, scores: np.ndarray, text: str | None, first: bool = False) -> np.ndarray:
        """Best scores after a message, from those before it; a matrix is a row for each role before."""
        for i, (change, shown) in enumerate(self.lines(text)):
            scores = (self.start if first and i == 0 else (scores[..., :, None] + change).max(-2)) + shown
        return scores

    def summary(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Best scores at the end: when the conversation starts here, and from each role before."""
        n = len(self.roles)
        lead, body = self.advance(np.zeros(n), texts[0], True), np.where(np.eye(n) > 0, 0.0, -1e18)
        for i, t in enumerate(texts):
            body = self.advance(body, t)
            lead = self.advance(lead, t) if i else lead
        return lead, body

    def decode(self, texts: list, before: int, after: int) -> list[list[int]]:
        """The role of each line; before: the role at the seam, -1 at the start; after: the role at the end."""
        steps, rows = [], [self.lines(t) for t in texts]
        scores, backs = None, []
        for change, shown in (x for r in rows for x in r):
            if scores is None and before < 0:
                scores = self.start + shown
                backs.append(None)
            else:
                held = (scores[:, None] if scores is not None else np.where(np.arange(len(self.roles)) == before, 0.0, -1e18)[:, None]) + change
                backs.append(held.argmax(0))
                scores = held.max(0) + shown
        at = after
        for back in reversed(backs):
            steps.append(at)
            at = int(back[at]) if back is not None else at
        steps.reverse()
        out, i = [], 0
        for r in rows:
            out.append(steps[i : i + len(r)])
            i += len(r)
        return out


def render(text: str | None, roles: list[str]) -> tuple[str, int]:
    """Canonical turns: a header line with the role, the lines, an end line; and their number.

    A marker is left out where it names the role that was found; a word before a colon that names another is text. Turn
    marks inside the text get a backslash, so that no text can open or end a turn.
    """
    out, last, n = [], None, 0
    for line, role in zip((text or "").split("\n"), roles, strict=True):
        who, rest = marker(line)
        named = who == role
        if role != last or (named and rest != line):
            if last is not None:
                out.append("<|im_end|>")
            out.append(f"<|im_start|>{role}")
            last, n = role, n + 1
        if rest or not named:
            out.append(FORGED.sub(r"<\\\1|im_\2", rest if named else line))
    return "\n".join([*out, "<|im_end|>"]) + "\n", n


def unrender(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of rendered turns, backslashes taken back."""
    turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", rendered, re.S)
    return [(role, re.sub(r"<\\(\\*)\|im_(start|end)", r"<\1|im_\2", text.removesuffix("\n"))) for role, text in turns]


def train(turns: DataFrame) -> Hmm:
    """A model of all labelled turns but the conversations with crc32(conv_id) mod 5 = 0, which are held out.

    The driver gets sums only, as many as there are roles and values.
    """
    usable = turns.where(F.col("role").isin(*ROLES) & (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                counts[3, role, str(min(12, len(text).bit_length()))] += 1
                for line in text.split("\n"):
                    for k, v in enumerate(seen(line)):
                        counts[k, role, str(v)] += 1
        rows = [(*key, n) for key, n in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["k", "role", "v", "n"])

    shown = ship(turns.sparkSession) and usable.select("role", "text").mapInArrow(lean(run), "k int, role string, v string, n long")
    value = {0: str, 1: int, 2: "True".__eq__, 3: int}
    shown = {(r["k"], r["role"], value[r["k"]](r["v"])): r["n"] for r in shown.groupBy("k", "role", "v").agg(F.sum("n").alias("n")).collect()}
    one = usable.where("turn is not null").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    first = one.groupBy("conv_id").agg(F.min_by("role", "turn").alias("role")).groupBy("role").count()
    then = one.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("then"))
    step = one.join(then, ["conv_id", "turn"]).groupBy("role", "then").count()
    return Hmm({r["role"]: r["count"] for r in first.collect()}, {(r["role"], r["then"]): r["count"] for r in step.collect()}, shown)


def pieces(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, turn, text and piece, which orders the pieces of a conversation and is bounded in size.

    A piece is chunk turn numbers. Where so many rows share them that a piece would be more than four chunks, it is cut by
    turn and by a hash of the text, and turns without a number, which come first, always are.
    """
    low = F.floor(F.col("turn") / chunk).cast("long")
    fine = F.pmod(F.xxhash64("text"), F.lit(FINE)).cast("long")
    rows = turns.select("conv_id", "turn", "text", low.alias("low"))
    full = rows.where("low is not null").groupBy("conv_id", "low").agg(F.count("*").alias("n")).where(F.col("n") > 4 * chunk)
    full = small(written(full.select(F.col("conv_id").alias("c"), F.col("low").alias("l"), F.lit(True).alias("full")), "full-pieces"))
    rows = rows.join(full, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("low") == F.col("l")), "left")
    cut = F.when(F.col("low").isNull(), fine + 1).when(F.col("full"), (F.col("turn") - F.col("low") * chunk) * FINE + fine + 1).otherwise(F.lit(0).cast("long"))
    return rows.select("conv_id", "turn", "text", F.struct(F.col("low"), cut.alias("cut")).alias("piece"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The runs of equal leading columns in sorted batches, each whole, as rows of Python values."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, group in groupby(rows, key=lambda r: str(r[:keys])):
        whole = list(group)
        yield whole[0][:keys], whole


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    for part in batched(rows, most):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def parse(turns: DataFrame, model: Hmm | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per message (conv_id, turn, text): conv_id, turn, role (of its first line), n_turns, rendered.

    The roles of the input are used for training only. Null text counts as empty; a null conv_id is one conversation,
    a null turn comes first; messages of equal turn, and those without, follow one another by their text, or in a crowded
    piece by a hash of it and then the text. Repeated rows each get a row. An empty table gives no rows.
    """
    spark = ship(turns.sparkSession)
    shared = spark.sparkContext.broadcast(model or train(turns))
    kind = "struct<low:bigint,cut:bigint>"
    numbers, ids = pa.list_(pa.float64()), [("conv_id", pa.int64()), ("piece", pa.struct([("low", pa.int64()), ("cut", pa.int64())]))]
    summed = pa.schema([*ids, ("lead", numbers), ("body", numbers)])
    seamed = pa.schema([*ids, ("before", pa.int32()), ("after", pa.int32())])
    rendered = pa.schema([ids[0], ("turn", pa.int64()), ("role", pa.string()), ("n_turns", pa.int32()), ("rendered", pa.string())])

    def ordered(df: DataFrame, *more: str) -> DataFrame:
        return df.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", *more)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = shared.value

        def rows() -> Iterator[tuple]:
            for key, piece in _groups(batches, 2):
                lead, body = hmm.summary([r[3] for r in piece])
                yield (*key, lead.tolist(), body.ravel().tolist())

        return _batches(rows(), summed, 2_000)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value.roles)

        def rows() -> Iterator[tuple]:
            for _, conv in _groups(batches, 1):
                scores, backs = None, []
                for *_, lead, body in conv:
                    if scores is None:
                        scores = np.array(lead)
                        backs.append(np.full(n, -1))
                    else:
                        held = scores[:, None] + np.array(body).reshape(n, n)
                        backs.append(held.argmax(0))
                        scores = held.max(0)
                at, seams = int(scores.argmax()), []
                for back in reversed(backs):
                    seams.append((int(back[at]), at))
                    at = int(back[at])
                yield from ((*r[:2], *seam) for r, seam in zip(conv, reversed(seams), strict=True))

        return _batches(rows(), seamed, 10_000)

    def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = shared.value

        def rows() -> Iterator[tuple]:
            for (conv, _), piece in _groups(batches, 2):
                found = hmm.decode([r[3] for r in piece], *piece[0][4:6])
                for (_, _, turn, text, *_), states in zip(piece, found, strict=True):
                    roles = [hmm.roles[i] for i in states]
                    done, n = render(text, roles)
                    yield conv, turn, roles[0], n, done

        return _batches(rows(), rendered, chunk)

    rows = pieces(turns, chunk).select("conv_id", "piece", "turn", "text")
    summaries = ordered(rows, "turn", "text").mapInArrow(lean(sum_up), f"conv_id long, piece {kind}, lead array<double>, body array<double>")
    seams = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(lean(chain), f"conv_id long, piece {kind}, before int, after int")
    seams = seams.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), "before", "after")
    joined = rows.join(seams, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("piece").eqNullSafe(F.col("p"))).drop("c", "p")
    return ordered(joined, "turn", "text").mapInArrow(lean(write_out), "conv_id long, turn long, role string, n_turns int, rendered string")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return parsed.select("conv_id", "turn", "role", "n_turns", F.crc32(F.col("rendered").cast("binary")).alias("rendered_crc32"), F.length("rendered").cast("long").alias("rendered_chars"))
