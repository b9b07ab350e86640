"""The seam to language models and embedders: routing, retry, classification, a deterministic stand-in, and maps over tables.

No network is used here: a provider is an object with model_id, extract(prompt, schema, entity_name) and classify(prompt,
options). The maps run it on the executors over Arrow batches, behind the response cache.
"""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import ship
from loomgraph.sources.snapshot import cache_misses

#: Status codes that no repetition mends (fixed values).
FATAL = (400, 401, 403)


def route(model: str) -> tuple[str, str]:
    """(kind, model name): 'ollama/<name>' is local, 'claude-...' has a kind of its own, all else speaks the common protocol."""
    if model.startswith("ollama/"):
        return "ollama", model.removeprefix("ollama/")
    return ("anthropic" if model.startswith("claude-") else "openai"), model


class FatalError(Exception):
    """A refusal that is not worth another try."""


def with_retry(call: Callable, attempts: int = 3, first: float = 1.0, factor: float = 2.0, most: float = 60.0, sleep: Callable = time.sleep):
    """call() with up to attempts tries: waits grow by factor, with a tenth of chance, up to most; what the answer asks for wins."""
    for n in range(attempts):
        try:
            return call()
        except FatalError:
            raise
        except Exception as error:
            code = next((c for c in (getattr(error, a, None) for a in ("status_code", "code", "status")) if isinstance(c, int)), None)
            if code in FATAL:
                raise FatalError(f"HTTP {code}: {error}") from error
            if n == attempts - 1:
                raise
            base = first * factor**n
            asked = _asked(error)
            sleep(min(base * random.uniform(0.9, 1.1), most) if asked is None else asked)


def _asked(error: Exception) -> float | None:
    """Seconds that the answer asks to wait: Retry-After, else until X-RateLimit-Reset."""
    headers = getattr(getattr(error, "response", None), "headers", {})
    for name, now in (("Retry-After", 0.0), ("X-RateLimit-Reset", time.time())):
        try:
            return max(0.0, float(headers[name]) - now)
        except (KeyError, TypeError, ValueError):
            continue
    return None


def chosen(answer: Column, options: list[str]) -> Column:
    """The option that the answer names, case aside; the first where it names none."""
    text = F.lower(F.trim(answer))
    return F.coalesce(*[F.when(text == o.lower(), F.lit(o)) for o in options], F.lit(options[0]))


class Fake:
    """Answers from a table of (schema, entity name), for tests and dry runs; it refuses what it does not know."""

    def __init__(self, answers: dict | None = None, classes: dict | None = None, model_id: str = "fake"):
        self.answers, self.classes, self.model_id = answers or {}, classes or {}, model_id

    def extract(self, prompt: str, schema: str, entity_name: str | None = None):
        return self.answers[schema, entity_name]

    def classify(self, prompt: str, options: list[str]) -> str:
        text = self.classes.get(prompt, options[0])
        return next((o for o in options if o.lower() == text.strip().lower()), options[0])


def ask(rows: DataFrame, call: Callable[[str], str], prompt: str = "prompt", into: str = "answer") -> DataFrame:
    """rows with the answer to each prompt, null where the call failed; each row is asked once, in batches on the executors."""
    from pyspark.sql.types import StringType, StructField, StructType

    ship(rows.sparkSession)
    rows = rows.drop(into)

    def one(text):
        try:
            return with_retry(lambda: call(text))
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{into: [one(t) for t in frame[prompt]]})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(into, StringType())]))


def cached(prompts: DataFrame, cache: DataFrame, call: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(answers, new): prompts (model, prompt) with response, from the cache (model, prompt_hash, response) where it has them.

    new are the rows that the cache lacks, to be appended. A repeated prompt is asked once.
    """
    asked = prompts.select("model", "prompt").distinct()
    fresh = ask(cache_misses(asked, cache), call, into="response").where("response is not null").select("model", "prompt_hash", "response")
    known = cache.select("model", "prompt_hash", "response").unionByName(fresh).groupBy("model", "prompt_hash").agg(F.min("response").alias("response"))
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256)).join(known, ["model", "prompt_hash"], "left"), fresh


def hashed_vector(text: str | None, dims: int = 64) -> np.ndarray:
    """A unit vector of hashed letter triples: a deterministic embedder that needs no model. Empty text gives zeros."""
    s = f"  {(text or '').strip().lower()} " if (text or "").strip() else ""
    v = np.zeros(dims)
    for i in range(len(s) - 2):
        h = zlib.crc32(s[i : i + 3].encode("utf-8", "replace"))
        v[h % dims] += 1 if h & 0x10000 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def embed(rows: DataFrame, text: str, into: str = "vector", embedder: Callable[[str], np.ndarray] = hashed_vector) -> DataFrame:
    """rows with a vector for each text, by a Pandas function over Arrow batches."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embedder(t).tolist())

    return rows.withColumn(into, run(F.col(text)))


def paraphrase(patterns: DataFrame, call: Callable[[str], str], model: str) -> DataFrame:
    """patterns (name, problem, solution, paraphrased) with text in new words; those that have been paraphrased are left alone."""
    todo = patterns.where(~F.coalesce("paraphrased", F.lit(False)))
    for c in ("problem", "solution"):
        todo = ask(todo.withColumn("_prompt", F.concat(F.lit(f"Say the {c} of the pattern "), "name", F.lit(" in your own words:\n"), c)), call, "_prompt", "_said")
        todo = todo.withColumn(c, F.coalesce("_said", c)).drop("_prompt", "_said")
    done = todo.withColumn("paraphrased", F.lit(True)).withColumn("source_model", F.lit(model))
    return patterns.where("paraphrased").unionByName(done, allowMissingColumns=True)


def check_constraints(constraints: DataFrame, assertions: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """(constraint_id, assertion_id, prompt, verdict): each constraint against the accepted assertions that touch its subject."""
    live = assertions.where("status = 'accepted'")
    ends = live.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"), F.col("id").alias("assertion_id"), "subject_id", "predicate", "object_id")
    pairs = constraints.select(F.col("id").alias("constraint_id"), F.col("subject_id").alias("entity_id"), "rule", "constraint_type").join(ends, "entity_id")
    prompt = F.concat(F.lit("Constraint ["), F.substring("constraint_id", 1, 8), F.lit("] ("), "constraint_type", F.lit("): "), "rule", F.lit("\nAssertion ["), F.substring("assertion_id", 1, 8), F.lit("]: "), F.concat_ws(" ", "subject_id", "predicate", "object_id"))
    return ask(pairs.withColumn("prompt", prompt), call, into="verdict").select("constraint_id", "assertion_id", "prompt", "verdict")
