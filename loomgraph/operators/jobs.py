"""Orchestration on the driver: order of passes, lock, run ledger, normalisation with resume, abstraction on demand, paths."""

from __future__ import annotations

import contextlib
import fcntl
import os
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import passes
from loomgraph.session import Scratch
from loomgraph.sources.store import Store


def steps(models: list[str], numbers: list[str]) -> list[tuple[str, str | None]]:
    """(pass, model) in the order in which an extraction runs: 1 by model, 2 once, 3 to 9 by model, 10 once, 12 by model, then 11."""
    order = [("1", True), ("2", False), *((str(n), True) for n in range(3, 10)), ("10", False), ("12", True), ("11", True)]
    return [(n, m) for n, by_model in order if n in numbers for m in (models if by_model else [None])]


def extract(models: list[str], numbers: list[str], run_pass: Callable[[str, str | None], None], count: Callable[[], tuple[int, int]]) -> dict:
    """Runs the passes in order; the ledger row with the numbers of entities and assertions before and after."""
    before = count()
    done = []
    for number, model in steps(models, numbers):
        run_pass(number, model)
        done.append((number, model))
    after = count()
    return {"models": models, "passes": numbers, "steps": done, "entities_before": before[0], "assertions_before": before[1], "entities_after": after[0], "assertions_after": after[1]}


@contextlib.contextmanager
def exclusive(path: str) -> Iterator[None]:
    """One job at a time on the driver's machine: a second one fails at once, and the lock ends with its holder."""
    with open(path, "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as error:
            raise RuntimeError(f"{path} is locked by another job") from error
        try:
            f.write(str(os.getpid()))
            f.flush()
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def normalise(tables: dict[str, DataFrame], subpasses: dict[str, Callable[[dict], dict]], model: str, promote: Callable[[dict], dict], again: bool = False) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables, ran): 10a, 10b and 10c in order, those left out that model has completed, then promotion.

    again starts over: vectors and the progress of these passes are dropped first.
    """
    out = dict(tables)
    if again:
        out["progress"] = passes.reset(out["progress"], tuple(subpasses))
        out["embeddings"] = out["embeddings"].limit(0)
    ran = []
    whole = out["progress"].sparkSession.createDataFrame([("__global__",)], "entity_id string")
    for number in sorted(subpasses):
        if passes.outstanding(whole, out["progress"], number, model).isEmpty():
            continue
        out = subpasses[number](out)
        out["progress"] = passes.completed(out["progress"], whole, number, model)
        ran.append(number)
    return promote(out), ran


def resumable(store: Store, steps: list[tuple[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]], after: Callable[[str], None] | None = None) -> list[str]:
    """Runs steps over the tables of a store, each at most once; the names of those that ran.

    A step takes the tables and returns those that it changes. These and the mark that the step is done are one version
    of the store, so a job that died is run again as it is: finished steps are passed over, and a step that had not
    been committed starts from the tables it had. after is called after each commit.
    """
    ran = []
    for name, step in steps:
        m = store.manifest()
        if name in m["applied"]:
            continue
        store.commit(step(store.read(check=False)), m["number"], applied={name: 1})
        ran.append(name)
        if after:
            after(name)
    return ran


def compress(assertions: DataFrame, vectors: DataFrame, statements: Callable[[DataFrame], DataFrame], subjects: DataFrame | None = None, proposed: int = 0, cap: int | None = 5_000, least: int = 3, threshold: float = 0.25, dry: bool = False, model: str = "model", entities: DataFrame | None = None, by: str = "id", small: int = 4096) -> DataFrame:
    """Abstractions on demand: of all subjects, or of those given (id), without a mark of progress.

    assertions as normalise.abstractions takes them; vectors: id, vector. Live assertions of a subject are clustered by
    average linkage, and clusters of at least so many become abstraction rows with what statements says of their
    prompts, as many as the queue has room for, or all without a cap. A dry run gives subject_id, cluster, child_ids and prompt instead, and asks nobody.
    Where assertions share vectors, by is the column that names theirs, vectors has a row for each of its values, and a
    repeated id of a subject counts once. Without a cap, and with at most small vectors, a subject of at most small
    assertions is clustered and put into words in one task, many subjects to a task; larger ones go through rounds.
    """
    from loomgraph.operators import clustering
    from loomgraph.operators import normalise as norms

    rows = assertions if subjects is None else assertions.join(subjects.select(F.col("id").alias("subject_id")).distinct(), "subject_id", "left_semi")
    save = Scratch(rows, "compress")
    near, together = vectors, None
    if by != "id":
        rows = rows.where(F.col("status").isin("accepted", "proposed"))
        known = vectors.where(F.col(by).isNotNull()).select(by, clustering.unit("vector").alias("v")).limit(small + 1).collect() if cap is None else None
        if known is not None and len(known) <= small:
            large = save(rows.groupBy("subject_id").agg(F.count("*").alias("n")).where(F.col("n") > small).select(F.col("subject_id").alias("big")))
            hot = not large.isEmpty()  # there are fewer than rows / small
            mine = F.col("subject_id") == F.col("big")
            together = norms.clusters_together(rows.join(F.broadcast(large), mine, "left_anti") if hot else rows, [tuple(k) for k in known], by, threshold, least, entities)
            rows = rows.join(F.broadcast(large), mine, "left_semi")
        if together is None or hot:
            rows = save(rows.dropDuplicates(["subject_id", "id"]))
            near = rows.select("id", by).join(vectors, by).select("id", "vector")
    if together is None or hot:
        live = save(norms.abstraction_groups(rows, least))
        labels = clustering.linkage_by_group(live.select(F.col("subject_id").alias("grp"), "id").join(near, "id"), threshold, small=small).select("id", "cluster")
        made = norms.clusters_made(live, save(labels), proposed, cap, least, entities)
        made = made if together is None else made.unionByName(together)
    else:
        made = together
    return made.select("subject_id", "cluster", "child_ids", "prompt") if dry else norms.accept_abstractions(made, statements(made), model=model)


def store_path(flag: str | None = None, env: dict | None = None, pointer: str | None = None, shipped: str = "store") -> str:
    """Where the store is: a flag, else LOOMGRAPH_STORE, else what a pointer file names, else the shipped copy."""
    env = os.environ if env is None else env
    if flag:
        return flag
    if env.get("LOOMGRAPH_STORE"):
        return env["LOOMGRAPH_STORE"]
    if pointer and Path(pointer).is_file() and (named := Path(pointer).read_text().strip()):
        return named
    return shipped


def size_warning(nodes: DataFrame, most: int = 50_000) -> str | None:
    """What to say of a graph of more than most nodes, else nothing."""
    n = nodes.agg(F.count("*")).first()[0]
    return f"{n} nodes are more than {most}: rebuild less often" if n > most else None
