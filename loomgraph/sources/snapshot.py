"""Snapshots: lossless Parquet stores, JSON and CSV exports, imports with reference resolution, incremental indexes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scalars import decode_list, encode_list, parse_date
from loomgraph.session import ship
from loomgraph.sources.store import Store


def save_store(tables: dict[str, DataFrame], path: str) -> None:
    """tables, and no others, as the next version of the store in path: readers see it at once and whole, or not at all."""
    store = Store(next(iter(tables.values())).sparkSession, path)
    store.commit(tables, drop=tuple(store.manifest()["tables"]))


def load_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last version; a ValueError where a part is not as it was written, or the format is a newer one."""
    return Store(spark, path).read()


def export_names(rows: DataFrame, entities: DataFrame, *columns: str) -> DataFrame:
    """rows with ids replaced by the names of entities that are not merged; other ids stay."""
    for c in columns:
        live = entities.where("status <> 'merged'").select(F.col("id").alias(c), F.col("name").alias("_name"))
        rows = rows.join(live, c, "left").withColumn(c, F.coalesce("_name", c)).drop("_name")
    return rows


def import_names(rows: DataFrame, entities: DataFrame, *columns: str) -> DataFrame:
    """rows with <c>_resolved for each column: by exact name (the last of equals, merged ones too), then by id, else null."""
    by_name = entities.groupBy("name").agg(F.max_by("id", F.struct("seq", "id")).alias("_by_name"))
    ids = entities.select(F.col("id").alias("_id"))
    for c in columns:
        rows = rows.join(by_name, rows[c] == by_name["name"], "left").drop("name").join(ids, F.col(c) == F.col("_id"), "left")
        rows = rows.withColumn(f"{c}_resolved", F.coalesce("_by_name", "_id")).drop("_by_name", "_id")
    return rows


def upsert(existing: DataFrame, new: DataFrame, key: str = "id", replace: bool = False) -> DataFrame:
    """existing and the rows of new whose key it lacks; with replace, new rows win."""
    new = new.where(F.coalesce(F.col(key), F.lit("")) != "").dropDuplicates([key])
    if replace:
        return existing.join(new.select(key), key, "left_anti").unionByName(new)
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """One type per folder; lists as JSON text."""
    lists = {n for n, t in rows.dtypes if t.startswith("array")}
    rows.select([encode_list(F.col(c)).alias(c) if c in lists else F.col(c) for c in rows.columns]).write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...] = ()) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows.select([decode_list(F.col(c)).alias(c) if c in lists else F.col(c) for c in rows.columns])


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A name per line, trimmed, without blanks."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def missing_vectors(entities: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Entities, not merged, without a vector of their present name."""
    rows = entities.where("status <> 'merged'").withColumn("content_hash", F.sha2("name", 256))
    return rows.join(embeddings.select(F.col("item_id").alias("id"), "content_hash"), ["id", "content_hash"], "left_anti")


def cache_misses(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts (model, prompt) that the cache (model, prompt_hash) lacks."""
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256)).join(cache.select("model", "prompt_hash"), ["model", "prompt_hash"], "left_anti")


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, title, headings, paragraphs, links) of raw HTML, by regular expressions."""
    html = F.col("html")
    return pages.select("page_id", F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(html, F.lit(r"<h[1-6]>")).alias("headings"), F.regexp_count(html, F.lit(r"<p>")).alias("paragraphs"), F.regexp_count(html, F.lit(r'href="')).alias("links"))


#: Columns of each type in the JSON snapshot, in its order; <c>_id columns appear as names, child_ids as their number. What
#: is not named here is lost in a round trip: force affects, pattern force and related lists, child_ids, is_entrance, the
#: rationale of constraints, patterns and anti-patterns, consistency, framings and the stamp of evaluation; source_model
#: becomes "imported" but for entities. Promotion cannot go on after a restore. save_store keeps everything.
EXPORTED = {
    "entities": ("id", "name", "entity_type", "description", "status", "source_model", "created_at"),
    "assertions": ("id", "subject_id", "predicate", "object_id", "confidence", "knowledge_origin", "rationale", "applicability", "conditions", "exceptions", "status", "created_at"),
    "constraints": ("id", "subject_id", "rule", "constraint_type", "conditions", "exceptions", "confidence", "knowledge_origin", "status", "created_at"),
    "patterns": ("id", "name", "subject_id", "context", "problem", "solution", "consequences", "emergent_properties", "confidence", "knowledge_origin", "status", "created_at"),
    "forces": ("id", "name", "direction", "rationale", "confidence", "knowledge_origin", "status", "created_at"),
    "antipatterns": ("id", "name", "subject_id", "conditions", "consequences", "mitigations", "confidence", "knowledge_origin", "status", "created_at"),
    "spatial_relations": ("id", "subject_id", "relation", "object_id", "confidence", "knowledge_origin", "rationale", "status", "created_at"),
    "process_relations": ("id", "predecessor_id", "successor_id", "hard_constraint", "rationale", "confidence", "knowledge_origin", "status", "created_at"),
    "abstraction_nodes": ("id", "statement", "child_ids", "abstraction_rationale", "confidence", "status", "created_at"),
}
_EMPTY = ("description", "rationale")
#: Types in the order of an import: what others refer to comes first.
IMPORTED = ("entities", "forces", "assertions", "constraints", "patterns", "antipatterns", "spatial_relations", "process_relations", "abstraction_nodes")
_OPTIONAL = {"patterns", "antipatterns"}


def export_type(rows: DataFrame, entities: DataFrame, item_type: str, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of a type as the JSON snapshot has them: of some statuses, ids of entities that are not merged as names, without what it does not keep.

    A column that rows lack is left out; a missing description or rationale is empty, and so is a missing subject.
    """
    rows = rows if statuses is None else rows.where(F.col("status").isin(*statuses))
    kept = [c for c in EXPORTED[item_type] if c in rows.columns]
    ids = [c for c in kept if c.endswith("_id")]
    out = export_names(rows.select(*kept), entities, *ids)
    shown = []
    for c in kept:
        if c == "child_ids":
            shown.append(F.size(c).alias("child_count"))
        elif c in ids:
            shown.append(F.coalesce(c, F.lit("")).alias(c.removesuffix("_id")))
        else:
            shown.append(F.coalesce(c, F.lit("")).alias(c) if c in _EMPTY else F.col(c))
    return out.select(*shown)


def export_all(tables: dict[str, DataFrame], statuses: tuple[str, ...] | None = None, types: tuple[str, ...] = tuple(EXPORTED)) -> dict[str, DataFrame]:
    return {t: export_type(tables[t], tables["entities"], t, statuses) for t in types if t in tables}


def write_snapshot(tables: dict[str, DataFrame], path: str, statuses: tuple[str, ...] | None = None) -> None:
    """Every type as JSON lines in a folder of its own below path, written by the executors."""
    for name, rows in export_all(tables, statuses).items():
        write_json(rows, f"{path}/{name}")


def import_type(existing: DataFrame, new: DataFrame, entities: DataFrame, item_type: str, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table, counts): rows of a snapshot added to a table of the type; counts: item_type, added, skipped.

    Rows without an id and, unless they replace, rows whose id is there are skipped, and so are rows that name an unknown
    entity; patterns and anti-patterns may have none. Names go before ids. Of rows with one id one is taken. Dates that are
    none become the time of the query; confidence is 0.5, status proposed and origin imported where they are missing.
    """
    ends = [c for c in EXPORTED[item_type] if c.endswith("_id")]
    rows = new.where(F.coalesce(F.col("id"), F.lit("")) != "").dropDuplicates(["id"])
    if not replace:
        rows = rows.join(existing.select("id"), "id", "left_anti")
    for end in ends:
        rows = rows.withColumnRenamed(end.removesuffix("_id"), end)
        rows = import_names(rows, entities, end).drop(end).withColumnRenamed(f"{end}_resolved", end)
        rows = rows if item_type in _OPTIONAL else rows.where(F.col(end).isNotNull())
    given = {"status": F.lit("proposed"), "confidence": F.lit(0.5), "knowledge_origin": F.lit("imported"), "entity_type": F.lit("component")}
    for c, value in given.items():
        if c in existing.columns and c in EXPORTED[item_type]:
            rows = rows.withColumn(c, F.coalesce(F.col(c), value) if c in rows.columns else value)
    if "created_at" in existing.columns:
        rows = rows.withColumn("created_at", parse_date(F.col("created_at").cast("string")) if "created_at" in rows.columns else F.current_timestamp())
    if "source_model" in existing.columns:
        known = F.col("source_model") if "source_model" in rows.columns and item_type == "entities" else F.lit(None)
        rows = rows.withColumn("source_model", F.coalesce(known, F.lit("imported")))
    rows = rows.select(*[c for c in existing.columns if c in rows.columns])
    kept = existing.join(rows.select("id"), "id", "left_anti")
    counts = new.agg(F.count("*").alias("all")).crossJoin(rows.agg(F.count("*").alias("added")))  # one row each
    return kept.unionByName(rows, allowMissingColumns=True), counts.select(F.lit(item_type).alias("item_type"), "added", (F.col("all") - F.col("added")).alias("skipped"))


def import_all(tables: dict[str, DataFrame], new: dict[str, DataFrame], replace: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, counts) after a snapshot was imported: entities and forces first, then what names them."""
    out, counts = dict(tables), None
    for name in IMPORTED:
        if name in new and name in tables:
            out[name], part = import_type(out[name], new[name], out["entities"], name, replace)
            counts = part if counts is None else counts.unionByName(part)
    return out, counts


def put_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache with new rows (model, prompt_hash, response); the newer of a key stays."""
    key = ["model", "prompt_hash"]
    return cache.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def get_cache(cache: DataFrame, prompts: DataFrame) -> DataFrame:
    """prompts (model, prompt) with the response that the cache has for them, or null."""
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256)).join(cache.select("model", "prompt_hash", "response"), ["model", "prompt_hash"], "left")


def build_index(entities: DataFrame, embeddings: DataFrame, embed, model: str = "model") -> DataFrame:
    """embeddings (item_id, model, content_hash, vector) with a vector of every entity's present name; only new and changed names are embedded."""
    own = embeddings.where(F.col("model") == model)
    todo = missing_vectors(entities, own)
    made = embed(todo, "name").select(F.col("id").alias("item_id"), F.lit(model).alias("model"), "content_hash", "vector")
    rest = embeddings.join(made.select("item_id", "model"), ["item_id", "model"], "left_anti")
    return rest.unionByName(made, allowMissingColumns=True)


def page_chunks(docs: DataFrame, pages: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, chunk_id, first, last, text): pages of a text (cut at form feeds), so many together, blank ones left out."""
    flat = docs.select(key, F.posexplode(F.split("text", "\f")).alias("page", "piece"))
    rows = flat.withColumn("chunk", F.floor(F.col("page") / pages)).where(F.trim(F.regexp_replace("piece", r"\s+", " ")) != "")
    groups = rows.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("page", "piece"))).alias("all"))  # as many rows as pages go together
    last = flat.groupBy(key).agg(F.max("page").alias("end"))
    first = F.col("chunk") * pages + 1
    end = F.least(F.col("chunk") * pages + pages, F.col("end") + 1)
    return groups.join(last, key).select(key, F.concat(F.col(key).cast("string"), F.lit("_p"), first.cast("string"), F.lit("-"), end.cast("string")).alias("chunk_id"), first.cast("int").alias("first"), end.cast("int").alias("last"), F.array_join(F.transform("all", lambda x: x["piece"]), "\n").alias("text"))


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of plain-text documents in a folder, a form feed between pages. PDF needs a reader that is not here."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc_id"), F.col("value").alias("text"))


class _Patterns(HTMLParser):
    """Patterns of a page: details of the class pattern under h2 sections, with their summary, paragraphs and links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.section, self.now, self.text, self.where, self.link, self.depth = [], "", None, [], None, None, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kinds = (a.get("class") or "").split()
        if tag == "details" and "pattern" in kinds:
            self.now = {"id": a.get("id") or "", "section": self.section, "summary": "", "higher": [], "lower": [], "problem": [], "solution": [], "mode": None}
        elif tag in ("h2", "summary", "p", "strong"):
            if tag == "p":
                self.where = "higher" if "higher-patterns" in kinds else "lower" if "lower-patterns" in kinds else "text"
            if tag == "strong" and self.now is not None:
                self.before, self.text = self.text, []
            else:
                self.text = []
        elif tag == "a" and self.where in ("higher", "lower"):
            self.link, self.text = (a.get("href") or "").lstrip("#"), []

    def handle_data(self, data):
        self.text.append(data)

    def handle_endtag(self, tag):
        said = " ".join("".join(self.text).split())
        if tag == "h2":
            self.section = said
        elif self.now is None:
            return
        elif tag == "summary":
            self.now["summary"] = said
        elif tag == "strong":
            label = said.rstrip(":").lower()
            if label in ("problem", "solution"):
                self.now["mode"], self.text = label, self.before
            else:
                self.text = [*self.before, said]
        elif tag == "a" and self.link is not None:
            self.now[self.where].append((self.link, _stars(said)))
            self.link = None
        elif tag == "p":
            if self.where == "text" and self.now["mode"] and said:
                self.now[self.now["mode"]].append(said)
            self.where = None
        elif tag == "details":
            self.found.append(self.now)
            self.now = None


def _stars(text: str) -> tuple[int | None, str, str]:
    """(number, name, stars) of a title such as '12 NAME**'."""
    stars = "**" if text.endswith("**") else "*" if text.endswith("*") else ""
    text = text[: len(text) - len(stars)].strip()
    head, _, rest = text.partition(" ")
    return (int(head), rest.strip() or text, stars) if head.isdigit() else (None, rest.strip() or text, stars)


def pattern_rows(pages: DataFrame) -> DataFrame:
    """(page_id, number, slug, name, confidence, section, problem, solution, higher, lower, related_pattern_names) of the patterns in pages of HTML.

    higher and lower are slugs of linked patterns. A page without patterns gives no rows.
    """
    ship(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                parser = _Patterns()
                parser.feed(html or "")
                for p in parser.found:
                    number, name, stars = _stars(p["summary"])
                    out.append((page, number, p["id"], name, stars, p["section"], "\n".join(p["problem"]), "\n".join(p["solution"]), [x for x, _ in p["higher"]], [x for x, _ in p["lower"]], [t[1] for _, t in p["higher"] + p["lower"]]))
            yield pd.DataFrame(out, columns=["page_id", "number", "slug", "name", "confidence", "section", "problem", "solution", "higher", "lower", "related_pattern_names"]).astype({"number": "Int64"})

    schema = f"page_id {dict(pages.dtypes)['page_id']}, number long, slug string, name string, confidence string, section string, problem string, solution string, higher array<string>, lower array<string>, related_pattern_names array<string>"
    return pages.select("page_id", "html").mapInPandas(run, schema)
