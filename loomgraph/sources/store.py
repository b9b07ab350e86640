"""A store of tables with versions beside one another, swapped at once, and a fingerprint of each part that is checked.

Data folders are written once and never changed. A version is a manifest, a small file that names the folders of every
table with their rows and fingerprints; it is written under a name of its own and renamed to the number of its version,
which fails if another writer was first. Until that rename readers see the version before, whatever a writer that died
has left; what no kept version names is removed by vacuum.

Keyed tables are cut into buckets by a hash of the key, and an upsert reads and writes only the buckets that it touches.
A fingerprint is the number of rows with the sum and the exclusive or of a hash of each: the order of rows and the cut
into files do not matter, and those of parts add up to that of the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.session import remove

#: The format of manifests and tables that this code writes.
FORMAT = 1
BUCKET = "_bucket"

Tables = dict[str, DataFrame]
Migration = Callable[[Tables], Tables]


class Conflict(RuntimeError):
    """Another writer has published the version that was to be written."""


class Damaged(ValueError):
    """A table is not what its manifest says."""


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, in which a null is not nothing and nested values keep their order."""
    parts: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        flat = not kind.startswith(("array", "map", "struct", "variant"))
        parts += [F.isnull(c), c if flat else F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def fingerprint(df: DataFrame, by: str | None = None) -> list[dict]:
    """rows, sum and xor of the row hashes of df, or of each value of the column by."""
    hashed = df.select(*([by] if by else []), row_hash(df.drop(by) if by else df).alias("h"))
    out = hashed.groupBy(*([by] if by else [])).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(28,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.expr("bit_xor(h)"), F.lit(0)).alias("xor"))
    return [r.asDict() for r in out.collect()]


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _publish(spark: SparkSession, text: str, path: str) -> None:
    """text as the file path, whole or not at all; Conflict if there is one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = _fs(spark, path)
    own = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(own, target, options)
    except Exception as error:
        fs.delete(own, False)
        if fs.exists(target):
            raise Conflict(path) from error
        raise


class Store:
    """The versions of a folder. migrations: from each older format to the next one."""

    def __init__(self, spark: SparkSession, path: str, migrations: dict[int, Migration] | None = None, format_: int = FORMAT):
        self.spark, self.path, self.migrations, self.format = spark, path.rstrip("/"), migrations or {}, format_

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in _names(self.spark, f"{self.path}/versions") if n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default of the last; that of an empty store has number 0 and no tables."""
        known = self.versions()
        if version == 0 or (not known and version is None):
            return {"number": 0, "format": self.format, "tables": {}, "applied": {}}
        number = known[-1] if version is None else version
        if number not in known:
            raise ValueError(f"version {number} is not in {self.path}")
        return json.loads(self.spark.read.text(f"{self.path}/versions/{number}.json", wholetext=True).first()["value"])

    def _write(self, df: DataFrame, buckets: int | None, key: list[str]) -> list[dict]:
        """df as new folders; bucket, path and fingerprint of each."""
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        if buckets:
            placed = df.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
            placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(at)
            read = self.spark.read.schema(placed.schema).parquet(at)
            return [{"bucket": r.pop(BUCKET), **r} | {"path": f"{at}/{BUCKET}={b}"} for r in fingerprint(read, BUCKET) for b in (r[BUCKET],)]
        df.write.parquet(at)
        return [{"bucket": None, "path": at} | fingerprint(self.spark.read.schema(df.schema).parquet(at))[0]]

    def _entry(self, df: DataFrame, key: list[str], buckets: int) -> dict:
        n = buckets if key else None
        return {"schema": json.loads(df.schema.json()), "key": key, "buckets": n, "parts": self._write(df, n, key)}

    def commit(self, tables: Tables, base: int | None = None, keys: dict[str, list[str]] | None = None, buckets: int = 8, drop: tuple[str, ...] = (), applied: dict[str, int] | None = None) -> int:
        """A new version in which tables are replaced, those named by drop gone and all others as they were; its number.

        base is the version that the writer has read: if it is no longer the last, or another writer is first, Conflict.
        keys names the key columns of tables that upsert will change.
        """
        old = self.manifest(base)
        if base is not None and self.versions()[-1:] not in ([], [base]):
            raise Conflict(f"version {base} is not the last of {self.path}")
        entries = {n: e for n, e in old["tables"].items() if n not in drop}
        for name, df in tables.items():
            entries[name] = self._entry(df, (keys or {}).get(name, entries.get(name, {}).get("key") or []), buckets)
        return self._version(old, entries, applied)

    def _version(self, old: dict, entries: dict, applied: dict[str, int] | None = None) -> int:
        new = {"number": old["number"] + 1, "format": self.format, "tables": entries, "applied": old["applied"] | (applied or {})}
        _publish(self.spark, json.dumps(new), f"{self.path}/versions/{new['number']}.json")
        return new["number"]

    def _part(self, entry: dict, parts: list[dict]) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*[p["path"] for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, check: bool = True) -> Tables:
        """The tables of a version, migrated to the present format. check reads them whole and raises Damaged where a part differs."""
        m = self.manifest(version)
        if m["format"] > self.format:
            raise ValueError(f"format {m['format']} is newer than {self.format}")
        if check:
            for name, entry in m["tables"].items():
                self._check(name, entry)
        tables = {n: self._part(e, e["parts"]) for n, e in m["tables"].items()}
        for number in range(m["format"], self.format):
            if number not in self.migrations:
                raise ValueError(f"no migration from format {number}")
            tables = self.migrations[number](tables)
        return tables

    def _check(self, name: str, entry: dict) -> None:
        if entry["buckets"]:
            df = self._part(entry, entry["parts"])
            at = F.pmod(F.xxhash64(*entry["key"]), F.lit(entry["buckets"])).cast("int")
            found = {r.pop(BUCKET): r for r in fingerprint(df.withColumn(BUCKET, at), BUCKET)}
        else:
            found = {None: fingerprint(self._part(entry, entry["parts"]))[0]}
        want = {p["bucket"]: {k: p[k] for k in ("rows", "sum", "xor")} for p in entry["parts"]}
        if bad := sorted((str(b) for b in found.keys() | want.keys() if found.get(b) != want.get(b))):
            raise Damaged(f"{name}: parts {', '.join(bad)} differ from version's manifest")

    def migrate(self) -> int:
        """The last version in the present format, as a new version if it was an older one."""
        m = self.manifest()
        if m["format"] == self.format:
            return m["number"]
        keys = {n: e["key"] for n, e in m["tables"].items()}
        tables = self.read(m["number"])
        keys = {n: k for n, k in keys.items() if n in tables and all(c in tables[n].columns for c in k)}
        return self.commit(tables, m["number"], keys, drop=tuple(n for n in m["tables"] if n not in tables))

    def upsert(self, name: str, rows: DataFrame, latest: list[str], stream: str | None = None, batch: int | None = None, gone: Column | None = None) -> int:
        """A new version in which, of the old and new rows of each key of a table, the one with the greatest columns latest is left.

        Only buckets that rows touch are read and written. gone marks rows that delete their key; they stay as marks, so
        that an older row that comes later does not bring the key back, and live() leaves them out. A batch of a stream
        that was applied already changes nothing, so a batch that is run again after a crash is harmless. Rows with a
        null in the key are refused with a ValueError. Nulls in latest count as the least.
        """
        old = self.manifest()
        if stream is not None and batch is not None and old["applied"].get(stream, -1) >= batch:
            return old["number"]
        entry = old["tables"][name]
        key, n = entry["key"], entry["buckets"]
        columns = [f["name"] for f in entry["schema"]["fields"]]
        new = rows.withColumn("deleted", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).select(columns)
        if not new.where(" or ".join(f"`{k}` is null" for k in key)).isEmpty():
            raise ValueError(f"{name}: a row without {', '.join(key)}")
        touched = {r[0] for r in new.select(F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")).distinct().collect()}  # n at most
        kept = [p for p in entry["parts"] if p["bucket"] not in touched]
        both = self._part(entry, [p for p in entry["parts"] if p["bucket"] in touched]).unionByName(new)
        rank = F.struct(*[F.col(c) for c in latest], row_hash(both))
        merged = both.groupBy(*key).agg(F.max_by(F.struct(*columns), rank).alias("row")).select("row.*")
        entries = old["tables"] | {name: entry | {"parts": kept + (self._write(merged, n, key) if touched else [])}}
        return self._version(old, entries, {stream: batch} if stream is not None and batch is not None else None)

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last versions, and every folder that none of them names; how many folders went."""
        numbers = self.versions()
        named = {p["path"] for v in numbers[-keep:] for e in self.manifest(v)["tables"].values() for p in e["parts"]}
        used = {p.removeprefix(f"{self.path}/data/").split("/")[0] for p in named}
        for v in numbers[:-keep]:
            remove(self.spark, f"{self.path}/versions/{v}.json")
        unused = [d for d in _names(self.spark, f"{self.path}/data") if d not in used]
        for d in unused:
            remove(self.spark, f"{self.path}/data/{d}")
        return len(unused)


def keyed(df: DataFrame) -> DataFrame:
    """df as the first state of a table that upsert changes: with the mark of deleted keys."""
    return df.withColumn("deleted", F.lit(False))


def live(df: DataFrame) -> DataFrame:
    return df.where("not deleted").drop("deleted")
