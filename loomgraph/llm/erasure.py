"""Cascading erasure by a co-ordered merge scan.

Tables are laid out in files sorted by the CRC of the person they belong to, so the files of all tables and the victims
share one order and one set of hash ranges. Erasing then needs no join and shuffles no table: each file is a task that
advances two cursors, one over the file and one over the sorted victims of the file's hash range, in batches. Equal
CRCs of different people are told apart by their ids. Survivors are streamed into a new file. What a table loses is,
in the order in which it was met, the sorted victim list of the table below it, so the cascade needs no shuffle either.

The driver handles lists of files and of sorted parts, as any reader of files does; rows, keys and victims are streamed
by the tasks. A task writes under a name of its own and renames; files are replaced only after all tasks have ended.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh, lean, small, table, written
from loomgraph.session import remove, shared_dir, ship

FILES = 350
ONE_IN = 400
BATCH = 65_536
#: Bytes of a row group of the sorted parts: a file's task reads the groups that it needs.
GROUP_BYTES = 1 << 20

FILE = "table_name string, file_no long, n_rows long, n_erased long, cents long, rewritten boolean, ids_sha256 string, columns string, path string"
LAID = FILE + ", keys string, lo_crc long, lo_id long, hi_crc long, hi_id long"
SCANNED = FILE + ", staged string, lost string, lo_crc long, lo_id long, hi_crc long, hi_id long"


class Plan(NamedTuple):
    """How a table is erased: the column that victims name, whether rows of one CRC ascend by it, and the column of money."""

    victim: str
    ordered: bool
    money: str


def crc(key: Column) -> Column:
    """The CRC under which a row is sorted: that of the decimal key, of the empty string for a null one."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def _qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, so that Spark and the tasks mean the same file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _move(old: str, new: str) -> None:
    """old takes new's place; asked again after it has, it does nothing."""
    where, a = _at(old)
    b = _at(new)[1]
    if where.get_file_info(a).type == fs.FileType.NotFound:
        return
    if not isinstance(where, fs.LocalFileSystem) and where.get_file_info(b).type != fs.FileType.NotFound:
        where.delete_file(b)
    where.move(a, b)


class _Out:
    """A Parquet file written in row groups under a name of this attempt, renamed when it is whole."""

    def __init__(self, uri: str, schema: pa.Schema, **options):
        self.uri, self.tmp, self.held, self.rows = uri, f"{uri}.{uuid.uuid4().hex}.tmp", [], 0
        where, path = _at(self.tmp)
        where.create_dir(posixpath.dirname(path), recursive=True)
        self.sink = where.open_output_stream(path)
        self.writer = pq.ParquetWriter(self.sink, schema, **options)

    def add(self, batch: pa.RecordBatch) -> None:
        if batch.num_rows:
            self.held.append(batch)
            self.rows += batch.num_rows
        if self.rows >= 2 * BATCH:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held))
        self.held, self.rows = [], 0

    def close(self, keep: bool = True) -> None:
        self.flush()
        self.writer.close()
        self.sink.close()
        if keep:
            _move(self.tmp, self.uri)
        else:
            where, path = _at(self.tmp)
            where.delete_file(path)


class _Digest:
    """What is reported of a file: rows, cents and the hash of its first column, taken batch by batch."""

    def __init__(self, money: str):
        self.money, self.n, self.cents, self.hash = money, 0, 0, hashlib.sha256()

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        ids = pc.fill_null(batch.column(0).cast(pa.string()), "").to_pylist()
        self.hash.update(((("," if self.n else "") + ",".join(ids))).encode())
        self.n += batch.num_rows
        x = batch.column(batch.schema.get_field_index(self.money)).cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.cents += int(np.floor(100 * np.where(np.isfinite(x), x, 0.0) + 0.5).astype(np.int64).sum())

    def row(self) -> dict:
        return {"n_rows": self.n, "cents": self.cents, "ids_sha256": self.hash.hexdigest()}


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for null, and where they are null."""
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _part(uri: str, first: int = 0, count: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows first to first + count of a Parquet file, reading the row groups that hold them."""
    where, path = _at(uri)
    with where.open_input_file(path) as source, pq.ParquetFile(source) as file:
        sizes = [file.metadata.row_group(g).num_rows for g in range(file.metadata.num_row_groups)]
        starts = np.cumsum([0, *sizes])
        end = int(starts[-1]) if count is None else first + count
        groups = [g for g in range(len(sizes)) if starts[g] < end and starts[g + 1] > first]
        at = int(starts[groups[0]]) if groups else 0
        for batch in file.iter_batches(BATCH, row_groups=groups):
            cut = batch.slice(max(0, first - at), max(0, min(batch.num_rows, end - at) - max(0, first - at)))
            at += batch.num_rows
            if cut.num_rows:
                yield cut


def _specs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            yield json.loads(text)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _run(spark: SparkSession, specs: list[dict], task: Callable[[dict], dict], ddl: str, name: str) -> DataFrame:
    """What task returns for each spec, a spec being a file; saved, so that no task runs again when the rows are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spec in _specs(batches):
            yield pa.RecordBatch.from_pylist([task(spec)], _arrow(ddl))

    if not specs:
        return spark.createDataFrame([], ddl)
    tasks = max(1, min(len(specs), max(2 * spark.sparkContext.defaultParallelism, len(specs) // 8)))
    asked = spark.createDataFrame([(json.dumps(s),) for s in specs], "spec string").repartition(tasks)
    return written(asked.mapInArrow(lean(run), ddl), name)


def _write(spec: dict) -> dict:
    """A file of the layout from the rows of the sorted parts that it holds; beside it, elsewhere, the CRCs of its rows."""
    digest, out, keys = _Digest(spec["money"]), None, None
    first = last = None
    for uri, start, count in spec["segments"]:
        for batch in _part(uri, start, count):
            rows = batch.select(spec["columns"])
            if out is None:
                out = _Out(spec["path"], rows.schema.remove_metadata())
                keys = _Out(spec["keys"], pa.schema([("crc", pa.int64())]), use_dictionary=False, column_encoding={"crc": "DELTA_BINARY_PACKED"})
                rows_schema = rows.schema.remove_metadata()
            crcs = batch.column(batch.schema.get_field_index(spec["crc"])).cast(pa.int64())
            ids, null = _ints(rows.column(rows.schema.get_field_index(spec["victim"])))
            ends = [(crcs[i].as_py(), None if null[i] else int(ids[i])) for i in (0, -1)]
            first, last = first or ends[0], ends[1]
            out.add(pa.RecordBatch.from_arrays(rows.columns, schema=rows_schema))
            keys.add(pa.RecordBatch.from_arrays([crcs], names=["crc"]))
            digest.add(rows)
    out.close()
    keys.close()
    return {**{k: spec[k] for k in ("table_name", "file_no", "path", "keys")}, **digest.row(), "n_erased": 0, "rewritten": False, "columns": ",".join(spec["columns"]), "lo_crc": first[0], "lo_id": first[1], "hi_crc": last[0], "hi_id": last[1]}


def lay_out(df: DataFrame, key: Column | None, name: str, plan: Plan, root: str, work: str, files: int = FILES, given_crc: str | None = None) -> DataFrame:
    """df as sorted files of 1 + n // files consecutive rows in root/name: a row of LAID per file.

    Rows ascend by the CRC of key, or by the column given_crc, which is not written; then by all columns from left to
    right, nulls first. Equal rows are interchangeable, so a row number of the scan that parts them in the range shuffle
    leaves no trace. An empty table has no files.
    """
    spark = ship(df.sparkSession)
    columns = [c for c in df.columns if c != given_crc]
    at, part, nth = (fresh(df, c) for c in ("crc", "part", "nth"))
    keyed = df.withColumn(at, F.col(given_crc) if given_crc else crc(key))
    keyed = keyed.select(*columns, at, F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias(nth))
    order = [F.col(at), *(F.col(f"`{c}`").asc_nulls_first() for c in columns)]
    in_order = keyed.repartitionByRange(*order, F.col(nth)).sortWithinPartitions(*order)
    parts_at = f"{work}/parts-{name}"
    in_order.select(*columns, at, F.spark_partition_id().alias(part)).write.option("parquet.block.size", GROUP_BYTES).parquet(parts_at)
    parts = spark.read.parquet(parts_at).groupBy(part, F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n")).collect()
    parts = sorted((r[part], f"{parts_at}/{posixpath.basename(r['path'])}", r["n"]) for r in parts)
    n = sum(p[2] for p in parts)
    size = 1 + n // files
    specs: list[dict] = []
    for _, path, count in parts:  # the parts in order, cut at every multiple of size
        done = 0
        while done < count:
            if not specs or specs[-1]["rows"] == size:
                no = len(specs)
                specs.append({"table_name": name, "file_no": no, "path": f"{root}/{name}/file-{no:05d}.parquet", "keys": f"{work}/keys-{name}/{no:05d}.parquet", "segments": [], "rows": 0, "columns": columns, "crc": at, "money": plan.money, "victim": plan.victim})
            take = min(count - done, size - specs[-1]["rows"])
            specs[-1]["segments"].append((path, done, take))
            specs[-1]["rows"] += take
            done += take
    laid = _run(spark, specs, _write, LAID, f"laid-{name}")
    remove(spark, parts_at)
    return laid


class _Victims:
    """The cursor over sorted victims: (crc, id) in ascending order, a batch of them held at a time."""

    def __init__(self, parts: list[str]):
        self.batches = (b for p in parts for b in _part(p))
        self.crc = self.id = np.empty(0, np.int64)
        self.ended = False

    def more(self) -> None:
        batch = next(self.batches, None)
        if batch is None:
            self.ended = True
        else:
            self.crc, self.id = np.concatenate([self.crc, _ints(batch.column(0))[0]]), np.concatenate([self.id, _ints(batch.column(1))[0]])

    def meet(self, ids: np.ndarray, low: tuple, high: tuple, keep: tuple) -> np.ndarray:
        """Which ids are victims from low to high. Those before keep are given up, as the next call's low is keep at least."""
        key = lambda i: (self.crc[i], self.id[i])
        gone = np.zeros(len(ids), bool)
        while True:
            n = range(len(self.crc))
            gone |= np.isin(ids, self.id[bisect_left(n, low, key=key) : bisect_right(n, high, key=key)])
            start = bisect_left(n, keep, key=key)
            self.crc, self.id = self.crc[start:], self.id[start:]
            if self.ended or (len(self.crc) and key(len(self.crc) - 1) > high):
                return gone
            self.more()

    def shares(self, keys: Iterator[np.ndarray]) -> bool:
        """Whether a CRC of the sorted keys is a victim's: two cursors, neither of which goes back."""
        crcs = next(keys, None)
        while crcs is not None:
            if not len(self.crc):
                if self.ended:
                    return False
                self.more()
            elif np.isin(self.crc, crcs).any():
                return True
            elif self.crc[-1] <= crcs[-1]:
                self.crc, self.id = self.crc[:0], self.id[:0]
            else:
                crcs = next(keys, None)
        return False


def _erase(spec: dict) -> dict:
    """A file without its victims, written beside it, and what it lost; nothing is written where no row goes."""
    victims, digest = _Victims(spec["parts"]), _Digest(spec["money"])
    lowest, highest = -(1 << 63), (1 << 63) - 1
    # first the CRCs alone: a file that has no victim's CRC is not read
    if not _Victims(spec["parts"]).shares(_ints(k.column(0))[0] for k in _part(spec["keys"])):
        return _untouched(spec)
    out = lost = None
    erased, ends = 0, []
    keys = _part(spec["keys"])
    held = pa.array([], pa.int64())
    for batch in _part(spec["path"]):
        while len(held) < batch.num_rows:
            held = pa.concat_arrays([held, next(keys).column(0)])
        crcs, held = held.slice(0, batch.num_rows).to_numpy(zero_copy_only=False), held.slice(batch.num_rows)
        ids, null = _ints(batch.column(batch.schema.get_field_index(spec["victim"])))
        known = np.flatnonzero(~null)
        gone = np.zeros(batch.num_rows, bool)
        if len(known):
            a, b = known[0], known[-1]
            low, high, keep = (crcs[a], lowest), (crcs[b], highest), (crcs[b], lowest)
            if spec["ordered"]:
                low, high, keep = (crcs[a], ids[a]), (crcs[b], ids[b]), (crcs[b], ids[b])
            gone = victims.meet(ids, low, high, keep) & ~null
        if out is None:
            schema = batch.schema.remove_metadata()
            out = _Out(spec["staged"], schema)
        stay = pa.RecordBatch.from_arrays(batch.filter(pa.array(~gone)).columns, schema=schema)
        out.add(stay)
        digest.add(stay)
        erased += int(gone.sum())
        if spec["lost"] and gone.any():
            fallen, none = _ints(batch.column(batch.schema.get_field_index(spec["lost_id"])))
            at = np.flatnonzero(gone & ~none)
            if len(at):
                lost = lost or _Out(spec["lost"], pa.schema([("crc", pa.int64()), ("id", pa.int64())]), use_dictionary=False)
                lost.add(pa.RecordBatch.from_arrays([pa.array(crcs[at], pa.int64()), pa.array(fallen[at], pa.int64())], names=["crc", "id"]))
                ends += [(int(crcs[i]), int(fallen[i])) for i in (at[0], at[-1])]
    out.close(keep=erased > 0 and digest.n > 0)
    if lost:
        lost.close()
    if not erased:
        return _untouched(spec)
    low, high = (ends[0], ends[-1]) if ends else ((None, None), (None, None))
    return {**{k: spec[k] for k in ("table_name", "file_no", "columns", "path", "staged")}, **digest.row(), "n_erased": erased, "rewritten": True, "lost": spec["lost"] if ends else None, "lo_crc": low[0], "lo_id": low[1], "hi_crc": high[0], "hi_id": high[1]}


def _untouched(spec: dict) -> dict:
    return {**{k: spec[k] for k in ("table_name", "file_no", "columns", "path", "n_rows", "cents", "ids_sha256")}, "n_erased": 0, "rewritten": False, "staged": None, "lost": None, "lo_crc": None, "lo_id": None, "hi_crc": None, "hi_id": None}


def sorted_victims(victims: DataFrame, path: str) -> list[tuple]:
    """victims (crc, id) written in order; (low, high, part) of every part, in order."""
    spark = victims.sparkSession
    victims.select("crc", "id").distinct().repartitionByRange("crc", "id").sortWithinPartitions("crc", "id").write.parquet(path)
    parts = spark.read.schema("crc long, id long").parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(F.struct("crc", "id")).alias("lo"), F.max(F.struct("crc", "id")).alias("hi"))
    return sorted((tuple(r["lo"]), tuple(r["hi"]), f"{path}/{posixpath.basename(r['path'])}") for r in parts.collect())


def scan(laid: DataFrame, plan: Plan, victims: list[tuple], work: str, lost_id: str | None = None) -> tuple[DataFrame, list[tuple]]:
    """Every file of laid met with the sorted victims of its range: a row of SCANNED per file, and the sorted parts of lost_id of the rows that go."""
    spark = laid.sparkSession
    specs = []
    for r in laid.orderBy("file_no").collect():
        low, high = (r["lo_crc"], -(1 << 63)), (r["hi_crc"], (1 << 63) - 1)
        if plan.ordered and r["lo_id"] is not None and r["hi_id"] is not None:
            low, high = (r["lo_crc"], r["lo_id"]), (r["hi_crc"], r["hi_id"])
        parts = [p for lo, hi, p in victims if lo <= high and hi >= low]
        spec = {k: r[k] for k in ("table_name", "file_no", "path", "keys", "columns", "n_rows", "cents", "ids_sha256")}
        specs.append(spec | {"parts": parts, "victim": plan.victim, "ordered": plan.ordered, "money": plan.money, "staged": f"{work}/staged-{r['table_name']}/{r['file_no']:05d}.parquet", "lost_id": lost_id, "lost": f"{work}/lost-{r['table_name']}/{r['file_no']:05d}.parquet" if lost_id else None})
    name = specs[0]["table_name"] if specs else "none"
    scanned = _run(spark, specs, _erase, SCANNED, f"scanned-{name}")
    lost = scanned.where(F.col("lost").isNotNull()).select("lo_crc", "lo_id", "hi_crc", "hi_id", "lost").collect()
    return scanned, sorted(((r["lo_crc"], r["lo_id"]), (r["hi_crc"], r["hi_id"]), r["lost"]) for r in lost)


def commit(scanned: DataFrame) -> None:
    """Rewritten files take the place of those they were made from, emptied ones go; a commit that broke off can be run again."""
    for r in scanned.where("rewritten").select("n_rows", "staged", "path").collect():
        if r["n_rows"]:
            _move(r["staged"], r["path"])
        else:
            where, path = _at(r["path"])
            if where.get_file_info(path).type != fs.FileType.NotFound:
                where.delete_file(path)


def victim_masters(clients: DataFrame, clicks: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """master_id of the masters to be erased: those whose CRC one_in divides, and the one with most clicks, smallest first among equals."""
    masters = clients.where(F.col("master_id").isNotNull()).select("master_id", "client_id").distinct()
    counts = clicks.where(F.col("client_id").isNotNull()).groupBy("client_id").agg(F.count("*").alias("n"))
    most = masters.join(counts, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy(F.col("n").desc(), "master_id").limit(1)
    drawn = masters.where(F.pmod(F.crc32(F.col("master_id").cast("string").cast("binary")), F.lit(one_in)) == 0)
    return drawn.select("master_id").unionByName(most.select("master_id")).distinct()


def erase(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, files: int = FILES, one_in: int = ONE_IN) -> DataFrame:
    """The four tables laid out in a new folder under spark.checkpoint.dir, and without the victims: a row of FILE per final file.

    A clients row goes when its master is a victim, also if it has no client_id; clicks and sales of such clients go,
    and the lines of these sales. Rows without an id are nobody's: a click or sale without client_id, or a line without
    sale_id or without its sale, sorts under the CRC of the empty string and stays. A sale_id that sales gives to
    several clients sorts its lines under the smallest, and they go with that client. Repeated rows each count; money
    that is null or not finite counts as 0 cents; a table may be empty, and then has no file. Columns may have any
    names and order as long as the ids and money are there; the first column should be a whole number.
    """
    spark = clients.sparkSession
    base = shared_dir(spark)
    tag = uuid.uuid4().hex
    root, work = (_qualified(spark, f"{base}/loomgraph-erasure{x}-{tag}") for x in ("", "-work"))
    plans = {"clients": Plan("master_id", False, "balance"), "clicks": Plan("client_id", False, "value"), "sales": Plan("client_id", False, "total"), "sale_lines": Plan("sale_id", True, "amount")}
    by_sale = fresh(sale_lines, "by_sale")
    owners = sales.where(F.col("sale_id").isNotNull()).groupBy(F.col("sale_id").alias(by_sale)).agg(F.min("client_id").alias("owner"))
    owner_crc = fresh(sale_lines, "owner_crc")
    # written, so that the lines of a hot sale meet a shuffle of their own, which Spark can split
    owners = small(written(owners.select(by_sale, crc(F.col("owner")).alias(owner_crc)), "owners"))
    lines = sale_lines.join(owners, sale_lines["sale_id"] == owners[by_sale], "left").drop(by_sale).withColumn(owner_crc, F.coalesce(owner_crc, F.lit(0)))
    laid = {
        "clients": lay_out(clients, F.col("client_id"), "clients", plans["clients"], root, work, files),
        "clicks": lay_out(clicks, F.col("client_id"), "clicks", plans["clicks"], root, work, files),
        "sales": lay_out(sales, F.col("client_id"), "sales", plans["sales"], root, work, files),
        "sale_lines": lay_out(lines, None, "sale_lines", plans["sale_lines"], root, work, files, owner_crc),
    }
    masters = written(victim_masters(clients, clicks, one_in), "masters")
    rows = written(clients.join(small(masters), "master_id", "left_semi").select("client_id", "master_id"), "victims")
    keyed = rows.select(crc(F.col("client_id")).alias("crc"), "client_id", "master_id")
    of_clients = sorted_victims(keyed.select("crc", F.col("master_id").alias("id")), f"{work}/victims-clients")
    of_people = sorted_victims(keyed.where(F.col("client_id").isNotNull()).select("crc", F.col("client_id").alias("id")), f"{work}/victims-people")
    scans = [scan(laid["clients"], plans["clients"], of_clients, work)[0], scan(laid["clicks"], plans["clicks"], of_people, work)[0]]
    gone_sales, of_lines = scan(laid["sales"], plans["sales"], of_people, work, "sale_id")
    scans += [gone_sales, scan(laid["sale_lines"], plans["sale_lines"], of_lines, work)[0]]
    for s in scans:
        commit(s)
    remove(spark, work)
    whole = scans[0]
    for s in scans[1:]:
        whole = whole.unionByName(s)
    return whole.where(F.col("n_rows") > 0).select("file_no", "n_rows", "n_erased", "cents", "rewritten", "table_name", "ids_sha256", "columns", F.regexp_replace("path", "^file:/+", "/").alias("path"))


def op11_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erase(*(table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines")))
