"""Session helpers: getting a session, and the package to the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "loomgraph", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; conf wins."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors, once per application, through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="loomgraph-code-"), "loomgraph.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("loomgraph", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
    return spark


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="loomgraph-"))
    return _own_dir[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours; where the session has ended, it is left to whoever owns the folder."""
    try:
        sc = spark.sparkContext
        if sc._jsc is not None:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        return


class Scratch:
    """Written intermediate tables of one loop, in the shared folder; they go when the application ends, or before by drop."""

    def __init__(self, df: DataFrame, name: str, folder: str | None = None):
        self.spark, self.n = df.sparkSession, 0
        self.base = f"{folder or shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(remove, self.spark, self.base)

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        """Deletes the nth table, which nothing reads any more."""
        remove(self.spark, f"{self.base}/{n}")

    def clear(self) -> None:
        """Deletes all tables, which nothing reads any more."""
        remove(self.spark, self.base)
