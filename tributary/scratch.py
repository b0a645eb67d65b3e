"""Intermediate tables in the folder that all executors share.

``cut`` ends a lineage by writing a table and reading it back.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tributary-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tributary/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system; a missing one is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator run.  Every table stays until ``free`` or ``close`` is called on it."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.what, self.paths = spark, what, {}

    def cut(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write df once and return it as a read of that table, so an executor may be lost at any time; by: a column of few values to part it by."""
        path = new_path(self.spark, self.what)
        w = df.write.partitionBy(by) if by else df.write
        w.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
        self.paths[id(out)] = (path, out)
        return out

    def counted(self, df: DataFrame, where: Column | None = None) -> tuple[DataFrame, int]:
        """``cut``, and how many rows were written (that meet a condition), counted while writing."""
        seen = Observation()
        n = F.count(F.lit(1)) if where is None else F.count_if(where)
        out = self.cut(df.observe(seen, n.alias("n")))
        return out, seen.get["n"]

    def free(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                delete(self.spark, path)

    def close(self, *keep: DataFrame) -> None:
        """Remove every table but those that a returned frame still reads."""
        kept = {id(k) for k in keep}
        self.free(*[df for k, (_, df) in list(self.paths.items()) if k not in kept])
        self.sweep()

    def sweep(self) -> None:
        """Let Spark remove the shuffle files of frames that nothing uses any more; else they stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
