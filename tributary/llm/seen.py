"""Has this key been seen before?  Exact first-or-repeat over a stream, with bounded memory.

Rows stream through a keyed state that holds, for a key, the seen flag: in which batch it came first and with which
arrival number.  The state is partitioned by key, lives in RocksDB on the executors' disks (block cache and write buffers
under one bound) and is checkpointed with every batch to the shared folder; no watermark ever expires a key.  Each
micro-batch emits one verdict for each of its own rows and appends them to a sink: a row is first if its key came into the
state with this very row, else a repeat.  Neither earlier rows nor earlier verdicts are read again, and no verdict changes later.

Rows arrive batch after batch, inside a batch by arrival number.  What is there at the first call is one batch unless
``files_per_batch`` says otherwise; a file that comes in a later batch came later, whatever its arrival numbers.  A batch that is
run again after a failure replaces its own verdicts.

Partial minima are formed before the shuffle by key, so a hot key costs one row a task; verdicts are put together by row,
not by key, so the rows of a key never meet in one task.

Null keys have not been seen and get no verdict, nor do rows without an arrival number, which take no part at all; '' is a
key.  Rows alike in key and arrival number are all first or all repeats: none is earlier than the other.  An empty
table gives no rows.  Other columns are neither read nor kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import scratch

_STATE = "spark.sql.streaming.stateStore"
STATE_CONF = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "256",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.metricsEnabled": "false",
}
VERDICTS = "table_name string, rec_id bigint, is_repeat boolean, batch int"


@dataclass(frozen=True)
class Arrivals:
    """A table of arriving rows on disk: its path, key column and arrival number."""

    name: str
    path: str
    key: str
    order: str = "rec_id"


@contextmanager
def _conf(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _pattern(path: str) -> str:
    """A pattern that matches this path alone: a file source takes a single file only by a pattern.

    Spark's file source takes the very files it found for patterns again, so a path with their signs can't be read.
    """
    path = path.rstrip("/")
    if not path or set(path) & set("[]{}*?\\"):
        raise ValueError(f"a stream can't be read from {path!r}")
    return f"{path[:-1]}[{path[-1]}]"


def _rows(reader: object, path: str, a: Arrivals) -> DataFrame:
    return reader.parquet(path).where(F.col(a.key).isNotNull() & F.col(a.order).isNotNull()).select(
        F.lit(a.name).alias("table_name"), F.col(a.key).cast("string").alias("key"), F.col(a.order).cast("bigint").alias("rec_id"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Seen:
    """The keyed state and the sink of verdicts in one folder, which later calls go on from."""

    def __init__(self, spark: SparkSession, tables: Sequence[Arrivals], folder: str | None = None, files_per_batch: int | None = None) -> None:
        self.spark, self.tables, self.files_per_batch = spark, tables, files_per_batch
        self.folder = folder or scratch.new_path(spark, "seen")
        self.sink = f"{self.folder}/verdicts"

    def take_in(self) -> None:
        """Run the files that came since the last call through the state, and append the verdicts of their rows."""
        streams = []
        for a in self.tables:
            reader = self.spark.readStream.schema(self.spark.read.parquet(a.path).select(a.key, a.order).schema)
            if self.files_per_batch:
                reader = reader.option("maxFilesPerTrigger", self.files_per_batch)
            streams.append(_rows(reader, _pattern(a.path), a))
        rows = _union(streams)
        now = F.current_timestamp()  # in a stream the time of the batch, kept for a batch that runs again
        new = rows.withColumn("at", now).groupBy("table_name", "key").agg(F.min("rec_id").alias("rec_id"), F.min("at").alias("since")).where(F.col("since") == now)
        # The batch's rows, and beside them the first row of each key that came with the batch.
        row = lambda df, n: df.select("table_name", "rec_id", F.xxhash64("key").alias("of_key"), F.lit(n).alias("n"))
        both = row(rows, 1).unionByName(row(new, 0))
        with _conf(self.spark, STATE_CONF):
            query = both.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).foreachBatch(self._emit).start()
            try:
                query.awaitTermination()
            finally:
                query.stop()

    def _emit(self, batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("table_name", "rec_id", "of_key").agg(F.sum("n").alias("n"), (F.min("n") > 0).alias("is_repeat")).where("n > 0")
        one = F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))
        rows.select("table_name", "rec_id", "is_repeat", one).drop("col").write.mode("overwrite").parquet(f"{self.sink}/batch={number}")

    def verdicts(self) -> DataFrame:
        """(table_name, rec_id, is_repeat, batch): the verdict of each row so far."""
        try:
            return self.spark.read.schema(VERDICTS).parquet(self.sink)
        except AnalysisException:  # no batch yet
            return self.spark.createDataFrame([], VERDICTS)


def repeats(spark: SparkSession, tables: Sequence[Arrivals], folder: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """(table_name, rec_id) of the rows whose key came before, read from the sink after all files that are there now."""
    s = Seen(spark, tables, folder, files_per_batch)
    s.take_in()
    return s.verdicts().where("is_repeat").select("table_name", "rec_id")


def error_rate(spark: SparkSession, tables: Sequence[Arrivals]) -> DataFrame:
    """(table_name, n_rows, n_repeats, n_wrong, wrong_rate): the verdicts of one batch held against a full aggregation by key.

    A row is wrong if its verdict is missing or unlike the truth by arrival numbers.
    """
    s = Seen(spark, tables)
    s.take_in()
    rows = _union([_rows(spark.read, a.path, a) for a in tables])
    true = rows.groupBy("table_name", "key").agg(F.min("rec_id").alias("rec_id")).select("table_name", "rec_id", F.xxhash64("key").alias("of_key"), F.lit(True).alias("first"))
    told = s.verdicts().groupBy("table_name", "rec_id").agg(F.count(F.lit(1)).alias("told"), F.count_if("is_repeat").alias("said"))
    judged = rows.withColumn("of_key", F.xxhash64("key")).join(true, ["table_name", "rec_id", "of_key"], "left").groupBy("table_name", "rec_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("first").isNull()).alias("true")).join(told, ["table_name", "rec_id"], "full")
    n, said, wrong = F.sum(F.coalesce("n", F.lit(0))), F.sum(F.coalesce("said", F.lit(0))), F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("told", F.lit(0)))
    bad = F.sum(F.greatest(wrong, F.abs(F.coalesce("true", F.lit(0)) - F.coalesce("said", F.lit(0)))))
    return judged.groupBy("table_name").agg(n.alias("n_rows"), said.alias("n_repeats"), bad.alias("n_wrong"), (bad / n).alias("wrong_rate"))
