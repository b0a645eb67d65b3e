"""New files of a folder as a stream: each file is taken in once, across restarts, by the stream's checkpoint."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def on_new_files(spark: SparkSession, folder: str, format: str, schema: Any, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 1000, **options: Any) -> int:
    """Give the rows of all files that weren't there before to handle, batch by batch; the number of batches.

    A batch may come again after a failure, with the same number, so handle must be idempotent in it.
    """
    done: list[int] = []

    def each(df: DataFrame, batch: int) -> None:
        handle(df, batch)
        done.append(batch)

    src = spark.readStream.format(format).schema(schema).options(**options).option("maxFilesPerTrigger", files_per_batch).load(folder)
    q = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return len(done)


def running_counts(stream: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts per window of time and keys, for rows at most ``late`` behind the latest."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))
