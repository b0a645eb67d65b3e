"""A session with the settings that the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Get or create a session; master and partitions are left to the cluster unless they are given."""
    b = SparkSession.builder.appName("tributary").config(map=DEFAULTS | conf)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def active_session() -> SparkSession:
    """The session there is; none is ever made."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active session")
    return spark


def num_workers(spark: SparkSession) -> int:
    """Executors beside the driver; in a local session the driver itself."""
    return max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
