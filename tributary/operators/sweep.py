"""Sweeps along a line: prefix sums, merged regions, points in regions, without a window over all rows.

Rows are range-partitioned by position; each partition is swept for itself and what it hands on to the next (a
sum, a last value) is one row a partition, carried by a window over these few.  Positions that are null are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.scratch import Scratch


def _parts(df: DataFrame, pos: str, s: Scratch) -> DataFrame:
    """df with its range partition as part__; equal positions share one."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return s.cut(df.where(F.col(pos).isNotNull()).repartitionByRange(n, pos).withColumn("part__", F.spark_partition_id()))


def prefix_sum(df: DataFrame, pos: str, value: str, into: str = "total") -> DataFrame:
    """One row per position: pos and the sum of value at it and all before."""
    x = _parts(df.groupBy(pos).agg(F.sum(value).alias(value)), pos, Scratch(df.sparkSession, "prefix"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    carry = x.groupBy("part__").agg(F.sum(value).alias("own__")).select("part__", F.coalesce(F.sum("own__").over(before), F.lit(0)).alias("carry__"))
    inside = F.sum(value).over(Window.partitionBy("part__").orderBy(pos))
    return x.join(F.broadcast(carry), "part__").select(pos, (F.col("carry__") + inside).alias(into))


def _with_next(df: DataFrame, pos: str, into: str) -> DataFrame:
    """df, one row per position, with the next position in the whole table, null for the last."""
    x = _parts(df, pos, Scratch(df.sparkSession, "next"))
    firsts = x.groupBy("part__").agg(F.min(pos).alias("first__"))
    after = firsts.select("part__", F.lead("first__").over(Window.orderBy("part__")).alias("after__"))
    nxt = F.coalesce(F.lead(pos).over(Window.partitionBy("part__").orderBy(pos)), F.col("after__"))
    return x.join(F.broadcast(after), "part__").select(*df.columns, nxt.alias(into))


def merge_regions(regions: DataFrame, start: str, end: str, depth: str) -> DataFrame:
    """(start, end, depth): a segment between each two successive ends of regions, with the sum of depths there, 0 in gaps."""
    ends = regions.select(F.col(start).alias("pos"), F.col(depth).alias("delta")).unionByName(regions.select(F.col(end).alias("pos"), (-F.col(depth)).alias("delta")))
    at = prefix_sum(ends, "pos", "delta", "depth")
    return _with_next(at, "pos", "next").where("next is not null").select(F.col("pos").alias("start"), F.col("next").alias("end"), "depth")


def merge_counts(*tables: DataFrame, pos: str = "pos", count: str = "count") -> DataFrame:
    """(pos, count): counts of all tables added up by position."""
    out = tables[0].select(pos, count)
    for t in tables[1:]:
        out = out.unionByName(t.select(pos, count))
    return out.groupBy(pos).agg(F.sum(count).alias(count))


def as_of(points: DataFrame, marks: DataFrame, pos: str, at: str, value: str, strict: bool = False) -> DataFrame:
    """points with the value of the last mark at or before their position (before it, if strict), null if there is none.

    Of marks at one position the greatest value counts.
    """
    s = Scratch(points.sparkSession, "asof")
    m = marks.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("pos__")).agg(F.max(value).alias("mark__"))
    cols = points.columns
    both = points.select(F.col(pos).alias("pos__"), F.struct(*cols).alias("row__"), F.lit(None).cast(m.schema["mark__"].dataType).alias("mark__"), F.lit(0 if strict else 1).alias("turn__")).unionByName(
        m.select("pos__", F.lit(None).cast(points.select(F.struct(*cols)).schema[0].dataType).alias("row__"), "mark__", F.lit(1 if strict else 0).alias("turn__")))
    x = _parts(both, "pos__", s)
    last = x.where("mark__ is not null").groupBy("part__").agg(F.max_by("mark__", "pos__").alias("last__"))
    parts = x.select("part__").distinct().join(last, "part__", "left")
    carried = parts.select("part__", F.last("last__", ignorenulls=True).over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)).alias("carry__"))
    w = Window.partitionBy("part__").orderBy("pos__", "turn__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = x.join(F.broadcast(carried), "part__").withColumn("value__", F.coalesce(F.last("mark__", ignorenulls=True).over(w), "carry__"))
    return got.where("row__ is not null").select("row__.*", F.col("value__").alias(value))


def allele_freq(mutations: DataFrame, regions: DataFrame) -> DataFrame:
    """(pos, num, denom, freq) of mutations (pos, count) in merged regions (start, end, depth); one where the depth is 0 or unknown fails."""
    x = as_of(mutations.select("pos", F.col("count").alias("num")), regions, "pos", "start", "depth")
    bad: Column = F.coalesce(F.col("depth"), F.lit(0)) == 0
    denom = F.when(bad, F.raise_error(F.concat(F.lit("no depth at "), F.col("pos").cast("string")))).otherwise(F.col("depth"))
    return x.select("pos", "num", denom.alias("denom"), (F.col("num") / denom).alias("freq"))
