"""Keys that hold most of the rows: find them by a sketch, treat them apart, unite.

A frequent-items sketch (a fixed number of counters, merged over partitions) names the candidates in one scan of
the key column.  Where the share must be exact, a count over a broadcast of these few keys keeps those above it.

``join`` joins the rows of heavy keys by broadcast, all others by an ordinary shuffle, and unites both.  ``aggregate`` tags
rows by a broadcast join with the heavy keys and gives only those a salt, so that one pass over the rows does for both.

Null keys are never heavy and are left out of results per key.  An empty table has no heavy keys.  A share is a
``Fraction``, compared in integers, so a key at exactly the share isn't above it.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the sketch.  A key is missed only if its share is under about 3.5 / COUNTERS.
COUNTERS = 4096
#: Rows of the small side that heavy keys may have and still be broadcast.
BROADCAST_ROWS = 20_000


def candidates(df: DataFrame, key: str, share: Fraction, least: bool = False) -> DataFrame:
    """(key, total): at most 2 / share keys that may be above the share, and the number of all rows; with least only those whose estimate is above it."""
    if share <= Fraction(8, COUNTERS):
        raise ValueError(f"the sketch has {COUNTERS} counters; the share must be above {8 / COUNTERS}")
    top = df.agg(F.call_function("approx_top_k", F.col(key), F.lit(ceil(2 / share)), F.lit(COUNTERS)).alias("top"), F.count(F.lit(1)).alias("total")).select(F.explode("top").alias("top"), "total")
    if least:
        top = top.where(F.col("top.count") * share.denominator > F.col("total") * share.numerator)
    return top.select(F.col("top.item").alias(key), "total").where(F.col(key).isNotNull())


def heavy_keys(df: DataFrame, key: str, share: Fraction) -> DataFrame:
    """(key, n_rows, total) of the keys that hold more than the share of all rows, null keys among these rows.

    There are fewer than 1 / share, so the result may always be broadcast.
    """
    df = df.select(key)
    n = F.count(F.lit(1))
    return (
        df.join(F.broadcast(candidates(df, key, share)), key)
        .groupBy(key).agg(n.alias("n_rows"), F.first("total").alias("total"))
        .where(F.col("n_rows") * share.denominator > F.col("total") * share.numerator)
    )


def likely_heavy(df: DataFrame, key: str, share: Fraction) -> DataFrame:
    """(key): at most 2 / share keys, those above the share by the sketch alone, whose counts are never too low; a table of its own, so that no plan sketches again."""
    rows = candidates(df, key, share, least=True).collect()
    return df.sparkSession.createDataFrame([(r[0],) for r in rows], df.select(key).schema)


def split(df: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is heavy, and the rest; rows without a key belong to the rest."""
    h = F.broadcast(heavy.select(key))
    return df.join(h, key, "left_semi"), df.join(h, key, "left_anti")


def aggregate(
    df: DataFrame, key: str, sums: dict[str, Column], distinct: dict[str, str], share: Fraction = Fraction(1, 100), salts: int = 64
) -> DataFrame:
    """Per key the sums (of expressions, null counting as none) and distinct counts (of columns, null not counted).

    Each row is read once, for the sums and for each distinct count.  First one row per key, salt and value is made, then one
    per key and salt, then one per key.  Heavy keys have a salt: for a distinct count a function of the value, so the parts are
    disjoint and add up exactly.  No row set of one key is ever in one task.
    """
    df = df.where(F.col(key).isNotNull())
    heavy = likely_heavy(df, key, share).select(F.col(key).alias("heavy_"))
    parts = [F.struct(F.lit("").alias("what"), F.lit(None).cast("string").alias("x"), *[e.alias(a) for a, e in sums.items()])]
    parts += [F.struct(F.lit(a).alias("what"), F.col(c).cast("string").alias("x"), *[F.when(F.lit(False), e).alias(s) for s, e in sums.items()]) for a, c in distinct.items()]
    salt = F.when(F.col("heavy_").isNotNull(), F.pmod(F.coalesce(F.xxhash64("x"), F.spark_partition_id()), F.lit(salts))).alias("salt")
    rows = df.select(F.col(key).alias("key_"), F.explode(F.array(*parts)).alias("p")).select("key_", "p.*").where("what = '' or x is not null")
    rows = rows.join(F.broadcast(heavy), F.col("key_") == F.col("heavy_"), "left").withColumn("salt", salt)
    adds = [F.sum(a).alias(a) for a in sums]
    one = rows.groupBy("key_", "salt", "what", "x").agg(*adds)
    part = one.groupBy("key_", "salt", "what").agg(*adds, F.count("x").alias("n_"))
    out = part.groupBy("key_").agg(*adds, *[F.coalesce(F.sum(F.when(F.col("what") == a, F.col("n_"))), F.lit(0)).alias(a) for a in distinct])
    return out.select(F.col("key_").alias(key), *sums, *distinct)


def join(left: DataFrame, right: DataFrame, key: str, share: Fraction = Fraction(1, 100), how: str = "inner", salts: int = 16) -> DataFrame:
    """Join on key (inner or left) where a few keys hold most rows of left.

    Heavy keys: the rows of right with these keys are broadcast if there are at most BROADCAST_ROWS (counted
    first), else each is repeated once per salt and joined by key and salt.  Other keys: an ordinary join.
    The columns of both sides but the key must differ in name; clashing ones of right get the suffix ``_right``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    for c in right.columns:
        if c != key and c in left.columns:
            right = right.withColumnRenamed(c, f"{c}_right")
    heavy = likely_heavy(left, key, share)
    hot, rest = split(left, key, heavy)
    r_hot, r_rest = split(right, key, heavy)
    if r_hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        first = hot.join(F.broadcast(r_hot), key, how)
    else:
        salt = "salt__"
        r_hot = r_hot.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hot = hot.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        first = hot.join(r_hot, [key, salt], how).drop(salt)
    return first.unionByName(rest.join(r_rest, key, how))


def found(tables: Sequence[tuple[str, DataFrame]], key: str, share: Fraction) -> DataFrame:
    """(table_name, key) of the heavy keys of several tables."""
    parts = [heavy_keys(df, key, share).select(F.lit(name).alias("table_name"), key) for name, df in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
