from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tributary.operators import skew


def test_heavy_keys_exact_share(spark):
    keys = ["a"] * 30 + ["b"] * 4 + ["c"] * 5 + [None] * 41 + [""] * 6 + [f"k{i}" for i in range(14)]
    df = spark.createDataFrame([(k, 1) for k in keys], "k string, total int").repartition(3)
    got = {r["k"]: (r["n_rows"], r["total"]) for r in skew.heavy_keys(df, "k", Fraction(4, 100)).collect()}
    assert got == {"a": (30, 100), "c": (5, 100), "": (6, 100)}  # b is at 4 percent, not above


def test_empty_and_share(spark):
    df = spark.createDataFrame([], "k string")
    assert skew.heavy_keys(df, "k", Fraction(1, 10)).collect() == []
    assert skew.aggregate(df, "k", {"n": F.lit(1)}, {"d": "k"}).collect() == []
    with pytest.raises(ValueError):
        skew.candidates(df, "k", Fraction(1, 10_000))


def test_aggregate(spark):
    rows = [("hot" if i % 3 else f"k{i % 40}", i % 17 if i % 5 else None, i) for i in range(4000)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, c int, x int").repartition(7)
    got = {r["k"]: (r["n"], r["x_sum"], r["d"]) for r in skew.aggregate(df, "k", {"n": F.lit(1), "x_sum": F.col("x")}, {"d": "c"}).collect()}
    want = {}
    for k, c, x in rows:
        if k is not None:
            n, s, seen = want.setdefault(k, [0, 0, set()])
            want[k] = [n + 1, s + x, seen | ({c} if c is not None else set())]
    assert got == {k: (n, s, len(d)) for k, (n, s, d) in want.items()}


def test_aggregate_reads_rows_once(spark, tmp_path):
    """After the sketch the rows are scanned once, and names of the operator's own may be columns."""
    spark.range(3000).selectExpr("if(id % 2 = 0, 'hot', cast(id % 50 as string)) as x", "cast(id % 9 as string) as salt", "id as what").write.parquet(f"{tmp_path}/t")
    out = skew.aggregate(spark.read.parquet(f"{tmp_path}/t"), "x", {"n": F.lit(1), "s": F.col("what")}, {"d": "salt", "e": "what"})
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    got = {r["x"]: (r["n"], r["d"], r["e"]) for r in out.collect()}
    assert got["hot"] == (1500, 9, 1500) and got["1"] == (60, 9, 60) and len(got) == 26


@pytest.mark.parametrize("rows", [20_000, 3])
def test_join(spark, monkeypatch, rows):
    """Also when the right side's heavy rows may not be broadcast."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 30}", i) for i in range(2000)] + [(None, -1)], "k string, x int").repartition(4)
    right = spark.createDataFrame([("hot", i) for i in range(5)] + [("k2", 7), ("k4", 8), (None, 9)], "k string, x int")
    for how in ("inner", "left"):
        got = sorted(skew.join(left, right, "k", how=how).collect(), key=str)
        want = sorted(left.join(right.withColumnRenamed("x", "x_right"), "k", how).collect(), key=str)
        assert got == want
