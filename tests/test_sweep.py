import random

import pytest

from tributary.operators import sweep


def test_merge_regions_with_gap(spark):
    r = spark.createDataFrame([(0, 10, 1), (5, 8, 2), (20, 25, 1), (20, 25, 1), (None, None, 1)], "s int, e int, d int")
    assert sorted(map(tuple, sweep.merge_regions(r, "s", "e", "d").collect())) == [(0, 5, 1), (5, 8, 3), (8, 10, 1), (10, 20, 0), (20, 25, 2)]
    assert sweep.merge_regions(r.limit(0), "s", "e", "d").collect() == []


def test_as_of(spark):
    rng = random.Random(1)
    marks = [(rng.randrange(500), i) for i in range(100)]
    points = [(i, rng.randrange(600)) for i in range(300)] + [(999, None)]
    p, m = spark.createDataFrame(points, "id int, pos int").repartition(3), spark.createDataFrame(marks, "at int, v int").repartition(3)
    for strict in (False, True):
        got = {r["id"]: r["v"] for r in sweep.as_of(p, m, "pos", "at", "v", strict).collect()}
        for i, x in points:
            before = [(a, v) for a, v in marks if x is not None and (a < x or a == x and not strict)]
            if x is not None:
                assert got[i] == (max(before)[1] if before else None)


def test_allele_freq_fails_without_depth(spark):
    r = spark.createDataFrame([(5, 9, 4)], "start int, end int, depth int")
    ok = sweep.allele_freq(spark.createDataFrame([(5, 2)], "pos int, count int"), r).collect()
    assert [tuple(x) for x in ok] == [(5, 2, 4, 0.5)]
    with pytest.raises(Exception, match="no depth"):
        sweep.allele_freq(spark.createDataFrame([(1, 2)], "pos int, count int"), r).collect()
