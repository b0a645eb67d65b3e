import random

import pytest
from pyspark.sql import functions as F

from tributary.llm import queries, seen


@pytest.mark.parametrize("name", ["p2_found", "p2_error_rate"])
def test_query(name, same):
    same(name, queries.QUERIES[name], queries.SQL[name])


SCHEMA = "rec_id bigint, k string, key string, first int"
ROWS = [(5, "a", "x", 1), (7, "a", "x", 1), (7, "b", "x", 1), (8, None, "x", 1), (9, None, "x", 1), (10, "", "x", 1), (11, "", None, None), (6, "b", None, 1), (None, "a", "x", 1)]


def said(s):
    return sorted((r["rec_id"], r["is_repeat"]) for r in s.verdicts().collect())


@pytest.mark.parametrize("name", ["t", "a b", "t1.parquet"])
def test_batches_append_nulls_and_ties(spark, tmp_path, name):
    """A second call appends the verdicts of the new rows only; those given stay as they are."""
    path = f"{tmp_path}/{name}"
    s = seen.Seen(spark, [seen.Arrivals("t", path + "/", "k")], f"file://{tmp_path}/seen")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    s.take_in()
    before = said(s)
    assert before == [(5, False), (6, False), (7, True), (7, True), (10, False), (11, True)]  # 7 stands for a (after 5) and b (after 6)
    spark.createDataFrame([(2, "b", "x", 1), (12, "c", "x", 1), (12, "c", "x", 1), (13, "a", "x", 1)], SCHEMA).write.mode("append").parquet(path)
    s.take_in()
    assert said(s) == sorted([*before, (2, True), (12, False), (12, False), (13, True)])
    assert {(r["batch"], r["rec_id"]) for r in s.verdicts().where("batch = 1").collect()} == {(1, 2), (1, 12), (1, 13)}
    s.take_in()  # nothing new
    assert s.verdicts().count() == len(before) + 4


def test_several_batches_against_a_replay(spark, tmp_path):
    """Files taken in one a batch, against a replay row by row."""
    rng, path, known, want = random.Random(3), f"{tmp_path}/t", set(), []
    s = seen.Seen(spark, [seen.Arrivals("t", path, "k")], f"file://{tmp_path}/seen", files_per_batch=1)
    for _ in range(3):
        rows = [(i, rng.choice(["hot", *map(str, range(300))]), "", 0) for i in rng.sample(range(10**6), 200)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        for i, k, *_ in sorted(rows):
            want.append((i, k in known))
            known.add(k)
        s.take_in()
    assert said(s) == sorted(want)


def test_error_rate_is_measured(spark, tmp_path, monkeypatch):
    a = [seen.Arrivals("t", f"{tmp_path}/t", "k")]
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/t")
    assert [tuple(r) for r in seen.error_rate(spark, a).collect()] == [("t", 6, 3, 0, 0.0)]
    told = seen.Seen.verdicts
    monkeypatch.setattr(seen.Seen, "verdicts", lambda s: told(s).withColumn("is_repeat", F.expr("is_repeat or rec_id = 10")))
    assert [tuple(r) for r in seen.error_rate(spark, a).collect()] == [("t", 6, 4, 1, 1 / 6)]
    monkeypatch.setattr(seen.Seen, "verdicts", lambda s: told(s).where("rec_id <> 5"))
    assert [r["n_wrong"] for r in seen.error_rate(spark, a).collect()] == [1]


@pytest.mark.parametrize("path", ["/x/a*", "/x/[a]", "/{x}", "/"])
def test_paths_that_are_patterns(spark, path):
    with pytest.raises(ValueError):
        seen._pattern(path)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "rec_id bigint, k string").write.parquet(f"{tmp_path}/t")
    assert seen.repeats(spark, [seen.Arrivals("t", f"{tmp_path}/t", "k")]).collect() == []
