from datetime import datetime as T

import numpy as np
import pyarrow as pa

from tributary.operators import orphans

PARENT = "hash string, recorded_at timestamp_ntz, extra string"
REF = "rec_id bigint, task_hash string, recorded_at timestamp_ntz, k string, ref int"
PURGE = "entity_type string, entity_id string, purged_at timestamp_ntz"


def run(spark, parents, refs, purges):
    t = orphans.Target("task", spark.createDataFrame(parents, PARENT), "hash", "Task")
    r = orphans.Reference("job", spark.createDataFrame(refs, REF), "task_hash", "task")
    return {x["rec_id"]: x["period"] for x in orphans.orphans([t], [r], spark.createDataFrame(purges, PURGE)).collect()}


def at(day):
    return T(2025, 1, day)


def test_kinds(spark):
    parents = [("a", at(5), None), ("a", at(9), None), ("", at(1), None), (None, at(1), None), ("p", at(1), None), ("q", at(8), None), ("b", at(9), "x")]
    refs = [(1, "a", at(5)), (2, "a", at(4)), (3, "", at(2)), (4, None, at(2)), (5, "none", at(2)), (6, "p", at(3)), (7, "q", at(9)), (7, "none", at(2)), (8, "b", at(9))]
    purges = [("Task", "p", at(1)), ("Task", "q", at(7)), ("Job", "a", at(20)), (None, "a", at(20)), ("Task", None, at(20)), ("Task", "b", None)]
    assert run(spark, parents, [(*x, "x", 1) for x in refs], purges) == {2: "2025-01", 5: "2025-01", 6: "2025-01", 7: "2025-01"}


def test_empty_tables(spark):
    assert run(spark, [], [], []) == {}
    assert run(spark, [], [(1, "a", at(1), None, None)], []) == {1: "2025-01"}
    assert run(spark, [("a", at(1), None)], [], [("Task", "a", at(1))]) == {}


def test_hot_keys_are_spread(spark, monkeypatch):
    """Many keys with a third of the references and more: each is spread, none is dropped, no range holds them all."""
    keys = [f"hot{i}" for i in range(200)]
    refs = [(i, keys[i % 200] if i % 3 else f"k{i}", at(1 + i % 20), None, None) for i in range(12000)] + [(i, "top", at(3), None, None) for i in range(12000, 20000)]
    sizes = []
    seen = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda s, rows, *a, **k: (sizes.append(len(rows)), seen(rows, *a, **k))[1])
    t = orphans.Target("task", seen([(k, at(10), None) for k in [*keys[:150], "top"]], PARENT), "hash", "Task")
    r = orphans.Reference("job", seen(refs, REF), "task_hash", "task")
    got = orphans.orphans([t], [r], seen([], PURGE), ranges=400)
    want = {i for i, k, day, *_ in refs if k not in keys[:150] and k != "top" or day < at(10)}
    assert sorted(x["rec_id"] for x in got.collect()) == sorted(want)
    assert sizes == [201]


def test_same_hash(monkeypatch):
    """Keys are told apart where their hashes agree."""
    batch = pa.record_batch({"h": [1, 5, 5, 5, 9], "k": ["Aa", "Ab", "Ac", "Ad", "Ae"], "known": [True] * 5, **dict.fromkeys(("first_at", "last_at", "purged_at"), pa.nulls(5, pa.timestamp("us")))})
    probe = pa.array(["Ad", "Ab", "Ax", "Aa", "Ae", "Ae"], pa.large_string())
    assert orphans._Range([batch]).find(np.array([5, 5, 5, 1, 9, 10]), probe).tolist() == [3, 1, -1, 0, 4, -1]


def test_fields_of_one_table_with_their_own_times(spark):
    rows = spark.createDataFrame([(1, 10, "a", "b", at(2), at(8))], "r1 bigint, r2 bigint, f string, g string, t1 timestamp_ntz, t2 timestamp_ntz")
    t = orphans.Target("task", spark.createDataFrame([("a", at(5), None), ("b", at(5), None), ("c", None, None)], PARENT), "hash", "Task")
    refs = [orphans.Reference("x", rows, "f", "task", "r1", "t1"), orphans.Reference("x", rows, "g", "task", "r2", "t2"), orphans.Reference("x", rows, "f", "task", "r2", "t2")]
    assert [tuple(r)[1:3] for r in orphans.orphans([t], refs, spark.createDataFrame([], PURGE)).collect()] == [("f", 1)]
    late = orphans.Reference("x", spark.createDataFrame([(1, "c", at(2), None, None), (2, "c", None, None, None), (3, "d", None, None, None)], REF), "task_hash", "task")
    assert [tuple(r)[2:] for r in orphans.orphans([t], [late], spark.createDataFrame([], PURGE)).collect()] == [(3, None)]


def test_every_row_counts(spark):
    got = orphans.orphans(
        [orphans.Target("task", spark.createDataFrame([], PARENT), "hash", "Task")],
        [orphans.Reference("job", spark.createDataFrame([(1, "x", at(1), None, None)] * 3, REF), "task_hash", "task")], spark.createDataFrame([], PURGE))
    assert orphans.report(got).collect()[0]["n_orphans"] == 3
