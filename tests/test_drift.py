import json
import random
from datetime import datetime

import pytest

from tributary.functions import json_text
from tributary.operators import drift

FILES = "dump_id bigint, repo string, exported_at timestamp_ntz"
LINES = "dump_id bigint, line_no int, payload string, record_type string"


def run(spark, files, lines):
    f = spark.createDataFrame([(i, r, None if t is None else datetime(2025, 1, t)) for i, r, t in files], FILES)
    rows = [(d, n, p if isinstance(p, str) or p is None else json.dumps(p), "x") for n, (d, p) in enumerate(lines)]
    records = drift.load(spark.createDataFrame(rows, LINES))
    return {tuple(r) for r in drift.changes(records, f).select("repo", "record_type", "dump_id", "change_kind", "field_name", "new_name").collect()}, records


def job(i, **more):
    return {"_type": "Job", "id": i, **more}


def test_changes(spark):
    lines = [
        (7, job("a", t="1", gone=1, old="x", same=1, k=None)), (7, job("b", t="2", gone=None, old=None, same=2.0)), (7, job("a", t="1", gone=1, old="x", same=1)),
        (3, {**job("a", t=1, new="x", other=5, same=1.0, k="v"), "_type": "JOB"}), (3, {**job("b", t="2", same=2), "_type": "j_o_b"}), (3, job("c", t=3, new="z")),
        (3, None), (3, ""), (3, '{"_type": "Job", "id"'), (3, "[1]"), (3, {"id": "no type"}), (3, {"_type": 5}), (3, '{"_type": "Job", "id": "a"} x'),
        (9, {"_type": "Value", "value_hash": "v", "n": True}), (5, job("q")), (8, job("q", lost=1)),
    ]
    got, _ = run(spark, [(7, "r", 1), (3, "r", 2), (9, "r", 3), (5, None, 1), (8, "s", None)], lines)
    assert got == {
        ("r", "job", 3, "retyped", "t", ""), ("r", "job", 3, "renamed", "old", "new"), ("r", "job", 3, "removed", "gone", ""), ("r", "job", 3, "added", "other", ""),
    }  # k has no types in the earlier file; 1 and 1.0 are one number


def test_differing_records_of_a_key(spark):
    """No change of name when a key's records don't agree, and none without a common key."""
    two = [(1, job("a", old=1)), (1, job("a", old=2)), (2, job("a", new=1))]
    got, _ = run(spark, [(1, "r", 1), (2, "r", 2)], two)
    assert {x[3] for x in got} == {"removed", "added"}
    got, _ = run(spark, [(1, "r", 1), (2, "r", 2)], [(1, job("a", old=1)), (2, job("b", new=1))])
    assert {x[3] for x in got} == {"removed", "added"}
    got, _ = run(spark, [(1, "r", 1), (2, "r", 2)], [(1, job("a", old=None)), (2, job("a", new=None))])
    assert {x[3] for x in got} == {"removed", "added"}


def test_skips_files_without_the_type(spark):
    got, _ = run(spark, [(1, "r", 1), (2, "r", 2), (3, "r", 3)], [(1, job("a", x=1)), (2, {"_type": "Tag", "tag_hash": "t"}), (3, job("a"))])
    assert got == {("r", "job", 3, "removed", "x", "")}
    assert run(spark, [], [])[0] == set()


def test_consistent_table(spark):
    _, records = run(spark, [], [(1, job("a", n=5, when="2025-01-02 03:04:05")), (1, job("b", m="six", when=["no"])), (1, job("c", n="7", when=None))])
    t = drift.consistent(records, {"n": ("int", ["n", "m"]), "at": ("timestamp_ntz", ["when"])})
    assert {r["record_key"]: (r["n"], r["at"], r["failed"]) for r in t.collect()} == {
        "a": (5, datetime(2025, 1, 2, 3, 4, 5), []), "b": (None, None, [("n", "m"), ("at", "when")]), "c": (7, None, [])}
    assert {tuple(r) for r in drift.failed_casts(t).collect()} == {(1, "job", "n", "m", 1, "six"), (1, "job", "at", "when", 1, '["no"]')}


def test_odd_json(spark):
    lines = [(1, '{"_type": "Job", "id": {"b": 1, "a": 2}, "s": "\\ud800", "big": 1e400, "n": NaN}'), (1, '{"_type": "Job", "id": "' + "x" * 100_000 + '", "d": ' + "[" * 500 + "]" * 500 + "}")]
    _, records = run(spark, [(1, "r", 1)], lines)
    assert records.count() == 2
    kinds = {r["path"]: r["kind"] for r in drift.target_types(drift.statistics(records)).collect()}
    assert kinds["d"] == "array" and kinds["big"] == kinds["n"] == "float"


def test_every_field_in_the_table(spark):
    """Columns come from the files: renames are one column, and what has no column or doesn't cast is in rest."""
    lines = [
        (1, job("a", old="x", size=1, deep={"k": [1]}, **{"odd name": 5})), (1, job("b", old="y", size=2, deep={"k": []}, both="p")),
        (2, job("a", new="x", size=1.5, Deep=7, both="q")), (2, job("b", new="y", size="many", big=2**53 + 1)), (2, job("c", big=0.5)), (2, job("d", run_id="r", execution_id="s")),
        (2, {"_type": "Tag", "tag_hash": "t", "new": True}),
    ]
    f = spark.createDataFrame([(1, "r", datetime(2025, 1, 1)), (2, "r", datetime(2025, 1, 2))], FILES)
    records = run(spark, [], lines)[1]
    columns = drift.layout(records, f, {"execution_id": ("string", ["execution_id", "run_id"])})
    assert {n: t for n, (t, _) in columns.items()} == {
        "execution_id": "string", "old": "string", "size": "double", "Deep": "bigint", "deep_2": "string", "both": "string", "big": "string", "new": "boolean"}
    rows = {r["record_key"]: r for r in drift.consistent(records, columns).collect()}
    seen = [r for r in drift.consistent(records, columns).collect() if r["old"] is not None]
    assert sorted((r["dump_id"], r["record_key"], r["old"]) for r in seen) == [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "y")]
    assert rows["t"]["new"] is True and rows["c"]["big"] == "0.5" and rows["c"]["rest"] == {}
    assert rows["d"]["execution_id"] == "s" and rows["d"]["rest"] == {"run_id": "r"}
    last = next(r for r in seen if r["dump_id"] == 2 and r["record_key"] == "b")
    assert last["failed"] == [("size", "size")] and last["rest"] == {"size": "many"} and last["big"] == str(2**53 + 1)
    first = next(r for r in seen if r["dump_id"] == 1 and r["record_key"] == "a")
    assert first["deep_2"] == '{"k": [1]}' and first["size"] == 1.0 and first["rest"] == {"odd name": "5"}


@pytest.mark.parametrize("depth", [5_000, 60_000])
def test_any_depth(spark, depth):
    """A record of any depth is a record, and its values are compared."""
    deep = '{"_type": "Job", "id": "a", "%s": ' + "[" * depth + "]" * depth + "}"
    got, records = run(spark, [(1, "r", 1), (2, "r", 2)], [(1, deep % "old"), (2, deep % "new")])
    assert got == {("r", "job", 2, "renamed", "old", "new")}
    assert records.count() == 2


def test_raw_types(spark):
    lines = [(1, job("a", n=1, m=1, t="2025-01-02T03:04:05", u="2025-01-02 03:04")), (1, job("b", n=2, m=2.5, t="2025-01-02", u="2025-13-77 99:99")), (2, job("a", n=1.5, m="1", t="x"))]
    f = spark.createDataFrame([(i, "r", datetime(2025, 1, i)) for i in (1, 2)], FILES)
    records = run(spark, [], lines)[1]
    stats = {(r["dump_id"], r["path"], r["kind"]): r["n"] for r in drift.statistics(records).collect()}
    assert stats[1, "n", "int"] == 2 and stats[1, "m", "int"] == stats[1, "m", "float"] == 1 and stats[1, "t", "time"] == stats[1, "t", "string"] == 1 and stats[1, "u", "time"] == 2
    assert {r["path"]: r["kind"] for r in drift.target_types(drift.statistics(records)).collect()} == {"_type": "string", "id": "string", "n": "float", "m": "float", "t": "string", "u": "time"}
    columns = drift.layout(records, f)
    assert {n: t for n, (t, _) in columns.items()} == {"n": "double", "m": "double", "t": "string", "u": "timestamp_ntz"}
    assert [tuple(r) for r in drift.failed_casts(drift.consistent(records, columns)).collect()] == [(1, "job", "u", "u", 1, "2025-13-77 99:99")]


def test_renames_against_all_pairs(spark):
    """The joined fingerprints against a comparison of every removed with every added field."""
    rng = random.Random(11)
    lines = [(d, job(f"k{rng.randrange(6)}", **{f"{'old' if d == 1 else 'new'}{i}": rng.choice([None, 1, 1.0, "1", [1], {}]) for i in range(4) if rng.random() < 0.7})) for d in (1, 2) for _ in range(5)]
    for n in range(12):
        keep = [x for x in lines if rng.random() < 0.5]
        at = {d: [p for e, p in keep if e == d] for d in (1, 2)}
        names = {d: {k for p in at[d] for k in p} for d in at}
        text = lambda v: json_text.canonical(v)
        held = {d: {k: {i: {text(p.get(k)) for p in at[d] if p["id"] == i} for i in {p["id"] for p in at[d]}} for k in names[d]} for d in at}
        both = {p["id"] for p in at[1]} & {p["id"] for p in at[2]}
        want = {(a, b) for a in names[1] - names[2] for b in names[2] - names[1] if both and all(len(held[1][a][i]) == 1 and held[1][a][i] == held[2][b][i] for i in both) and any(held[1][a][i] != {"null"} for i in both)}
        got = {x[4:] for x in run(spark, [(1, "r", 1), (2, "r", 2)], keep)[0] if x[3] == "renamed"}
        assert got == want
