import random

import pyarrow as pa
import pytest

from tributary.operators import reach
from tributary.plans import graph
from tributary.scratch import Scratch


def below(links, start):
    seen, work = set(), list(start)
    while work:
        at = work.pop()
        new = {d for s, d in links if s == at} - seen
        seen |= new
        work += new
    return seen


def digest(x):
    return None if x is None else x.ljust(16, "-").encode()


@pytest.mark.parametrize("seed", range(6))
def test_ancestors(monkeypatch, seed):
    """Small groups by search, large ones by passes, with and without hubs, over cycles and repeated links."""
    monkeypatch.setattr(reach, "MANY", [2, 5, 64][seed % 3])
    monkeypatch.setattr(reach, "PASS", 3)
    monkeypatch.setattr(reach, "HUBS", [0, 3][seed % 2])
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)]  # parent, child
    own = sorted({(f"g{i}", f"n{rng.randrange(62)}") for i in range(30) for _ in range(1 + i % 9)})
    downs = {x: below(links, [x]) for _, x in own}
    want = {(g, a) for g, a in own if any(h == g and b in downs[a] and a not in downs[b] for h, b in own)}
    rows = [(None, c, p) for p, c in links] + [(g, c, None) for g, c in own]
    rng.shuffle(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array([digest(r[k]) for r in rows[i : i + 40]], pa.binary()) for k in range(3)], ["g", "c", "p"]) for i in range(0, len(rows), 40)]
    got = [(g, c) for b in reach.ancestors(iter(batches)) for g, c in zip(b["g"].to_pylist(), b["c"].to_pylist())]
    assert want and len(got) == len(set(got)) and set(got) == {(digest(g), digest(c)) for g, c in want}


def test_passed_on_both_ways(spark):
    """One task and the intervals agree."""
    rng = random.Random(7)
    links = spark.createDataFrame([(f"c{rng.randrange(40)}", f"c{rng.randrange(40)}") for _ in range(45)], "parent_id string, child_id string")
    cand = spark.createDataFrame(sorted({(f"v{i}", f"c{rng.randrange(41)}") for i in range(40) for _ in range(4)}), "value_hash string, call_hash string")
    one = graph.passed_on(cand, links, Scratch(spark, "test")).collect()
    assert one and sorted(one) == sorted(graph.passed_on(cand, links, Scratch(spark, "test"), task_links=0).collect())


def test_passed_on_takes_no_rounds(spark):
    """Links that one task can hold are written a few times, however long their ways."""
    links = spark.createDataFrame([(f"c{i}", f"c{i + d}") for i in range(200) for d in (1, 7)], "parent_id string, child_id string")
    cand = spark.createDataFrame([("v", "c0"), ("v", "c199"), ("w", "c5")], "value_hash string, call_hash string")
    s = Scratch(spark, "test")
    assert [tuple(r) for r in graph.passed_on(cand, links, s).collect()] == [("v", "c0")]
    assert len(s.paths) <= 4


@pytest.mark.parametrize("core_links", [0, 12, reach.LINKS])
def test_reachable_both_ways(spark, core_links):
    """Rounds, rounds and a task, and one task alone reach the same, over cycles, unreached parts and roots without links."""
    rng = random.Random(5)
    links = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(50)] + [(f"m{i}", f"m{i + 1}") for i in range(11)] + [("n1", "m0"), ("far", "off"), ("off", "far")]
    e = spark.createDataFrame([("x", a, "x", b) for a, b in links] + [("y", "n1", "y", "other type"), ("x", "n1", "x", None)], "src_type string, src string, dst_type string, dst string")
    roots = ["n1", "n2", "alone"]
    want = sorted([("x", r) for r in {*roots} | below(links, roots)] + [("x", "")])
    got = graph.reachable(e, spark.createDataFrame([("x", r) for r in [*roots, "n1"]], "type string, id string"), core_links)
    assert sorted((r["type"], r["id"] or "") for r in got.collect()) == want


def test_reachable_takes_no_rounds(spark, monkeypatch):
    """A way of 150 links isn't followed by a table a link."""
    cuts, cut = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda s, df, by=None: cuts.append(1) or cut(s, df, by))
    e = spark.createDataFrame([("x", f"{i}", "x", f"{i + 1}") for i in range(150)], "src_type string, src string, dst_type string, dst string")
    assert graph.reachable(e, spark.createDataFrame([("x", "0")], "type string, id string")).count() == 151
    assert len(cuts) <= 4


def test_flow_frees_what_it_made(spark, data, monkeypatch):
    """Tables and shuffle files of the parts of the dataflow don't stay beside those of the whole."""
    from tributary.plans.provenance import Provenance

    freed, close = [], Scratch.close
    monkeypatch.setattr(Scratch, "close", lambda s, *keep: freed.append(len(s.paths)) or close(s, *keep))
    graph.dataflow_edges(Provenance(spark, data))
    assert len(freed) == 2 and all(freed)


def test_merged_edges_planned_once(spark, tmp_path):
    """The edges, each use of which would run the whole dataflow again, are read once."""
    rows = [("CallNodeValue", "c", v, "call_result", "CallNode", "c", None, None) for v in ("v", "w")] + [("ArgumentValue", "a", "w", "call_arg_result_routing", "CallNodeValue", "c", "w", 1)]
    schema = "src_type string, src string, src_value string, edge_kind string, dst_type string, dst string, dst_value string, position int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/edges")
    got = graph.merge_call_values(spark.read.parquet(f"{tmp_path}/edges"), spark.createDataFrame([("c", "v")], "call_hash string, value_hash string"))
    assert not any(str(tmp_path) in f for f in got.inputFiles())
    assert {tuple(r) for r in got.collect()} == {("CallNodeValue", "c", "v", "call_result", "CallNode", "c", None, None), ("ArgumentValue", "a", "w", "data", "CallNodeValue", "c", "v", 1)}
