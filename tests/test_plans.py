import hashlib
import random
from dataclasses import dataclass

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tributary.functions import scalars as S
from tributary.functions import values as V
from tributary.functions.hashing import hash_text
from tributary.plans import annotate, reuse, sync, tags
from tributary.plans import transforms as T
from tributary.plans.graph import levels, passed_on, reachable, topological_levels
from tributary.plans.lineage import parse
from tributary.plans.provenance import Provenance
from tributary.scratch import Scratch
from tributary.sources import datasets, files
from tributary.streaming import changes


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_values(spark):
    a = F.array(*map(F.lit, [1, 2, 3, 4]))
    r = one(spark, V.item(a, -1), V.item(a, 9, strict=False), V.slice_(a, 1, 3), V.slice_(a, -3, -1), V.slice_(a, 0, 4, 2), V.add(a, F.array(F.lit(5)), "array"), V.multiply(F.lit("ab"), 2, "string"), V.multiply(a, 0, "array"))
    assert list(r) == [4, None, [2, 3], [2, 3], [1, 3], [1, 2, 3, 4, 5], "abab", []]
    with pytest.raises(Exception):
        one(spark, V.item(a, 9))
    with pytest.raises(Exception):
        one(spark, V.divide(F.lit(1), F.lit(0)))


def test_arrays(spark):
    r = one(spark, T.zip_(F.array(F.lit(1), F.lit(2)), F.array(F.lit("a"))), T.flatten(F.array(F.array(F.lit(1)), F.lit(None).cast("array<int>"))), T.map_array_leaves(lambda x: x + 1, F.array(F.array(F.lit(1))), 2))
    assert [tuple(x) for x in r[0]] == [(1, "a")] and list(r)[1:] == [[1], [[2]]]


def test_combinators(spark):
    assert T.compose(lambda x: x + 1, lambda x: x * 2)(5) == 11 and T.compose()(3) == 3
    assert T.cond(False, 1, True, lambda: 2, lambda: 1 / 0) == 2
    assert T.catch(lambda: 1 / 0, ValueError, lambda e: 1, ZeroDivisionError, lambda e: 2) == 2
    with pytest.raises(ZeroDivisionError):
        T.catch(lambda: 1 / 0, ValueError, lambda e: 1)
    assert T.catch(lambda: spark.range(1).select(T.throw("no")), Exception, lambda e: "caught") == "caught"
    assert T.catch_all([lambda: 1, lambda: 1 / 0], recover=lambda xs: [isinstance(x, Exception) for x in xs]) == [False, True]
    assert T.merge_dicts([{"a": {"b": 1, "c": 1}}, {"a": {"b": 2}, "d": 3}]) == {"a": {"b": 2, "c": 1}, "d": 3}
    assert T.get_context({"a": {"b": 5}}, "a.b") == 5 and T.get_context({}, "a.b", 1) == 1
    assert T.map_leaves(lambda x: x * 2, {"a": (1, [2])}) == {"aa": (2, [4])} and sorted(T.iter_leaves([1, {2: {3}}])) == [1, 2, 3]
    assert T.seq([lambda: 1, lambda: 2]) == [1, 2] and T.force(T.delay(lambda: 3)) == 3
    with T.no_provenance():
        assert not T.recording()
    assert T.recording()


def test_merging_and_nesting():
    assert T.merge_dicts([{"x": 5}, {"x": {"a": 1}}, {"x": {"b": 2}}]) == {"x": {"b": 2}}  # not all are dicts: the last counts
    assert T.merge_dicts([{"x": {"a": 1}}, {"x": {"b": 2}}, {"x": 3}]) == {"x": 3} and T.merge_dicts([]) == {}
    @dataclass
    class Box:
        a: int
        b: list
    assert list(T.iter_leaves([Box(1, [2, 3])])) == [1, 2, 3] and T.map_leaves(lambda x: x + 1, Box(1, [2])) == Box(2, [3])


def test_context():
    f = T.transform(lambda: T.current_context("a.b"), namespace="c", name="f", version="1")
    outer = T.transform(lambda: f(), namespace="c", name="g", version="1")
    assert f() is None and f.update_context({"a": {"b": 1}})() == 1 and outer.update_context({"a": {"b": 2}})() == 2
    with T.context({"a": {"b": 3, "c": 4}}):
        assert f() == 3 and f.update_context({"a": {"b": 5}})() == 5 and T.current_context("a.c") == 4
    assert T.current_context("a.c", "none") == "none"


def test_quoted_macro_udf(spark):
    q = T.quote(lambda: 1 / 0)
    m = T.macro(lambda spark, take, a, b: a.eval() if take else b)
    assert m(True, T.quote(lambda: 7), q) == 7 and m(False, T.quote(lambda: 7), q) is q
    def plus(x: pd.Series) -> pd.Series:
        return x + 1
    assert spark.range(2).select(T.udf(plus, "bigint")("id").alias("y"), T.udf(lambda x: str(x), "string")("id").alias("z")).collect() == [(1, "0"), (2, "1")]


def test_annotations(spark):
    have = spark.createDataFrame([("a", "c")], "arg_hash string, result_call_hash string")
    more = spark.createDataFrame([("a", "c"), ("a", "d"), ("a", "d"), (None, "d"), ("b", None)], "arg_hash string, result_call_hash string")
    assert sorted(map(tuple, annotate.derive(have, more).collect())) == [("a", "c"), ("a", "d")]
    states, edges = annotate.merge_states(spark.createDataFrame([("n", "s2"), ("n", "s1"), ("n", "s1"), ("m", "x"), ("k", None)], "name string, state string"))
    named = {r["name"]: r["state"] for r in states.collect()}
    assert set(named) == {"n", "m"} and named["m"] == "x" and sorted(map(tuple, edges.collect())) == [("s1", named["n"]), ("s2", named["n"])]
    assert annotate.merge_states(spark.createDataFrame([("n", "s1"), ("n", "s2")], "name string, state string"))[0].first()["state"] == named["n"]
    store = spark.createDataFrame([], "tag_hash string, entity_type string, entity_id string, key string, value string")
    edits = spark.createDataFrame([], "parent_id string, child_id string")
    rows = spark.createDataFrame([("v", "j", None), ("v", "k", "e")], "value_hash string, job_id string, execution_id string")
    out, store, edits = annotate.apply_tags(rows, store, edits, {"a": "1"}, {"b": "2"}, {"c": "3"})
    assert out is rows and sorted((r["entity_type"], r["entity_id"], r["key"]) for r in store.collect()) == [("Execution", "e", "c"), ("Job", "j", "b"), ("Job", "k", "b"), ("Value", "v", "a")]
    t = annotate.ValueType("Point", "x int, y int", ("x",), lambda v: v["y"] > 0)
    p = F.struct(F.lit(1).alias("x"), F.lit(None).cast("int").alias("y"))
    assert list(one(spark, t.valid(p), t.load(t.dump(p))["x"], t.hash(p) == t.hash(F.struct(F.lit(1).alias("x"), F.lit(5).alias("y"))))) == [False, 1, True]
    annotate.register_type(t)
    with pytest.raises(ValueError):
        annotate.register_type(annotate.ValueType("Point", "x int", ("x",)))


def test_cache_scope(spark):
    req = spark.createDataFrame([("t", a) for a in "wxyz"], "task_hash string, args_hash string")
    at = lambda *keys: spark.createDataFrame([("t", k, f"{keys[0]}{k}") for k in keys], "task_hash string, args_hash string, value_hash string")
    tables = at("x"), at("y", "x"), at("z", "x", "y")
    hits = lambda **kw: {r["args_hash"]: (r["hit"], r["value_hash"]) for r in reuse.check_cache(req, *tables, **kw).collect()}
    assert hits() == {"w": ("miss", None), "x": ("cse", "xx"), "y": ("ultimate", "yy"), "z": ("single", "zz")}
    assert {k for k, v in hits(scope="execution").items() if v[0] != "miss"} == {"x"} and all(v[0] == "miss" for v in hits(scope="none").values())
    assert hits(allowed=("single",)) == {"w": ("miss", None), "x": ("single", "zx"), "y": ("single", "zy"), "z": ("single", "zz")}


def test_tag_texts(spark):
    with pytest.raises(Exception, match="not JSON"):
        one(spark, S.parse_tag_value(F.lit("[1")))
    with pytest.raises(Exception, match="no key"):
        one(spark, S.parse_tag(F.lit("=x")))
    assert list(one(spark, S.parse_tag_value(F.lit("[1"), strict=False), S.parse_tag(F.lit("=x"), strict=False), S.parse_tag(F.lit("a=b=c"))["value"], hash_text(F.lit("x")))) == [None, None, "b=c", hashlib.sha512(b"x").hexdigest()[:40]]


def test_query_flags(spark, data):
    p = Provenance(spark, data)
    ids = [r["execution_id"] for r in p.job.where("execution_id is not null").select("execution_id").distinct().orderBy("execution_id").limit(2).collect()]
    both = lambda *a: {tuple(r) for r in parse(p, a).select("type", "id").collect()}
    assert both("--job", "--exec-id", ",".join(ids)) == both("--job", "--exec-id", ids[0], "--exec-id", ids[1]) == both("-j", "--exec-id", ids[0]) | both("-j", "--exec-id", ids[1])
    assert both("--task", "-t", "pack") == both("--task", "--task-name", "pack") and parse(p, ["--all"]).types == parse(p, []).types
    v = p.argument.select("value_hash").where("value_hash is not null").first()[0]
    assert both("--arg", v) == both("--argument", v) != set()
    with pytest.raises(ValueError):
        parse(p, ["--nothing"])


def test_sql_keeps_views(spark):
    spark.range(3).createOrReplaceTempView("dataset")
    try:
        assert datasets.sql_query(spark.range(5), "WITH x AS (SELECT id + 1 AS y, '{a}' AS b FROM dataset) SELECT max(y) AS m, max(b) AS b FROM x").first() == (5, "{a}")
        assert spark.table("dataset").count() == 3
    finally:
        spark.catalog.dropTempView("dataset")


def test_identity_of_transforms():
    def make(body, **kw):
        return T.transform(body, namespace="n", name="f", **kw)
    a, b = make(lambda x: x, version="1"), make(lambda x: x + 1, version="1")
    assert a.hash == b.hash != make(lambda x: x, version="2").hash
    assert a.partial(1).hash != a.hash and a.partial(1)() == 1 and a.with_options(k=1).hash != a.hash
    assert T.lookup("n.f").hash == make(lambda x: x, version="2").hash
    assert make(lambda x: x, version="1", hash_includes=["x"]).hash != a.hash


def test_maps_fuse(spark):
    df = T.map_(lambda c: c * 2, T.map_(lambda c: c + 1, spark.range(3), "id"), "value")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1


def test_reachable_with_cycle(spark):
    e = spark.createDataFrame([("n", a, "n", b) for a, b in ["ab", "bc", "ca", "cd", "ef"]], "src_type string, src string, dst_type string, dst string")
    got = reachable(e, spark.createDataFrame([("n", "a")], "type string, id string"))
    assert sorted(r["id"] for r in got.collect()) == list("abcd")


def test_levels(spark):
    e = spark.createDataFrame([tuple(x) for x in ["ab", "bc", "ac", "xy", "yx", "yz"]], "src string, dst string")
    assert {tuple(r) for r in topological_levels(e).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_engine(spark, tmp_path):
    src = datasets.from_data(spark, spark.range(5).toDF("x"), f"file://{tmp_path}/src")
    inner = T.transform(lambda df: df, namespace="n", name="inner", version="1")
    f = T.transform(lambda df, n: df.where(F.col("x") > n), namespace="n", name="f", version="1")
    root = f"file://{tmp_path}/engine"
    e = reuse.Engine(spark, root)
    assert e.explain_miss(f, src, 1) == "new_task"
    first = e.run(f, src, 1, uses=[inner])
    assert first.reused is None and first.df.count() == 3
    assert e.run(f, src, 1).reused == "cse" and e.explain_miss(f, src, 2) == "new_args"
    again = reuse.Engine(spark, root)
    assert again.run(f, src, 1, uses=[inner]).reused == "ultimate"
    other = T.transform(lambda df: df, namespace="n", name="inner", version="2")
    assert reuse.Engine(spark, root).run(f, src, 1, uses=[other]).reused is None
    assert e.run(f, first, 3).df.count() == 1 and e.manifest().count() == 3
    files.remove(spark, first.path)
    assert reuse.Engine(spark, root).run(f, src, 1, uses=[inner]).reused is None


def test_datasets(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    ds = datasets.Dataset(spark, root, "csv").save(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), ["k"])
    files.write_text(spark, f"{root}/note.txt", "x")
    assert ds.read(validate=True).count() == 2 and len(ds.files()) == 2
    h = ds.hash
    assert ds.is_valid(h) and sum(len(x) for x in ds.pandas_shards()) == 2
    with pytest.raises(ValueError):
        datasets.Dataset(spark, root, "nothing")
    with pytest.raises(ValueError):
        datasets.from_files(spark, [])
    with pytest.raises(ValueError):
        datasets.from_files(spark, ds.files()[:1] + [f"{root}/note.txt"])
    assert datasets.from_files(spark, [f.replace("file:", "") for f in ds.files()]).read().count() == 2
    assert ds.purge() == 2 and not ds.is_valid(h)
    with pytest.raises(ValueError):
        datasets.sql_query(spark.range(1), "SELECT 1")


def test_tags(spark):
    schema = "tag_hash string, entity_type string, entity_id string, key string, value string"
    t, e = spark.createDataFrame([], schema), spark.createDataFrame([], "parent_id string, child_id string")
    new = lambda v: spark.createDataFrame([("Job", "j", "k", v)], "entity_type string, entity_id string, key string, value string")
    def stored(pair):
        """Each version is a stored table, as it would be outside of tests."""
        return tuple(spark.createDataFrame(df.collect(), df.schema) for df in pair)
    for v in ("1", "1", "2"):
        t, e = stored(tags.record(t, e, new(v)))
    assert tags.multimap(t, e).first()["tags"] == {"k": ["1", "2"]}
    t2, e2 = stored(tags.record(t, e, new("3"), update=True))
    assert tags.multimap(t2, e2).first()["tags"] == {"k": ["3"]} and tags.superseded(t2, e2).count() == 2
    assert tags.multimap(*stored(tags.delete(t2, e2, new("x")))).collect() == []


def test_transfer_twice(spark):
    r = sync.to_records(spark.createDataFrame([("a", None), ("b", 2)], "id string, n int"), "Job")
    empty = r.limit(0)
    once = sync.put(empty, r.unionByName(r))
    assert once.count() == 2 and sync.put(once, r).count() == 2 and sync.missing(once, r).count() == 0


def test_new_files(spark, tmp_path):
    got = []
    def run():
        return changes.on_new_files(spark, f"{tmp_path}/in", "json", "x int", f"{tmp_path}/cp", lambda df, i: got.extend(r["x"] for r in df.collect()))
    spark.createDataFrame([(1,)], "x int").write.json(f"{tmp_path}/in")
    run()
    spark.createDataFrame([(2,)], "x int").write.mode("append").json(f"{tmp_path}/in")
    run()
    assert run() == 0 and sorted(got) == [1, 2]


def test_candidates_passed_on(spark):
    """Ancestors count by every parent and through cycles, those of one cycle not for each other."""
    rng = random.Random(3)
    links = [(f"c{rng.randrange(i):02}", f"c{i:02}") for i in range(1, 50) for _ in range(rng.randrange(1, 3))] + [("c07", "c07"), ("x", "y"), ("y", "x"), ("c03", "x"), ("y", "low"), ("low", "lower")]
    for i in (9, 20, 31):
        links += [(f"c{i:02}", f"r{i}"), (f"r{i}", f"c{rng.randrange(i):02}")]
    calls = sorted({c for e in links for c in e} | {"no link"})
    cand = sorted({(f"v{i}", rng.choice(calls)) for i in range(60) for _ in range(1 + i % 4)} | {("w", c) for c in ("x", "y", "lower", "c03")})
    below = {}
    for n in calls:
        reached, work = set(), [n]
        while work:
            at = work.pop()
            new = {c for p, c in links if p == at} - reached
            reached |= new
            work += new
        below[n] = reached
    want = {(v, a) for v, a in cand if any(w == v and b in below[a] and a not in below[b] for w, b in cand)}
    got = passed_on(spark.createDataFrame(cand, "value_hash string, call_hash string"), spark.createDataFrame(links, "parent_id string, child_id string"), Scratch(spark, "test"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {a for v, a in want if v == "w"} == {"x", "y", "c03"}


def test_levels_across_cycles(spark):
    """Nodes on and behind cycles have levels too."""
    e = spark.createDataFrame([tuple(x) for x in ["ab", "bc", "ac", "xy", "yx", "yz", "cx", "pq", "qp", "ss"]], "src string, dst string")
    assert sorted(tuple(r) for r in levels(e).collect()) == [
        ("a", 0, False), ("b", 1, False), ("c", 2, False), ("p", 0, True), ("q", 0, True), ("s", 0, True), ("x", 3, True), ("y", 3, True), ("z", 4, False)]
