"""Composition of transforms, annotation of results, datasets and files as queries over the stored tables, with their SQL."""

from __future__ import annotations

import asyncio
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import scratch, session
from tributary.functions import scalars as S
from tributary.functions import text as X
from tributary.functions.hashing import hash_struct
from tributary.plans import annotate, reuse, tags
from tributary.plans import transforms as T
from tributary.plans.lineage import LineageQuery
from tributary.plans.provenance import Provenance, ctes
from tributary.sources import database, datasets, files
from tributary.sources.tables import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


# --- evaluation


@query("SELECT o_orderstatus, count(*) AS n, true AS refused FROM orders GROUP BY o_orderstatus")
def bool_forbidden(spark: SparkSession, d: str) -> DataFrame:
    """A column has no truth of its own; conditions are built with ``cond``."""
    def branch(c) -> bool:
        try:
            return not bool(c)
        except Exception:  # noqa: BLE001
            return True
    c = F.col("o_totalprice") > 0
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(branch(c)))


@query("SELECT r_regionkey, r_name, n FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) x ON n_regionkey = r_regionkey")
def awaited_values(spark: SparkSession, d: str) -> DataFrame:
    """Two plans awaited side by side; their rows go on as values."""
    async def both():
        return await asyncio.gather(T.value(table(spark, d, "region", "r_regionkey", "r_name")), T.value(table(spark, d, "nation").groupBy("n_regionkey").count()))
    names, counts = asyncio.run(both())
    n = {r["n_regionkey"]: r["count"] for r in counts}
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"], n[r["r_regionkey"]]) for r in names if r["r_regionkey"] in n], "r_regionkey bigint, r_name string, n bigint")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def quoted_plan(spark: SparkSession, d: str) -> DataFrame:
    """A quoted plan over a table that isn't there does no harm while it isn't evaluated."""
    T.quote(table, spark, d, "no_such_table")
    return T.quote(lambda least: table(spark, d, "customer").where(F.col("c_acctbal") > least).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), 0).eval()


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def identity_const(spark: SparkSession, d: str) -> DataFrame:
    """A frame after another was run for its effects."""
    s = table(spark, d, "supplier", "s_suppkey", "s_acctbal")
    return T.const(T.identity(s), T.identity(s.where("s_acctbal < 0")))


@query("SELECT 'customer' AS source, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def apply_in_sequence(spark: SparkSession, d: str) -> DataFrame:
    count = lambda name: (name, T.apply_func(lambda n: table(spark, d, n).count(), name))
    done = T.seq([lambda n=n: T.force(T.delay(lambda: count(n))) for n in ("customer", "orders", "part")])
    return spark.createDataFrame(done, "source string, n bigint")


@query("SELECT p_brand, upper(p_brand) AS loud, min(p_size) AS least FROM part GROUP BY p_brand")
def lifted_function(spark: SparkSession, d: str) -> DataFrame:
    """A built-in function and a plain one lifted to transforms, one found again by its name."""
    loud = T.as_transform(F.upper)

    @T.transform(namespace="lift", version="1")
    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("p_brand").agg(F.min("p_size").alias("least"))
    found = T.lookup("lift.least")
    assert found is not None and found.hash == T.lookup(hash=least.hash).hash
    return found(table(spark, d, "part")).withColumn("loud", loud(F.col("p_brand")))


@query("SELECT p_partkey, p_size * 2 + 1 AS size FROM part")
def wrapped_transform(spark: SparkSession, d: str) -> DataFrame:
    """A transform around another, whose identity includes the inner one's."""
    @T.transform(namespace="wrap", version="1")
    def size(df: DataFrame) -> DataFrame:
        return df.select("p_partkey", (F.col("p_size") * 2).alias("size"))
    more = T.wraps(lambda inner: lambda df: inner(df).withColumn("size", F.col("size") + 1))(size)
    assert more.hash != size.hash
    return more(table(spark, d, "part"))


@query("SELECT 'recorded' AS what, 1 AS n UNION ALL SELECT 'rows', count(*) FROM nation")
def unrecorded_run(spark: SparkSession, d: str) -> DataFrame:
    """Of two evaluations only the one outside the scope is in the manifest."""
    e = reuse.Engine(spark, scratch.new_path(spark, "engine"))
    f = T.transform(lambda df, n: df.where(F.col("n_nationkey") >= n), namespace="quiet", name="f", version="1")
    src = datasets.Dataset(spark, f"{d}/nation.parquet")
    with T.no_provenance():
        e.run(f, src, 5)
    whole = e.run(f, src, 0)
    out = spark.createDataFrame([("recorded", e.manifest().count()), ("rows", whole.df.count())], "what string, n bigint")
    e.clear()
    return out


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice < 0) AS n_bad, count(*) AS n FROM orders GROUP BY o_orderpriority")
def thrown_and_caught(spark: SparkSession, d: str) -> DataFrame:
    """A check that fails on rows that aren't there passes; one that fails on the rows is recovered from, both together."""
    o = table(spark, d, "orders", "o_orderpriority", "o_totalprice")
    check = lambda bad: T.catch(lambda: o.select("*", F.when(bad, T.throw("bad price")).alias("checked")), Exception, lambda e: None)
    fine, none = check(F.col("o_totalprice") < 0), check(F.col("o_totalprice") >= 0)
    failed = T.catch_all([lambda: none.count(), lambda: fine.count()], AttributeError, lambda xs: sum(isinstance(x, Exception) for x in xs))
    assert failed == 1
    return fine.groupBy("o_orderpriority").agg(F.count("checked").alias("n_bad"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, 'UTC+02' AS zone, 'UTC' AS later, 'UTC+03' AS nested FROM events GROUP BY event_type")
def scoped_options(spark: SparkSession, d: str) -> DataFrame:
    """Settings in a scope, gone behind it, and a run in a session of its own."""
    zone = lambda s: s.conf.get("spark.sql.session.timeZone")
    before = zone(spark)
    with T.options(spark, spark__sql__session__timeZone="UTC+02"):
        inside = zone(spark)
    nested = T.subrun(spark, zone, spark__sql__session__timeZone="UTC+03")
    later = "UTC" if zone(spark) == before else "changed"
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("*", F.lit(inside).alias("zone"), F.lit(later).alias("later"), F.lit(nested).alias("nested"))


@query("SELECT p_partkey, p_size * 3 AS plain, p_size * 7 AS scaled FROM part")
def context_override(spark: SparkSession, d: str) -> DataFrame:
    """A transform reads its factor from the context, which an updated one has its own of; what isn't updated stays."""
    @T.transform(namespace="ctx", version="1")
    def scale(c):
        return c * T.current_context("scale.factor") * T.current_context("scale.unit", 0)
    with T.context({"scale": {"factor": 3, "unit": 1}}):
        plain, scaled = scale(F.col("p_size")), scale.update_context({"scale": {"factor": 7}})(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", plain.alias("plain"), scaled.alias("scaled"))


@query("SELECT r_regionkey, r_name AS last, r_regionkey + 1 AS kept, 'b' AS only FROM region")
def merged_dicts(spark: SparkSession, d: str) -> DataFrame:
    """Nested dicts of each row's values: merged while all are dicts, else the last counts."""
    rows = table(spark, d, "region", "r_regionkey", "r_name").collect()
    out = []
    for r in rows:
        m = T.merge_dicts([{"x": 5, "n": {"kept": r["r_regionkey"] + 1, "last": "a"}}, {"x": {"a": 1}, "n": {"last": r["r_name"]}}, {"x": {"b": "b"}}])
        out.append((r["r_regionkey"], m["n"]["last"], m["n"]["kept"], "".join(m["x"].values())))
    return spark.createDataFrame(out, "r_regionkey bigint, last string, kept bigint, only string")


@query("SELECT event_id, event_type AS kind, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 2 AS n_keys FROM events")
def merged_map_columns(spark: SparkSession, d: str) -> DataFrame:
    """Maps of each row's own values; the later value of a key counts, null maps count as empty."""
    k = F.get_json_object("props", "$.k")
    m = T.merge_maps(F.create_map(F.lit("kind"), F.lit("?"), F.lit("k"), F.lit("none")), F.create_map(F.lit("kind"), F.col("event_type")), F.when(k.isNotNull(), F.create_map(F.lit("k"), k)))
    return table(spark, d, "events").select("event_id", m["kind"].alias("kind"), m["k"].alias("k"), F.size(m).alias("n_keys"))


@dataclass(frozen=True)
class _Pair:
    name: str
    keys: tuple


@query("SELECT n_regionkey, count(*) AS n, CAST(sum(n_nationkey + 1) AS BIGINT) AS total, string_agg(lower(n_name), ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def nested_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of dicts, lists and dataclasses, walked and mapped."""
    nested: dict[int, list[_Pair]] = {}
    for r in table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").orderBy("n_name").collect():
        nested.setdefault(r["n_regionkey"], []).append(_Pair(r["n_name"], (r["n_nationkey"],)))
    low = T.map_leaves(lambda x: x.lower() if isinstance(x, str) else x + 1, list(nested.values()))
    rows = []
    for k, pairs in zip(nested, low):
        leaves = list(T.iter_leaves(pairs))
        numbers, names = [x for x in leaves if isinstance(x, int)], [x for x in leaves if isinstance(x, str)]
        rows.append((k, len(numbers), sum(numbers), ",".join(names)))
    return spark.createDataFrame(rows, "n_regionkey bigint, n bigint, total bigint, names string")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def macro_branch(spark: SparkSession, d: str) -> DataFrame:
    """A macro gets its branches unevaluated and builds only the one it takes."""
    @T.macro
    def pick(spark: SparkSession, name: str, found: T.Quoted, missing: T.Quoted) -> DataFrame:
        return (found if files.exists(spark, f"{d}/{name}.parquet") else missing).eval()
    return pick("orders", T.quote(lambda: table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))), T.quote(table, spark, d, "no_such_table"))


@query("SELECT s_nationkey, count(*) AS n, count(*) FILTER (WHERE s_acctbal < 0) AS n_refused, count(DISTINCT s_name) AS n_identities FROM supplier GROUP BY s_nationkey")
def custom_values(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as values of a type of their own: dumped, loaded, checked, told apart by name only."""
    t = annotate.register_type(annotate.ValueType("Account", "name string, balance double", ("name",), _solvent))
    v = F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    x = table(spark, d, "supplier").select("s_nationkey", t.load(t.dump(v)).alias("v"))
    return x.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(~annotate.value_type("Account").valid(F.col("v"))).alias("n_refused"), F.countDistinct(t.hash(F.col("v"))).alias("n_identities"))


def _solvent(v):
    return v["balance"] >= 0


@query("SELECT true AS active, true AS workers, count(*) AS n FROM region")
def session_info(spark: SparkSession, d: str) -> DataFrame:
    s = session.active_session()
    return table(s, d, "region").agg(F.count(F.lit(1)).alias("n")).select(F.lit(s is not None).alias("active"), F.lit(session.num_workers(spark) >= 1).alias("workers"), "n")


# --- annotation of recorded runs


@query(ctes("p_argument", "p_call_edge") + "SELECT arg_hash, result_call_hash FROM p_argument UNION SELECT a.arg_hash, e.parent_id FROM p_argument a JOIN p_call_edge e ON e.child_id = a.call_hash")
def derived_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each argument also derives from the parents of its call."""
    p = Provenance(spark, d)
    p.cut("call_edge", "argument")
    have = p.argument.select("arg_hash", "result_call_hash").distinct()
    pairs = p.argument.select("arg_hash", F.col("call_hash").alias("child_id")).join(p.call_edge, "child_id").select("arg_hash", F.col("parent_id").alias("result_call_hash"))
    return annotate.derive(have, pairs)


@query(ctes("p_job", "p_call", "p_tag") + """SELECT entity_type, key, count(*) AS n FROM (SELECT entity_type, entity_id, key, value FROM p_tag WHERE is_current UNION SELECT 'Value', c.value_hash, 'kept', 'yes' FROM p_job j JOIN p_call c ON c.call_hash = j.call_hash WHERE c.value_hash IS NOT NULL
UNION SELECT 'Job', j.id, 'reviewed', 'no' FROM p_job j JOIN p_call c ON c.call_hash = j.call_hash UNION SELECT 'Execution', j.execution_id, 'batch', 'late' FROM p_job j JOIN p_call c ON c.call_hash = j.call_hash WHERE j.execution_id IS NOT NULL) t GROUP BY ALL""")
def applied_tags(spark: SparkSession, d: str) -> DataFrame:
    """Results, jobs and executions of all finished calls tagged; tags of one key add up."""
    p = Provenance(spark, d)
    p.cut("job", "call", "tag")
    results = p.job.join(p.call.select("call_hash", "value_hash"), "call_hash").select("value_hash", F.col("id").alias("job_id"), "execution_id")
    now = p.tag.where("is_current").select("tag_hash", "entity_type", "entity_id", "key", "value")
    none = spark.createDataFrame([], "parent_id string, child_id string")
    _, store, edits = annotate.apply_tags(results, now, none, {"kept": "yes"}, {"reviewed": "no"}, {"batch": "late"})
    return tags.current(store, edits).groupBy("entity_type", "key").agg(F.count(F.lit(1)).alias("n"))


@query(ctes("p_job") + "SELECT execution_id AS name, count(DISTINCT task_hash) AS n_parents, count(DISTINCT task_hash) > 1 AS joined FROM p_job WHERE execution_id IS NOT NULL AND task_hash IS NOT NULL GROUP BY execution_id")
def merged_states(spark: SparkSession, d: str) -> DataFrame:
    """Per execution the states that its tasks left, joined into one."""
    job = Provenance(spark, d).job.where("execution_id is not null and task_hash is not null")
    states, edges = annotate.merge_states(job.select(F.col("execution_id").alias("name"), F.col("task_hash").alias("state")))
    n = edges.groupBy(F.col("dst").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return states.join(n, "state", "left").select("name", F.coalesce("n", F.lit(1)).alias("n_parents"), F.col("n").isNotNull().alias("joined"))


@query(ctes("p_job", "p_task") + "SELECT t.name, (SELECT count(*) FROM p_job j WHERE j.task_hash = t.hash) AS n_jobs FROM p_task t WHERE t.hash = (SELECT task_hash FROM p_job WHERE task_hash IN (SELECT hash FROM p_task) GROUP BY task_hash ORDER BY count(*) DESC, task_hash LIMIT 1)")
def busiest_task(spark: SparkSession, d: str) -> DataFrame:
    """The number of jobs of one task, the one with most."""
    p = Provenance(spark, d)
    n = p.job.groupBy(F.col("task_hash").alias("hash")).agg(F.count(F.lit(1)).alias("n_jobs"))
    return p.task.join(n, "hash").agg(F.max_by(F.struct("name", "n_jobs"), F.struct("n_jobs", F.lit(None).cast("string"))).alias("x")).select("x.name", "x.n_jobs")


@query(ctes("p_job", "p_execution") + "SELECT 'first' AS what, (SELECT e.id FROM p_execution e LEFT JOIN p_job j ON j.id = e.job_id ORDER BY j.start_time DESC NULLS LAST, e.id LIMIT 1) AS id UNION ALL SELECT 'one', NULL UNION ALL SELECT 'only', (SELECT min(id) FROM p_execution)")
def one_and_first(spark: SparkSession, d: str) -> DataFrame:
    p = Provenance(spark, d)
    q = LineageQuery(p).filter_types(["Execution"])
    least = p.execution.agg(F.min("id")).first()[0]
    many = q.one_or_none()
    rows = [("first", q.order_by("time").first()[1]), ("one", many and many[1]), ("only", q.filter_ids([least]).one()[1])]
    return spark.createDataFrame(rows, "what string, id string")


# --- datasets, files, databases


@query("SELECT o_orderstatus AS status, count(*) AS n, true AS listed, true AS same, true AS changed, true AS is_valid FROM orders GROUP BY o_orderstatus")
def dataset_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Listing, identity, the dataset on given files, and purging by age."""
    ds = datasets.Dataset(spark, scratch.new_path(spark, "shards"), recurse=True).save(table(spark, d, "orders", "o_orderkey", "o_orderstatus"), ["o_orderstatus"])
    shards, before = ds.files(), ds.hash
    again = datasets.from_files(spark, [s.replace("file:", "") if s.startswith("file:") else s for s in shards])
    same, still = again.read().count() == ds.read().count(), ds.is_valid(before)
    rows = spark.createDataFrame([tuple(r) for r in datasets.Dataset(spark, ds.path).read().groupBy("o_orderstatus").count().collect()], "status string, n bigint")
    kept = ds.purge(older_than_hours=24) == 0
    gone = ds.purge() == len(shards)
    return rows.select("status", "n", F.lit(kept and gone).alias("listed"), F.lit(same).alias("same"), F.lit(not ds.is_valid(before)).alias("changed"), F.lit(still).alias("is_valid"))


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def pandas_shards(spark: SparkSession, d: str) -> DataFrame:
    """A pandas frame a file, and all files as one."""
    ds = datasets.from_data(spark, table(spark, d, "supplier", "s_suppkey", "s_acctbal").repartition(3), scratch.new_path(spark, "pandas"))
    parts = list(ds.pandas_shards())
    assert len(parts) == len(ds.files()) and len(pd.concat(parts)) == len(ds.pandas())
    return spark.createDataFrame(pd.concat(parts))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def catalog_table(spark: SparkSession, d: str) -> DataFrame:
    """A table of the catalog on a dataset, read by name, then cleaned of its files."""
    name = f"tributary_{scratch.new_path(spark, 't').rsplit('-', 1)[1]}"
    datasets.Dataset(spark, scratch.new_path(spark, "catalog")).save(table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal"), table=name)
    try:
        rows = scratch.Scratch(spark, "rows").cut(datasets.from_catalog(spark, "default", name).where("c_acctbal > 0").select("c_custkey", "c_name"))
        assert datasets.clean_catalog_table(spark, name) > 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return rows


@query("SELECT n_nationkey, n_name FROM nation")
def xml_records(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "xml")
    src = table(spark, d, "nation", "n_nationkey", "n_name")
    src.write.format("xml").option("rowTag", "nation").save(path)
    return datasets.Dataset(spark, path, "xml").read(schema=src.schema, rowTag="nation")


@query("SELECT event_id AS id, event_type AS kind, CAST(round(value, 2) AS DOUBLE) AS amount FROM events")
def grok_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a log by a pattern with names."""
    root = scratch.new_path(spark, "log")
    e = table(spark, d, "events").select(F.concat(F.lit("id="), F.col("event_id"), F.lit(" ["), "event_type", F.lit("] took "), F.round("value", 2).cast("decimal(18,2)")).alias("value"))
    e.write.text(root)
    x = spark.read.text(root).select(*datasets.grok_columns(F.col("value"), r"id=%{INT:id} \[%{WORD:kind}\] took %{NUMBER:amount}"))
    return x.select(F.col("id").cast("bigint").alias("id"), "kind", F.col("amount").cast("double").alias("amount"))


@query("SELECT 'a' || r_regionkey AS name, length(r_name) AS n_bytes, true AS same FROM region")
def copied_files(spark: SparkSession, d: str) -> DataFrame:
    """Files copied by the executors; a second time all stay as they are."""
    root = scratch.new_path(spark, "copy")
    for r in table(spark, d, "region").collect():
        files.write_text(spark, f"{root}/x/a{r['r_regionkey']}", r["r_name"])
    found = files.file_set(spark, f"{root}/x")
    pairs = found.select(F.col("path").alias("src"), F.concat(F.lit(f"{root}/y/"), F.element_at(F.split("path", "/"), -1)).alias("dst"))
    n = files.copy_files(spark, pairs)
    again = files.copy_files(spark, pairs, skip_same=True).where("n_bytes is not null").isEmpty()
    ids = lambda what: {r["path"].rsplit("/", 1)[1]: r["hash"] for r in files.content_identities(spark, f"{root}/{what}").collect()}
    return n.select(F.element_at(F.split("dst", "/"), -1).alias("name"), "n_bytes", F.lit(again and ids("x") == ids("y")).alias("same"))


@query("SELECT 'file' AS scheme, true AS known UNION ALL SELECT 'hdfs', true UNION ALL SELECT 'http', true UNION ALL SELECT 'https', true UNION ALL SELECT 'ftp', true")
def file_schemes(spark: SparkSession, d: str) -> DataFrame:
    """Schemes that a connector is always there for; s3a, gs and abfss depend on the class path."""
    known = files.schemes(spark)
    return spark.createDataFrame([(s, known[s]) for s in ("file", "hdfs", "http", "https", "ftp")], "scheme string, known boolean")


@query("SELECT n_name AS name, count(*) AS n, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def database_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Rows into a database table, twice with the same end, and read again in parts.  The database is in the driver's memory."""
    url = f"jdbc:derby:memory:{scratch.new_path(spark, 'db').rsplit('-', 1)[1]};create=true"
    rows = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").join(table(spark, d, "nation", "n_nationkey", "n_name").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select("c_custkey", "n_name", "c_acctbal")
    given = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for _ in range(2):
        database.refresh(rows, url, "customers", parts=2, **given)
    high = rows.agg(F.max("c_custkey")).first()[0] or 1
    x = database.read(spark, url, "customers", "c_custkey", (0, high), parts=3, **given)
    return x.groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


# --- examples of whole pipelines


@query("""WITH RECURSIVE page AS (SELECT p_partkey AS k, p_size FROM part), walk(k, depth) AS (SELECT 1, 0 UNION SELECT l.k, depth + 1 FROM walk JOIN (SELECT k AS s, k * 2 AS k FROM page UNION ALL SELECT k, k * 2 + 1 FROM page) l ON l.s = walk.k WHERE depth < 5)
SELECT 'https://h.org/p/' || k AS url, min(depth) AS depth, count(*) > 0 AS seen, bool_or(k IN (SELECT k FROM page)) AS found FROM walk GROUP BY k""")
def bounded_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Pages reached by links in at most five steps from one page, each visited once."""
    k = F.col("p_partkey")
    link = lambda n: F.concat(F.lit('<a href="/p/'), n.cast("string"), F.lit('#top">x</a>'))
    pages = table(spark, d, "part").select(F.concat(F.lit("https://h.org/p/"), k.cast("string")).alias("url"), F.concat(link(k * 2), link(k * 2 + 1)).alias("html"))
    return X.crawl(pages, spark.createDataFrame([("https://h.org/p/1",)], "url string"), 5).select("url", "depth", F.lit(True).alias("seen"), "found")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(trim(p_name)), ' +')) AS word FROM part) t WHERE word <> '' GROUP BY word")
def disposable_parts(spark: SparkSession, d: str) -> DataFrame:
    """Map and reduce with parts that are kept in no manifest and removed behind the result."""
    s = scratch.Scratch(spark, "parts")
    mapped = s.cut(table(spark, d, "part").select(F.explode(F.split(F.lower(F.trim("p_name")), " +")).alias("word")).where("word <> ''").groupBy("word", F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")))
    out = s.cut(mapped.groupBy("word").agg(F.sum("n").alias("n")))
    s.close(out)
    return out


# --- scalars


@query("SELECT event_id, event_type || '=' || CASE WHEN regexp_matches(v, '[ ,]') OR regexp_matches(v, '^[0-9]+$') OR v IN ('', 'true', 'false', 'null') THEN '\"' || v || '\"' ELSE v END AS tag FROM (SELECT event_id, event_type, coalesce(json_extract_string(props, '$.k'), 'two words') AS v FROM events) t")
def formatted_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.format_tag(F.col("event_type"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("two words"))).alias("tag"))


@query("SELECT n_nationkey, '{\"a\":' || n_regionkey || ',\"b\":{\"x\":null,\"y\":\"' || n_name || '\"}}' AS json FROM nation")
def normalized_json(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{ "b": {"y" : "'), "n_name", F.lit('", "x": null}, "a":'), F.col("n_regionkey").cast("string"), F.lit("}"))
    return table(spark, d, "nation").select("n_nationkey", S.normalized_json(raw).alias("json"))


@query("SELECT count(DISTINCT p_name) AS n_names, count(DISTINCT (p_name, p_size)) AS n_pairs, count(DISTINCT p_size) AS n_sizes, 40 AS len FROM part")
def identities_apart(spark: SparkSession, d: str) -> DataFrame:
    """Identities are as many as what they stand for, parts can't run into each other, null isn't ''."""
    p = table(spark, d, "part")
    own = hash_struct("Part", F.col("p_name"), F.col("p_size"))
    return p.agg(F.countDistinct(hash_struct("Name", F.col("p_name"))).alias("n_names"), F.countDistinct(own).alias("n_pairs"), F.countDistinct(hash_struct("Size", F.col("p_size"))).alias("n_sizes"), F.max(F.length(own)).alias("len"))


@query("""SELECT text, json, CASE WHEN regexp_matches(text, '[ ,]') OR json NOT LIKE '"%' OR text LIKE '"%' THEN '"' || replace(text, '"', '\\"') || '"' ELSE text END AS formatted FROM (VALUES
('', 'null'), ('10', '10'), (' -3 ', '-3'), ('1_000', '1000'), ('2.5', '2.5'), ('1e3', '1000.0'), ('inf', 'Infinity'), ('nan', 'NaN'), ('true', 'true'), ('null', 'null'), ('word', '"word"'),
('two words', '"two words"'), ('a,b', '"a,b"'), ('[1, 2]', '[1,2]'), ('{"b": 1, "a": 2}', '{"a":2,"b":1}'), ('"10"', '"10"'), ('10x', '"10x"')) t(text, json)""")
def tag_values(spark: SparkSession, d: str) -> DataFrame:
    texts = ["", "10", " -3 ", "1_000", "2.5", "1e3", "inf", "nan", "true", "null", "word", "two words", "a,b", "[1, 2]", '{"b": 1, "a": 2}', '"10"', "10x"]
    t = F.col("text")
    return spark.createDataFrame([(x,) for x in texts], "text string").select("text", S.parse_tag_value(t).alias("json"), S.format_tag_value(t).alias("formatted"))


QUERIES = Q
