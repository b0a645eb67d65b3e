"""Recorded runs: filters, joins, aggregates, walks, tags, transfer and reuse, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary import scratch
from tributary.plans import graph, reuse, sync, tags
from tributary.plans import transforms as T
from tributary.plans.lineage import ANY, LineageQuery, job_status, parse, status_term, task_term, with_results
from tributary.plans.provenance import ERROR_TYPE, Provenance, ctes
from tributary.sources.datasets import Dataset
from tributary.sources.tables import table

Q, SQL = {}, {}


def query(*views: str, sql: str | None = None):
    """Register a query of the views; sql comes after the common tables of those named."""
    def add(f):
        Q[f.__name__] = lambda spark, d: f(Provenance(spark, d))
        if sql is not None:
            text = ctes(*(f"p_{v}" for v in views))
            if sql.startswith("WITH "):
                deep = sql.startswith("WITH RECURSIVE ")
                text, rest = text.replace("WITH ", "WITH RECURSIVE ", 1) if deep else text, sql[15 if deep else 5:]
                SQL[f.__name__] = f"{text.rstrip()}, {rest}"
            else:
                SQL[f.__name__] = text + sql
        return f
    return add


_ERR = f"'{ERROR_TYPE}'"
_FULL = "p_job j LEFT JOIN p_call c ON c.call_hash = j.call_hash LEFT JOIN p_value v ON v.value_hash = c.value_hash"
_STATUS = f"CASE WHEN v.type = {_ERR} THEN 'FAILED' WHEN j.end_time IS NULL THEN 'RUNNING' WHEN j.cached THEN 'CACHED' ELSE 'DONE' END"
_TERMS = {"RUNNING": "j.end_time IS NULL AND j.call_hash IS NULL", "CACHED": "j.cached", "FAILED": f"v.type = {_ERR}", "DONE": f"NOT j.cached AND v.type <> {_ERR}"}
_TASK = ("ingest.clean", "align")  # a namespace and a name that occur


def _purged(p: Provenance, kind: str) -> DataFrame:
    """The ids of all records of a type that were ever purged."""
    return table(p.spark, p.folder, "purge_log").where(F.col("entity_type") == kind).select("entity_id").distinct()


_PURGED = "(SELECT entity_id FROM purge_log WHERE entity_type = '{}')"
#: The executions of purged jobs.
_EXECS = f"(SELECT execution_id FROM p_job WHERE id IN {_PURGED.format('Job')})"


def _execs(p: Provenance) -> DataFrame:
    return p.job.join(_purged(p, "Job").withColumnRenamed("entity_id", "id"), "id", "left_semi").select("execution_id").distinct()


#: The values that are part of another.
_PART = "(SELECT value_hash FROM p_subvalue)"


# --- the views and derived columns


for _v, _cols in {
    "job": "id, start_time, end_time, task_hash, cached, call_hash, parent_id, execution_id", "execution": "id, args, updated_time, job_id", "task": "hash, name, namespace, source",
    "call": "call_hash, task_name, task_hash, args_hash, value_hash, called_at", "value": "value_hash, type, format", "subvalue": "value_hash, parent_value_hash",
    "call_edge": "parent_id, child_id, call_order", "argument": "arg_hash, call_hash, value_hash, arg_position, arg_key, result_call_hash", "tag": "tag_hash, entity_type, entity_id, key, value, is_current", "file": "value_hash, path",
}.items():
    def _view(p: Provenance, v=_v, cols=_cols) -> DataFrame:
        return getattr(p, v).select(*cols.split(", "))
    _view.__name__ = f"view_{_v}"
    query(_v, sql=f"SELECT {_cols} FROM p_{_v}")(_view)


@query("job", "call", "value", sql=f"SELECT j.id, {_STATUS} AS status, epoch_us(j.end_time) - epoch_us(j.start_time) AS duration_us FROM {_FULL}")
def job_statuses(p: Provenance) -> DataFrame:
    return with_results(p, p.job).select("id", job_status().alias("status"), F.expr("timestampdiff(MICROSECOND, start_time, end_time)").alias("duration_us"))


@query("job", "call", "value", "execution", sql=f"""
WITH s AS (SELECT j.id, {_STATUS} AS status FROM {_FULL}) SELECT e.id, CASE WHEN s.id IS NULL THEN 'FAILED' WHEN s.status IN ('DONE', 'CACHED') THEN 'DONE' ELSE s.status END AS status
FROM p_execution e LEFT JOIN s ON s.id = e.job_id""".strip())
def execution_statuses(p: Provenance) -> DataFrame:
    s = with_results(p, p.job).select(F.col("id").alias("job_id"), job_status().alias("status"))
    status = F.when(F.col("status").isNull(), "FAILED").when(F.col("status").isin("DONE", "CACHED"), "DONE").otherwise(F.col("status"))
    return p.execution.join(s, "job_id", "left").select("id", status.alias("status"))


# --- filters


def _two(df: DataFrame) -> DataFrame:
    return df.select("type", "id")


@query("job", "task", sql="SELECT 'Job' AS type, id FROM p_job UNION ALL SELECT 'Task', hash FROM p_task")
def filter_types(p: Provenance) -> DataFrame:
    return _two(LineageQuery(p).filter_types(["Job", "Task"]).all())


@query("execution", "job", "call", "task", "value", sql=" UNION ALL ".join(f"SELECT '{t}' AS type, {c} AS id FROM {v} WHERE {c} IN (SELECT entity_id FROM purge_log)" for t, c, v in (
    ("Execution", "id", "p_execution"), ("Job", "id", "p_job"), ("CallNode", "call_hash", "p_call"), ("Task", "hash", "p_task"), ("Value", "value_hash", "p_value"))))
def filter_ids(p: Provenance) -> DataFrame:
    return _two(LineageQuery(p).filter_ids(table(p.spark, p.folder, "purge_log").select("entity_id")).all())


@query("execution", "job", "call", "task", "value", sql="""
SELECT 'Execution' AS type, id FROM p_execution WHERE id LIKE 'a%' UNION ALL SELECT 'Job', id FROM p_job WHERE id LIKE 'a%' UNION ALL SELECT 'CallNode', call_hash FROM p_call WHERE call_hash LIKE 'a%'
UNION ALL SELECT 'Task', hash FROM p_task WHERE hash LIKE 'a%' OR name = 'a' UNION ALL SELECT 'Value', value_hash FROM p_value WHERE value_hash LIKE 'a%'""".strip())
def like_id(p: Provenance) -> DataFrame:
    return _two(LineageQuery(p).like_id("a").all())


_X = f"WITH x AS (SELECT DISTINCT call_hash, task_hash, id FROM p_job WHERE execution_id IN {_EXECS})"
_PATHS = """, used AS (SELECT value_hash FROM p_call WHERE call_hash IN (SELECT call_hash FROM {x}) UNION SELECT value_hash FROM p_argument WHERE call_hash IN (SELECT call_hash FROM {x})),
vals AS (SELECT value_hash FROM used UNION SELECT s.value_hash FROM p_subvalue s WHERE s.parent_value_hash IN (SELECT value_hash FROM used))"""


@query("execution", "job", "call", "task", "value", "argument", "subvalue", sql=_X + _PATHS.format(x="x") + f"""
SELECT 'Execution' AS type, e.id FROM p_execution e WHERE e.id IN (SELECT execution_id FROM p_job) AND e.id IN {_EXECS} UNION ALL SELECT 'Job', id FROM p_job WHERE execution_id IN {_EXECS} UNION ALL SELECT 'CallNode', call_hash FROM p_call WHERE call_hash IN (SELECT call_hash FROM x)
UNION ALL SELECT 'Task', hash FROM p_task WHERE hash IN (SELECT task_hash FROM x) UNION ALL SELECT 'Value', value_hash FROM p_value WHERE value_hash IN (SELECT value_hash FROM vals)""")
def filter_executions(p: Provenance) -> DataFrame:
    return _two(LineageQuery(p).filter_execution_ids(_execs(p)).all())


@query("job", "call", "value", sql=" UNION ALL ".join(f"SELECT '{k}' AS status, j.id FROM {_FULL} WHERE {t}" for k, t in _TERMS.items()))
def filter_job_status(p: Provenance) -> DataFrame:
    return graph.union([LineageQuery(p).filter_job_statuses([k]).all().select(F.lit(k).alias("status"), "id") for k in _TERMS])


@query("job", "call", "value", "execution", sql=f"SELECT e.id, j.start_time AS time FROM p_execution e JOIN ({_FULL}) ON e.job_id = j.id WHERE ({_TERMS['DONE']}) OR ({_TERMS['CACHED']}) OR ({_TERMS['FAILED']})")
def filter_execution_status(p: Provenance) -> DataFrame:
    return LineageQuery(p).filter_execution_statuses(["DONE", "FAILED"]).all().select("id", "time")


_NAMED = "(SELECT hash FROM p_task WHERE (namespace = 'model.fit' AND name = 'align') OR name = 'pack')"


@query("job", "task", sql=f"SELECT 'Job' AS type, id FROM p_job WHERE task_hash IN {_NAMED} UNION ALL SELECT 'Task', hash FROM {_NAMED}")
def filter_task_names(p: Provenance) -> DataFrame:
    return _two(LineageQuery(p).filter_task_names(["model.fit.align", "pack"]).all())


@query("job", "task", sql=f"WITH h AS (SELECT entity_id FROM purge_log WHERE entity_type = 'Task') SELECT 'Job' AS type, id FROM p_job WHERE task_hash IN (FROM h) UNION ALL SELECT 'Task', hash FROM p_task WHERE hash IN (FROM h)")
def filter_task_hashes(p: Provenance) -> DataFrame:
    return _two(LineageQuery(p).filter_task_hashes(_purged(p, "Task")).all())


_HELD = "(SELECT parent_value_hash FROM p_subvalue WHERE value_hash IN {v})"


@query("job", "call", "argument", "subvalue", sql=f"SELECT DISTINCT j.id FROM p_job j JOIN p_argument a ON a.call_hash = j.call_hash WHERE a.value_hash IN {_PART} OR a.value_hash IN {_HELD.format(v=_PART)}")
def filter_arguments(p: Provenance) -> DataFrame:
    return LineageQuery(p).filter_arguments(p.subvalue.select("value_hash")).all().select("id")


@query("job", "call", "subvalue", sql=f"SELECT DISTINCT j.id FROM p_job j JOIN p_call c ON c.call_hash = j.call_hash WHERE c.value_hash IN {_PART} OR c.value_hash IN {_HELD.format(v=_PART)}")
def filter_results(p: Provenance) -> DataFrame:
    return LineageQuery(p).filter_results(p.subvalue.select("value_hash")).all().select("id")


@query("value", sql="SELECT value_hash AS id FROM p_value WHERE type IN ('lane.Sample', 'builtins.int')")
def filter_value_types(p: Provenance) -> DataFrame:
    return LineageQuery(p).filter_value_types(["lane.Sample", "builtins.int"]).all().select("id")


@query("value", "file", sql="SELECT value_hash AS id FROM p_file WHERE path LIKE 'store/a%.csv' OR path LIKE 'store/b0%'")
def file_glob(p: Provenance) -> DataFrame:
    return LineageQuery(p).filter_file_paths(["store/a*.csv", "store/b0*"]).all().select("id")


_TAGGED = "(SELECT a.entity_id FROM p_tag a JOIN p_tag b ON a.entity_id = b.entity_id WHERE a.is_current AND b.is_current AND a.key = 'script' AND a.value = 'run.py' AND b.key = 'batch')"


@query("execution", "tag", sql=f"SELECT id FROM p_execution WHERE id IN {_TAGGED}")
def tag_filter_and(p: Provenance) -> DataFrame:
    return LineageQuery(p).filter_tags([("script", "run.py"), ("batch", ANY)]).all().select("id")


@query("execution", "job", "call", "task", "value", "argument", "subvalue", "tag", sql=f"WITH x AS (SELECT DISTINCT call_hash, task_hash, id FROM p_job WHERE execution_id IN {_TAGGED})" + _PATHS.format(x="x") + f"""
SELECT type, count(*) AS n FROM (SELECT 'Execution' AS type FROM p_execution WHERE id IN {_TAGGED} UNION ALL SELECT 'Job' FROM p_job WHERE execution_id IN {_TAGGED} UNION ALL SELECT 'CallNode' FROM p_call WHERE call_hash IN (SELECT call_hash FROM x)
UNION ALL SELECT 'Task' FROM p_task WHERE hash IN (SELECT task_hash FROM x) UNION ALL SELECT 'Value' FROM p_value WHERE value_hash IN (SELECT value_hash FROM vals)) t GROUP BY type""")
def execution_tag_counts(p: Provenance) -> DataFrame:
    return LineageQuery(p).filter_execution_tags([("script", "run.py"), ("batch", ANY)]).count()


@query("execution", "job", sql="""
SELECT type, id FROM (SELECT 0 AS r, 'Execution' AS type, e.id, j.start_time AS t FROM p_execution e LEFT JOIN p_job j ON j.id = e.job_id UNION ALL SELECT 1, 'Job', id, start_time FROM p_job) x
ORDER BY r, t DESC NULLS LAST, id LIMIT 50 OFFSET 400""".strip())
def page_union(p: Provenance) -> DataFrame:
    return LineageQuery(p).filter_types(["Execution", "Job"]).order_by("time").page(8, 50)


@query("job", sql="SELECT 'Job' AS type, id FROM p_job WHERE cached ORDER BY start_time DESC NULLS LAST, id LIMIT 20")
def limit_after_filter(p: Provenance) -> DataFrame:
    return LineageQuery(p).filter_job_statuses(["CACHED"]).order_by("time").limit(20)


@query("execution", "job", "call", "task", "value", sql="SELECT 'Execution' AS type, count(*) AS n FROM p_execution UNION ALL SELECT 'Job', count(*) FROM p_job UNION ALL SELECT 'CallNode', count(*) FROM p_call UNION ALL SELECT 'Task', count(*) FROM p_task UNION ALL SELECT 'Value', count(*) FROM p_value")
def counts_per_type(p: Provenance) -> DataFrame:
    return LineageQuery(p).count()


@query("job", sql="SELECT id AS id, 'Job' AS type FROM p_job WHERE false")
def empty_query(p: Provenance) -> DataFrame:
    return LineageQuery(p).filter_types(["Job"]).empty().select("id", "type")


@query("job", "task", "call", "value", sql=f"SELECT 'Job' AS type, j.id FROM {_FULL} WHERE j.task_hash IN (SELECT hash FROM p_task WHERE name = 'pack') AND (({_TERMS['DONE']}) OR ({_TERMS['FAILED']}))")
def parsed_query(p: Provenance) -> DataFrame:
    return parse(p, ["--job", "--task-name", "pack", "--job-status", "DONE", "--job-status", "FAILED"]).select("type", "id")


# --- joins


@query("job", "call", "argument", "subvalue", sql="""
WITH used AS (SELECT c.value_hash, j.execution_id FROM p_call c JOIN p_job j ON j.call_hash = c.call_hash UNION SELECT a.value_hash, j.execution_id FROM p_argument a JOIN p_job j ON j.call_hash = a.call_hash),
al AS (SELECT * FROM used UNION SELECT s.value_hash, u.execution_id FROM p_subvalue s JOIN used u ON u.value_hash = s.parent_value_hash) SELECT execution_id, count(*) AS n_values FROM al WHERE value_hash IS NOT NULL GROUP BY execution_id""".strip())
def execution_value_paths(p: Provenance) -> DataFrame:
    from tributary.plans.lineage import value_jobs

    return value_jobs(p, p.job).where("value_hash is not null").groupBy("execution_id").agg(F.count(F.lit(1)).alias("n_values"))


@query("job", "call", "file", "subvalue", sql="""
SELECT DISTINCT f.path, j.id AS job_id FROM p_file f LEFT JOIN p_subvalue s ON s.value_hash = f.value_hash JOIN p_call c ON c.value_hash = f.value_hash OR c.value_hash = s.parent_value_hash JOIN p_job j ON j.call_hash = c.call_hash""".strip())
def file_producers(p: Provenance) -> DataFrame:
    """A join on either of two keys, as the union of two plain joins."""
    held = p.file.select("path", "value_hash").unionByName(p.file.join(p.subvalue, "value_hash").select("path", F.col("parent_value_hash").alias("value_hash")))
    calls = held.join(p.call.select("value_hash", "call_hash"), "value_hash")
    return calls.join(p.job.select("call_hash", F.col("id").alias("job_id")), "call_hash").select("path", "job_id").distinct()


@query("argument", "call", sql="SELECT a.arg_hash, c.task_name FROM p_argument a LEFT JOIN p_call c ON c.call_hash = a.result_call_hash")
def argument_results(p: Provenance) -> DataFrame:
    return p.argument.select("arg_hash", F.col("result_call_hash").alias("call_hash")).join(p.call.select("call_hash", "task_name"), "call_hash", "left").select("arg_hash", "task_name")


@query("job", sql="SELECT p.id AS parent_id, c.id AS child_id FROM p_job p JOIN p_job c ON c.parent_id = p.id")
def child_jobs(p: Provenance) -> DataFrame:
    return p.job.select(F.col("id").alias("parent_id")).join(p.job.select("parent_id", F.col("id").alias("child_id")), "parent_id")


@query("call_edge", "call", sql="SELECT e.parent_id, e.call_order, c.task_name FROM p_call_edge e JOIN p_call c ON c.call_hash = e.child_id")
def call_children(p: Provenance) -> DataFrame:
    return p.call_edge.join(p.call.select(F.col("call_hash").alias("child_id"), "task_name"), "child_id").select("parent_id", "call_order", "task_name")


@query("job", "execution", sql="SELECT j.id FROM p_job j LEFT JOIN p_execution e ON e.id = j.execution_id WHERE e.id IS NULL")
def orphan_jobs(p: Provenance) -> DataFrame:
    return p.job.join(p.execution.select(F.col("id").alias("execution_id")), "execution_id", "left_anti").select("id")


@query("task", "job", sql="SELECT hash FROM p_task WHERE hash NOT IN (SELECT task_hash FROM p_job WHERE task_hash IS NOT NULL)")
def unused_tasks(p: Provenance) -> DataFrame:
    return p.task.join(p.job.select(F.col("task_hash").alias("hash")), "hash", "left_anti").select("hash")


@query("file", "value", sql="SELECT path FROM p_file WHERE value_hash IN (SELECT value_hash FROM p_value WHERE format = 'pickle')")
def files_of_format(p: Provenance) -> DataFrame:
    return p.file.join(p.value.where("format = 'pickle'").select("value_hash"), "value_hash", "left_semi").select("path")


@query("call", "job", sql="SELECT count(*) FILTER (WHERE v IN (SELECT task_hash FROM p_job)) AS n_both, count(*) FILTER (WHERE v NOT IN (SELECT task_hash FROM p_job WHERE task_hash IS NOT NULL)) AS n_calls_only FROM (SELECT DISTINCT task_hash AS v FROM p_call WHERE task_hash IS NOT NULL) t")
def task_sets(p: Provenance) -> DataFrame:
    """Set intersection and difference."""
    a, b = p.call.where("task_hash is not null").select("task_hash").distinct(), p.job.where("task_hash is not null").select("task_hash")
    tagged = a.intersect(b).select(F.lit(1).alias("both")).unionByName(a.join(b, "task_hash", "left_anti").select(F.lit(0).alias("both")))
    return tagged.agg(F.count_if(F.col("both") == 1).alias("n_both"), F.count_if(F.col("both") == 0).alias("n_calls_only"))


# --- aggregates


@query("task", sql="SELECT namespace, name, count(hash) AS n_versions FROM p_task WHERE name LIKE '%a%' GROUP BY namespace, name")
def task_versions(p: Provenance) -> DataFrame:
    return p.task.where("name like '%a%'").groupBy("namespace", "name").agg(F.count("hash").alias("n_versions")).orderBy("namespace", "name")


@query("task", "job", sql="SELECT t.hash, count(j.id) AS n_jobs, max(j.start_time) AS latest FROM p_task t JOIN p_job j ON j.task_hash = t.hash GROUP BY t.hash")
def task_jobs(p: Provenance) -> DataFrame:
    per = p.job.groupBy(F.col("task_hash").alias("hash")).agg(F.count("id").alias("n_jobs"), F.max("start_time").alias("latest"))
    return p.task.select("hash").join(per, "hash").orderBy(F.desc("latest"))


@query("task", "job", "execution", sql="SELECT t.namespace, count(e.id) AS n_executions, max(j.start_time) AS latest FROM p_execution e JOIN p_job j ON j.id = e.job_id JOIN p_task t ON t.hash = j.task_hash GROUP BY t.namespace")
def namespace_executions(p: Provenance, sort: str = "latest") -> DataFrame:
    root = p.execution.select(F.col("job_id").alias("id")).join(p.job.select("id", "task_hash", "start_time"), "id")
    x = root.join(p.task.select(F.col("hash").alias("task_hash"), "namespace"), "task_hash")
    out = x.groupBy("namespace").agg(F.count("id").alias("n_executions"), F.max("start_time").alias("latest"))
    return out.orderBy("namespace" if sort == "namespace" else F.desc(sort))


@query("tag", sql="SELECT entity_type, key, value, count(*) AS n FROM p_tag WHERE is_current AND key <> '' GROUP BY ALL")
def tag_counts_kv(p: Provenance) -> DataFrame:
    return p.tag.where("is_current and key <> ''").groupBy("entity_type", "key", "value").agg(F.count(F.lit(1)).alias("n"))


@query("tag", sql="SELECT key, entity_type, count(*) AS n FROM p_tag WHERE is_current AND key <> '' GROUP BY ALL")
def tag_counts_key(p: Provenance) -> DataFrame:
    return p.tag.where("is_current and key <> ''").groupBy("key", "entity_type").agg(F.count(F.lit(1)).alias("n"))


_MATRIX = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ("RUNNING", "CACHED", "DONE", "FAILED"))


@query("job", "call", "value", "task", sql=f"""
WITH s AS (SELECT CASE WHEN t.namespace <> '' THEN t.namespace || '.' || t.name ELSE t.name END AS task, {_STATUS} AS status FROM {_FULL} JOIN p_task t ON t.hash = j.task_hash)
SELECT CASE WHEN grouping(task) = 1 THEN 'ALL' ELSE task END AS task, {_MATRIX}, count(*) AS total FROM s GROUP BY ROLLUP (task)""".strip())
def status_matrix(p: Provenance) -> DataFrame:
    full = F.when(F.col("namespace") != "", F.concat("namespace", F.lit("."), "name")).otherwise(F.col("name"))
    s = with_results(p, p.job).join(p.task.select(F.col("hash").alias("task_hash"), full.alias("task")), "task_hash").select("task", job_status().alias("status"))
    return s.rollup("task").agg(F.grouping("task").alias("g"), *[F.count_if(F.col("status") == x).alias(x.lower()) for x in ("RUNNING", "CACHED", "DONE", "FAILED")], F.count(F.lit(1)).alias("total")).select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.col("task")).alias("task"), "running", "cached", "done", "failed", "total")


@query("job", "call", "value", sql=f"SELECT j.execution_id, {_STATUS} AS status, count(*) AS n FROM {_FULL} GROUP BY ALL")
def execution_status_counts(p: Provenance) -> DataFrame:
    return with_results(p, p.job).groupBy("execution_id", job_status().alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("job", "execution", sql="""
WITH a AS (SELECT execution_id, min(start_time) s, max(end_time) e FROM p_job GROUP BY execution_id)
SELECT x.id, coalesce(epoch_us(r.end_time) - epoch_us(r.start_time), epoch_us(a.e) - epoch_us(a.s)) AS duration_us FROM p_execution x LEFT JOIN p_job r ON r.id = x.job_id LEFT JOIN a ON a.execution_id = x.id""".strip())
def execution_duration(p: Provenance) -> DataFrame:
    """The root job's, else from the first start to the last end of all jobs."""
    own = p.job.select(F.col("id").alias("job_id"), F.expr("timestampdiff(MICROSECOND, start_time, end_time)").alias("own"))
    of_all = p.job.groupBy("execution_id").agg(F.min("start_time").alias("s"), F.max("end_time").alias("e")).select(F.col("execution_id").alias("id"), F.expr("timestampdiff(MICROSECOND, s, e)").alias("whole"))
    return p.execution.join(own, "job_id", "left").join(of_all, "id", "left").select("id", F.coalesce("own", "whole").alias("duration_us"))


@query("job", sql="SELECT task_hash, arg_min(id, (end_time, id)) AS first_ended, arg_max(id, (start_time, id)) AS last_started FROM p_job WHERE end_time IS NOT NULL AND start_time IS NOT NULL GROUP BY task_hash")
def first_last_job(p: Provenance) -> DataFrame:
    return p.job.where("end_time is not null and start_time is not null").groupBy("task_hash").agg(
        F.min_by("id", F.struct("end_time", "id")).alias("first_ended"), F.max_by("id", F.struct("start_time", "id")).alias("last_started"))


@query("job", sql="SELECT execution_id, id FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY start_time DESC NULLS LAST, id) AS rn FROM p_job) t WHERE rn <= 2")
def latest_per_group(p: Provenance) -> DataFrame:
    w = Window.partitionBy("execution_id").orderBy(F.desc_nulls_last("start_time"), "id")
    return p.job.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("execution_id", "id")


@query("job", "execution", sql="SELECT 'Execution' AS type, e.id FROM p_execution e LEFT JOIN p_job j ON j.id = e.job_id ORDER BY j.start_time DESC NULLS LAST, e.id LIMIT 1 OFFSET 2")
def nth_recent(p: Provenance) -> DataFrame:
    return graph.infer_id(p, "~3")


@query("file", sql="SELECT path, min(value_hash) AS value_hash FROM p_file GROUP BY path")
def first_per_path(p: Provenance) -> DataFrame:
    return p.file.groupBy("path").agg(F.min("value_hash").alias("value_hash"))


@query("file", sql="SELECT path FROM p_file WHERE path LIKE 'store/c%' ORDER BY path LIMIT 25 OFFSET 25")
def file_page(p: Provenance) -> DataFrame:
    return p.file.where(F.col("path").startswith("store/c")).select("path").orderBy("path").offset(25).limit(25)


@query("execution", "job", "task", sql="SELECT e.id, t.name FROM p_execution e JOIN p_job j ON j.id = e.job_id JOIN p_task t ON t.hash = j.task_hash WHERE e.args LIKE '%nightly%' ORDER BY j.start_time DESC, e.id LIMIT 30 OFFSET 30")
def execution_page(p: Provenance) -> DataFrame:
    x = p.execution.where("args like '%nightly%'").select("id", F.col("job_id")).join(p.job.select(F.col("id").alias("job_id"), "task_hash", "start_time"), "job_id")
    return x.join(p.task.select(F.col("hash").alias("task_hash"), "name"), "task_hash").orderBy(F.desc("start_time"), "id").offset(30).limit(30).select("id", "name")


Q["latest_version"] = lambda spark, d: table(spark, d, "db_version").agg(F.max_by("id", F.struct("version", "timestamp")).alias("id"), F.max("version").alias("version"))
SQL["latest_version"] = 'SELECT arg_max(id, (version, "timestamp")) AS id, max(version) AS version FROM db_version WHERE version IS NOT NULL'


# --- walks


@query("job", sql="""
WITH RECURSIVE cyc(s, v) AS (SELECT id, parent_id FROM p_job WHERE parent_id IS NOT NULL UNION SELECT cyc.s, p.parent_id FROM cyc JOIN p_job p ON p.id = cyc.v WHERE p.parent_id IS NOT NULL),
loops AS (SELECT DISTINCT s FROM cyc WHERE s = v),
top AS (SELECT j.id, j.parent_id FROM p_job j LEFT JOIN p_job p ON p.id = j.parent_id WHERE p.id IS NULL OR j.id IN (FROM loops) OR j.parent_id IN (FROM loops)),
t(id, depth) AS (SELECT id, 0 FROM top UNION ALL SELECT j.id, depth + 1 FROM t JOIN p_job j ON j.parent_id = t.id WHERE j.id NOT IN (SELECT id FROM top))
SELECT p_job.execution_id, t.id, t.depth FROM t JOIN p_job ON p_job.id = t.id""".strip())
def job_tree(p: Provenance) -> DataFrame:
    return graph.job_tree(p).select("execution_id", "id", "depth")


@query("job", sql="""
WITH RECURSIVE cyc(s, v) AS (SELECT id, parent_id FROM p_job WHERE parent_id IS NOT NULL UNION SELECT cyc.s, p.parent_id FROM cyc JOIN p_job p ON p.id = cyc.v WHERE p.parent_id IS NOT NULL),
loops AS (SELECT DISTINCT s FROM cyc WHERE s = v),
live AS (SELECT id, parent_id FROM p_job WHERE parent_id IS NOT NULL AND id NOT IN (FROM loops) AND parent_id NOT IN (FROM loops)),
n AS (SELECT id FROM p_job UNION SELECT parent_id FROM p_job WHERE parent_id IS NOT NULL),
t(id, root) AS (SELECT id, id FROM n WHERE id NOT IN (SELECT id FROM live) UNION ALL SELECT l.id, t.root FROM t JOIN live l ON l.parent_id = t.id)
SELECT j.id, t.root AS root_id, r.execution_id FROM p_job j JOIN t ON t.id = j.id LEFT JOIN p_job r ON r.id = t.root""".strip())
def inherited_execution(p: Provenance) -> DataFrame:
    return graph.inherited_execution(p)


@query("job", "call", "value", "task", sql=f"""
WITH RECURSIVE cyc(s, v) AS (SELECT id, parent_id FROM p_job WHERE parent_id IS NOT NULL UNION SELECT cyc.s, p.parent_id FROM cyc JOIN p_job p ON p.id = cyc.v WHERE p.parent_id IS NOT NULL),
loops AS (SELECT DISTINCT s FROM cyc WHERE s = v),
keyed AS (SELECT *, coalesce(strftime(start_time, '%Y%m%d%H%M%S%f'), '99999999999999999999') || '-' || id AS key FROM p_job),
top AS (SELECT j.id FROM p_job j LEFT JOIN p_job p ON p.id = j.parent_id WHERE p.id IS NULL OR j.id IN (FROM loops) OR j.parent_id IN (FROM loops)),
t(id, depth, path) AS (SELECT id, 0, key FROM keyed WHERE id IN (FROM top) UNION ALL SELECT j.id, depth + 1, path || '/' || key FROM t JOIN keyed j ON j.parent_id = t.id WHERE j.id NOT IN (FROM top)),
f AS (SELECT j.id FROM {_FULL} WHERE (({_TERMS['DONE']}) OR ({_TERMS['FAILED']})) AND j.task_hash IN (SELECT hash FROM p_task WHERE name < 'm')),
r AS (SELECT p_job.execution_id, row_number() OVER (PARTITION BY p_job.execution_id ORDER BY path) - 1 AS position, t.id, t.depth FROM t JOIN p_job ON p_job.id = t.id WHERE t.id IN (SELECT id FROM f))
SELECT * FROM r WHERE position BETWEEN 5 AND 9""".strip())
def job_pages(p: Provenance) -> DataFrame:
    """Of each execution the second page of five of its done and failed jobs of some tasks, in tree order."""
    p.cut("job")
    some = p.task.where("name < 'm'").select(F.col("hash").alias("task_hash"))
    jobs = with_results(p, p.job).where(status_term("DONE") | status_term("FAILED")).join(some, "task_hash", "left_semi")
    return graph.job_list(p, jobs, 1, 5)


_EDGES = """e AS (SELECT 'Execution' st, id s, 'Job' dt, job_id d FROM p_execution WHERE job_id IS NOT NULL UNION SELECT 'Job', id, 'Task', task_hash FROM p_job WHERE task_hash IS NOT NULL
UNION SELECT 'Job', id, 'CallNode', call_hash FROM p_job WHERE call_hash IS NOT NULL UNION SELECT 'Job', parent_id, 'Job', id FROM p_job WHERE parent_id IS NOT NULL
UNION SELECT 'CallNode', call_hash, 'Task', task_hash FROM p_call WHERE task_hash IS NOT NULL UNION SELECT 'CallNode', call_hash, 'Value', value_hash FROM p_call WHERE value_hash IS NOT NULL
UNION SELECT 'CallNode', call_hash, 'Value', value_hash FROM p_argument WHERE value_hash IS NOT NULL UNION SELECT 'CallNode', call_hash, 'CallNode', result_call_hash FROM p_argument
UNION SELECT 'CallNode', parent_id, 'CallNode', child_id FROM p_call_edge UNION SELECT 'Value', parent_value_hash, 'Value', value_hash FROM p_subvalue
UNION SELECT entity_type, entity_id, 'Tag', tag_hash FROM p_tag WHERE is_current UNION SELECT 'Tag', tag_hash, 'Tag', next_hash FROM p_tag WHERE next_hash IS NOT NULL)"""


@query("execution", "job", "call", "argument", "call_edge", "subvalue", "tag", sql=f"WITH RECURSIVE {_EDGES}, r(type, id) AS (SELECT 'Execution', id FROM p_execution UNION SELECT e.dt, e.d FROM r JOIN e ON e.st = r.type AND e.s = r.id) SELECT type, id FROM r")
def reachable_records(p: Provenance) -> DataFrame:
    """What all executions reach."""
    p.cut("job", "call", "call_edge", "argument")
    return graph.reachable(graph.edges(p), p.execution.select(F.lit("Execution").alias("type"), "id"))


@query("execution", "job", "call", "argument", "call_edge", "subvalue", "tag", sql=f"WITH {_EDGES} SELECT st AS src_type, dt AS dst_type, count(*) AS n FROM e WHERE NOT (st = 'Job' AND dt = 'Job' AND s = d) GROUP BY ALL")
def record_edges(p: Provenance) -> DataFrame:
    return graph.edges(p).select("src_type", "src", "dst_type", "dst").distinct().groupBy("src_type", "dst_type").agg(F.count(F.lit(1)).alias("n"))


_ROOTS = "(SELECT job_id FROM p_execution WHERE job_id IS NOT NULL)"


@query("execution", "job", sql=f"WITH RECURSIVE r(id) AS (SELECT j.id FROM p_job j WHERE j.parent_id IN {_ROOTS} UNION SELECT j.id FROM r JOIN p_job j ON j.parent_id = r.id) SELECT id FROM r WHERE id NOT IN {_ROOTS}")
def rollback_descendants(p: Provenance) -> DataFrame:
    """The descendants of every execution's root job."""
    links = p.job.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    return graph.rollback(links, p.execution.where("job_id is not null").select(F.col("job_id").alias("id")).distinct())


@query("job", sql="SELECT id AS src, NULL AS dst FROM p_job UNION SELECT parent_id, id FROM p_job WHERE parent_id IS NOT NULL")
def advance_states(p: Provenance) -> DataFrame:
    """The jobs that ended in an hour's first half and their links are known; all jobs and links are then added."""
    ids, link = lambda df: df.select("id"), lambda df: df.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    known = p.job.where("minute(end_time) < 30")
    nodes, edges = graph.advance(ids(known), link(known), ids(p.job), link(p.job))
    return nodes.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges)


#: Full names of tasks that the dataflow passes over.
_INTERNAL = ["model.fit.align", "ingest.clean.pack"]
_OUTER = "SELECT * FROM p_call WHERE task_hash IS NULL OR task_hash NOT IN (SELECT hash FROM p_task WHERE CASE WHEN namespace <> '' THEN namespace || '.' || name ELSE name END IN ('model.fit.align', 'ingest.clean.pack'))"
#: The origin of each value: candidates, ancestors of those of values with several, and those that aren't an ancestor of another but on a cycle with it.
_ORIGIN = f"""outer_call AS ({_OUTER}),
cand AS (SELECT value_hash AS v, call_hash AS c FROM outer_call WHERE value_hash IS NOT NULL UNION SELECT s.value_hash, o.call_hash FROM p_subvalue s JOIN outer_call o ON o.value_hash = s.parent_value_hash),
many AS (SELECT DISTINCT c FROM cand WHERE v IN (SELECT v FROM cand GROUP BY v HAVING count(*) > 1)),
anc(c, a) AS (SELECT m.c, e.parent_id FROM many m JOIN p_call_edge e ON e.child_id = m.c UNION SELECT anc.c, e.parent_id FROM anc JOIN p_call_edge e ON e.child_id = anc.a),
near AS (SELECT c, a FROM anc WHERE a IN (FROM many)),
passed AS (SELECT DISTINCT x.v, x.c FROM cand x JOIN cand y ON x.v = y.v AND x.c <> y.c JOIN near ON near.c = y.c AND near.a = x.c ANTI JOIN near back ON back.c = x.c AND back.a = y.c),
started AS (SELECT call_hash, max(start_time) AS began FROM p_job WHERE call_hash IS NOT NULL GROUP BY call_hash),
origin AS (SELECT p_value.value_hash, o.call_hash FROM p_value LEFT JOIN (SELECT v, c AS call_hash FROM (SELECT cand.v, cand.c, row_number() OVER (PARTITION BY cand.v ORDER BY began DESC NULLS LAST, cand.c DESC) AS rn
  FROM cand ANTI JOIN passed ON passed.v = cand.v AND passed.c = cand.c JOIN started ON started.call_hash = cand.c) WHERE rn = 1) o ON o.v = p_value.value_hash)"""
_PRODUCER = """res AS (SELECT call_hash, value_hash AS v FROM p_call WHERE value_hash IS NOT NULL UNION SELECT c.call_hash, s.value_hash FROM p_call c JOIN p_subvalue s ON s.parent_value_hash = c.value_hash),
producer AS (SELECT e.parent_id AS call_hash, a.v AS value, min(e.child_id) AS child_hash FROM p_call_edge e JOIN res a ON a.call_hash = e.parent_id JOIN res b ON b.call_hash = e.child_id AND b.v = a.v
  WHERE e.child_id IN (SELECT call_hash FROM outer_call) GROUP BY ALL HAVING count(*) = 1)"""
_AORIGIN = """av AS (SELECT arg_hash, call_hash, result_call_hash, value_hash AS v FROM p_argument UNION SELECT a.arg_hash, a.call_hash, a.result_call_hash, s.value_hash FROM p_argument a JOIN p_subvalue s ON s.parent_value_hash = a.value_hash),
re AS (SELECT call_hash, value_hash AS v FROM p_call WHERE value_hash IS NOT NULL UNION SELECT c.call_hash, s.value_hash FROM p_call c JOIN p_subvalue s ON s.parent_value_hash = c.value_hash),
ends AS (SELECT arg_hash, call_hash AS child_id FROM p_argument UNION SELECT arg_hash, result_call_hash FROM p_argument),
shared AS (SELECT x.arg_hash, e.parent_id FROM ends x JOIN p_call_edge e ON e.child_id = x.child_id JOIN (SELECT arg_hash, count(*) AS need FROM ends GROUP BY arg_hash) y ON y.arg_hash = x.arg_hash GROUP BY x.arg_hash, e.parent_id, need HAVING count(DISTINCT x.child_id) = need),
ctx AS (SELECT s.arg_hash, s.parent_id FROM shared s JOIN p_call c ON c.call_hash = s.parent_id QUALIFY row_number() OVER (PARTITION BY s.arg_hash ORDER BY c.called_at DESC NULLS LAST, s.parent_id DESC) = 1),
par AS (SELECT e.child_id, e.parent_id FROM p_call_edge e JOIN p_call c ON c.call_hash = e.parent_id QUALIFY row_number() OVER (PARTITION BY e.child_id ORDER BY c.called_at DESC NULLS LAST, e.parent_id DESC) = 1),
known AS (SELECT DISTINCT a.arg_hash, a.v AS value, 'result' AS edge_kind, a.result_call_hash AS "to", CASE WHEN re.v IS NOT NULL THEN a.v ELSE c.value_hash END AS to_value, e.call_order
  FROM av a JOIN p_call c ON c.call_hash = a.result_call_hash LEFT JOIN re ON re.call_hash = a.result_call_hash AND re.v = a.v LEFT JOIN ctx ON ctx.arg_hash = a.arg_hash
  LEFT JOIN p_call_edge e ON e.parent_id = ctx.parent_id AND e.child_id = a.result_call_hash WHERE c.value_hash IS NOT NULL
UNION SELECT a.arg_hash, a.v, 'routed', b.arg_hash, a.v, NULL FROM av a JOIN par ON par.child_id = a.call_hash JOIN av b ON b.call_hash = par.parent_id AND b.v = a.v),
aorigin AS (SELECT * FROM known UNION SELECT arg_hash, v, 'origin', NULL, NULL, NULL FROM av WHERE (arg_hash, v) NOT IN (SELECT arg_hash, value FROM known) AND v IS NOT NULL UNION SELECT arg_hash, v, 'origin', NULL, NULL, NULL FROM av WHERE v IS NULL)"""
_FLOW = ("job", "call", "call_edge", "argument", "subvalue", "value", "task")
_FLOW_SQL = f"""WITH RECURSIVE {_ORIGIN}, {_PRODUCER}, {_AORIGIN}, flow AS (
SELECT 'Value' AS src_type, value_hash AS src, CAST(NULL AS VARCHAR) AS src_value, CASE WHEN call_hash IS NULL THEN 'call_value_origin' ELSE 'call_result' END AS edge_kind, CASE WHEN call_hash IS NOT NULL THEN 'CallNode' END AS dst_type, call_hash AS dst, CAST(NULL AS VARCHAR) AS dst_value FROM origin
UNION ALL SELECT 'CallNodeValue', call_hash, value, 'call_result_routing', 'CallNodeValue', child_hash, value FROM producer
UNION ALL SELECT 'CallNodeValue', call_hash, v, 'call_result', 'CallNode', call_hash, NULL FROM res WHERE (call_hash, v) NOT IN (SELECT call_hash, value FROM producer)
UNION ALL SELECT DISTINCT 'CallNode', call_hash, NULL, 'call_arg', 'ArgumentValue', arg_hash, value_hash FROM p_argument
UNION ALL SELECT 'CallNode', call_hash, NULL, 'call_origin', NULL, NULL, NULL FROM p_call WHERE call_hash NOT IN (SELECT call_hash FROM p_argument)
UNION ALL SELECT 'ArgumentValue', arg_hash, value, CASE edge_kind WHEN 'origin' THEN 'call_arg_origin' WHEN 'routed' THEN 'call_arg_routing' ELSE CASE WHEN value = to_value THEN 'call_arg_result_routing' ELSE 'data' END END,
  CASE edge_kind WHEN 'result' THEN 'CallNodeValue' WHEN 'routed' THEN 'ArgumentValue' END, "to", to_value FROM aorigin)"""


@query(*_FLOW, sql=f"WITH RECURSIVE {_ORIGIN} SELECT value_hash, call_hash FROM origin")
def value_origins(p: Provenance) -> DataFrame:
    p.cut("job", "call", "call_edge")
    return graph.value_origin(p, _INTERNAL)


@query("call", "call_edge", "subvalue", "task", "job", sql=f"WITH outer_call AS ({_OUTER}), {_PRODUCER} SELECT call_hash, value, child_hash FROM producer")
def child_producers(p: Provenance) -> DataFrame:
    return graph.child_producer(p, _INTERNAL)


@query("call", "call_edge", "argument", "subvalue", sql=f'WITH {_AORIGIN} SELECT arg_hash, value, edge_kind, "to", to_value, call_order FROM aorigin')
def argument_origins(p: Provenance) -> DataFrame:
    p.cut("call", "call_edge", "argument")
    return graph.argument_origin(p)


@query("call", "argument", sql="""SELECT call_hash, arg_hash, row_number() OVER (PARTITION BY call_hash ORDER BY arg_position NULLS LAST, arg_key NULLS FIRST, arg_hash) - 1 AS position
FROM (SELECT DISTINCT call_hash, arg_hash, arg_position, arg_key FROM p_argument) a UNION ALL SELECT call_hash, NULL, NULL FROM p_call WHERE call_hash NOT IN (SELECT call_hash FROM p_argument)""")
def call_arguments(p: Provenance) -> DataFrame:
    """The arguments of each call in order, positional ones first; a call without any is an origin."""
    p.cut("call", "argument")
    return graph.call_arguments(p).select("call_hash", "arg_hash", "position")


@query(*_FLOW, sql=_FLOW_SQL + " SELECT src_type, edge_kind, dst_type, count(*) AS n, count(DISTINCT dst) AS n_ends FROM flow GROUP BY ALL")
def upstream_edges(p: Provenance) -> DataFrame:
    p.cut("job", "call", "call_edge", "argument")
    return graph.dataflow_edges(p, _INTERNAL).groupBy("src_type", "edge_kind", "dst_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("n_ends"))


@query(*_FLOW, sql=_FLOW_SQL + """, m AS (SELECT dst AS call_hash FROM flow WHERE src_type = 'CallNodeValue' AND dst_type = 'CallNode' GROUP BY dst HAVING count(*) > 1),
old AS (SELECT f.src, f.src_value, f.dst AS merged, c.value_hash AS whole FROM flow f JOIN m ON m.call_hash = f.dst JOIN p_call c ON c.call_hash = m.call_hash WHERE f.src_type = 'CallNodeValue' AND f.dst_type = 'CallNode' AND c.value_hash IS NOT NULL),
s AS (SELECT f.src_type, coalesce(o.merged, f.src) AS src, coalesce(o.whole, f.src_value) AS src_value, f.edge_kind, f.dst_type, f.dst, f.dst_value FROM flow f LEFT JOIN old o ON f.src_type = 'CallNodeValue' AND o.src = f.src AND o.src_value = f.src_value),
t AS (SELECT s.src_type, s.src, s.src_value, s.edge_kind, s.dst_type, coalesce(o.merged, s.dst) AS dst, coalesce(o.whole, s.dst_value) AS dst_value FROM s LEFT JOIN old o ON s.dst_type = 'CallNodeValue' AND o.src = s.dst AND o.src_value = s.dst_value),
u AS (SELECT DISTINCT src_type, src, src_value, CASE WHEN edge_kind IN ('data', 'call_arg_result_routing') THEN CASE WHEN src_value IS NOT DISTINCT FROM dst_value THEN 'call_arg_result_routing' ELSE 'data' END ELSE edge_kind END AS edge_kind, dst_type, dst, dst_value FROM t)
SELECT src_type, edge_kind, dst_type, count(*) AS n, count(DISTINCT dst) AS n_ends FROM u GROUP BY ALL""")
def merged_call_values(p: Provenance) -> DataFrame:
    """The dataflow with one call value for each call that several lead to."""
    p.cut("job", "call", "call_edge", "argument")
    out = graph.merge_call_values(graph.dataflow_edges(p, _INTERNAL), p.call.where("value_hash is not null").select("call_hash", "value_hash"))
    return out.groupBy("src_type", "edge_kind", "dst_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("n_ends"))


@query(*_FLOW, sql=_FLOW_SQL + f""", walk(t, c, v) AS (SELECT 'Value', value_hash, CAST(NULL AS VARCHAR) FROM p_value WHERE type = '{ERROR_TYPE}'
UNION SELECT f.dst_type, f.dst, f.dst_value FROM walk w JOIN flow f ON f.src_type = w.t AND f.src = w.c AND f.src_value IS NOT DISTINCT FROM w.v WHERE f.dst IS NOT NULL) SELECT t AS type, c AS id, v AS value FROM walk""")
def upstream_of_values(p: Provenance) -> DataFrame:
    p.cut("job", "call", "call_edge", "argument")
    return graph.upstream(p, p.value.where(f"type = '{ERROR_TYPE}'").select("value_hash"), _INTERNAL)


@query("file", "job", "call", "argument", "subvalue", sql="""
WITH f AS (SELECT path, value_hash, value_hash AS held FROM p_file UNION ALL SELECT f.path, f.value_hash, s.parent_value_hash FROM p_file f JOIN p_subvalue s ON s.value_hash = f.value_hash),
u AS (SELECT c.value_hash AS held, j.id AS job_id, 'result' AS kind, 1 AS r, j.end_time AS ts FROM p_call c JOIN p_job j ON j.call_hash = c.call_hash
  UNION ALL SELECT a.value_hash, j.id, 'arg', 0, j.start_time FROM p_argument a JOIN p_job j ON j.call_hash = a.call_hash)
SELECT path, value_hash, job_id, kind FROM (SELECT f.path, f.value_hash, u.job_id, u.kind, row_number() OVER (PARTITION BY f.path ORDER BY r DESC, ts DESC NULLS LAST, job_id DESC, f.value_hash DESC) AS rn FROM f JOIN u ON u.held = f.held) t WHERE rn = 1""".strip())
def find_file_latest(p: Provenance) -> DataFrame:
    return graph.find_file(p)


@query("subvalue", sql="SELECT value_hash AS src, parent_value_hash AS dst FROM p_subvalue WHERE value_hash NOT IN (SELECT parent_value_hash FROM p_subvalue)")
def leaf_parts(p: Provenance) -> DataFrame:
    return p.subvalue.join(p.subvalue.select(F.col("parent_value_hash").alias("value_hash")), "value_hash", "left_anti").select(F.col("value_hash").alias("src"), F.col("parent_value_hash").alias("dst"))


@query()
def topological_levels(p: Provenance) -> DataFrame:
    """The level of every call with a link, over all links, a cycle counting as one node."""
    p.cut("call_edge")
    return graph.levels(p.call_edge.select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst")))


# --- tags, transfer


@query("tag", sql="SELECT entity_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, key ORDER BY rec_id DESC) AS rn FROM p_tag) t WHERE rn = 1")
def current_tags(p: Provenance) -> DataFrame:
    """Tags that no later one of the same entity and key supersedes, by an anti-join with the edits."""
    w = Window.partitionBy("entity_id", "key").orderBy("rec_id")
    edits = p.tag.select(F.col("tag_hash").alias("parent_id"), F.lead("tag_hash").over(w).alias("child_id")).where("child_id is not null")
    return tags.current(p.tag, edits).select("entity_id", "key", "value")


@query("tag", sql="SELECT entity_id, key, value FROM p_tag WHERE is_current AND key <> 'batch' UNION ALL SELECT DISTINCT entity_id, 'batch', 'new' FROM p_tag WHERE is_current AND key = 'batch'")
def updated_tags(p: Provenance) -> DataFrame:
    now = p.tag.where("is_current").select("tag_hash", "entity_type", "entity_id", "key", "value")
    none = now.select(F.col("tag_hash").alias("parent_id"), F.col("tag_hash").alias("child_id")).limit(0)
    new = now.where("key = 'batch'").withColumn("value", F.lit("new"))
    return tags.current(*tags.record(now, none, new, update=True)).select("entity_id", "key", "value")


@query("tag", sql="SELECT entity_id, count(*) AS n_keys, max(CASE WHEN key = 'script' THEN value END) AS script FROM p_tag WHERE is_current AND key <> 'batch' GROUP BY entity_type, entity_id")
def deleted_tags(p: Provenance) -> DataFrame:
    now = p.tag.where("is_current").select("tag_hash", "entity_type", "entity_id", "key", "value")
    none = now.select(F.col("tag_hash").alias("parent_id"), F.col("tag_hash").alias("child_id")).limit(0)
    left = tags.multimap(*tags.delete(now, none, now.where("key = 'batch'")))
    return left.select("entity_id", F.size("tags").alias("n_keys"), F.try_element_at(F.col("tags")["script"], F.lit(1)).alias("script"))


@query("value", sql="SELECT value_hash, type FROM p_value")
def sync_new_records(p: Provenance) -> DataFrame:
    """Half of the records are there already; a transfer adds the others, a second one none."""
    p.cut("value")
    v = p.value.select("value_hash", "type", "format")
    source = sync.to_records(v, "Value")
    target = source.where("record_id < '8'")
    ids = source.select("record_type", "record_id")
    once = sync.transfer(source, target, ids)
    twice = sync.transfer(source, once, ids)
    return sync.from_records(twice, "Value", v.schema).select("value_hash", "type")


@query("job", sql="SELECT id, execution_id FROM p_job")
def exported_records(p: Provenance) -> DataFrame:
    j = p.job.select("id", "execution_id", "cached")
    path = scratch.new_path(p.spark, "export")
    sync.export_lines(sync.to_records(j, "Job"), path)
    return sync.from_records(sync.import_lines(p.spark, path), "Job", j.schema).select("id", "execution_id")


@query("call", "argument", "call_edge", sql="""
SELECT call_hash, arg_hash AS part, value_hash, arg_position AS position, arg_key, result_call_hash AS other FROM p_argument WHERE call_hash IN (SELECT call_hash FROM p_call)
UNION SELECT parent_id, 'child', NULL, call_order, NULL, child_id FROM p_call_edge WHERE parent_id IN (SELECT call_hash FROM p_call)""")
def nested_call_records(p: Provenance) -> DataFrame:
    """Calls as nested JSON records with args and children, written, read again and made flat."""
    p.cut("call", "call_edge", "argument")
    calls = sync.nested_calls(p.call.select("call_hash", "task_hash"), p.argument, p.call_edge)
    path = scratch.new_path(p.spark, "nested")
    sync.export_lines(sync.to_records(calls, "CallNode"), path)
    args, kids = sync.flat_calls(sync.from_records(sync.import_lines(p.spark, path), "CallNode", calls.schema))
    none = F.lit(None).cast("string")
    a = args.select("call_hash", F.col("arg_hash").alias("part"), "value_hash", F.col("arg_position").alias("position"), "arg_key", F.col("result_call_hash").alias("other"))
    k = kids.select(F.col("parent_id").alias("call_hash"), F.lit("child").alias("part"), none.alias("value_hash"), F.col("call_order").alias("position"), none.alias("arg_key"), F.col("child_id").alias("other"))
    return a.unionByName(k).distinct()


@query("value", "subvalue", "job", sql="""
SELECT 'Value' AS record_type, v.value_hash AS id, count(s.value_hash) AS n, min(s.value_hash) AS first FROM p_value v LEFT JOIN p_subvalue s ON s.parent_value_hash = v.value_hash GROUP BY v.value_hash
UNION ALL SELECT 'Job', j.id, count(c.id), arg_min(c.id, (coalesce(c.start_time, TIMESTAMP '9999-01-01'), c.id)) FROM p_job j LEFT JOIN p_job c ON c.parent_id = j.id AND c.id <> j.id GROUP BY j.id""")
def nested_value_and_job_records(p: Provenance) -> DataFrame:
    out = []
    for kind, df, part in (("Value", sync.nested_values(p.value, p.subvalue), "subvalues"), ("Job", sync.nested_jobs(p.job), "children")):
        back = sync.from_records(sync.to_records(df, kind), kind, df.schema)
        out.append(back.select(F.lit(kind).alias("record_type"), F.col(sync.IDS[kind]).alias("id"), F.size(part).alias("n"), F.get(part, F.lit(0)).alias("first")))
    return graph.union(out)


@query("job", "execution", sql="SELECT 'Job' AS record_type, id AS record_id, count(*) OVER () AS n_known FROM p_job WHERE id IN (SELECT job_id FROM p_execution) ORDER BY id")
def fetched_records(p: Provenance) -> DataFrame:
    """The root jobs of executions got from a store by their ids; those it lacks are left to a later transfer."""
    store = sync.to_records(p.job.select("id", "task_hash"), "Job")
    ids = p.execution.where("job_id is not null").select(F.lit("Job").alias("record_type"), F.col("job_id").alias("record_id"))
    got = sync.get(store, ids)
    n = sync.has(store, ids).agg(F.count(F.lit(1)))
    return got.select("record_type", "record_id", n.scalar().alias("n_known"))


@query("tag", "job", "value", sql="SELECT 'Job' AS type, id FROM p_job WHERE cached UNION ALL SELECT 'Value', value_hash FROM p_value WHERE format = 'pickle'")
def tag_filter_types(p: Provenance) -> DataFrame:
    """Jobs and values by tags of their own."""
    return _two(LineageQuery(p).filter_tags([("cached", "true")]).filter_types(["Job"]).all().unionByName(LineageQuery(p).filter_tags([("format", ANY)]).filter_types(["Value"]).all()))


# --- reuse


_REQ = "(SELECT DISTINCT task_hash, args_hash FROM p_call WHERE task_hash IS NOT NULL AND args_hash IS NOT NULL)"
_CUR = "(SELECT hash FROM p_task WHERE hash < 'c')"


@query("call", "call_edge", "task", sql=f"""
WITH cl AS (SELECT call_hash, task_hash FROM p_call UNION SELECT e.parent_id, c.task_hash FROM p_call_edge e JOIN p_call c ON c.call_hash = e.child_id),
stale AS (SELECT call_hash FROM cl WHERE task_hash IS NULL OR task_hash NOT IN {_CUR})
SELECT task_hash, args_hash, arg_max(call_hash, (called_at, call_hash)) AS call_hash FROM p_call WHERE task_hash IS NOT NULL AND args_hash IS NOT NULL AND called_at IS NOT NULL AND call_hash NOT IN (SELECT call_hash FROM stale) GROUP BY ALL""".strip())
def closure_subset_hit(p: Provenance) -> DataFrame:
    calls = p.call.where("called_at is not null")
    closure = calls.select("call_hash", "task_hash").unionByName(p.call_edge.join(p.call.select(F.col("call_hash").alias("child_id"), "task_hash"), "child_id").select(F.col("parent_id").alias("call_hash"), "task_hash")).distinct()
    requests = p.call.where("task_hash is not null and args_hash is not null").select("task_hash", "args_hash")
    return reuse.closure_hits(calls, closure, requests, p.task.where("hash < 'c'").select(F.col("hash").alias("task_hash")))


@query("call", sql=f"""
WITH r AS (SELECT task_hash, args_hash FROM {_REQ} UNION SELECT task_hash, 'other' FROM {_REQ} UNION SELECT 'other', args_hash FROM {_REQ})
SELECT task_hash, args_hash, CASE WHEN task_hash = 'other' THEN 'new_task' WHEN args_hash = 'other' THEN 'new_args' ELSE 'new_call' END AS reason FROM r""".strip())
def miss_reason(p: Provenance) -> DataFrame:
    r = p.call.where("task_hash is not null and args_hash is not null").select("task_hash", "args_hash").distinct()
    asked = r.unionByName(r.withColumn("args_hash", F.lit("other"))).unionByName(r.withColumn("task_hash", F.lit("other")))
    return reuse.miss_reason(p.call.where("task_hash is not null"), asked)


_LAST = "(SELECT arg_max(id, (updated_time, id)) FROM p_execution WHERE updated_time IS NOT NULL)"


@query("call", "call_edge", "task", "job", "execution", sql=f"""
WITH cl AS (SELECT call_hash, task_hash FROM p_call UNION SELECT e.parent_id, c.task_hash FROM p_call_edge e JOIN p_call c ON c.call_hash = e.child_id),
stale AS (SELECT call_hash FROM cl WHERE task_hash IS NULL OR task_hash NOT IN {_CUR}),
c AS (SELECT * FROM p_call WHERE task_hash IS NOT NULL AND args_hash IS NOT NULL AND called_at IS NOT NULL),
k AS (SELECT task_hash, args_hash, arg_max(value_hash, (called_at, call_hash)) AS value_hash FROM c WHERE call_hash IN (SELECT call_hash FROM p_job WHERE execution_id = {_LAST}) GROUP BY ALL),
u AS (SELECT task_hash, args_hash, arg_max(call_hash, (called_at, call_hash)) AS call_hash FROM c WHERE call_hash NOT IN (SELECT call_hash FROM stale) GROUP BY ALL),
s AS (SELECT task_hash, args_hash, arg_max(call_hash, (called_at, call_hash)) AS call_hash FROM c GROUP BY ALL),
r AS (SELECT DISTINCT q.task_hash, q.args_hash, k.value_hash AS kv, uc.value_hash AS uv, sc.value_hash AS sv FROM {_REQ} q LEFT JOIN k USING (task_hash, args_hash)
  LEFT JOIN u USING (task_hash, args_hash) LEFT JOIN p_call uc ON uc.call_hash = u.call_hash LEFT JOIN s USING (task_hash, args_hash) LEFT JOIN p_call sc ON sc.call_hash = s.call_hash)
SELECT task_hash, args_hash, CASE WHEN kv IS NOT NULL THEN 'cse' WHEN uv IS NOT NULL THEN 'ultimate' WHEN sv IS NOT NULL THEN 'single' ELSE 'miss' END AS hit, coalesce(kv, uv, sv) AS value_hash FROM r""".strip())
def cache_lookup(p: Provenance) -> DataFrame:
    """Requests for all recorded calls: first in the latest execution, then calls with current tasks all below, then any call."""
    p.cut("call", "call_edge")
    calls = p.call.where("task_hash is not null and args_hash is not null and called_at is not null")
    closure = calls.select("call_hash", "task_hash").unionByName(p.call_edge.join(p.call.select(F.col("call_hash").alias("child_id"), "task_hash"), "child_id").select(F.col("parent_id").alias("call_hash"), "task_hash")).distinct()
    requests = p.call.where("task_hash is not null and args_hash is not null").select("task_hash", "args_hash")
    last = p.execution.where("updated_time is not null").agg(F.max_by("id", F.struct("updated_time", "id")).alias("execution_id"))
    here = calls.join(p.job.join(F.broadcast(last), "execution_id", "left_semi").select("call_hash"), "call_hash", "left_semi")  # one execution
    full = reuse.closure_hits(calls, closure, requests, p.task.where("hash < 'c'").select(F.col("hash").alias("task_hash"))).join(calls.select("call_hash", "value_hash"), "call_hash")
    latest = F.max_by("value_hash", F.struct("called_at", "call_hash")).alias("value_hash")
    keys = ["task_hash", "args_hash"]
    return reuse.check_cache(requests, here.groupBy(*keys).agg(latest), full.select(*keys, "value_hash"), calls.groupBy(*keys).agg(latest))


Q["engine_reuse"] = lambda spark, d: _engine_reuse(spark, d)
SQL["engine_reuse"] = "SELECT * FROM (VALUES ('first', 'run', 5), ('again', 'cse', 5), ('later', 'ultimate', 5), ('other', 'run', 2)) t(step, reused, n_rows)"


def _engine_reuse(spark: SparkSession, d: str) -> DataFrame:
    @T.transform(namespace="demo", version="1")
    def regions(df: DataFrame, above: int) -> DataFrame:
        return df.where(F.col("r_regionkey") > above)
    src = Dataset(spark, f"{d}/region.parquet")
    root = scratch.new_path(spark, "engine")
    e = reuse.Engine(spark, root)
    got = [("first", e.run(regions, src, -1)), ("again", e.run(regions, src, -1)), ("later", reuse.Engine(spark, root).run(regions, src, -1)), ("other", e.run(regions, src, 2))]
    out = spark.createDataFrame([(n, r.reused or "run", r.df.count()) for n, r in got], "step string, reused string, n_rows bigint")
    e.clear()
    return out


QUERIES = Q
