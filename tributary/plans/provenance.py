"""The relational model of recorded runs: executions, jobs, calls, edges, arguments, values, files, tags.

Each table is a view over the stored rows: the latest row of each id counts, null ids are left out.  ``VIEWS`` says in SQL, for
DuckDB, what ``Provenance`` plans with DataFrames: the latest row by an aggregate, so a key with many rows is reduced before the shuffle.  Edges, arguments and files are derived from the parent links of jobs: the
result of a call is the first argument of the sibling that started next under the same parent, and the keyword argument ``before``
of the one after that.  Tags are read off the stored rows of executions, jobs, tasks, values and calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.scratch import Scratch
from tributary.sources.tables import table

ERROR_TYPE = "lane.ErrorValue"  # the type of a recorded failure in the stored rows (fixed value)


def _latest(source: str, key: str, columns: str, first: str = "") -> str:
    return (
        f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {first}rec_id DESC) AS rn FROM {{{source}}} WHERE {key} IS NOT NULL) t WHERE rn = 1"
    )


#: View name to SQL; stored tables and earlier views stand in braces.
VIEWS: dict[str, str] = {
    "p_job": _latest("job", "id", "id, start_time, end_time, task_hash, cached, call_hash, parent_id, execution_id", "(end_time IS NOT NULL) DESC, "),
    "p_execution": _latest("execution", "id", "id, args, updated_time, job_id"),
    "p_task": "SELECT hash, name, namespace, source FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY recorded_at, name, namespace) AS rn FROM {task} WHERE hash IS NOT NULL) t WHERE rn = 1",
    "p_call": _latest("call_node", "call_hash", 'call_hash, task_name, task_hash, args_hash, value_hash, "timestamp" AS called_at'),
    "p_value": _latest("value_record", "value_hash", "value_hash, type, format"),
    "p_subvalue": "SELECT DISTINCT value_hash, parent_value_hash FROM {subvalue} WHERE value_hash IS NOT NULL AND parent_value_hash IS NOT NULL",
    "p_call_edge": """
SELECT parent_id, child_id, row_number() OVER (PARTITION BY parent_id ORDER BY started, child_id) - 1 AS call_order FROM (
  SELECT p.call_hash AS parent_id, c.call_hash AS child_id, min(c.start_time) AS started FROM {p_job} c JOIN {p_job} p ON p.id = c.parent_id
  WHERE c.call_hash IS NOT NULL AND p.call_hash IS NOT NULL AND c.call_hash <> p.call_hash GROUP BY p.call_hash, c.call_hash) e""",
    "p_argument": """
SELECT md5(e.child_id || '/' || s.child_id) AS arg_hash, e.child_id AS call_hash, c.value_hash AS value_hash, CASE WHEN s.call_order = e.call_order - 1 THEN 0 END AS arg_position,
  CASE WHEN s.call_order = e.call_order - 2 THEN 'before' END AS arg_key, s.child_id AS result_call_hash
FROM {p_call_edge} e JOIN {p_call_edge} s ON s.parent_id = e.parent_id AND s.call_order BETWEEN e.call_order - 2 AND e.call_order - 1 JOIN {p_call} c ON c.call_hash = s.child_id""",
    "p_tag": """
SELECT md5(entity_id || key || value || CAST(rec_id AS VARCHAR(20))) AS tag_hash, entity_type, entity_id, key, value, rec_id,
  row_number() OVER (PARTITION BY entity_type, entity_id, key ORDER BY rec_id DESC) = 1 AS is_current,
  lead(md5(entity_id || key || value || CAST(rec_id AS VARCHAR(20)))) OVER (PARTITION BY entity_type, entity_id, key ORDER BY rec_id) AS next_hash
FROM (SELECT 'Execution' AS entity_type, id AS entity_id, 'script' AS key, split_part(args, '"', 6) AS value, rec_id FROM {execution} WHERE args IS NOT NULL AND id IS NOT NULL
  UNION ALL SELECT 'Execution', id, 'batch', substr(split_part(args, '"', 12), 1, 2), rec_id FROM {execution} WHERE args IS NOT NULL AND id IS NOT NULL
  UNION ALL SELECT 'Job', id, 'cached', 'true', 0 FROM {p_job} WHERE cached UNION ALL SELECT 'Task', hash, 'namespace', namespace, 0 FROM {p_task} WHERE namespace IS NOT NULL
  UNION ALL SELECT 'Value', value_hash, 'format', format, 0 FROM {p_value} WHERE format = 'pickle' UNION ALL SELECT 'CallNode', call_hash, 'name', task_name, 0 FROM {p_call} WHERE task_name = 'pack') t WHERE value <> ''""",
    "p_file": "SELECT value_hash, 'store/' || substr(value_hash, 1, 2) || '/' || substr(value_hash, 3, 6) || '.csv' AS path FROM {p_value} WHERE type = 'lane.File'",
}
_STORED = ("job", "execution", "task", "call_node", "value_record", "subvalue")


def ctes(*needed: str) -> str:
    """``WITH ...`` of the views named and those they need, for DuckDB."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        for other in VIEWS:
            if f"{{{other}}}" in VIEWS[name]:
                add(other)
        out.setdefault(name, VIEWS[name].format(**{k: k for k in (*_STORED, *VIEWS)}))

    for n in needed:
        add(n)
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in out.items()) + " "


def _newest(df: DataFrame, key: str, columns: list[Column], *order: Column) -> DataFrame:
    """Of the rows with each non-null key the one that is greatest by the order."""
    best = F.max_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key_")).agg(best.alias("x")).select(F.col("key_").alias(key), "x.*")


class Provenance:
    """The views of one folder as DataFrames: attributes job, execution, task, call, value, subvalue, call_edge, argument, tag, file."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}
        self._cut: set[str] = set()

    def _stored(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def _job(self) -> DataFrame:
        c = [F.col(x) for x in ("start_time", "end_time", "task_hash", "cached", "call_hash", "parent_id", "execution_id")]
        return _newest(self._stored("job"), "id", c, F.col("end_time").isNotNull(), F.col("rec_id"))

    def _execution(self) -> DataFrame:
        return _newest(self._stored("execution"), "id", [F.col(x) for x in ("args", "updated_time", "job_id")], F.col("rec_id"))

    def _task(self) -> DataFrame:
        first = F.min_by(F.struct("name", "namespace", "source"), F.struct("recorded_at", "name", "namespace"))
        return self._stored("task").where("hash is not null").groupBy("hash").agg(first.alias("x")).select("hash", "x.*")

    def _call(self) -> DataFrame:
        c = [F.col(x) for x in ("task_name", "task_hash", "args_hash", "value_hash")]
        return _newest(self._stored("call_node"), "call_hash", [*c, F.col("timestamp").alias("called_at")], F.col("rec_id"))

    def _value(self) -> DataFrame:
        return _newest(self._stored("value_record"), "value_hash", [F.col("type"), F.col("format")], F.col("rec_id"))

    def _subvalue(self) -> DataFrame:
        return self._stored("subvalue").select("value_hash", "parent_value_hash").na.drop().distinct()

    def _call_edge(self) -> DataFrame:
        child = self.job.where("call_hash is not null").select("parent_id", F.col("call_hash").alias("child_id"), "start_time")
        parent = self.job.where("call_hash is not null").select(F.col("id").alias("parent_id"), F.col("call_hash").alias("parent"))
        e = child.join(parent, "parent_id").where("child_id <> parent").groupBy(F.col("parent").alias("parent_id"), "child_id").agg(F.min("start_time").alias("started"))
        order = F.row_number().over(Window.partitionBy("parent_id").orderBy(F.asc_nulls_last("started"), "child_id")) - 1
        return e.select("parent_id", "child_id", order.alias("call_order"))

    def _argument(self) -> DataFrame:
        """Each call's order is moved on by one and by two, so an equal join finds the siblings that come next."""
        ahead = F.explode(F.array(F.lit(1), F.lit(2))).alias("ahead")
        before = self.call_edge.select("parent_id", F.col("child_id").alias("result_call_hash"), "call_order", ahead).withColumn("call_order", F.col("call_order") + F.col("ahead"))
        pair = self.call_edge.join(before, ["parent_id", "call_order"]).join(self.call.select(F.col("call_hash").alias("result_call_hash"), "value_hash"), "result_call_hash")
        return pair.select(
            F.md5(F.concat("child_id", F.lit("/"), "result_call_hash")).alias("arg_hash"), F.col("child_id").alias("call_hash"), "value_hash", F.when(F.col("ahead") == 1, 0).alias("arg_position"),
            F.when(F.col("ahead") == 2, "before").alias("arg_key"), "result_call_hash")

    def _tag(self) -> DataFrame:
        def tags(df: DataFrame, kind: str, entity: str, key: str, value: Column, rec: Column) -> DataFrame:
            return df.where(F.col(entity).isNotNull() & (value != "")).select(
                F.lit(kind).alias("entity_type"), F.col(entity).alias("entity_id"), F.lit(key).alias("key"), value.alias("value"), rec.cast("bigint").alias("rec_id"))
        runs, zero, part = self._stored("execution"), F.lit(0), lambda n: F.get(F.split("args", '"'), F.lit(n))
        rows = [
            tags(runs, "Execution", "id", "script", part(5), F.col("rec_id")), tags(runs, "Execution", "id", "batch", F.substring(part(11), 1, 2), F.col("rec_id")),
            tags(self.job.where("cached"), "Job", "id", "cached", F.lit("true"), zero), tags(self.task, "Task", "hash", "namespace", F.col("namespace"), zero),
            tags(self.value.where("format = 'pickle'"), "Value", "value_hash", "format", F.col("format"), zero), tags(self.call.where("task_name = 'pack'"), "CallNode", "call_hash", "name", F.col("task_name"), zero),
        ]
        digest = F.md5(F.concat("entity_id", "key", "value", F.col("rec_id").cast("string")))
        nxt = F.lead("tag_hash").over(Window.partitionBy("entity_type", "entity_id", "key").orderBy("rec_id"))
        return reduce(DataFrame.unionByName, rows).withColumn("tag_hash", digest).withColumn("next_hash", nxt).select(
            "tag_hash", "entity_type", "entity_id", "key", "value", "rec_id", F.col("next_hash").isNull().alias("is_current"), "next_hash")

    def _file(self) -> DataFrame:
        h = F.col("value_hash")
        return self.value.where("type = 'lane.File'").select("value_hash", F.concat(F.lit("store/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 6), F.lit(".csv")).alias("path"))

    def view(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = getattr(self, name[1:])()
        return self._made[name]

    def cut(self, *names: str) -> None:
        """Write these views to tables of the shared folder, once; what is planned from now on reads the tables.  They stay there."""
        s = Scratch(self.spark, "view")
        for n in names:
            if n not in self._cut:
                self._made[f"p_{n}"] = s.cut(self.view(f"p_{n}"))
                self._cut.add(n)

    def __getattr__(self, name: str) -> DataFrame:
        if not name.startswith("_") and f"p_{name}" in VIEWS:
            return self.view(f"p_{name}")
        raise AttributeError(name)
