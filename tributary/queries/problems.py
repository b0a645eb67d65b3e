"""The queries of the general problems, over whole tables, with their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import drift, hierarchy, intervals, nesting, orphans, skew
from tributary.scratch import Scratch
from tributary.sources.tables import table

# --- 1: references to records that do not exist


def _p1(spark: SparkSession, d: str) -> DataFrame:
    t = orphans.Target
    targets = [
        t("task", table(spark, d, "task", "hash", "recorded_at"), "hash", "Task"),
        t("value_record", table(spark, d, "value_record", "value_hash", "recorded_at"), "value_hash", "Value"),
        t("call_node", table(spark, d, "call_node", "call_hash", "recorded_at"), "call_hash", "CallNode"),
        t("job", table(spark, d, "job", "id", "recorded_at"), "id", "Job"),
    ]
    call, job = table(spark, d, "call_node", "rec_id", "task_hash", "value_hash", "recorded_at"), table(spark, d, "job", "rec_id", "call_hash", "recorded_at")
    r = orphans.Reference
    refs = [
        r("call_node", call, "task_hash", "task"), r("call_node", call, "value_hash", "value_record"), r("job", job, "call_hash", "call_node"),
        r("execution", table(spark, d, "execution", "rec_id", "job_id", "recorded_at"), "job_id", "job"),
    ]
    return orphans.orphans(targets, refs, table(spark, d, "purge_log"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(_p1(spark, d))


_P1_SQL = """
WITH refs AS (
  SELECT 'call_node' table_name, 'task_hash' field_name, 'Task' e, rec_id, recorded_at ts, task_hash k FROM call_node UNION ALL
  SELECT 'call_node', 'value_hash', 'Value', rec_id, recorded_at, value_hash FROM call_node UNION ALL
  SELECT 'job', 'call_hash', 'CallNode', rec_id, recorded_at, call_hash FROM job UNION ALL
  SELECT 'execution', 'job_id', 'Job', rec_id, recorded_at, job_id FROM execution),
p AS (SELECT e, k, min(ts) lo, max(ts) hi FROM (
  SELECT 'Task' e, hash k, recorded_at ts FROM task UNION ALL SELECT 'Value', value_hash, recorded_at FROM value_record UNION ALL
  SELECT 'CallNode', call_hash, recorded_at FROM call_node UNION ALL SELECT 'Job', id, recorded_at FROM job) GROUP BY e, k),
g AS (SELECT entity_type e, entity_id k, max(purged_at) purged FROM purge_log GROUP BY 1, 2),
found AS (SELECT table_name, field_name, rec_id, strftime(ts, '%Y-%m') AS period
  FROM refs LEFT JOIN p ON p.e = refs.e AND p.k = refs.k LEFT JOIN g ON g.e = refs.e AND g.k = refs.k
  WHERE refs.k IS NOT NULL AND (p.k IS NULL OR ts < lo OR purged >= hi))
"""

# --- 3: schemas that drift between files


def _p3_records(spark: SparkSession, d: str) -> DataFrame:
    return drift.load(table(spark, d, "dump_record", "dump_id", "line_no", "payload"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    records = Scratch(spark, "p3").cut(_p3_records(spark, d))
    return drift.changes(records, table(spark, d, "dump_file", "dump_id", "repo", "exported_at")).select(
        "repo", "record_type", "dump_id", "change_kind", "field_name", "new_name")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    records = Scratch(spark, "p3").cut(_p3_records(spark, d))
    return drift.consistent(records, drift.layout(records, table(spark, d, "dump_file", "dump_id", "repo", "exported_at")))


def p3_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    return drift.failed_casts(p3_records(spark, d))


def p3_types(spark: SparkSession, d: str) -> DataFrame:
    return drift.target_types(drift.statistics(_p3_records(spark, d)))


_P3_SQL = """
WITH r AS (SELECT dump_id, payload::JSON AS j, row_number() OVER () AS rid FROM dump_record WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND json_type(payload, '$._type') = 'VARCHAR'),
t AS (SELECT *, lower(replace(j->>'_type', '_', '')) AS rt FROM r),
k AS (SELECT *, CASE rt WHEN 'job' THEN j->>'id' WHEN 'execution' THEN j->>'id' WHEN 'value' THEN j->>'value_hash' WHEN 'callnode' THEN j->>'call_hash' WHEN 'tag' THEN j->>'tag_hash' END AS key FROM t),
f AS (SELECT dump_id, rt, key, rid, path, json_extract(j, '$."' || path || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS path FROM k)),
g AS (SELECT dump_id, rt, key, path, CASE WHEN json_type(v) <> 'NULL' THEN v::VARCHAR END AS v, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind,
  CASE WHEN json_type(v) = 'VARCHAR' AND regexp_full_match(v->>'$', '\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d(:\\d\\d(\\.\\d{1,9})?)?(Z|[+-]\\d\\d:?\\d\\d)?') THEN 'time' WHEN json_type(v) = 'DOUBLE' THEN 'float' WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'int' END AS fine FROM f)
"""
_P3_FOUND = """, st AS (SELECT dump_id, rt, path, list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)) AS kinds FROM g GROUP BY ALL),
files AS (SELECT dump_id, min(repo) AS repo, min(exported_at) AS at FROM dump_file WHERE repo IS NOT NULL AND exported_at IS NOT NULL GROUP BY dump_id),
pair AS (SELECT * FROM (SELECT repo, rt, dump_id AS d, lag(dump_id) OVER (PARTITION BY repo, rt ORDER BY files.at, dump_id) AS e FROM (SELECT DISTINCT dump_id, rt FROM st) h JOIN files USING (dump_id)) WHERE e IS NOT NULL),
young AS (SELECT d, e, pair.rt, path, kinds FROM pair JOIN st ON st.dump_id = d AND st.rt = pair.rt), old AS (SELECT d, e, pair.rt, path, kinds FROM pair JOIN st ON st.dump_id = e AND st.rt = pair.rt),
gone AS (SELECT d, e, rt, path FROM old ANTI JOIN young USING (d, rt, path)), new AS (SELECT d, e, rt, path FROM young ANTI JOIN old USING (d, rt, path)),
records AS (SELECT dump_id, rt, key, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY ALL),
vals AS (SELECT dump_id, rt, key, path, count(*) AS n, min(v) AS lo, max(v) AS hi FROM g WHERE v IS NOT NULL AND key IS NOT NULL GROUP BY ALL),
judged AS (SELECT a.d, a.rt, a.path AS field_name, b.path AS new_name, (x.n IS NULL OR (x.n = ra.n AND x.lo = x.hi)) AND (y.n IS NULL OR (y.n = rb.n AND y.lo = y.hi)) AND x.lo IS NOT DISTINCT FROM y.lo AS same, x.lo IS NOT NULL AS filled
  FROM gone a JOIN new b ON a.d = b.d AND a.rt = b.rt JOIN records ra ON ra.dump_id = a.e AND ra.rt = a.rt JOIN records rb ON rb.dump_id = a.d AND rb.rt = a.rt AND rb.key = ra.key
  LEFT JOIN vals x ON x.dump_id = a.e AND x.rt = a.rt AND x.key = ra.key AND x.path = a.path LEFT JOIN vals y ON y.dump_id = a.d AND y.rt = a.rt AND y.key = ra.key AND y.path = b.path),
renamed AS (SELECT d, rt, field_name, new_name FROM judged GROUP BY ALL HAVING bool_and(same) AND bool_or(filled)),
found AS (SELECT d, rt, 'retyped' AS change_kind, path AS field_name, '' AS new_name FROM young JOIN old USING (d, rt, path) WHERE len(young.kinds) > 0 AND len(old.kinds) > 0 AND young.kinds <> old.kinds
  UNION ALL SELECT d, rt, 'renamed', field_name, new_name FROM renamed UNION ALL SELECT d, rt, 'removed', path, '' FROM gone WHERE (d, rt, path) NOT IN (SELECT d, rt, field_name FROM renamed)
  UNION ALL SELECT d, rt, 'added', path, '' FROM new WHERE (d, rt, path) NOT IN (SELECT d, rt, new_name FROM renamed))
SELECT repo, rt AS record_type, d AS dump_id, change_kind, field_name, new_name FROM found JOIN pair USING (d, rt)"""
_P3_TYPES = """, n AS (SELECT rt, path, coalesce(fine, kind) AS kind, count(*) AS n FROM g WHERE kind IS NOT NULL GROUP BY ALL),
m AS (SELECT rt, path, CASE WHEN sum(n) FILTER (kind = 'float') > 0 THEN 'float' ELSE 'int' END AS kind, coalesce(sum(n) FILTER (kind IN ('int', 'float')), 0) AS n FROM n GROUP BY rt, path UNION ALL SELECT * FROM n WHERE kind NOT IN ('int', 'float'))
SELECT rt AS record_type, path, arg_max(kind, (n, kind)) AS kind FROM m GROUP BY rt, path"""

# --- 4: deeply nested semi-structured records


def _p4_rows(spark: SparkSession, d: str) -> DataFrame:
    return nesting.flatten(table(spark, d, "raw_record", "line_id", "payload"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nesting.links(_p4_rows(spark, d), Scratch(spark, "p4"))


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    return nesting.objects(_p4_rows(spark, d))


def p4_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nesting.bridge(_p4_rows(spark, d))


# --- 5: parent-child links to full hierarchies


def _p5_edges(spark: SparkSession, d: str) -> DataFrame:
    job = table(spark, d, "job", "id", "parent_id").select(F.lit("job").alias("ns"), F.col("id").alias("child"), F.col("parent_id").alias("parent"))
    sub = table(spark, d, "subvalue", "value_hash", "parent_value_hash")
    return job.unionByName(sub.select(F.lit("subvalue").alias("ns"), F.col("value_hash").alias("child"), F.col("parent_value_hash").alias("parent")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycles(_p5_edges(spark, d)).select(F.col("ns").alias("table_name"), F.col("node").alias("node_key"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_p5_edges(spark, d)).select(
        F.col("ns").alias("table_name"), F.col("node").alias("node_key"), "path", "depth", "root", "n_parents", F.col("n_descendants").alias("n_in_tree"), "on_cycle")


def p5_further_paths(spark: SparkSession, d: str) -> DataFrame:
    """The links to containers that a value doesn't hang under in p5_paths, and its paths by them."""
    return hierarchy.further(_p5_edges(spark, d)).select(F.col("ns").alias("table_name"), F.col("node").alias("node_key"), F.col("parent").alias("parent_key"), "path", "depth")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """How many descendants each node has by all its links outside cycles; p5_intervals says which."""
    return hierarchy.descendant_counts(_p5_edges(spark, d)).select(F.col("ns").alias("table_name"), F.col("node").alias("node_key"), "n_descendants")


def p5_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The descendants of a node by all its links are the other nodes of its table and a row's root whose own pos is between the row's pos and last_pos."""
    return hierarchy.descendants(_p5_edges(spark, d)).select(F.col("ns").alias("table_name"), F.col("node").alias("node_key"), "root", "pos", "last_pos", "own", "n_descendants")


_P5_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT * FROM (
  SELECT 'job' t, id c, parent_id p FROM job UNION ALL SELECT 'subvalue', value_hash, parent_value_hash FROM subvalue) WHERE c IS NOT NULL AND p IS NOT NULL),
top AS (SELECT * FROM e SEMI JOIN e x ON e.t = x.t AND e.p = x.c),
r(t, s, v) AS (SELECT t, c, p FROM top UNION SELECT r.t, r.s, top.p FROM r JOIN top ON top.t = r.t AND top.c = r.v),
cyc AS (SELECT DISTINCT t, s AS k FROM r WHERE s = v)
"""

#: Nodes, all links outside cycles, the one link of each child that makes the tree, and the tree from its roots.
_P5_TREE = """, n AS (SELECT 'job' t, unnest([id, parent_id]) k FROM job UNION SELECT 'subvalue', unnest([value_hash, parent_value_hash]) FROM subvalue),
every AS (SELECT e.* FROM e ANTI JOIN cyc ON e.t = cyc.t AND e.c = cyc.k ANTI JOIN cyc y ON e.t = y.t AND e.p = y.k),
live AS (SELECT t, c, arg_min(p, md5(t || chr(0) || p)) p FROM every GROUP BY t, c),
d(t, k, path, depth, root) AS (SELECT n.t, n.k, n.k, 0, n.k FROM n ANTI JOIN live ON live.t = n.t AND live.c = n.k WHERE n.k IS NOT NULL
  UNION ALL SELECT d.t, live.c, d.path || '/' || live.c, depth + 1, root FROM d JOIN live ON live.t = d.t AND live.p = d.k)"""

# --- 6: overlapping and gapped time intervals


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(table(spark, d, "job", "execution_id", "start_time", "end_time"), "execution_id", "start_time", "end_time", Scratch(spark, "p6").cut)


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(table(spark, d, "job", "execution_id", "start_time", "end_time"), "execution_id", "start_time", "end_time", Scratch(spark, "p6").cut)


_P6_SQL = """
WITH j AS (SELECT execution_id, epoch_us(start_time) s, epoch_us(end_time) e FROM job WHERE execution_id IS NOT NULL AND end_time > start_time),
m AS (SELECT *, max(e) OVER (PARTITION BY execution_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM j)
"""

# --- 7: a few keys holding most records


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.found([(t, table(spark, d, t, "task_hash")) for t in ("job", "call_node")], "task_hash", Fraction(4, 100))


def p7_results(spark: SparkSession, d: str) -> DataFrame:
    job = table(spark, d, "job", "task_hash", "call_hash", "start_time", "end_time", "cached")
    us = F.expr("timestampdiff(MICROSECOND, start_time, end_time)")
    j = skew.aggregate(
        job, "task_hash", {"n_rows": F.lit(1), "n_cached": F.coalesce(F.col("cached").cast("int"), F.lit(0)), "n_ended": F.col("end_time").isNotNull().cast("int"), "total_us": us},
        {"n_calls": "call_hash"},
    )
    call = table(spark, d, "call_node", "task_hash", "call_hash")
    zero = F.lit(0)
    c = skew.aggregate(call, "task_hash", {"n_rows": F.lit(1), "n_cached": zero, "n_ended": zero, "total_us": F.lit(None).cast("bigint")}, {"n_calls": "call_hash"})
    return j.withColumn("table_name", F.lit("job")).unionByName(c.withColumn("table_name", F.lit("call_node")))


def p7_join(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by the namespace of their task, and how many came before the task was recorded: a join on the skewed key."""
    t = table(spark, d, "task", "hash", "namespace", "recorded_at").groupBy(F.col("hash").alias("task_hash")).agg(
        F.min("recorded_at").alias("known_at"), F.min("namespace").alias("namespace"))
    job = table(spark, d, "job", "task_hash", "recorded_at")
    return skew.join(job, t, "task_hash", how="left").groupBy("namespace").agg(
        F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("recorded_at") < F.col("known_at")).alias("n_early"))


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report,
    "p3_found": p3_found, "p3_records": p3_records, "p3_failed_casts": p3_failed_casts, "p3_types": p3_types,
    "p4_found": p4_found, "p4_objects": p4_objects, "p4_bridge": p4_bridge,
    "p5_found": p5_found, "p5_paths": p5_paths, "p5_further_paths": p5_further_paths, "p5_descendants": p5_descendants, "p5_intervals": p5_intervals,
    "p6_found": p6_found, "p6_periods": p6_periods,
    "p7_found": p7_found, "p7_results": p7_results, "p7_join": p7_join,
}

SQL = {
    "p3_found": _P3_SQL + _P3_FOUND,
    "p3_types": _P3_SQL + _P3_TYPES,
    "p1_found": _P1_SQL + "SELECT * FROM found",
    "p1_report": _P1_SQL + "SELECT table_name, field_name, period, count(*) AS n_orphans FROM found GROUP BY ALL",
    "p5_found": _P5_SQL + "SELECT t AS table_name, k AS node_key FROM cyc",
    "p5_paths": _P5_SQL + _P5_TREE + """,
a(t, k, v) AS (SELECT t, c, p FROM live UNION ALL SELECT a.t, a.k, live.p FROM a JOIN live ON live.t = a.t AND live.c = a.v),
s AS (SELECT t, v, count(*) n FROM a GROUP BY t, v)
SELECT d.t AS table_name, d.k AS node_key, path, depth, root, coalesce(np, 0) AS n_parents, coalesce(s.n, 0) AS n_in_tree, cyc.k IS NOT NULL AS on_cycle
FROM d LEFT JOIN s ON s.t = d.t AND s.v = d.k LEFT JOIN cyc ON cyc.t = d.t AND cyc.k = d.k
LEFT JOIN (SELECT t, c, count(*) np FROM e GROUP BY t, c) e2 ON e2.t = d.t AND e2.c = d.k""",
    "p5_further_paths": _P5_SQL + _P5_TREE + """
SELECT x.t AS table_name, x.c AS node_key, x.p AS parent_key, d.path || '/' || x.c AS path, d.depth + 1 AS depth FROM every x ANTI JOIN live ON live.t = x.t AND live.c = x.c AND live.p = x.p JOIN d ON d.t = x.t AND d.k = x.p""",
    "p5_descendants": _P5_SQL + _P5_TREE + """,
a(t, k, v) AS (SELECT t, c, p FROM every UNION SELECT a.t, a.k, every.p FROM a JOIN every ON every.t = a.t AND every.c = a.v)
SELECT n.t AS table_name, n.k AS node_key, count(a.k) AS n_descendants FROM n LEFT JOIN a ON a.t = n.t AND a.v = n.k WHERE n.k IS NOT NULL GROUP BY n.t, n.k""",
    "p6_found": _P6_SQL + "SELECT execution_id, reach AS gap_start_us, s AS gap_end_us FROM m WHERE reach < s",
    "p6_periods": _P6_SQL + ", i AS (SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY execution_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) k FROM m) "
    "SELECT execution_id, min(s) AS start_us, max(e) AS end_us FROM i GROUP BY execution_id, k",
    "p7_found": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, task_hash FROM {t} WHERE task_hash IS NOT NULL GROUP BY task_hash HAVING count(*) * 100 > (SELECT count(*) FROM {t}) * 4" for t in ("job", "call_node")),
    "p7_results": """
SELECT 'job' AS table_name, task_hash, count(*) AS n_rows, count(*) FILTER (WHERE cached) AS n_cached, count(end_time) AS n_ended,
  CAST(sum(date_diff('microsecond', start_time, end_time)) AS BIGINT) AS total_us, count(DISTINCT call_hash) AS n_calls FROM job WHERE task_hash IS NOT NULL GROUP BY task_hash
UNION ALL SELECT 'call_node', task_hash, count(*), 0, 0, NULL, count(DISTINCT call_hash) FROM call_node WHERE task_hash IS NOT NULL GROUP BY task_hash""",
    "p7_join": """
SELECT namespace, count(*) AS n_jobs, count(*) FILTER (WHERE j.recorded_at < known_at) AS n_early FROM job j
LEFT JOIN (SELECT hash, min(recorded_at) known_at, min(namespace) namespace FROM task GROUP BY hash) t ON t.hash = j.task_hash GROUP BY namespace""",
}
