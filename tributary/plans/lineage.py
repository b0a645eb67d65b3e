"""Filters over recorded runs: one query stands for five record types, each a frame of ids.

A ``LineageQuery`` is immutable.  Filters are kept as functions of a type and its frame and are applied before any
sort, limit or page; joins that only restrict are semi-joins, so no filter repeats a row.  Types that aren't wanted are never planned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.plans.provenance import ERROR_TYPE, Provenance

TYPES = ("Execution", "Job", "CallNode", "Task", "Value")
ANY = object()
_ID = {"Execution": "id", "Job": "id", "CallNode": "call_hash", "Task": "hash", "Value": "value_hash"}
_VIEW = {"Execution": "execution", "Job": "job", "CallNode": "call", "Task": "task", "Value": "value"}
Filter = Callable[["LineageQuery", str, DataFrame], DataFrame]


def among(df: DataFrame, column: str, keys: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose column is one of the keys: of a few literals, or of the first column of a frame of any size, by a semi-join."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(keys[keys.columns[0]].alias(column)), column, "left_semi")
    return df.where(F.col(column).isin(list(keys)))


def _any(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def status_term(status: str) -> Column:
    """The filter for a status, over columns end_time, call_hash, cached and value_type; statuses may overlap."""
    terms = {
        "RUNNING": F.col("end_time").isNull() & F.col("call_hash").isNull(),
        "CACHED": F.col("cached"),
        "FAILED": F.col("value_type") == ERROR_TYPE,
        "DONE": ~F.col("cached") & (F.col("value_type") != ERROR_TYPE),
    }
    if status not in terms:
        raise NotImplementedError(status)
    return terms[status]


def job_status() -> Column:
    """The one status of a job: the first of failed, running, cached that applies, else done."""
    return (
        F.when(F.col("value_type") == ERROR_TYPE, "FAILED").when(F.col("end_time").isNull(), "RUNNING").when(F.col("cached"), "CACHED").otherwise("DONE")
    )


def with_results(p: Provenance, jobs: DataFrame) -> DataFrame:
    """jobs (with call_hash) and the value_hash and value_type of their results, null where there is none."""
    calls = p.call.select("call_hash", "value_hash")
    values = p.value.select("value_hash", F.col("type").alias("value_type"))
    return jobs.join(calls, "call_hash", "left").join(values, "value_hash", "left")


def task_term(name: str) -> Column:
    """``ns.name`` is both, a bare name is the name in any namespace."""
    ns, _, short = name.rpartition(".")
    return ((F.col("namespace") == ns) & (F.col("name") == short)) if ns else F.col("name") == name


def value_jobs(p: Provenance, jobs: DataFrame) -> DataFrame:
    """(value_hash, execution_id): values and the executions they took part in, as result or argument, whole or as a part."""
    j = jobs.where("call_hash is not null").select("call_hash", "execution_id").distinct()
    result = p.call.select("call_hash", "value_hash").join(j, "call_hash")
    arg = p.argument.select("call_hash", "value_hash").join(j, "call_hash")
    used = result.select("value_hash", "execution_id").unionByName(arg.select("value_hash", "execution_id")).distinct()
    part = p.subvalue.join(used.withColumnRenamed("value_hash", "parent_value_hash"), "parent_value_hash").select("value_hash", "execution_id")
    return used.unionByName(part).distinct()


@dataclass(frozen=True)
class LineageQuery:
    p: Provenance
    types: tuple[str, ...] = TYPES
    filters: tuple[Filter, ...] = ()
    order: str | None = None
    nothing: bool = False
    shared: tuple[str, ...] = ()

    def _with(self, f: Filter, types: Iterable[str] = TYPES, **more: object) -> LineageQuery:
        keep = set(types)
        return replace(self, types=tuple(t for t in self.types if t in keep), filters=(*self.filters, f), **more)

    # -- filters

    def filter_types(self, types: Iterable[str]) -> LineageQuery:
        return self._with(lambda q, t, df: df, types)

    def filter_ids(self, ids: Sequence[str] | DataFrame) -> LineageQuery:
        return self._with(lambda q, t, df: among(df, _ID[t], ids))

    def like_id(self, prefix: str) -> LineageQuery:
        """Ids that start so; of tasks also those with exactly this name."""
        def f(q: LineageQuery, t: str, df: DataFrame) -> DataFrame:
            hit = F.col(_ID[t]).startswith(prefix)
            return df.where(hit | task_term(prefix) if t == "Task" else hit)
        return self._with(f)

    def _by_executions(self, t: str, df: DataFrame, ids: DataFrame) -> DataFrame:
        """Records of a type that belong to the executions ids (execution_id)."""
        jobs = self.p.job.join(ids, "execution_id", "left_semi")
        if t == "Execution":
            return df.join(ids.withColumnRenamed("execution_id", "id"), "id", "left_semi")
        if t == "Job":
            return df.join(ids, "execution_id", "left_semi")
        if t == "CallNode":
            return df.join(jobs.select("call_hash"), "call_hash", "left_semi")
        if t == "Task":
            return df.join(jobs.select(F.col("task_hash").alias("hash")), "hash", "left_semi")
        return df.join(value_jobs(self.p, jobs).select("value_hash"), "value_hash", "left_semi")

    def filter_execution_ids(self, ids: Sequence[str] | DataFrame) -> LineageQuery:
        def f(q: LineageQuery, t: str, df: DataFrame) -> DataFrame:
            return q._by_executions(t, df, among(q.p.job.select("execution_id"), "execution_id", ids).distinct())
        return self._with(f, shared=("job", "call", "argument"))

    def filter_execution_statuses(self, statuses: Sequence[str]) -> LineageQuery:
        """By the status of the root job, a cached one counting as done; only executions, latest first."""
        wanted = [*statuses, *(["CACHED"] if "DONE" in statuses else [])]

        def f(q: LineageQuery, t: str, df: DataFrame) -> DataFrame:
            root = with_results(q.p, q.p.job.select(F.col("id").alias("job_id"), "end_time", "call_hash", "cached"))
            return df.join(root.where(_any(map(status_term, wanted))).select("job_id"), "job_id", "left_semi")
        return self._with(f, ["Execution"], order="time")

    def filter_job_statuses(self, statuses: Sequence[str]) -> LineageQuery:
        def f(q: LineageQuery, t: str, df: DataFrame) -> DataFrame:
            return with_results(q.p, df).where(_any(map(status_term, statuses))).select(df.columns)
        return self._with(f, ["Job"])

    def filter_task_names(self, names: Sequence[str]) -> LineageQuery:
        def f(q: LineageQuery, t: str, df: DataFrame) -> DataFrame:
            hit = q.p.task.where(_any(map(task_term, names))).select("hash")
            return df.join(hit.withColumnRenamed("hash", "task_hash"), "task_hash", "left_semi") if t == "Job" else df.join(hit, "hash", "left_semi")
        return self._with(f, ["Job", "Task"])

    def filter_task_hashes(self, hashes: Sequence[str] | DataFrame) -> LineageQuery:
        return self._with(lambda q, t, df: among(df, "task_hash" if t == "Job" else "hash", hashes), ["Job", "Task"])

    def _by_values(self, used: Callable[[Provenance], DataFrame], hashes: Sequence[str] | DataFrame) -> LineageQuery:
        def f(q: LineageQuery, t: str, df: DataFrame) -> DataFrame:
            u = used(q.p)
            whole = among(u, "value_hash", hashes).select("call_hash")
            parts = among(q.p.subvalue, "value_hash", hashes).select(F.col("parent_value_hash").alias("value_hash"))
            return df.join(whole.unionByName(u.join(parts, "value_hash", "left_semi").select("call_hash")), "call_hash", "left_semi")
        return self._with(f, ["Job"])

    def filter_arguments(self, hashes: Sequence[str] | DataFrame) -> LineageQuery:
        """Jobs with one of the values as an argument, or in one."""
        return self._by_values(lambda p: p.argument.select("call_hash", "value_hash"), hashes)

    def filter_results(self, hashes: Sequence[str] | DataFrame) -> LineageQuery:
        """Jobs with one of the values as their result, or in it."""
        return self._by_values(lambda p: p.call.select("call_hash", "value_hash"), hashes)

    def filter_value_types(self, types: Sequence[str]) -> LineageQuery:
        return self._with(lambda q, t, df: df.where(F.col("type").isin(list(types))), ["Value"])

    def filter_file_paths(self, patterns: Sequence[str]) -> LineageQuery:
        """``*`` matches anything; as in SQL patterns, ``_`` is any character and ``%`` anything."""
        def f(q: LineageQuery, t: str, df: DataFrame) -> DataFrame:
            return df.join(q.p.file.where(_any(F.col("path").like(x.replace("*", "%")) for x in patterns)).select("value_hash"), "value_hash", "left_semi")
        return self._with(f, ["Value"])

    @staticmethod
    def _tagged(p: Provenance, tags: Sequence[tuple[str, object]]) -> DataFrame:
        """(entity_id) with all of the tags now."""
        out = None
        for key, value in tags:
            one = p.tag.where(F.col("is_current") & (F.col("key") == key) & (F.lit(True) if value is ANY else F.col("value") == F.lit(value))).select("entity_id").distinct()
            out = one if out is None else out.join(one, "entity_id", "left_semi")
        if out is None:
            raise ValueError("no tags")
        return out

    def filter_tags(self, tags: Sequence[tuple[str, object]]) -> LineageQuery:
        return self._with(lambda q, t, df: df.join(q._tagged(q.p, tags).withColumnRenamed("entity_id", _ID[t]), _ID[t], "left_semi"))

    def filter_execution_tags(self, tags: Sequence[tuple[str, object]]) -> LineageQuery:
        return self._with(lambda q, t, df: q._by_executions(t, df, q._tagged(q.p, tags).withColumnRenamed("entity_id", "execution_id")), shared=("job", "call", "argument"))

    def empty(self) -> LineageQuery:
        return replace(self, nothing=True)

    def order_by(self, key: str) -> LineageQuery:
        if key != "time":
            raise NotImplementedError(key)
        return replace(self, order=key)

    # -- results

    def build(self) -> dict[str, DataFrame]:
        """The rows of each wanted type; for several types the views that their filters share are made once."""
        if self.shared and len(self.types) > 1:
            self.p.cut(*self.shared)
        out = {}
        for t in self.types:
            df = getattr(self.p, _VIEW[t])
            for f in self.filters:
                df = f(self, t, df)
            out[t] = df.where(F.lit(False)) if self.nothing else df
        return out

    def all(self) -> DataFrame:
        """(type, id, time): distinct; time is the start of a job or of an execution's root job, null for others."""
        parts = []
        for t, df in self.build().items():
            if t == "Execution":
                df = df.join(self.p.job.select(F.col("id").alias("job_id"), F.col("start_time").alias("time")), "job_id", "left")
            time = F.col("time") if t == "Execution" else F.col("start_time") if t == "Job" else F.lit(None).cast("timestamp_ntz")
            parts.append(df.select(F.lit(t).alias("type"), F.col(_ID[t]).alias("id"), time.alias("time"), F.lit(TYPES.index(t)).alias("rank")))
        return reduce(DataFrame.unionByName, parts).distinct()

    def ordered(self) -> DataFrame:
        time = [F.desc_nulls_last("time")] if self.order else []
        return self.all().orderBy("rank", *time, "id")

    def limit(self, n: int) -> DataFrame:
        return self.ordered().limit(n).select("type", "id")

    def page(self, page: int, size: int) -> DataFrame:
        return self.ordered().offset(page * size).limit(size).select("type", "id")

    def count(self) -> DataFrame:
        return self.all().groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def select(self, *columns: str) -> DataFrame:
        if not columns or set(columns) - {"id", "type"}:
            raise ValueError("only id and type can be selected")
        return self.all().select(*columns)

    def first(self) -> tuple[str, str] | None:
        rows = self.ordered().take(1)
        return (rows[0]["type"], rows[0]["id"]) if rows else None

    def one_or_none(self) -> tuple[str, str] | None:
        """The only record, or None if there is none or more than one."""
        rows = self.ordered().take(2)
        return (rows[0]["type"], rows[0]["id"]) if len(rows) == 1 else None

    def one(self) -> tuple[str, str]:
        got = self.one_or_none()
        if got is None:
            raise LookupError("not exactly one record")
        return got


#: Flags of the textual query language and what they call; each may be repeated.
FLAGS: dict[str, tuple[str, Callable[[list[str]], object]]] = {
    "--id": ("filter_ids", list), "--exec-id": ("filter_execution_ids", lambda v: [i for x in v for i in x.split(",") if i]), "--exec-status": ("filter_execution_statuses", list),
    "--job-status": ("filter_job_statuses", list), "--task-name": ("filter_task_names", list), "--task-hash": ("filter_task_hashes", list),
    "--argument": ("filter_arguments", list), "--arg": ("filter_arguments", list), "--result": ("filter_results", list), "--value-type": ("filter_value_types", list),
    "--file-path": ("filter_file_paths", list), "--tag": ("filter_tags", lambda v: [_tag(x) for x in v]), "--exec-tag": ("filter_execution_tags", lambda v: [_tag(x) for x in v]),
}
_TYPE_FLAGS = {"--exec": "Execution", "--job": "Job", "--call-node": "CallNode", "--task": "Task", "--value": "Value", "--file": "Value"}
#: Short forms of flags.
_SHORT = {"-t": "--task-name", "-e": "--exec", "-j": "--job"}


def _tag(text: str) -> tuple[str, object]:
    key, eq, value = text.partition("=")
    if not key:
        raise ValueError(f"no key in tag {text!r}")
    return key, value if eq else ANY


def parse(p: Provenance, args: Sequence[str]) -> LineageQuery:
    """A query from flags, such as ``--job --task-name a.b --tag script=run.py``."""
    got: dict[str, list[str]] = {}
    types, rest = [], list(args)
    while rest:
        flag = rest.pop(0)
        flag = _SHORT.get(flag, flag)
        if flag == "--all":
            types += TYPES
        elif flag in _TYPE_FLAGS:
            types.append(_TYPE_FLAGS[flag])
        elif flag in FLAGS and rest:
            got.setdefault(flag, []).append(rest.pop(0))
        else:
            raise ValueError(f"unknown or incomplete flag {flag}")
    q = LineageQuery(p)
    if types:
        q = q.filter_types(types)
    for flag, values in got.items():
        method, convert = FLAGS[flag]
        q = getattr(q, method)(convert(values))
    return q
