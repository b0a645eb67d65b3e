"""Reuse of earlier results: fingerprints, a manifest, and why something has to run again.

An evaluation is a transform with arguments.  Its fingerprint is made from the transform's identity and the arguments'
(values by their content, datasets by their listing, results of other evaluations by their fingerprint), never from a
printed plan.  The manifest has one row an evaluation: fingerprint, transform, arguments, the identities of all
transforms under it, the result's path and the digest of the result's files.  Three kinds of reuse, tried in order: the same
evaluation in this execution; an evaluation of any age whose transforms are all as they were (shallow check);
the same transform and arguments.  A row is used only while its result's files are as they were.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import scratch
from tributary.functions.hashing import python_hash
from tributary.plans.transforms import Transform, as_transform, recording
from tributary.sources.datasets import Dataset

MANIFEST = "fingerprint string, task_hash string, args_hash string, task_name string, closure array<string>, path string, digest string, execution_id string, made_at double"


# --- over tables of recorded calls


def closure_hits(calls: DataFrame, closure: DataFrame, requests: DataFrame, current: DataFrame) -> DataFrame:
    """(task_hash, args_hash, call_hash): per request the latest call all of whose tasks are current.

    calls (call_hash, task_hash, args_hash, called_at), closure (call_hash, task_hash), requests (task_hash, args_hash), current
    (task_hash).  A call with a stale task is taken out by an anti-join; the rest is a grouped maximum.
    """
    want = calls.join(requests.distinct(), ["task_hash", "args_hash"], "left_semi")
    stale = closure.join(want.select("call_hash").distinct(), "call_hash", "left_semi").join(current.distinct(), "task_hash", "left_anti").select("call_hash").distinct()
    good = want.join(stale, "call_hash", "left_anti")
    return good.groupBy("task_hash", "args_hash").agg(F.max_by("call_hash", F.struct("called_at", "call_hash")).alias("call_hash"))


def miss_reason(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """(task_hash, args_hash, reason): ``new_task`` if no call has the task, ``new_args`` if none has it with these arguments, else ``new_call``."""
    known = calls.groupBy("task_hash").agg(F.lit(True).alias("has_task"))
    pair = calls.groupBy("task_hash", "args_hash").agg(F.lit(True).alias("has_pair"))
    reason = F.when(F.col("has_task").isNull(), "new_task").when(F.col("has_pair").isNull(), "new_args").otherwise("new_call")
    return requests.distinct().join(known, "task_hash", "left").join(pair, ["task_hash", "args_hash"], "left").select("task_hash", "args_hash", reason.alias("reason"))


#: Kinds of reuse in the order in which they are tried.
HITS = ("cse", "ultimate", "single")


def check_cache(requests: DataFrame, same_execution: DataFrame, shallow: DataFrame, single: DataFrame, scope: str = "backend", allowed: Sequence[str] = HITS) -> DataFrame:
    """(task_hash, args_hash, hit, value_hash): the first of three lookup tables (task_hash, args_hash, value_hash) that has the request.

    scope ``execution`` looks only at the same execution, ``none`` nowhere; kinds that aren't allowed are passed over.
    """
    tables = dict(zip(HITS, (same_execution, shallow, single)))
    kinds = [k for k in HITS if k in allowed and scope != "none" and (k == "cse" or scope == "backend")]
    keys = ["task_hash", "args_hash"]
    out = requests.select(*keys).distinct()
    for k in kinds:
        out = out.join(tables[k].groupBy(*keys).agg(F.max("value_hash").alias(k)), keys, "left")
    hit = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds], F.lit("miss"))
    return out.select(*keys, hit.alias("hit"), F.coalesce(*kinds, F.lit(None).cast("string")).alias("value_hash"))


# --- running


@dataclass
class Result:
    """A written result; ``reused`` names the kind of reuse, or is None."""

    df: DataFrame
    fingerprint: str
    path: str
    reused: str | None


@dataclass
class Engine:
    """Runs transforms and keeps their results and provenance under a root folder of the shared file system."""

    spark: SparkSession
    root: str
    shallow: bool = True
    execution_id: str = field(default_factory=lambda: python_hash("Execution", time.time_ns()))
    config_args: frozenset[str] = frozenset()
    seen: dict[str, Result] = field(default_factory=dict)

    def _rows(self) -> DataFrame | None:
        p = f"{self.root}/manifest"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(p)
        if not fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            return None
        return self.spark.read.schema(MANIFEST).json(p)

    def _known(self, task_hash: str, args_hash: str) -> list[Any]:
        """The evaluations of one transform with these arguments, latest first; only these come to the driver."""
        rows = self._rows()
        return [] if rows is None else rows.where((F.col("task_hash") == task_hash) & (F.col("args_hash") == args_hash)).orderBy(F.desc("made_at")).collect()

    def manifest(self) -> DataFrame:
        """All evaluations that were recorded."""
        rows = self._rows()
        return self.spark.createDataFrame([], MANIFEST) if rows is None else rows

    def argument_hash(self, value: Any) -> str:
        if isinstance(value, Result):
            return value.fingerprint
        if isinstance(value, Dataset):
            return value.hash
        if isinstance(value, DataFrame):
            raise TypeError("a frame has no identity; pass a Dataset or the Result of another run")
        return python_hash("Value", value)

    def args_hash(self, args: Sequence[Any], kwargs: dict[str, Any]) -> str:
        named = {k: self.argument_hash(v) for k, v in kwargs.items() if k not in self.config_args}
        return python_hash("Args", [self.argument_hash(a) for a in args], named)

    def run(self, f: Transform | Callable[..., DataFrame], *args: Any, uses: Sequence[Transform] = (), **kwargs: Any) -> Result:
        """The result of f, reused if it may be.  uses: the transforms that f itself calls, whose identities count in a shallow check."""
        t = as_transform(f)
        task, arg = t.hash, self.args_hash(args, kwargs)
        key = python_hash("Eval", task, arg)
        if key in self.seen:
            return Result(self.seen[key].df, key, self.seen[key].path, "cse")
        current = sorted({task, *(u.hash for u in uses)})
        for row in self._known(task, arg):
            if set(row.closure) <= set(current) if self.shallow else row.closure == current:
                ds = Dataset(self.spark, row.path)
                if ds.digest() == row.digest:
                    out = self.seen[key] = Result(ds.read(), key, row.path, "ultimate" if self.shallow else "single")
                    return out
        value = [x.df if isinstance(x, Result) else x.read() if isinstance(x, Dataset) else x for x in args]
        named = {k: x.df if isinstance(x, Result) else x.read() if isinstance(x, Dataset) else x for k, x in kwargs.items()}
        path = f"{self.root}/results/{key}-{time.time_ns()}"
        t(*value, **named).write.parquet(path)
        ds = Dataset(self.spark, path)
        if recording():
            row = {"fingerprint": key, "task_hash": task, "args_hash": arg, "task_name": t.fullname, "closure": current, "path": path, "digest": ds.digest(), "execution_id": self.execution_id, "made_at": time.time()}
            self.spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/manifest")
        out = self.seen[key] = Result(ds.read(), key, path, None)
        return out

    def explain_miss(self, f: Transform | Callable[..., DataFrame], *args: Any, **kwargs: Any) -> str:
        """``new_task``, ``new_args`` or ``new_call`` (known, but not usable)."""
        t = as_transform(f)
        rows = self._rows()
        if rows is None or rows.where(F.col("task_hash") == t.hash).isEmpty():
            return "new_task"
        return "new_call" if self._known(t.hash, self.args_hash(args, kwargs)) else "new_args"

    def clear(self) -> None:
        scratch.delete(self.spark, self.root)
        self.seen.clear()
