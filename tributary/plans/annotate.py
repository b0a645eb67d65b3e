"""What is added to recorded runs afterwards: derived edges, tags on results, joined states, values of own types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.hashing import hash_struct
from tributary.plans import tags


def derive(argument_results: DataFrame, pairs: DataFrame) -> DataFrame:
    """argument_results (arg_hash, result_call_hash) with an edge for each of pairs, once; a pair with a null end adds none."""
    new = pairs.select("arg_hash", "result_call_hash").where("arg_hash is not null and result_call_hash is not null").distinct()
    return argument_results.unionByName(new.join(argument_results, ["arg_hash", "result_call_hash"], "left_anti"))


def apply_tags(results: DataFrame, store: DataFrame, edits: DataFrame, value_tags: dict[str, str] | None = None, job_tags: dict[str, str] | None = None, execution_tags: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, tags, edits): the results (value_hash, job_id, execution_id, ...) unchanged, and the store with these tags on their
    values, jobs and executions, each once; a null id is tagged with nothing."""
    parts = [F.struct(F.lit(kind).alias("entity_type"), F.col(column).alias("entity_id"), F.lit(k).alias("key"), F.lit(v).alias("value"))
             for kind, column, given in (("Value", "value_hash", value_tags), ("Job", "job_id", job_tags), ("Execution", "execution_id", execution_tags)) for k, v in (given or {}).items()]
    if not parts:
        return results, store, edits
    new = results.select(F.explode(F.array(*parts)).alias("t")).select("t.*").where("entity_id is not null")
    return results, *tags.record(store, edits, new)


def merge_states(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((name, state), edges (src, dst)): per name one state that all of its states (name, state) lead to; a single state stays as it is.

    The joined state's identity is made of those of its parents, in order, so joining again gives the same.
    """
    per = states.where("state is not null").groupBy("name").agg(F.array_sort(F.collect_set("state")).alias("parents"))
    joined = F.when(F.size("parents") == 1, F.element_at("parents", 1)).otherwise(hash_struct("Merge", F.col("name"), F.array_join("parents", ",")))
    per = per.withColumn("state", joined)
    edges = per.where(F.size("parents") > 1).select(F.explode("parents").alias("src"), F.col("state").alias("dst"))
    return per.select("name", "state"), edges


@dataclass(frozen=True)
class ValueType:
    """A type of values of one's own: its name, the fields that make it up, and which of them are its identity."""

    name: str
    schema: str
    identity: tuple[str, ...]
    check: Callable[[Column], Column] | None = None

    def hash(self, value: Column) -> Column:
        """Identity of a struct column: of the type's name and the identity fields."""
        return hash_struct(self.name, *[value[f] for f in self.identity])

    def dump(self, value: Column) -> Column:
        return F.to_json(value, {"ignoreNullFields": "false"})

    def load(self, text: Column) -> Column:
        return F.from_json(text, self.schema)

    def valid(self, value: Column) -> Column:
        """Whether a struct is a value of the type: not null, with its identity, and as ``check`` has it."""
        ok = value.isNotNull()
        for f in self.identity:
            ok = ok & value[f].isNotNull()
        return ok if self.check is None else ok & F.coalesce(self.check(value), F.lit(False))


_types: dict[str, ValueType] = {}


def register_type(t: ValueType) -> ValueType:
    """Make a type known by its name; a second of the same name must be equal."""
    if _types.setdefault(t.name, t) != t:
        raise ValueError(f"another type is named {t.name}")
    return t


def value_type(name: str) -> ValueType:
    return _types[name]
