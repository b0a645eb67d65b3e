"""Records as JSON lines, and idempotent transfer between stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Version of the record format.
FORMAT_VERSION = 1
#: The id of each type of record.
IDS = {"Execution": "id", "Job": "id", "CallNode": "call_hash", "Value": "value_hash", "Tag": "tag_hash"}


def nested_calls(call: DataFrame, argument: DataFrame, call_edge: DataFrame) -> DataFrame:
    """Calls with their args (arg_hash, value_hash, arg_position, arg_key, upstream) in order of position and key, and their children in call order."""
    of = argument.groupBy("call_hash", "arg_hash", "value_hash", "arg_position", "arg_key").agg(F.array_sort(F.collect_set("result_call_hash")).alias("upstream"))
    order = [F.coalesce("arg_position", F.lit(2**31 - 1)).alias("o"), F.coalesce("arg_key", F.lit("")).alias("k")]
    entry = F.struct(*order, "arg_hash", "value_hash", "arg_position", "arg_key", "upstream")
    args = of.groupBy("call_hash").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("o", "k")).alias("args"))
    kids = call_edge.groupBy(F.col("parent_id").alias("call_hash")).agg(F.transform(F.array_sort(F.collect_list(F.struct("call_order", "child_id"))), lambda e: e["child_id"]).alias("children"))
    return call.join(args, "call_hash", "left").join(kids, "call_hash", "left").withColumn("args", F.coalesce("args", F.array().cast(args.schema["args"].dataType))).withColumn(
        "children", F.coalesce("children", F.array().cast("array<string>")))


def nested_values(value: DataFrame, subvalue: DataFrame) -> DataFrame:
    """Values with the hashes of their parts, in order."""
    parts = subvalue.groupBy(F.col("parent_value_hash").alias("of")).agg(F.array_sort(F.collect_set("value_hash")).alias("subvalues"))
    return value.join(parts, value["value_hash"] == parts["of"], "left").drop("of").withColumn("subvalues", F.coalesce("subvalues", F.array().cast("array<string>")))


def nested_jobs(job: DataFrame) -> DataFrame:
    """Jobs with the ids of their children by start time."""
    kids = job.where("parent_id is not null and id <> parent_id").groupBy(F.col("parent_id").alias("of")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("start_time").isNull().alias("late"), "start_time", "id"))), lambda e: e["id"]).alias("children"))
    return job.join(kids, job["id"] == kids["of"], "left").drop("of").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def flat_calls(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((call_hash, arg_hash, value_hash, arg_position, arg_key, result_call_hash), (parent_id, child_id, call_order)) of ``nested_calls``."""
    a = calls.select("call_hash", F.explode("args").alias("a")).select("call_hash", "a.arg_hash", "a.value_hash", "a.arg_position", "a.arg_key", F.explode_outer("a.upstream").alias("result_call_hash"))
    return a, calls.select(F.col("call_hash").alias("parent_id"), F.posexplode("children").alias("call_order", "child_id")).select("parent_id", "child_id", "call_order")


def to_records(df: DataFrame, record_type: str) -> DataFrame:
    """(record_type, record_id, json): each row as one JSON object with its type and version."""
    body = F.to_json(F.struct(F.lit(FORMAT_VERSION).alias("_version"), F.lit(record_type).alias("_type"), *df.columns), {"ignoreNullFields": "false"})
    return df.select(F.lit(record_type).alias("record_type"), F.col(IDS[record_type]).alias("record_id"), body.alias("json"))


def from_records(records: DataFrame, record_type: str, schema: StructType) -> DataFrame:
    """The rows of one type of ``to_records``; a line of another version or that isn't JSON is left out."""
    full = StructType([*schema.fields]).add("_version", "integer").add("_type", "string")
    x = records.where(F.col("record_type") == record_type).select(F.from_json("json", full).alias("x")).where(
        (F.col("x._version") == FORMAT_VERSION) & (F.col("x._type") == record_type))
    return x.select(*[f"x.{f.name}" for f in schema.fields])


def export_lines(records: DataFrame, path: str) -> None:
    """Write the JSON lines of records as text files."""
    records.select("json").write.mode("overwrite").text(path)


def import_lines(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, json) of JSON lines; lines without a known type have null ids."""
    line = spark.read.text(path).withColumnRenamed("value", "json")
    t = F.get_json_object("json", "$._type")
    rid = F.coalesce(*[F.when(t == k, F.get_json_object("json", f"$.{v}")) for k, v in IDS.items()])
    return line.select(t.alias("record_type"), rid.alias("record_id"), "json")


def missing(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids (record_type, record_id) that a store lacks."""
    return ids.select("record_type", "record_id").distinct().join(store, ["record_type", "record_id"], "left_anti")


def get(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The records with these ids (record_type, record_id), each once."""
    return store.join(ids.select("record_type", "record_id").distinct(), ["record_type", "record_id"], "left_semi")


def has(store: DataFrame, ids: DataFrame) -> DataFrame:
    """(record_type, record_id) of those ids that the store has."""
    return ids.select("record_type", "record_id").distinct().join(store, ["record_type", "record_id"], "left_semi")


def dangling(store: DataFrame, references: DataFrame) -> DataFrame:
    """References (record_type, record_id, ...) to records that the store lacks as yet: they may come with a later transfer."""
    return references.join(store.select("record_type", "record_id"), ["record_type", "record_id"], "left_anti")


def put(store: DataFrame, records: DataFrame) -> DataFrame:
    """The store with those records that it lacks, one per id; a second time nothing changes."""
    new = records.dropDuplicates(["record_type", "record_id"]).join(store, ["record_type", "record_id"], "left_anti")
    return store.unionByName(new.select(store.columns))


def transfer(source: DataFrame, target: DataFrame, ids: DataFrame) -> DataFrame:
    """The target after taking the records with these ids from the source: a push or a pull."""
    wanted = missing(target, ids)
    return put(target, source.join(wanted, ["record_type", "record_id"], "left_semi"))
