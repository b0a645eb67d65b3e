"""Versioned tags: a tag is never changed, a new one names those it supersedes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.hashing import hash_struct


def tag_hash(entity_type: str, entity_id: Column, key: Column, value: Column, parents: Column) -> Column:
    return hash_struct("Tag", F.lit(entity_type), entity_id, key, value, F.array_join(F.array_sort(parents), ","))


def current(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """Tags (tag_hash, ...) that no edit (parent_id, child_id) supersedes."""
    return tags.join(edits.select(F.col("parent_id").alias("tag_hash")), "tag_hash", "left_anti")


def superseded(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """Tags that an edit supersedes, each once."""
    return tags.join(edits.select(F.col("parent_id").alias("tag_hash")), "tag_hash", "left_semi")


def record(tags: DataFrame, edits: DataFrame, new: DataFrame, update: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tags, edits) after recording new (entity_type, entity_id, key, value).

    A tag that is current already is left as it is.  With update, the current tags of the same entity and key with another
    value are superseded; without, values of a key add up.
    """
    now = current(tags, edits)
    same = ["entity_type", "entity_id", "key"]
    fresh = new.select(*same, "value").distinct().join(now.select(*same, "value"), [*same, "value"], "left_anti")
    if update:
        old = now.join(fresh.select(*same).distinct(), same, "left_semi").groupBy(*same).agg(F.array_sort(F.collect_set("tag_hash")).alias("parents"))
        fresh = fresh.join(old, same, "left")
    else:
        fresh = fresh.withColumn("parents", F.lit(None).cast("array<string>"))
    parents = F.coalesce("parents", F.array().cast("array<string>"))
    fresh = fresh.withColumn("tag_hash", hash_struct("Tag", F.col("entity_type"), F.col("entity_id"), F.col("key"), F.col("value"), F.array_join(parents, ",")))
    new_edits = fresh.select(F.explode(parents).alias("parent_id"), F.col("tag_hash").alias("child_id"))
    added = fresh.select("tag_hash", *same, "value").join(tags.select("tag_hash"), "tag_hash", "left_anti")
    return tags.unionByName(added), edits.unionByName(new_edits).distinct()


def delete(tags: DataFrame, edits: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, edits) after putting an empty tag, the tombstone, in place of the current tags of keys (entity_type, entity_id, key)."""
    same = ["entity_type", "entity_id", "key"]
    gone = current(tags, edits).join(keys.select(*same).distinct(), same, "left_semi")
    stone = gone.groupBy(*same).agg(F.array_sort(F.collect_set("tag_hash")).alias("parents"))
    stone = stone.withColumn("tag_hash", hash_struct("Tag", F.lit("Null"), F.lit(""), F.lit(""), F.lit(""), F.array_join("parents", ",")))
    rows = stone.select("tag_hash", F.lit("Null").alias("entity_type"), F.lit("").alias("entity_id"), F.lit("").alias("key"), F.lit("").alias("value"))
    return tags.unionByName(rows), edits.unionByName(stone.select(F.explode("parents").alias("parent_id"), F.col("tag_hash").alias("child_id"))).distinct()


def multimap(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """(entity_type, entity_id, tags): the current tags of each entity as a map from key to its values in order."""
    now = current(tags, edits).where("entity_type <> 'Null'")
    per_key = now.groupBy("entity_type", "entity_id", "key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return per_key.groupBy("entity_type", "entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "values")))).alias("tags"))
