"""Identities: SHA-512, cut to 40 hex digits, of a structure whose parts can't run into each other."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of an identity.
HASH_LEN = 40


def hash_text(c: Column) -> Column:
    return F.substring(F.sha2(c, 512), 1, HASH_LEN)


def _part(c: Column) -> Column:
    """Length and text of a part, so that no two lists of parts give the same text; null differs from ''."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("n"))


def hash_struct(tag: str, *parts: Column) -> Column:
    """Identity of a tagged list of parts."""
    return hash_text(F.concat(F.lit(f"{len(tag)}:{tag}"), *[_part(p) for p in parts]))


def args_hash(*parts: Column) -> Column:
    return hash_struct("Args", *parts)


def eval_hash(task_hash: Column, args: Column) -> Column:
    return hash_struct("Eval", task_hash, args)


def call_hash(task_hash: Column, args: Column, result: Column, children: Column) -> Column:
    """children: an array of call hashes, in any order."""
    return hash_struct("CallNode", task_hash, args, result, F.array_join(F.array_sort(children), ","))


def set_hash(values: Column) -> Column:
    """Identity of an array as a set: order and repetition don't count, and a list of the same items differs."""
    return hash_struct("Set", F.to_json(F.array_sort(F.array_distinct(values))))


def list_hash(values: Column) -> Column:
    return hash_struct("List", F.to_json(values))


def python_hash(tag: str, *parts: object) -> str:
    """The same kind of identity for driver values, by their normalized JSON."""
    texts = [json.dumps(p, sort_keys=True, separators=(",", ":"), default=str) for p in parts]
    text = f"{len(tag)}:{tag}" + "".join(f"{len(t)}:{t}" for t in texts)
    return hashlib.sha512(text.encode()).hexdigest()[:HASH_LEN]
