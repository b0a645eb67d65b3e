"""Records whose fields drift between files: one consistent table, and each change.

Each line is loaded as a map from a path (a top-level field) to its raw type and text; statistics of types
are aggregated per file and path; from these come the changes between successive files of a source and the column and type that
a path gets in the common table, whose values that don't cast are reported with file and path, and kept, not dropped.

Raw types are finer than JSON's: integers and other numbers are apart, and so are strings that are times.  Changes compare the types of JSON.

Lines of any depth are read.  Lines that are null, empty, not whole JSON or not an object hold no record; a record without a textual ``_type`` has
none and is left out.  A later member of an object with the same name replaces the earlier.  Repeated lines change nothing.
Files of a source are ordered by their time, then by id; files or records without a partner (unknown file, null source
or time) are left out of the comparison but stay in the table.  A change of name is judged on all records
whose key is in both files, by aggregates per key: several differing records of one key never agree with anything.  A field's
values are compared as one fingerprint of its keys and values, so each removed field is joined with its equals, not paired with every added one.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.json_text import canonical, read_json
from tributary.scratch import Scratch

#: The member that is the key of a record, by its type.
KEYS = {"job": "id", "execution": "id", "value": "value_hash", "callnode": "call_hash", "tag": "tag_hash"}
_KINDS = {str: "string", int: "int", float: "float", bool: "boolean", list: "array", dict: "object", type(None): "null"}
#: Raw types that are another type in JSON.
_JSON = {"int": "number", "float": "number", "time": "string"}
_TIME = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:?\d\d)?")
#: What may name a column without quoting.
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_FIELD = pa.struct([("path", pa.string()), ("kind", pa.string()), ("raw", pa.string()), ("digest", pa.binary())])
_OUT = pa.schema([("dump_id", pa.int64()), ("line_no", pa.int32()), ("record_type", pa.string()), ("record_key", pa.string()), ("fields", pa.list_(_FIELD))])


def parse(payload: str | None) -> dict | None:
    """The record of a line, or None."""
    try:
        o = read_json(payload or "")
    except ValueError:
        return None
    return o if isinstance(o, dict) and isinstance(o.get("_type"), str) else None


def kind_of(v: object) -> str:
    """The raw type of a value."""
    return "time" if isinstance(v, str) and _TIME.fullmatch(v) else _KINDS[type(v)]


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.set_int_max_str_digits(0)
    for b in batches:
        rows = []
        for d, n, p in zip(b.column("dump_id").to_pylist(), b.column("line_no").to_pylist(), b.column("payload").to_pylist()):
            o = parse(p)
            if o is None:
                continue
            kind = o["_type"].lower().replace("_", "")
            key = o.get(KEYS.get(kind, ""))
            fields = []
            for path, v in o.items():
                text = canonical(v)
                raw = v if isinstance(v, str) else None if v is None else text
                fields.append({"path": path, "kind": kind_of(v), "raw": raw, "digest": md5(text.encode("utf-8", "surrogatepass")).digest()})
            rows.append({"dump_id": d, "line_no": n, "record_type": kind, "record_key": None if key is None else key if isinstance(key, str) else canonical(key), "fields": fields})
        if rows:
            yield pa.RecordBatch.from_pylist(_clean(rows), _OUT)


def _clean(rows: list[dict]) -> list[dict]:
    """Lone surrogates can't be stored as UTF-8; they become escapes in texts."""
    for r in rows:
        for f in r["fields"]:
            for k in ("path", "raw"):
                if f[k] is not None:
                    f[k] = f[k].encode("utf-8", "backslashreplace").decode()
        for k in ("record_type", "record_key"):
            if r[k] is not None:
                r[k] = r[k].encode("utf-8", "backslashreplace").decode()
    return rows


def load(lines: DataFrame) -> DataFrame:
    """lines (dump_id, line_no, payload) as (dump_id, line_no, record_type, record_key, fields): path, kind, raw, digest of each field."""
    return lines.select(F.col("dump_id").cast("bigint"), F.col("line_no").cast("int"), F.col("payload").cast("string")).mapInArrow(
        _load, "dump_id bigint, line_no int, record_type string, record_key string, fields array<struct<path string, kind string, raw string, digest binary>>")


def statistics(records: DataFrame) -> DataFrame:
    """(dump_id, record_type, path, kind, n, wide, inexact): how often a path of a file has each raw type, null among them.

    wide counts integers beyond bigint, inexact numbers that a double doesn't hold as they are.
    """
    f = records.select("dump_id", "record_type", F.explode("fields").alias("f")).select("dump_id", "record_type", "f.path", "f.kind", "f.raw")
    whole = F.when(F.col("kind") == "int", F.col("raw").try_cast("bigint"))
    return f.groupBy("dump_id", "record_type", "path", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("kind") == "int") & whole.isNull()).alias("wide"),
        F.count_if((F.col("kind") == "int") & ~F.coalesce(whole.between(-(2**53), 2**53), F.lit(False))).alias("inexact"))


def _json_kind(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(j)) for k, j in _JSON.items()], kind)


def _pairs(stats: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, record_type, dump_id, prev_id, now, then): maps from path to types of a file and of the one before it that holds the type."""
    types = F.array_sort(F.collect_set(F.when(F.col("kind") != "null", _json_kind(F.col("kind"))))).alias("kinds")
    stats = stats.groupBy("dump_id", "record_type", "path").agg(types)
    held = stats.groupBy("dump_id", "record_type").agg(F.map_from_entries(F.collect_list(F.struct("path", "kinds"))).alias("now"))
    f = files.where("repo is not null and exported_at is not null").groupBy("dump_id").agg(F.min("repo").alias("repo"), F.min("exported_at").alias("exported_at"))
    w = Window.partitionBy("repo", "record_type").orderBy("exported_at", "dump_id")
    return held.join(f, "dump_id").select(
        "repo", "record_type", "dump_id", F.lag("dump_id").over(w).alias("prev_id"), "now", F.lag("now").over(w).alias("then")).where("prev_id is not null")


def changes(records: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, record_type, dump_id, change_kind, field_name, new_name): retyped, renamed, removed and added fields of each later file."""
    pairs = _pairs(statistics(records), files)
    gone = F.array_except(F.map_keys("then"), F.map_keys("now"))
    new = F.array_except(F.map_keys("now"), F.map_keys("then"))
    both = F.filter(F.array_intersect(F.map_keys("then"), F.map_keys("now")), lambda p: (F.size(F.col("then")[p]) > 0) & (F.size(F.col("now")[p]) > 0) & (F.col("then")[p] != F.col("now")[p]))
    diff = pairs.select("repo", "record_type", "dump_id", "prev_id", gone.alias("gone"), new.alias("new"), both.alias("retyped"))

    # Per file, type and key: for each path the number of its non-null values and their least and greatest digest.
    wanted = diff.where((F.size("gone") > 0) & (F.size("new") > 0))
    then = wanted.select(F.col("prev_id").alias("file"), "record_type", F.col("dump_id").alias("pair"), F.lit(0).alias("side"), F.col("gone").alias("paths"))
    now = wanted.select(F.col("dump_id").alias("file"), "record_type", F.col("dump_id").alias("pair"), F.lit(1).alias("side"), F.col("new").alias("paths"))
    keyed = records.where("record_key is not null").withColumnRenamed("dump_id", "file")
    seen = keyed.join(then.unionByName(now), ["file", "record_type"]).select(
        "pair", "record_type", "side", "record_key",
        F.explode(F.transform("paths", lambda p: F.struct(
            p.alias("path"), F.get(F.filter("fields", lambda f: (f["path"] == p) & (f["kind"] != "null")), F.lit(0))["digest"].alias("digest")))).alias("x"))
    per_path = seen.groupBy("pair", "record_type", "record_key", "side", "x.path").agg(
        F.count(F.lit(1)).alias("n"), F.count("x.digest").alias("set"), F.min("x.digest").alias("lo"), F.max("x.digest").alias("hi"))
    # One value for all records of the key: null everywhere, or the same digest everywhere.
    one = F.struct("path", ((F.col("set") == 0) | ((F.col("set") == F.col("n")) & (F.col("lo") == F.col("hi")))).alias("one"), F.col("lo").alias("digest"))
    per_key = per_path.groupBy("pair", "record_type", "record_key").agg(
        F.collect_list(F.when(F.col("side") == 0, one)).alias("old"), F.collect_list(F.when(F.col("side") == 1, one)).alias("young"))
    both = per_key.where((F.size("old") > 0) & (F.size("young") > 0))
    sides = both.select("pair", "record_type", "record_key", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("old").alias("x")), F.struct(F.lit(1).alias("side"), F.col("young").alias("x")))).alias("s"))
    values = sides.select("pair", "record_type", "record_key", "s.side", F.explode("s.x").alias("x")).select("pair", "record_type", "record_key", "side", "x.*")
    # A key is there once a side, path and pair, so the fingerprint is one of a set; null is like absent.
    mark = lambda n: F.bit_xor(F.when(F.col("digest").isNotNull(), F.xxhash64("record_key", "digest", F.lit(n))))
    prints = values.groupBy("pair", "record_type", "side", "path").agg(F.bool_and("one").alias("one"), F.count("digest").alias("n"), mark(1).alias("a"), mark(2).alias("b")).where("one and n > 0")
    same = ["pair", "record_type", "n", "a", "b"]
    renamed = prints.where("side = 0").select(*same, F.col("path").alias("field_name")).join(prints.where("side = 1").select(*same, F.col("path").alias("new_name")), same)

    moved = renamed.groupBy(F.col("pair").alias("dump_id"), "record_type").agg(F.collect_list(F.struct("field_name", "new_name")).alias("renamed"))
    empty = F.array().cast("array<struct<field_name string, new_name string>>")
    full = diff.join(moved, ["dump_id", "record_type"], "left").withColumn("renamed", F.coalesce("renamed", empty))

    def kind(name: str, paths: F.Column) -> F.Column:
        return F.transform(paths, lambda p: F.struct(F.lit(name).alias("k"), p.alias("f"), F.lit("").alias("n")))

    rows = F.concat(
        kind("retyped", F.col("retyped")),
        F.transform("renamed", lambda r: F.struct(F.lit("renamed").alias("k"), r["field_name"].alias("f"), r["new_name"].alias("n"))),
        kind("removed", F.array_except("gone", F.transform("renamed", lambda r: r["field_name"]))),
        kind("added", F.array_except("new", F.transform("renamed", lambda r: r["new_name"]))),
    )
    return full.select("repo", "record_type", "dump_id", F.explode(rows).alias("x")).select(
        "repo", "record_type", "dump_id", F.col("x.k").alias("change_kind"), F.col("x.f").alias("field_name"), F.col("x.n").alias("new_name"))


def target_types(stats: DataFrame) -> DataFrame:
    """(record_type, path, kind): the raw type most of a path's non-null values have; integers and numbers count together, as what holds both."""
    n = stats.where("kind <> 'null'").groupBy("record_type", "path").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in ("int", "float")], F.lit(1))
    number = n.select("record_type", "path", F.when(F.col("n_float") > 0, "float").otherwise("int").alias("kind"), (F.col("n_int") + F.col("n_float")).alias("n"))
    other = stats.where("kind not in ('null', 'int', 'float')").groupBy("record_type", "path", "kind").agg(F.sum("n").alias("n"))
    return number.unionByName(other).groupBy("record_type", "path").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))


def layout(records: DataFrame, files: DataFrame, declared: dict[str, tuple[str, list[str]]] | None = None) -> dict[str, tuple[str, list[tuple[str, str]]]]:
    """The columns of the common table, for ``consistent``: name to (SQL type, the (record_type, path) it was written under).

    Every field of every type gets a column.  Names of a type are one field if ``changes`` found them renamed, unless
    both are in one file of that type; the pairs seen most often are merged first.  A column has the name that most values have and the type that
    ``statistics`` counts most often over its names: arrays and objects stay JSON text, numbers are bigint, double or, where neither holds all of them, string,
    and strings that are times timestamp_ntz.
    Declared columns keep name, type and order of paths, and take in what was renamed from or to these paths.  Names that can't be
    column names get none; ``consistent`` keeps their values in ``rest``.
    """
    declared = declared or {}
    s = Scratch(records.sparkSession, "layout")
    stats = s.cut(statistics(records))
    kinds = stats.groupBy("record_type", "path", "kind").agg(*[F.sum(c).alias(c) for c in ("n", "wide", "inexact")]).collect()  # as many as fields
    pairs = s.cut(changes(records, files).where("change_kind = 'renamed'").groupBy("record_type", "field_name", "new_name").agg(F.count(F.lit(1)).alias("n")))
    moved = pairs.select("record_type", F.explode(F.array("field_name", "new_name")).alias("path")).distinct()
    held = stats.select("dump_id", "record_type", "path").join(moved, ["record_type", "path"], "left_semi")
    together = {(r.record_type, r.path, r.other) for r in held.join(held.withColumnRenamed("path", "other"), ["dump_id", "record_type"]).where("path <> other").select("record_type", "path", "other").distinct().collect()}
    renames = pairs.collect()
    s.close()

    n: dict[tuple[str, str], int] = {}
    for r in kinds:
        n[r.record_type, r.path] = n.get((r.record_type, r.path), 0) + (r.n if r.kind != "null" else 0)
    group = {x: [x] for x in n}
    owner = {p: name for name, (_, paths) in declared.items() for p in paths}
    of = {x: owner.get(x[1]) for x in n}
    for r in sorted(renames, key=lambda r: (-r.n, r.record_type, r.field_name, r.new_name)):
        x, y = (r.record_type, r.field_name), (r.record_type, r.new_name)
        if x not in group or y not in group or group[x] is group[y]:
            continue
        if (of[x] and of[y] and of[x] != of[y]) or (of[x] is None or of[x] != of[y]) and any((r.record_type, a[1], b[1]) in together for a in group[x] for b in group[y]):
            continue
        both, name = group[x] + group[y], of[x] or of[y]
        for z in both:
            group[z], of[z] = both, name
    members: dict[str, list[tuple[str, str]]] = {name: [] for name in declared}
    for x in sorted(n):
        name = of[x] or max(group[x], key=lambda z: (n[z], z[1]))[1]
        if x[1] == "_type" or x[1] == KEYS.get(x[0]):
            continue
        members.setdefault(name, []).append(x)
    taken = {"dump_id", "line_no", "record_type", "record_key", "failed", "rest"} | {name.lower() for name in declared}
    out = {}
    for name, own in members.items():
        if name in declared:
            order = {p: i for i, p in enumerate(declared[name][1])}
            out[name] = (declared[name][0], sorted(own, key=lambda x: (order.get(x[1], len(order)), x)))
        elif _NAME.fullmatch(name):
            count: dict[str, int] = {}
            mine = [r for r in kinds if (r.record_type, r.path) in own and r.kind != "null"]
            for r in mine:
                kind = "number" if r.kind in ("int", "float") else r.kind
                count[kind] = count.get(kind, 0) + r.n
            kind = max(count, key=lambda k: (count[k], k), default="string")
            floats, wide, inexact = any(r.kind == "float" for r in mine), any(r.wide for r in mine), any(r.inexact for r in mine)
            number = "bigint" if not floats and not wide else "double" if not inexact else "string"
            free, i = name, 2
            while free.lower() in taken:
                free, i = f"{name}_{i}", i + 1
            taken.add(free.lower())
            out[free] = ({"number": number, "boolean": "boolean", "time": "timestamp_ntz"}.get(kind, "string"), sorted(own, key=lambda x: (-n[x], x)))
    return out


def consistent(records: DataFrame, columns: dict[str, tuple[str, list[str | tuple[str, str]]]]) -> DataFrame:
    """One table: dump_id, line_no, record_type, record_key, the columns, failed (column and path of values that don't cast) and
    rest: from path to raw value, each non-null field that is in no column, those that don't cast among them.

    columns: name to (SQL type, the paths it was written under, of any type or as (record_type, path); the first that is there counts).
    """
    by = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["path"], f["raw"])))
    df = records.select("dump_id", "line_no", "record_type", "record_key", by.alias("raw"))

    def at(p: str | tuple[str, str]) -> tuple[F.Column, str]:
        return (F.col("raw")[p], p) if isinstance(p, str) else (F.when(F.col("record_type") == p[0], F.col("raw")[p[1]]), p[1])

    null = F.lit(None).cast("string")
    raw = {name: F.coalesce(null, *[at(p)[0] for p in paths]) for name, (_, paths) in columns.items()}
    path = {name: F.coalesce(null, *[F.when(at(p)[0].isNotNull(), F.lit(at(p)[1])) for p in paths]) for name, (_, paths) in columns.items()}
    cast = {name: raw[name].try_cast(columns[name][0]) for name in columns}
    failed = F.array_compact(F.array(*[F.when(raw[n].isNotNull() & cast[n].isNull(), F.struct(F.lit(n).alias("column_name"), path[n].alias("path"))) for n in columns])) if columns else F.lit(None).cast("array<struct<column_name string, path string>>")
    key = F.coalesce(null, *[F.when(F.col("record_type") == t, F.lit(k)) for t, k in KEYS.items()])
    used = F.array_compact(F.array(F.lit("_type"), key, *[F.when(cast[n].isNotNull(), path[n]) for n in columns]))
    df = df.select("dump_id", "line_no", "record_type", "record_key", "raw", *[c.alias(n) for n, c in cast.items()], failed.alias("failed"), used.alias("used"))
    rest = F.map_filter("raw", lambda p, v: v.isNotNull() & ~F.array_contains("used", p))
    return df.select("dump_id", "line_no", "record_type", "record_key", *[F.col(n) for n in columns], "failed", rest.alias("rest"))


def failed_casts(table: DataFrame) -> DataFrame:
    """(dump_id, record_type, column_name, path, n_failed, least_value) of ``consistent``: the values of each file that don't cast, and one of them."""
    f = table.select("dump_id", "record_type", F.explode("failed").alias("f"), "rest").select("dump_id", "record_type", "f.column_name", "f.path", F.col("rest")[F.col("f.path")].alias("value"))
    return f.groupBy("dump_id", "record_type", "column_name", "path").agg(F.count(F.lit(1)).alias("n_failed"), F.min("value").alias("least_value"))
