"""Deeply nested records as flat tables that keep every parent-child link.

Each JSON line is walked bottom-up.  Every object is put in a canonical form, its members in order and nested objects
replaced by references to their hashes (arrays stay, with references for the objects in them), and hashed itself: a
Merkle identity, the same wherever the same subtree occurs.  Identical objects are stored once; each occurrence, that of
a line's own object too, is one bridge row with the object around it, the place in it, and its ordinal among the objects there.

``body`` is JSON; an object in it is always a reference ``{"#": hash}``, so a line is got back from its bridge row without a
parent and the bodies of the objects below, equal to the line as a JSON value (of members with one name the last counts; 1.0 is 1).
A string that holds JSON stays a string in the body; the objects in it are stored and bridged too, with ``$`` in their place.

Links between records are bridge rows: an occurrence that is an item of a list of a record names the link and the hash
of the object that holds the list; an item that is a bare key is a bridge row of its own with the key in ``child_key``.
``links`` gets the keys on both sides from the stored objects.

A record is a Job if it has ``id``, else a CallNode if it has ``call_hash``, else a Value if it has ``value_hash``;
null and '' are not keys.  Lists of items come as arrays or objects of any nesting, as single items, or as strings that
hold such JSON.  An object is an item if it has the key; one that is a record of another kind is walked for its own
links but is no item; any other object is a container.  Lines that are null or not one whole JSON object give no rows.
Nesting of any depth is walked without a limit of its own.  Numbers and booleans are never keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.json_text import read_json, scalar
from tributary.scratch import Scratch

#: Kinds of records in order of precedence, with their keys.
KINDS = (("Job", "id"), ("CallNode", "call_hash"), ("Value", "value_hash"))
#: Lists of a record: member, key of its items, link.
LISTS = {"Job": [("children", "id", "job_child")], "CallNode": [("args", "arg_hash", "argument"), ("children", "call_hash", "call_child")], "Value": [("subvalues", "value_hash", "subvalue")]}
#: The keys of holder and item of each link.
ENDS = {"argument": ("call_hash", "arg_hash"), "upstream": ("arg_hash", "call_hash"), "call_child": ("call_hash", "call_hash"), "job_child": ("id", "id"), "subvalue": ("value_hash", "value_hash")}
_KEYS = ("id", "call_hash", "value_hash", "arg_hash")

_OBJECT = [("object_hash", pa.string()), *[(k, pa.string()) for k in _KEYS], ("body", pa.string())]
_BRIDGE = [("line_id", pa.int64()), ("node", pa.int32()), ("parent_node", pa.int32()), ("ordinal", pa.int32()), ("parent_hash", pa.string()), ("child_hash", pa.string()),
           ("child_key", pa.string()), ("place", pa.string()), ("link_kind", pa.string()), ("holder_hash", pa.string())]
_ARROW = pa.schema(_OBJECT + _BRIDGE)
_SCHEMA = "object_hash string, id string, call_hash string, value_hash string, arg_hash string, body string, line_id bigint, node int, parent_node int, ordinal int, parent_hash string, child_hash string, child_key string, place string, link_kind string, holder_hash string"


class _Held(str):
    """A string that holds JSON, with what it holds."""

    value: list | dict


def _held(s: str) -> str:
    t = s.strip()
    if t[:1] in ("[", "{") and t[-1:] in ("]", "}"):
        try:
            v = read_json(t)
        except ValueError:
            return s
        if isinstance(v, (list, dict)):
            h = _Held(s)
            h.value = v
            return h
    return s


def record_kind(o: dict) -> str | None:
    for kind, name in KINDS:
        if isinstance(k := o.get(name), str) and k:
            return kind
    return None


def _flat(text: str | tuple) -> str:
    """The text of nested tuples of texts."""
    if isinstance(text, str):
        return text
    out, work = [], [text]
    while work:
        t = work.pop()
        if isinstance(t, str):
            out.append(t)
        else:
            work.extend(reversed(t))
    return "".join(out)


def _path(steps: tuple | None) -> str:
    out = []
    while steps:
        steps, step = steps
        out.append(step)
    return "/".join(reversed(out))


class _Line:
    """The objects, nodes and items of one line.

    A node is [parent node, ordinal, place, hash, number of objects right below, link, holder node].
    """

    def __init__(self, root: dict) -> None:
        self.objects: list[tuple] = []
        self.nodes: list[list] = []
        self.number: dict[int, int] = {}
        self.items: list[tuple[int, int, str, str, str]] = []
        self._identify(root)
        self._link(root)

    def _frame(self, v: dict | list, node: int, steps: tuple | None, text: bool) -> tuple:
        """(value, its members to come, texts of finished ones, node around what is in it, steps there, whether out of a string)."""
        if isinstance(v, dict):
            own = len(self.nodes)
            if node >= 0:
                self.nodes[node][4] += 1
            self.nodes.append([node, self.nodes[node][4] - 1 if node >= 0 else 0, _path(steps), None, 0, None, None])
            self.number[id(v)] = own
            return v, iter(list(v.items())), [], own, None, text
        return v, iter(enumerate(v)), [], node, steps, text

    def _identify(self, root: dict) -> None:
        """Numbers nodes in the order of the text, and hashes objects when all in them are."""
        stack = [self._frame(root, -1, None, False)]
        names: list = [None]  # the member that each frame is for
        while stack:
            value, members, parts, node, steps, text = stack[-1]
            for name, v in members:
                if type(v) is str and v and not v[0].isalnum() and isinstance(h := _held(v), _Held):
                    value[name] = v = h
                    parts.append((name, scalar(str(v))))
                    stack.append(self._frame(h.value, node, ((steps, str(name)), "$"), True))
                    names.append(name)
                    break
                if isinstance(v, (dict, list)):
                    stack.append(self._frame(v, node, (steps, str(name)), False))
                    names.append(name)
                    break
                parts.append((name, scalar(v)))
            else:
                stack.pop()
                name = names.pop()
                if isinstance(value, list):
                    out = ("[", *[x for _, t in parts for x in (t, ",")][:-1], "]") if parts else "[]"
                else:
                    body = "{" + ",".join(f"{scalar(k)}:{_flat(t)}" for k, t in sorted(parts, key=lambda x: x[0])) + "}"
                    digest = sha256(body.encode("utf-8", "surrogatepass")).hexdigest()[:40]
                    self.nodes[node][3] = digest
                    self.objects.append((digest, *[k if isinstance(k := value.get(x), str) and k else None for x in _KEYS], body))
                    out = f'{{"#":"{digest}"}}'
                if stack and not text:
                    stack[-1][2].append((name, out))

    def _link(self, root: dict) -> None:
        """Gives the items of lists their links, in the order of the text.  Work: (value, key of items, link, holder, node around it, steps there)."""
        work: list[tuple] = [(root, None, None, None, 0, None)]

        def members(v: dict, node: int, *lists: tuple) -> None:
            for name, key, link in reversed(lists):
                work.append((v.get(name), key, link, node if link else None, node, (None, name)))

        while work:
            v, name, link, holder, node, steps = work.pop()
            if isinstance(v, _Held):
                work.append((v.value, name, link, holder, node, (steps, "$")))
            elif isinstance(v, str):
                if v and link:
                    self.items.append((node, holder, link, v, _path(steps)))
            elif isinstance(v, list):
                work.extend((v[i], name, link, holder, node, (steps, str(i))) for i in range(len(v) - 1, -1, -1))
            elif isinstance(v, dict):
                own = self.number[id(v)]
                key = v.get(name) if name else None
                if link and isinstance(key, str) and key:
                    self.nodes[own][5:7] = link, holder
                    if link == "argument":
                        members(v, own, ("upstream", "call_hash", "upstream"), ("value", None, None))
                        continue
                    name = None
                kind = record_kind(v)
                if kind is not None:
                    members(v, own, *LISTS[kind])
                elif name is None or name not in v:  # a container
                    if name is None:
                        link, holder = None, None
                    work.extend((x, name, link, holder, own, (None, k)) for k, x in reversed(v.items()) if not (link is None and isinstance(x, str)))

    def rows(self, line_id: int, stored: set[str]) -> Iterator[tuple]:
        nodes, none = self.nodes, (None,) * len(_BRIDGE)
        for o in self.objects:
            if o[0] not in stored:
                stored.add(o[0])
                yield (*o, *none)
        none = (None,) * len(_OBJECT)
        for i, (parent, ordinal, place, digest, _, link, holder) in enumerate(nodes):
            inside = parent >= 0
            yield (*none, line_id, i, parent if inside else None, ordinal, nodes[parent][3] if inside else None, digest, None, place, link, None if holder is None else nodes[holder][3])
        count: dict[int, int] = {}
        for i, (parent, holder, link, key, place) in enumerate(self.items, len(nodes)):
            count[parent] = n = count.get(parent, -1) + 1
            yield (*none, line_id, i, parent, n, nodes[parent][3], None, key, place, link, nodes[holder][3])


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.set_int_max_str_digits(0)
    for b in batches:
        rows: list[tuple] = []
        stored: set[str] = set()  # objects of the batch
        for i, p in zip(b.column("line_id").to_pylist(), b.column("payload").to_pylist()):
            try:
                o = read_json(p or "")
            except ValueError:
                continue
            if isinstance(o, dict):
                rows += _Line(o).rows(i, stored)
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    def text(x: object) -> object:
        return x.encode("utf-8", "backslashreplace").decode() if isinstance(x, str) else x

    try:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
    except UnicodeEncodeError:  # lone surrogates
        return _batch([tuple(map(text, r)) for r in rows])


def flatten(lines: DataFrame) -> DataFrame:
    """All rows of lines (line_id, payload): object rows, one for an object and batch, and bridge rows."""
    return lines.select(F.col("line_id").cast("bigint"), F.col("payload").cast("string")).mapInArrow(_flatten, _SCHEMA)


def objects(rows: DataFrame) -> DataFrame:
    """(object_hash, id, call_hash, value_hash, arg_hash, body, object_kind, object_key): each distinct object once; nested objects in body are references."""
    kind = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col(k).isNotNull(), F.lit(n)) for n, k in KINDS])
    return rows.where("object_hash is not null").select("object_hash", *_KEYS, "body").groupBy("object_hash").agg(*[F.first(c).alias(c) for c in (*_KEYS, "body")]).select(
        "*", kind.alias("object_kind"), F.coalesce(*[k for _, k in KINDS]).alias("object_key"))


def bridge(rows: DataFrame) -> DataFrame:
    """(line_id, node, parent_node, ordinal, parent_hash, child_hash, child_key, place, link_kind, holder_hash): each occurrence of an object,
    without a parent for a line's own one, and each bare key in a list of a record.

    Nodes of a line are numbered, objects in the order of the text, then keys.  ordinal counts the objects, or the keys, with one parent.
    place is the way to it from the object around it.  link_kind is null where no record lists it; else holder_hash is the record (or,
    for upstream, the entry) that lists it, which isn't the parent if there are containers between.
    """
    return rows.where("node is not null").select(*[n for n, _ in _BRIDGE])


def links(rows: DataFrame, s: Scratch) -> DataFrame:
    """(link_kind, parent_key, child_key), distinct: bridge rows that are items, joined with the stored objects on either side.

    As the objects of a subtree are stored once, its links are joined once, however often it occurs.
    """
    rows = s.cut(rows.where("object_hash is not null or link_kind is not null").select("object_hash", *_KEYS, "link_kind", "holder_hash", "child_hash", "child_key"))
    keys = s.cut(rows.where("object_hash is not null and coalesce(id, call_hash, value_hash, arg_hash) is not null").select("object_hash", *_KEYS).distinct())
    held = rows.where("link_kind is not null").select("link_kind", "holder_hash", "child_hash", "child_key").distinct()

    def end(side: int) -> F.Column:
        return F.coalesce(*[F.when(F.col("link_kind") == k, F.col(e[side])) for k, e in ENDS.items()])

    inner = held.where("child_hash is not null").drop("child_key").join(keys.withColumnRenamed("object_hash", "child_hash"), "child_hash").select("link_kind", "holder_hash", end(1).alias("child_key"))
    both = inner.unionByName(held.where("child_hash is null").select("link_kind", "holder_hash", "child_key"))
    return both.join(keys.withColumnRenamed("object_hash", "holder_hash"), "holder_hash").select("link_kind", end(0).alias("parent_key"), "child_key").distinct()
