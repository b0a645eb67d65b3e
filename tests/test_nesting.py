import json
import random

import pytest

from tributary.functions import json_text
from tributary.operators import nesting
from tributary.scratch import Scratch

SCHEMA = "line_id bigint, payload string, parent string, place string"


def run(spark, *payloads):
    rows = [(i, p if isinstance(p, str) or p is None else json.dumps(p), "x", "y") for i, p in enumerate(payloads)]
    return nesting.flatten(spark.createDataFrame(rows, SCHEMA))


def links(spark, *payloads):
    return {tuple(r) for r in nesting.links(run(spark, *payloads), Scratch(spark, "t")).collect()}


def test_shapes_of_lists(spark):
    want = {("subvalue", "v", "a"), ("subvalue", "v", "b")}
    for shape in (["a", "b"], {"0": "a", "1": "b"}, [["a"], {"x": ["b", None, ""]}], '["a", {"value_hash": "b"}]', [{"value_hash": "a"}, '{"k": "b"}'], ["a", "b", "a"]):
        assert links(spark, {"value_hash": "v", "subvalues": shape}) == want, shape
    assert links(spark, {"value_hash": "v", "subvalues": "a"}) == {("subvalue", "v", "a")}
    for none in (None, "", [], {}, [None, ""], "[]"):
        assert links(spark, {"value_hash": "v", "subvalues": none}, {"value_hash": "w"}) == set()


def test_records_in_place_of_keys(spark):
    call = {
        "call_hash": "c", "value_hash": "r", "children": ["k", {"call_hash": "d", "children": "e"}],
        "args": {"0": {"arg_hash": "g", "value_hash": "x", "upstream": [{"call_hash": "u", "args": [{"arg_hash": "h", "upstream": "w"}]}]}, "1": {"arg_hash": "i", "value": '{"value_hash": "z", "subvalues": ["s"]}'}},
    }
    got = links(spark, call, {"id": "j", "call_hash": "c2", "children": [{"id": "j2", "children": {"a": "j3"}}, "j4"]})
    assert got == {
        ("call_child", "c", "k"), ("call_child", "c", "d"), ("call_child", "d", "e"), ("argument", "c", "g"), ("upstream", "g", "u"), ("argument", "u", "h"), ("upstream", "h", "w"),
        ("argument", "c", "i"), ("subvalue", "z", "s"), ("job_child", "j", "j2"), ("job_child", "j2", "j3"), ("job_child", "j", "j4"),
    }


def test_broken_lines(spark):
    assert run(spark, None, "", "--", "[]", "5", '{"id": "j"', '{"id": "j"} x').collect() == []
    assert run(spark).collect() == []


def test_merkle_identities(spark):
    part = {"value_hash": "p", "data": [1, {"x": 2}]}
    same = {"data": [1.0, {"x": 2}], "value_hash": "p"}
    rows = run(spark, {"value_hash": "a", "subvalues": [part, same]}, {"value_hash": "b", "subvalues": {"k": part}}, {"value_hash": "b", "subvalues": {"k": {**part, "data": [2, {"x": 2}]}}})
    objects = {r["object_hash"]: r for r in nesting.objects(rows).collect()}
    assert sum(o["object_key"] == "p" for o in objects.values()) == 2  # one for both orders of members, one for other data
    bridge = nesting.bridge(rows).collect()
    p = next(h for h, o in objects.items() if o["object_key"] == "p" and '"data":[1,' in o["body"])
    assert sorted((b["line_id"], b["place"], b["ordinal"], b["link_kind"]) for b in bridge if b["child_hash"] == p) == [(0, "subvalues/0", 0, "subvalue"), (0, "subvalues/1", 1, "subvalue"), (1, "k", 0, "subvalue")]
    holder = {b["holder_hash"] for b in bridge if b["line_id"] == 1 and b["child_hash"] == p}
    assert [objects[h]["object_key"] for h in holder] == ["b"]  # over the container k
    assert {b["parent_hash"] for b in bridge} - {None} <= set(objects) and {b["child_hash"] for b in bridge} == set(objects)
    assert len({(b["line_id"], b["node"]) for b in bridge}) == len(bridge)
    assert sorted(b["line_id"] for b in bridge if b["parent_hash"] is None) == [0, 1, 2]


def test_texts_are_no_objects(spark):
    """A string that holds JSON and the JSON itself are different objects; what is in the string is stored and bridged all the same."""
    rows = run(spark, {"a": "[1]"}, {"a": [1]}, {"a": '{"b": [{"c": 1}]}'})
    objects = {r["object_hash"]: r["body"] for r in nesting.objects(rows).collect()}
    assert sorted(objects.values()) == sorted(['{"a":"[1]"}', '{"a":[1]}', json.dumps({"a": '{"b": [{"c": 1}]}'}, separators=(",", ":")), next(b for b in objects.values() if b.startswith('{"b"')), '{"c":1}'])
    assert sorted(b["place"] for b in nesting.bridge(rows).collect() if b["line_id"] == 2) == ["", "a/$", "b/0"]


def restored(h, bodies):
    def inside(v):
        return restored(v["#"], bodies) if isinstance(v, dict) else [inside(x) for x in v] if isinstance(v, list) else v

    return {k: inside(v) for k, v in json.loads(bodies[h]).items()}


def test_lines_come_back(spark):
    """Each line from its own bridge row and the bodies below it; every occurrence has a row with its place and ordinal."""
    rng = random.Random(5)

    def value(d):
        kind = rng.randrange(8 if d else 4)
        if kind > 5:
            return [value(d - 1) for _ in range(rng.randrange(4))]
        if kind > 3:
            return {rng.choice(["#", "id", "call_hash", "args", "children", "subvalues", "", "\u00e9\"/"]): value(d - 1) for _ in range(rng.randrange(4))}
        return [rng.choice([1, 2.5, 10**30, -0.0, 1e300]), rng.choice(["", "x", " [1, 2] ", '{"#": "y"}', "[", "\U0001f600", "\n"]), None, rng.random() < 0.5][kind]

    lines = [{"r": value(5), "s": value(4)} for _ in range(120)]
    rows = run(spark, *lines).cache()
    bodies = {r["object_hash"]: r["body"] for r in nesting.objects(rows).collect()}
    bridge = [b for b in nesting.bridge(rows).collect() if b["child_hash"]]
    assert {b["line_id"]: restored(b["child_hash"], bodies) for b in bridge if b["parent_hash"] is None} == dict(enumerate(lines))

    def occurrences(v):
        """Objects below v in the order of the text, each with the number of objects with the same parent before it."""
        inner, todo = [], [(x, k) for k, x in v.items()]
        out = []
        while todo:
            x, place = todo.pop(0)
            if isinstance(x, str) and x.strip()[:1] in ("[", "{") and x != "[":
                x, place = json.loads(x), f"{place}/$"
            if isinstance(x, list):
                todo = [(y, f"{place}/{i}") for i, y in enumerate(x)] + todo
            elif isinstance(x, dict):
                inner.append((place, len(inner)))
                out += [inner[-1], *occurrences(x)]
        return out

    for i, line in enumerate(lines):
        assert [(b["place"], b["ordinal"]) for b in sorted(bridge, key=lambda b: b["node"]) if b["line_id"] == i and b["parent_hash"]] == occurrences(line)


def test_deep_canonical():
    deep = lambda v: json_text._deep_canonical(v)
    for v in ({"b": [1.0, 2.5, {}], "a": {"d": None, "c": "\u00e9"}}, [], {}, [[1], [True, "x"]], {"x": [{"y": 1e3}]}):
        assert deep(v) == json_text.canonical(v)
    v = []
    for _ in range(60_000):
        v = [v]
    assert json_text.canonical(v) == "[" * 60_001 + "]" * 60_001


@pytest.mark.parametrize("depth", [900, 60_000])
def test_any_depth(spark, depth):
    text = '{"value_hash":"top","subvalues":' + "[" * depth + '{"value_hash":"x"}' + "]" * depth + "}"
    assert links(spark, text) == {("subvalue", "top", "x")}


def test_deep_parser():
    for text in ('{"a": [1, {"b": null}, "x"], "c": {}}', "[]", ' [ 1 , [ ] , {"k" : -2.5e3} ] ', '"s"', "{}"):
        assert json_text.deep_json(text) == json.loads(text)
    for text in ("[1,]", '{"a"}', "[1 2]", "[1]]", '{"a":1,}', "[", '{1:2}', ""):
        with pytest.raises(ValueError):
            json_text.deep_json(text)
