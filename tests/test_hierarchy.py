import random

import pytest

from tributary.operators import hierarchy as H

SCHEMA = "ns string, child string, parent string, v int, c int"


def frame(spark, edges, ns="t"):
    return spark.createDataFrame([(ns, a, b, 1, 2) for a, b in edges], SCHEMA)


def on_cycle(edges):
    up = {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    out = set()
    for n in up:
        seen, work = set(), list(up[n])
        while work:
            x = work.pop()
            if x not in seen:
                seen.add(x)
                work += up.get(x, ())
        if n in seen:
            out.add(n)
    return out


def graphs():
    rng = random.Random(5)
    loop = [(f"l{i}", f"l{(i + 1) % 40}") for i in range(40)]
    yield "long", loop + [("in", "l3"), ("l9", "out")] + [(f"c{i}", f"c{i + 1}") for i in range(90)]
    yield "self", [("a", "a"), ("b", "a"), ("c", "d"), ("d", "c"), ("c", None), (None, "c"), ("", "b")]
    yield "two loops", loop + [(f"m{i}", f"m{(i + 1) % 7}") for i in range(7)] + [("l0", "m0")]
    yield "joined loops", loop + [("l0", "l20"), ("l30", "l5"), ("x", "l1"), ("l1", "y"), ("y", "l1")]
    yield "random", [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)]
    yield "tree", [(f"n{i}", f"n{i // 2}") for i in range(1, 60)] * 2
    yield "none", []


def test_cycles(spark):
    """All graphs at once, each in a namespace of its own."""
    all_ = None
    for name, edges in graphs():
        f = frame(spark, edges, name)
        all_ = f if all_ is None else all_.unionByName(f)
    got = sorted((r["ns"], r["node"]) for r in H.cycles(all_).collect())
    assert got == sorted((name, n) for name, edges in graphs() for n in on_cycle(edges))


@pytest.mark.parametrize("name,core", [("joined loops", 12), ("self", 0)])
def test_cycles_large_core(spark, name, core):
    """A small core limit makes the distributed ways run."""
    edges = dict(graphs())[name]
    got = [r["node"] for r in H.cycles(frame(spark, edges), core_links=core).collect()]
    assert sorted(got) == sorted(on_cycle(edges))


def test_hierarchy(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 2)
    rng = random.Random(2)
    edges = [(f"n{i:03}", f"n{rng.randrange(max(0, i - 9), i):03}") for i in range(1, 150)] + [("n000", None), ("alone", None)]
    edges += [("n010", "n002"), ("x", "y"), ("y", "x"), ("under", "x"), ("deep", "under"), ("lost", "no_row"), ("n001", "n000")]
    rows = {r["node"]: r for r in H.hierarchy(frame(spark, edges)).collect()}
    loops = on_cycle(edges)
    ups = {}
    for a, b in edges:
        if a is not None and b is not None:
            ups.setdefault(a, set()).add(b)
    assert set(rows) == {x for e in edges for x in e if x is not None}
    up = {}
    for r in rows.values():
        n = r["node"]
        assert r["on_cycle"] == (n in loops) and r["n_parents"] == len(ups.get(n, ()))
        keys = r["path"].split("/")
        assert keys[-1] == n and keys[0] == r["root"] and r["depth"] == len(keys) - 1
        if len(keys) > 1:
            assert keys[-2] in ups[n] and rows[keys[-2]]["path"] == "/".join(keys[:-1])
            up[n] = keys[-2]
        else:
            assert n in loops or not ups.get(n) or ups[n] <= loops
    for r in rows.values():
        below = {m for m, x in rows.items() if x["path"].startswith(r["path"] + "/")}
        inside = {m for m, x in rows.items() if x["root"] == r["root"] and r["pos"] <= x["pos"] <= r["last_pos"]} - {r["node"]}
        assert inside == below and r["n_descendants"] == len(below)


def test_long_chains(spark, monkeypatch):
    """Chains far longer than a block and a round of leaves, with branches off them: the core is placed by doubling."""
    monkeypatch.setattr(H, "BLOCK", 16)
    edges = [(f"a{i:03}", f"a{i - 1:03}") for i in range(1, 200)] + [(f"b{i:03}", f"b{i - 1:03}") for i in range(1, 70)] + [("b000", "a100"), ("twig", "a050"), ("b069", None), ("leaf", "b060")]
    up = {c: p for c, p in edges if p}
    want = {}
    for n in {x for e in edges for x in e if x}:
        path = [n]
        while path[-1] in up:
            path.append(up[path[-1]])
        want[n] = "/".join(reversed(path))
    rows = {r["node"]: r for r in H.hierarchy(frame(spark, edges)).collect()}
    assert {n: r["path"] for n, r in rows.items()} == want
    assert all(r["n_descendants"] == sum(w.startswith(want[n] + "/") for w in want.values()) == r["last_pos"] - r["pos"] and r["depth"] == want[n].count("/") for n, r in rows.items())
    assert sorted(r["pos"] for r in rows.values()) == list(range(len(want)))


def test_namespaces_and_empty(spark):
    e = frame(spark, [("a", "b")], "p").unionByName(frame(spark, [("b", "a")], "q"))
    assert H.cycles(e).collect() == []
    assert {(r["ns"], r["node"], r["depth"]) for r in H.hierarchy(e).collect()} == {("p", "b", 0), ("p", "a", 1), ("q", "a", 0), ("q", "b", 1)}
    assert H.hierarchy(e.limit(0)).collect() == []


def test_star(spark):
    """Many children of one node."""
    rows = H.hierarchy(frame(spark, [(f"c{i}", "hub") for i in range(500)])).collect()
    pos = sorted(r["pos"] for r in rows)
    assert pos == list(range(501)) and next(r for r in rows if r["node"] == "hub")["n_descendants"] == 500


def test_descendants_by_all_parents(spark):
    """Nodes with several parents are below each of them, also across further links; cycles stay apart."""
    rng = random.Random(5)
    edges = [(f"n{i:02}", f"n{rng.randrange(max(0, i - 12), i):02}") for i in range(1, 60) for _ in range(rng.randrange(1, 4))]
    edges += [("x", "y"), ("y", "x"), ("under", "x"), ("n05", "under"), ("alone", None)]
    links = {(c, p) for c, p in edges if p is not None and not {c, p} & {"x", "y"}}
    below = {}
    for n in {x for e in edges for x in e if x is not None}:
        reached, work = set(), [n]
        while work:
            at = work.pop()
            new = {c for c, p in links if p == at} - reached
            reached |= new
            work += new
        below[n] = reached
    rows = H.descendants(frame(spark, edges)).collect()
    own = {r["node"]: r for r in rows if r["own"]}
    assert set(own) == set(below)
    for n, want in below.items():
        mine = [r for r in rows if r["node"] == n]
        got = [m for r in mine for m, x in own.items() if x["root"] == r["root"] and r["pos"] <= x["pos"] <= r["last_pos"]]
        assert sorted(got) == sorted(want | {n}) and {r["n_descendants"] for r in mine} == {len(want)}
    tree = {r["node"]: r for r in H.hierarchy(frame(spark, edges)).collect()}
    kept = {(n, r["path"].split("/")[-2]) for n, r in tree.items() if r["depth"]}
    more = H.further(frame(spark, edges)).collect()
    assert {(r["node"], r["parent"]) for r in more} == links - kept and len(more) == len(links - kept)
    assert all(r["path"] == tree[r["parent"]]["path"] + "/" + r["node"] and r["depth"] == tree[r["parent"]]["depth"] + 1 for r in more)
