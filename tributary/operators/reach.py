"""Walks over a graph of links (c, p) of 16-byte digests by one task, for graphs of at most LINKS links.

Nodes are numbered, links are arrays of numbers by child; every link is followed once, however long the way.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Links, or links and candidates, that one task may hold: about 220 bytes each at the peak.
LINKS = 4_000_000
#: Nodes of a group from which one pass over all links is made for many such groups, and groups a pass, 64 at most.
MANY, PASS = 64, 64
#: Nodes in the middle of many ways, whose ways are known before any search, 64 at most.
HUBS = 64


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    """16-byte values as rows of two numbers."""
    return np.concatenate([np.zeros((0, 2), "u8"), *[np.frombuffer(x.buffers()[1], "u8", 2 * len(x), 16 * x.offset).reshape(-1, 2) for x in column.cast(pa.binary(16)).chunks if len(x)]])


def numbered(*columns: pa.ChunkedArray) -> tuple[int, list[np.ndarray]]:
    """How many different values there are in the columns, and the columns as numbers of values."""
    both = np.concatenate([_digests(c) for c in columns])
    kinds, first, at = np.unique(np.ascontiguousarray(both[:, 0]), return_index=True, return_inverse=True)
    if (both[first[at], 1] != both[:, 1]).any():  # the first halves of two digests agree
        kinds, at = np.unique(both.view("S16").ravel(), return_inverse=True)
    return len(kinds), np.split(at.astype("i4").ravel(), np.cumsum([len(c) for c in columns])[:-1])


def ordered(n: int, a: np.ndarray, b: np.ndarray) -> tuple[array, array]:
    """Links a to b of n nodes: of node v, those at places at[v] to at[v + 1] of the second array."""
    by = np.argsort(a, kind="stable")
    return array("i", np.searchsorted(a[by], np.arange(n + 1)).astype("i4").tobytes()), array("i", b[by].astype("i4").tobytes())


def strong(n: int, at: array, to: array) -> array:
    """The strongly connected component of each node: its place in an order in which links lead to the same or an earlier one.  Tarjan's method, without recursion."""
    comp, low, num = array("i", [-1]) * n, array("i", [0]) * n, array("i", [0]) * n
    count, done, stack = 0, 0, []
    for root in range(n):
        if num[root]:
            continue
        work = [[root, at[root]]]
        count += 1
        num[root] = low[root] = count
        stack.append(root)
        while work:
            v, i = top = work[-1]
            if i < at[v + 1]:
                top[1] = i + 1
                w = to[i]
                if not num[w]:
                    count += 1
                    num[w] = low[w] = count
                    stack.append(w)
                    work.append([w, at[w]])
                elif comp[w] < 0 and num[w] < low[v]:
                    low[v] = num[w]
                continue
            work.pop()
            if work and low[v] < low[work[-1][0]]:
                low[work[-1][0]] = low[v]
            if low[v] == num[v]:
                while True:
                    w = stack.pop()
                    comp[w] = done
                    if w == v:
                        break
                done += 1
    return comp


def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, p) of one task, a null c marking a start p: the nodes (v) that are reached from the starts, with these."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    begin = t.filter(t["c"].is_null())["p"]
    t = t.filter(t["c"].is_valid())
    n, (start, a, b) = numbered(begin, t["c"], t["p"])
    at, to = ordered(n, a, b)
    seen = bytearray(n)
    work = start.tolist()
    for v in work:
        seen[v] = 1
    while work:
        v = work.pop()
        for w in to[at[v] : at[v + 1]]:
            if not seen[w]:
                seen[w] = 1
                work.append(w)
    numbers = np.concatenate([start, a, b])
    place = np.unique(numbers, return_index=True)[1][np.frombuffer(seen, "u1").astype(bool)]
    whole = pa.chunked_array([*begin.chunks, *t["c"].chunks, *t["p"].chunks], pa.binary())
    yield from pa.table({"v": whole.take(pa.array(place))}).to_batches(max_chunksize=50_000)


def _below(n: int, at: array, to: array, own: dict[int, int]) -> array:
    """Of nodes whose links lead to lower numbers: the bits (own) of all nodes from which links lead to a node, in one pass."""
    bits = array("Q", [0]) * n
    for v in range(n - 1, -1, -1):
        x = bits[v] | own.get(v, 0)
        if x:
            for p in to[at[v] : at[v + 1]]:
                bits[p] |= x
    return bits


def _above(n: int, at: array, to: array, own: dict[int, int]) -> array:
    """The bits of all nodes to which links lead from a node."""
    bits = array("Q", [0]) * n
    for v in range(n):
        x = 0
        for p in to[at[v] : at[v + 1]]:
            x |= bits[p] | own.get(p, 0)
        bits[v] = x
    return bits


def _ancestors(n: int, at: array, to: array, first: array, members: array) -> Iterator[tuple[int, int]]:
    """(group, node) of the nodes of a group, members[first[group]:first[group + 1]], that are ancestors of another of it; links lead from children to parents, which have lower numbers."""
    size = np.diff(np.frombuffer(first, "i4"))
    large = np.flatnonzero(size > MANY).tolist()
    for i in range(0, len(large), PASS):
        own: dict[int, int] = defaultdict(int)
        for k, g in enumerate(large[i : i + PASS]):
            for v in members[first[g] : first[g + 1]]:
                own[v] |= 1 << k
        bits = _below(n, at, to, own)
        yield from ((g, v) for k, g in enumerate(large[i : i + PASS]) for v in members[first[g] : first[g + 1]] if bits[v] >> k & 1)
    small = np.flatnonzero((size > 1) & (size <= MANY)).tolist()
    if not small:
        return
    # Ways through a hub are told by bits; the search for others doesn't enter one.
    parents = np.diff(np.frombuffer(at, "i4")).astype("i8")
    children = np.bincount(np.frombuffer(to, "i4"), minlength=n)
    top = np.argsort(-parents * children, kind="stable")[:HUBS].tolist()
    hub = {v: 1 << k for k, v in enumerate(top)}
    leads, led = _below(n, at, to, hub), _above(n, at, to, hub)
    for v, x in hub.items():
        leads[v] |= x
        led[v] |= x
    for g in small:
        nodes = members[first[g] : first[g + 1]]
        among, low, found, seen = set(nodes), min(nodes), set(), set()
        for x in nodes:
            if leads[x] and any(leads[x] & led[y] for y in nodes if y != x):
                found.add(x)
        work = [v for v in nodes if v not in hub]
        while work:
            v = work.pop()
            for p in to[at[v] : at[v + 1]]:
                if p >= low and p not in seen and p not in hub:
                    seen.add(p)
                    if p in among:
                        found.add(p)
                    work.append(p)
        yield from ((g, v) for v in found)


def ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, c, p) of one task, links from c to its parent p with a null g, and nodes c of a group g with a null p: the rows (g, c)
    of nodes that are ancestors of another node of their group, those of one cycle not of each other."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    del got
    own = t.select(["g", "c"]).filter(t["g"].is_valid())
    t = t.select(["c", "p"]).filter(t["g"].is_null())
    n, (a, b, c) = numbered(t["c"], t["p"], own["c"])
    n_groups, (g,) = numbered(own["g"])
    del t
    comp = np.frombuffer(strong(n, *ordered(n, a, b)), "i4")
    a, b, c = comp[a], comp[b], comp[c]
    n = int(comp.max(initial=-1)) + 1
    links = np.unique((a.astype("i8") * n + b)[a != b])
    at, to = ordered(n, links // max(n, 1), links % max(n, 1))
    rows = np.unique(g.astype("i8") * n + c)
    groups = ordered(n_groups, rows // max(n, 1), rows % max(n, 1))
    hits = np.fromiter((k * n + v for k, v in _ancestors(n, at, to, *groups)), "i8")
    keep = np.isin(g.astype("i8") * n + c, hits)
    yield from own.filter(pa.array(keep)).to_batches(max_chunksize=50_000)
