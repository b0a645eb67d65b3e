"""Parent-child links to whole hierarchies: cycles first, then heavy paths.

Nodes are named by a namespace and a key; inside, both are one 16-byte digest, so links are short and several
tables run in one pass.

*Cycles.*  Nodes without a parent link or without a child link lie on no cycle; each round drops them from both ends
and splices out a random independent part of the nodes with one link in and one out, noting the link that took
their place.  So a chain of any length shrinks by a constant factor a round.  What is left is searched for strongly
connected components: by Tarjan's method in one task once it has at most CORE_LINKS links, by forward and backward
reach of a pivot per component otherwise.  Spliced nodes are on a cycle if their replacement link is.

*Heavy paths.*  Links to and from cycle nodes are cut; a node with several parents hangs under the one of the least digest,
and the links to its further parents are given by ``further`` and followed by ``descendants``.  ``forest`` gives each node its chain
and position.  Paths are made by concatenating chain segments: a chain has the path of the node above its head as its prefix, so
any path has at most log2(n) of them.  Segments are cut into blocks of BLOCK nodes, so no task holds a whole chain.  The descendants of
a node are an interval of positions, in an order in which every chain is contiguous.

Links with a null end are ignored, but a non-null end is still a node; repeated links count once; '' is a key; a node
that is its own parent is on a cycle; a parent without a row of its own is a root; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators import forest
from tributary.scratch import Scratch

#: Links of which one task may find the components: about 20 MB.
CORE_LINKS = 200_000
#: Nodes of a chain whose segment is made at once.
BLOCK = 256


def node_id(ns: F.Column, key: F.Column) -> F.Column:
    """16 bytes for a namespace and key."""
    return F.unhex(F.md5(F.concat(ns, F.lit("\x00"), key)))


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (c, p) of one task: those inside a strongly connected component.  Tarjan's method, without recursion."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    c, p = t.column("c").to_pylist(), t.column("p").to_pylist()
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(x, len(ids)) for x in c])
    b = np.array([ids.setdefault(x, len(ids)) for x in p])
    n = len(ids)
    order = np.argsort(a, kind="stable")
    at, to = np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()
    comp, low, num = [-1] * n, [0] * n, [0] * n
    count, stack, on = 0, [], [False] * n
    for root in range(n):
        if num[root]:
            continue
        work = [(root, at[root])]
        count += 1
        num[root] = low[root] = count
        stack.append(root)
        on[root] = True
        while work:
            v, i = work[-1]
            if i < at[v + 1]:
                work[-1] = (v, i + 1)
                w = to[i]
                if not num[w]:
                    count += 1
                    num[w] = low[w] = count
                    stack.append(w)
                    on[w] = True
                    work.append((w, at[w]))
                elif on[w]:
                    low[v] = min(low[v], num[w])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == num[v]:
                while True:
                    w = stack.pop()
                    on[w] = False
                    comp[w] = v
                    if w == v:
                        break
    comp = np.array(comp)
    inside = comp[a] == comp[b]
    yield pa.Table.from_batches(got).filter(pa.array(inside)).select(["c", "p"]).combine_chunks().to_batches()[0] if inside.any() else got[0].slice(0, 0).select(["c", "p"])


def _reach_components(links: DataFrame, s: Scratch) -> DataFrame:
    """The links inside strongly connected components of a core too large for one task.

    Every node gets the greatest node that reaches it as its colour; within a colour, what reaches the colour's own
    node backward is its component.  Components found are taken out with their links, until no link is left.
    """
    found, rest, left = None, links, 1
    while left:
        nodes = s.cut(rest.select(F.col("c").alias("v")).union(rest.select("p")).distinct().withColumn("colour", F.col("v")))
        while True:  # the greatest colour flows along the links
            flow = rest.join(nodes.withColumnRenamed("v", "c"), "c").groupBy(F.col("p").alias("v")).agg(F.max("colour").alias("new"))
            moved = (F.coalesce("new", "colour") > F.col("colour")).alias("moved")
            new, n_moved = s.counted(nodes.join(flow, "v", "left").select("v", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), moved), F.col("moved"))
            s.free(nodes)
            nodes = new.select("v", "colour")
            if not n_moved:
                break
        same = s.cut(
            rest.join(nodes.select(F.col("v").alias("c"), F.col("colour").alias("cc")), "c").join(nodes.select(F.col("v").alias("p"), F.col("colour").alias("pc")), "p")
            .where("cc = pc").select("c", "p", F.col("cc").alias("colour"))
        )
        member = s.cut(nodes.where("v = colour").select("v", "colour"))
        while True:  # backward from each colour's own node
            more = same.join(member.select(F.col("v").alias("p"), "colour"), ["p", "colour"]).select(F.col("c").alias("v"), "colour").distinct().join(member, ["v", "colour"], "left_anti")
            more, n_more = s.counted(more)
            if not n_more:
                break
            member = s.cut(member.unionByName(more))
        m = member.select("v")
        part = same.join(m.withColumnRenamed("v", "c"), "c", "left_semi").join(m.withColumnRenamed("v", "p"), "p", "left_semi").select("c", "p")
        found = s.cut(part if found is None else found.unionByName(part))
        rest, left = s.counted(same.select("c", "p").join(m.withColumnRenamed("v", "c"), "c", "left_anti").join(m.withColumnRenamed("v", "p"), "p", "left_anti"))
    return found if found is not None else links.limit(0)


def cyclic(links: DataFrame, s: Scratch, core_links: int = CORE_LINKS) -> DataFrame:
    """(v) of the nodes that reach themselves along links (c, p), given once each."""
    splices: list[DataFrame] = []
    cur, n, stuck = links, None, 0
    while True:
        # Nodes with a link in and one out, with their numbers and the only neighbour if there is one.
        node = (
            cur.select(F.col("c").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("in"), F.col("p").alias("up"), F.lit(None).cast("binary").alias("down"))
            .unionByName(cur.select(F.col("p").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("in"), F.lit(None).cast("binary").alias("up"), F.col("c").alias("down")))
            .groupBy("v").agg(F.sum("out").alias("out"), F.sum("in").alias("in"), F.min("up").alias("up"), F.min("down").alias("down"))
            .where("out > 0 and in > 0")
        )
        # A node is spliced out if its number of this round is below both neighbours': a third of a chain, no two adjacent.
        draw = lambda c: F.xxhash64(c, F.lit(len(splices)))
        chain = (F.col("out") == 1) & (F.col("in") == 1) & (draw("v") < draw("up")) & (draw("v") < draw("down"))
        node = s.cut(node.select("v", chain.alias("gone"), "up", "down"))
        kept = node.where("not gone").select("v")
        gone = node.where("gone").select("v", "up", "down")
        new = cur.join(kept.withColumnRenamed("v", "c"), "c", "left_semi").join(kept.withColumnRenamed("v", "p"), "p", "left_semi").select("c", "p")
        # A neighbour may itself have been dropped; the link that replaces the node is then dropped with it.
        bridge = gone.join(kept.withColumnRenamed("v", "down"), "down", "left_semi").join(kept.withColumnRenamed("v", "up"), "up", "left_semi")
        bridge = s.cut(bridge.select("v", F.col("down").alias("c"), F.col("up").alias("p")))
        new, n_new = s.counted(new.unionByName(bridge.select("c", "p")).distinct())
        splices.append(bridge)
        s.free(node, *([cur] if cur is not links else []))
        before, n, cur = n, n_new, new
        stuck = stuck + 1 if n == before else 0
        if n <= core_links:
            loops = s.cut(cur.coalesce(1).mapInArrow(_components, "c binary, p binary"))
            break
        if stuck > 3:
            loops = _reach_components(cur, s)
            break
    for bridge in reversed(splices):
        on = bridge.join(loops, ["c", "p"], "left_semi")
        both = on.select("c", F.col("v").alias("p")).unionByName(on.select(F.col("v").alias("c"), "p"))
        loops = s.cut(loops.unionByName(both))
    # A component's links cover its nodes; each node of a cycle is the child of one.
    return loops.select(F.col("c").alias("v")).distinct()


def components(links: DataFrame, cycle: DataFrame, s: Scratch, core_links: int = CORE_LINKS) -> DataFrame:
    """(v, comp) of the nodes on cycles (v) of links (c, p): the least node of their strongly connected component."""
    inner, n = s.counted(links.join(cycle.withColumnRenamed("v", "c"), "c", "left_semi").join(cycle.withColumnRenamed("v", "p"), "p", "left_semi").select("c", "p"))
    inner = s.cut(inner.coalesce(1).mapInArrow(_components, "c binary, p binary")) if n <= core_links else _reach_components(inner, s)
    # No link left leads out of a component: the least label spreads both ways, and a node takes its label's label.
    both = s.cut(inner.union(inner.select("p", "c")).toDF("v", "w").distinct())
    label, moved = s.cut(cycle.select("v", F.col("v").alias("comp"))), 1
    while moved:
        near = both.join(label.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("comp").alias("near"))
        low = label.join(near, "v").select("v", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        far = label.select(F.col("v").alias("comp"), F.col("comp").alias("far"))
        new, moved = s.counted(low.join(far, "comp").select("v", F.least("comp", "far").alias("comp"), (F.least("comp", "far") < F.col("was")).alias("moved")), F.col("moved"))
        label = new.select("v", "comp")
    return label


def _links(edges: DataFrame) -> DataFrame:
    """edges (ns, child, parent) as distinct (c, p)."""
    return edges.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select(
        node_id(F.col("ns"), F.col("child")).alias("c"), node_id(F.col("ns"), F.col("parent")).alias("p")).distinct()


def cycles(edges: DataFrame, core_links: int = CORE_LINKS) -> DataFrame:
    """(ns, node): the nodes of edges (ns, child, parent) that reach themselves by one step or more."""
    s = Scratch(edges.sparkSession, "cycles")
    links = s.cut(_links(edges))
    v = s.cut(cyclic(links, s, core_links))
    s.close(v)
    # A node on a cycle is the child of a link.
    return edges.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("ns", "child", node_id(F.col("ns"), F.col("child")).alias("v")).join(
        v, "v", "left_semi").select("ns", F.col("child").alias("node")).distinct()


class _Base:
    """Nodes, links outside cycles and heavy paths of edges (ns, child, parent)."""

    def __init__(self, edges: DataFrame, s: Scratch, core_links: int, acyclic: bool = False) -> None:
        none = lambda t: F.lit(None).cast(t)
        links = s.cut(_links(edges))
        loop = links.select(F.col("c").alias("v")).limit(0) if acyclic else s.cut(cyclic(links, s, core_links))
        self.live = links if acyclic else s.cut(links.join(loop.withColumnRenamed("v", "c"), "c", "left_anti").join(loop.withColumnRenamed("v", "p"), "p", "left_anti").select("c", "p"))

        def row(df: DataFrame, v: str, ns: F.Column, node: F.Column, up: F.Column, n: int, on: bool) -> DataFrame:
            return df.select(F.col(v).alias("v"), ns.alias("ns"), node.alias("node"), up.alias("up"), F.lit(n).cast("bigint").alias("n"), F.lit(on).alias("on"))

        keys = edges.select("ns", F.explode(F.array_distinct(F.array("child", "parent"))).alias("node")).where("node is not null").withColumn("v", node_id(F.col("ns"), F.col("node")))
        t, b = none("string"), none("binary")
        rows = row(keys, "v", F.col("ns"), F.col("node"), b, 0, False).unionByName(row(self.live, "c", t, t, F.col("p"), 0, False)).unionByName(
            row(links, "c", t, t, b, 1, False)).unionByName(row(loop, "v", t, t, b, 0, True))
        agg = rows.groupBy("v").agg(F.max("ns").alias("ns"), F.max("node").alias("node"), F.min("up").alias("up"), F.sum("n").alias("n_parents"), F.max("on").alias("on_cycle"))
        #: (v, ns, node, up, n_parents, on_cycle)
        self.nodes, n = s.counted(agg)
        #: (v, up, size, depth, pos, root, head, idx, light)
        self.places = forest.places(self.nodes, n, s)

    def extra(self) -> DataFrame:
        """(c, p): the links to further parents."""
        return self.live.join(self.places.where("up is not null").select(F.col("v").alias("c"), "up"), "c").where("p <> up").select("c", "p")


def _paths(base: _Base, s: Scratch, separator: str) -> DataFrame:
    """(v, ns, node, path, depth, root, n_parents, n_descendants, pos, last_pos, on_cycle) of all nodes."""
    st = base.places
    branch = st.where("idx = 0 and up is not null").select(F.col("up").alias("v")).distinct().withColumn("branch", F.lit(True))
    named = base.nodes.drop("up").join(st, "v").join(branch, "v", "left").withColumn("block", F.floor(F.col("idx") / BLOCK))
    named = s.cut(named)
    run = Window.partitionBy("head", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segment = F.concat_ws(separator, F.collect_list("node").over(run)).alias("segment")
    # Of chains of several blocks: the keys of all blocks before each.
    long, some = s.counted(named.where(F.col("idx") == BLOCK).select("head"))
    text = (named.join(long, "head", "left_semi") if some else named.limit(0)).groupBy("head", "block").agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("x")).select(
        "head", "block", F.concat(F.array_join(F.transform("x", lambda x: x["node"]), separator), F.lit(separator)).alias("text"))
    before = F.concat_ws("", F.collect_list("text").over(Window.partitionBy("head").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    inner = s.cut(text.select("head", "block", before.alias("inner")).where("block > 0"))
    # What a chain's prefix adds to that of the chain above: the segment down to the node above its head.
    over = named.select("v", "head", "block", "idx", "node", "branch").select("v", "head", "block", "branch", segment).where("branch").join(inner, ["head", "block"], "left").select(
        F.col("v").alias("up"), F.col("head").alias("over"), F.concat(F.coalesce("inner", F.lit("")), "segment", F.lit(separator)).alias("lead"))
    heads = named.where("idx = 0 and up is not null").select("head", "up", "light")
    chains = s.cut(heads.join(over, "up").select("head", "over", "lead", "light"), "light")
    placed = [s.cut(named.where("idx = 0 and up is null").select("head", F.lit("").alias("prefix"), F.col("node").alias("root_key")))]
    level = 1
    while True:
        prev = placed[-1].withColumnRenamed("head", "over")
        nxt, more = s.counted(chains.where(F.col("light") == level).join(prev, "over").select("head", F.concat("prefix", "lead").alias("prefix"), "root_key"))
        if not more:
            break
        placed.append(nxt)
        level += 1
    whole = forest.union(placed)
    starts = whole.select("head", F.lit(0).cast("bigint").alias("block"), "prefix", "root_key").unionByName(
        inner.join(whole, "head").select("head", "block", F.concat("prefix", "inner").alias("prefix"), "root_key"))
    rows = named.drop("root", "branch", "up", "light").withColumn("segment", segment)
    return rows.join(starts, ["head", "block"]).select(
        "v", "ns", "node", F.concat("prefix", "segment").alias("path"), "depth", F.col("root_key").alias("root"), "n_parents",
        (F.col("size") - 1).alias("n_descendants"), "pos", (F.col("pos") + F.col("size") - 1).alias("last_pos"), "on_cycle")


def hierarchy(edges: DataFrame, core_links: int = CORE_LINKS, separator: str = "/") -> DataFrame:
    """One row per node of edges (ns, child, parent), a null parent marking a root:

    ns, node, path (keys from the root to the node), depth (0 for a root), root, n_parents (distinct ones),
    n_descendants, pos and last_pos (the descendants of a node are the other nodes of its ns and root with
    pos between these two), on_cycle.  A node on a cycle is alone: its path is its key and it has no descendants;
    nodes below a cycle hang under roots of their own.  Of a node's parents only one counts for all but n_parents.
    The tables it cuts stay.
    """
    s = Scratch(edges.sparkSession, "hierarchy")
    return _paths(_Base(edges, s, core_links), s, separator).drop("v")


def roots(edges: DataFrame, core_links: int = CORE_LINKS) -> DataFrame:
    """(ns, node, root, depth) as in ``hierarchy``, without making paths."""
    s = Scratch(edges.sparkSession, "roots")
    base = _Base(edges, s, core_links)
    named = base.nodes.select("v", "ns", "node").join(base.places.select("v", "root", "depth"), "v").select("ns", "node", "depth", F.col("root").alias("v"))
    return named.join(base.nodes.select("v", F.col("node").alias("root")), "v").select("ns", "node", "root", "depth")


def further(edges: DataFrame, core_links: int = CORE_LINKS, separator: str = "/") -> DataFrame:
    """(ns, node, parent, path, depth): each link outside cycles to a parent that the node doesn't hang under in ``hierarchy``,
    and the path and depth that the node has by this link under its parent's own path."""
    s = Scratch(edges.sparkSession, "further")
    base = _Base(edges, s, core_links)
    nodes = s.cut(_paths(base, s, separator).select("v", "ns", "node", "path", "depth"))
    up = nodes.select(F.col("v").alias("p"), F.col("node").alias("parent"), F.col("path").alias("lead"), (F.col("depth") + 1).alias("depth"))
    return base.extra().join(nodes.select(F.col("v").alias("c"), "ns", "node"), "c").join(up, "p").select(
        "ns", "node", "parent", F.concat("lead", F.lit(separator), "node").alias("path"), "depth")


def _intervals(base: _Base, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, root, pos, last_pos) of each node's own subtree, and of the further subtrees below it, disjoint from its own and each other.

    Who has a further subtree is told by pieces of chains: all nodes from a chain's head to a place.  Each round goes up one chain, at
    most log2(n) rounds; then the subtrees that hang below others are handed on, a round for each further link on a way.
    """
    st = s.cut(base.places)
    above = s.cut(st.where("idx = 0 and up is not null").select("head", F.col("up").alias("v")).join(st.select("v", F.col("head").alias("over"), F.col("idx").alias("over_idx")), "v").select("head", "over", "over_idx"))
    front, more = s.counted(base.extra().select("c", F.col("p").alias("v")).join(st.select("v", "head", "idx"), "v").groupBy("c", "head").agg(F.max("idx").alias("idx")))
    pieces = [front]
    while more:
        front, more = s.counted(front.select("c", "head").join(above, "head").groupBy("c", F.col("over").alias("head")).agg(F.max("over_idx").alias("idx")))
        pieces.append(front)
    held = s.cut(forest.union(pieces).groupBy("c", "head").agg(F.max("idx").alias("idx")))
    # A further subtree below the root of another: what holds the other holds it too.
    at = held.select(F.col("c").alias("v")).distinct().join(st.select("v", "head", "idx"), "v").select(F.col("v").alias("over"), "head", F.col("idx").alias("at"))
    below = s.cut(held.join(at, "head").where("at <= idx and over <> c").select("over", "c").distinct())
    new, more = held, 1
    while more:
        found = new.withColumnRenamed("c", "over").join(below, "over").groupBy("c", "head").agg(F.max("idx").alias("idx"))
        new, more = s.counted(found.join(held.withColumnRenamed("idx", "known"), ["c", "head"], "left").where("known is null or idx > known").select("c", "head", "idx"))
        if more:
            held = s.cut(held.unionByName(new).groupBy("c", "head").agg(F.max("idx").alias("idx")))
    last = (F.col("pos") + F.col("size") - 1).alias("last_pos")
    sub = st.select(F.col("v").alias("c"), F.col("root").alias("c_root"), F.col("pos").alias("c_pos"), last.alias("c_last"))
    mine = st.select(F.col("v").alias("a"), "head", F.col("idx").alias("at"), "root", "pos", last)
    inside = (F.col("c_root") == F.col("root")) & F.col("c_pos").between(F.col("pos"), F.col("last_pos"))
    further_rows = held.join(mine, "head").where("at <= idx").select("a", "c", "root", "pos", "last_pos").join(sub, "c").where(~inside).select(
        "a", F.col("c_root").alias("root"), F.col("c_pos").alias("pos"), F.col("c_last").alias("last_pos"))
    reach = F.max("last_pos").over(Window.partitionBy("a", "root").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    # A further subtree holds the node's own one only on a cycle, so the own interval stays and the others are apart from it.
    return st.select(F.col("v").alias("a"), "root", "pos", last), s.cut(further_rows.distinct().withColumn("reach", reach).where("reach is null or reach < pos").drop("reach"))


def descendants(edges: DataFrame, core_links: int = CORE_LINKS) -> DataFrame:
    """(ns, node, root, pos, last_pos, own, n_descendants): disjoint intervals of positions that hold exactly a node and all its
    descendants along links outside cycles, by any parent.

    A node has one row with own, whose pos is its position and whose interval is its subtree in ``hierarchy``, and a row for each
    further subtree: of a node that hangs elsewhere and is reached from it by a way with a further link.  Intervals inside others are left out.
    """
    s = Scratch(edges.sparkSession, "descendants")
    base = _Base(edges, s, core_links)
    own, more = _intervals(base, s)
    size = F.col("last_pos") - F.col("pos") + 1
    extra = more.groupBy("a").agg(F.sum(size).alias("more"))
    n = own.join(extra, "a", "left").select("a", (size - 1 + F.coalesce("more", F.lit(0))).alias("n_descendants"))
    key = base.nodes.select(F.col("v").alias("a"), "ns", "node").join(n, "a")
    rows = own.withColumn("own", F.lit(True)).unionByName(more.withColumn("own", F.lit(False)))
    return rows.join(key, "a").join(base.nodes.select(F.col("v").alias("root"), F.col("node").alias("root_key")), "root").select(
        "ns", "node", F.col("root_key").alias("root"), "pos", "last_pos", "own", "n_descendants")


def with_descendants(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, node): the rows of groups (g, node) whose node has another node of its group as a descendant along edges (ns, child, parent) without cycles.

    Nodes are points on the line of positions: a node is kept if the next point at or behind the start of one of its intervals lies
    in the interval.  No pairs are made.  A node without a link has no descendants.
    """
    s = Scratch(edges.sparkSession, "within")
    base = _Base(edges, s, CORE_LINKS, acyclic=True)
    own, more = _intervals(base, s)
    at = s.cut(groups.select("g", "node").distinct().join(base.nodes.select(F.col("v").alias("a"), "node"), "node"))
    mine = at.join(own, "a")
    none = F.lit(None).cast("bigint")
    points = mine.select("g", "root", F.col("pos").alias("x"), F.col("pos").alias("point"), F.lit(None).cast("string").alias("node"), none.alias("last_pos"))
    inner = mine.select("g", "root", (F.col("pos") + 1).alias("x"), none.alias("point"), "node", "last_pos")
    outer = at.join(more, "a").select("g", "root", F.col("pos").alias("x"), none.alias("point"), "node", "last_pos")
    nearest = F.min("point").over(Window.partitionBy("g", "root").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = points.unionByName(inner).unionByName(outer).withColumn("nearest", nearest)
    return rows.where("node is not null and nearest <= last_pos").select("g", "node").distinct()


def descendant_counts(edges: DataFrame, core_links: int = CORE_LINKS) -> DataFrame:
    """(ns, node, n_descendants) of ``descendants``."""
    return descendants(edges, core_links).where("own").select("ns", "node", "n_descendants")
