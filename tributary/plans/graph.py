"""Walks over recorded runs: reachability, trees, upstream dataflow, files and ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators import hierarchy, reach
from tributary.plans.provenance import Provenance
from tributary.scratch import Scratch


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- typed record edges and reachability


def edges(p: Provenance) -> DataFrame:
    """(src_type, src, label, dst_type, dst): who owns whom among the records, one row per link."""
    def e(df: DataFrame, st: str, s: str, label: str, dt: str, d: str) -> DataFrame:
        return df.where(F.col(s).isNotNull() & F.col(d).isNotNull()).select(
            F.lit(st).alias("src_type"), F.col(s).alias("src"), F.lit(label).alias("label"), F.lit(dt).alias("dst_type"), F.col(d).alias("dst"))
    return union([
        e(p.execution, "Execution", "id", "root_job", "Job", "job_id"),
        e(p.job, "Job", "id", "task", "Task", "task_hash"),
        e(p.job, "Job", "id", "call", "CallNode", "call_hash"),
        e(p.job.where("id <> parent_id"), "Job", "parent_id", "child_job", "Job", "id"),
        e(p.call, "CallNode", "call_hash", "task", "Task", "task_hash"),
        e(p.call, "CallNode", "call_hash", "result", "Value", "value_hash"),
        e(p.argument, "CallNode", "call_hash", "argument", "Value", "value_hash"),
        e(p.argument, "CallNode", "call_hash", "upstream", "CallNode", "result_call_hash"),
        e(p.call_edge, "CallNode", "parent_id", "child_call", "CallNode", "child_id"),
        e(p.subvalue, "Value", "parent_value_hash", "part", "Value", "value_hash"),
        e(p.tag.where("next_hash is not null"), "Tag", "tag_hash", "superseded_by", "Tag", "next_hash"),
        p.tag.where("is_current").select(F.col("entity_type").alias("src_type"), F.col("entity_id").alias("src"), F.lit("tag").alias("label"), F.lit("Tag").alias("dst_type"), F.col("tag_hash").alias("dst")),
    ])


def reachable(edges: DataFrame, roots: DataFrame, core_links: int = reach.LINKS) -> DataFrame:
    """(type, id): the roots (type, id) and all that is reached from them, each once.

    Only links to nodes with links of their own are followed, by one task once they are at most core_links.  While there are more, layer
    by layer, each cut and joined once; what was seen is taken out by anti-joins, so cycles end and diamonds don't multiply rows.
    After every few layers links to seen nodes, and from those that nothing leads to any more, are taken out too.
    """
    s = Scratch(edges.sparkSession, "reach")
    node = lambda t, i: hierarchy.node_id(F.col(t), F.col(i))
    given = roots.select("type", "id").distinct()
    every = s.cut(edges.where("src is not null").select(node("src_type", "src").alias("c"), F.col("dst_type").alias("type"), F.col("dst").alias("id")))
    links = every.select("c", node("type", "id").alias("p")).where("p is not null")
    front = s.cut(given.where("id is not null").select(node("type", "id").alias("v")))
    seen = [front]

    # A node without links leads nowhere; at the end it is reached with any link to it.
    rest, n = s.counted(links.join(links.select(F.col("c").alias("p")).distinct(), "p", "left_semi").select("c", "p"))
    rounds = 0
    while n > core_links:
        front, more = s.counted(rest.join(front.withColumnRenamed("v", "c"), "c").select(F.col("p").alias("v")).distinct().join(union(seen), "v", "left_anti"))
        if not more:
            rest, n = rest.limit(0), 0
            break
        seen.append(front)
        rounds += 1
        if rounds % 4 == 0:
            seen = [s.cut(union(seen))]
            old, new = rest, rest.join(seen[0].withColumnRenamed("v", "p"), "p", "left_anti")
            starts = new.select(F.col("p").alias("c")).union(front.select("v")).distinct()
            rest, n = s.counted(new.join(starts, "c", "left_semi").select("c", "p"))
            s.free(old)
    if n:
        rows = rest.unionByName(front.select(F.lit(None).cast("binary").alias("c"), F.col("v").alias("p")))
        seen.append(s.cut(rows.coalesce(1).mapInArrow(reach.reached, "v binary")))
        s.free(rest)
    # Whatever is reached is a root or the end of a link of a node that was seen.
    return every.join(union(seen).withColumnRenamed("v", "c"), "c", "left_semi").select("type", "id").union(given).distinct()


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level) of an acyclic edge list (src, dst): the longest way from a node without a predecessor.

    Nodes on a cycle or behind one never get a level and are left out.
    """
    s = Scratch(edges.sparkSession, "topo")
    left = s.cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    todo = s.cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    done, level = [], 0
    while True:
        front, more = s.counted(todo.join(left.select(F.col("dst").alias("node")), "node", "left_anti"))
        if not more:
            return union(done) if done else todo.select("node", F.lit(0).alias("level")).limit(0)
        done.append(front.select("node", F.lit(level).alias("level")))
        left = s.cut(left.join(front.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst"))
        todo = s.cut(todo.join(front, "node", "left_anti"))
        level += 1


def levels(edges: DataFrame) -> DataFrame:
    """(node, level, on_cycle) of any edge list (src, dst): ``topological_levels`` with the nodes of a cycle as one node, so none is left out."""
    s = Scratch(edges.sparkSession, "levels")
    node = lambda c: hierarchy.node_id(F.lit("n"), F.col(c))
    own = edges.where("src is not null and dst is not null")
    links = s.cut(own.select(node("dst").alias("c"), node("src").alias("p")).distinct())
    loop = s.cut(hierarchy.cyclic(links, s))
    comp = s.cut(hierarchy.components(links, loop, s))
    keys = s.cut(own.select(F.col("src").alias("node")).union(own.select("dst")).distinct().withColumn("v", node("node")).join(comp, "v", "left").select(
        "node", "v", F.coalesce("comp", "v").alias("at"), F.col("comp").isNotNull().alias("on_cycle")))
    of = keys.select("v", "at")
    whole = links.join(of.toDF("c", "dst"), "c").join(of.toDF("p", "src"), "p").where("src <> dst").select("src", "dst")
    got = topological_levels(whole).withColumnRenamed("node", "at")
    return keys.join(got, "at", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"), "on_cycle")


# --- trees of jobs


def job_tree(p: Provenance) -> DataFrame:
    """(execution_id, id, depth, order_path): a job's preorder position is the order of order_path, siblings by start time then id.

    Jobs on a cycle of parents are alone, with depth 0.
    """
    key = F.concat(F.coalesce(F.date_format(F.col("start_time").cast("timestamp"), "yyyyMMddHHmmssSSSSSS"), F.lit("99999999999999999999")), F.lit("-"), F.col("id"))
    job = p.job.withColumn("key", key)
    up = job.select(F.col("id").alias("parent_id"), F.col("key").alias("parent"))
    links = job.select("key", "parent_id").join(up, "parent_id", "left").select(F.lit("job").alias("ns"), F.col("key").alias("child"), "parent")
    tree = hierarchy.hierarchy(links)
    return tree.select(F.col("node").alias("key"), F.col("depth").cast("int").alias("depth"), F.col("path").alias("order_path")).join(job.select("key", "id", "execution_id"), "key").select(
        "execution_id", "id", "depth", "order_path")


def job_list(p: Provenance, jobs: DataFrame, page: int, size: int) -> DataFrame:
    """(execution_id, position, id, depth): one page of jobs (id), those that a filter left, of each execution in the order of its tree, from 0."""
    tree = job_tree(p).join(jobs.select("id").distinct(), "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("execution_id").orderBy("order_path")) - 1
    return tree.select("execution_id", place.alias("position"), "id", "depth").where(F.col("position").between(page * size, (page + 1) * size - 1))


def inherited_execution(p: Provenance) -> DataFrame:
    """(id, root_id, execution_id): each job with its root job and the execution of that, at any depth."""
    links = p.job.select(F.lit("job").alias("ns"), F.col("id").alias("child"), F.col("parent_id").alias("parent"))
    roots = hierarchy.roots(links).select(F.col("node").alias("id"), F.col("root").alias("root_id"))
    of_root = p.job.select(F.col("id").alias("root_id"), "execution_id")
    return p.job.select("id").join(roots, "id").join(of_root, "root_id", "left").select("id", "root_id", "execution_id")


def rollback(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): all descendants of nodes (id) along edges (src, dst): what is no longer valid when these states are rolled back to."""
    typed = edges.select(F.lit("n").alias("src_type"), "src", F.lit("n").alias("dst_type"), "dst")
    roots = nodes.select(F.lit("n").alias("type"), "id")
    return reachable(typed, roots).select("id").join(nodes.select("id"), "id", "left_anti")


def advance(known_nodes: DataFrame, known_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, ...) and edges (src, dst) after adding those that aren't there yet; the rows there stay as they are."""
    new_n = nodes.dropDuplicates(["id"]).join(known_nodes.select("id"), "id", "left_anti").select(known_nodes.columns)
    new_e = edges.select("src", "dst").distinct().join(known_edges, ["src", "dst"], "left_anti")
    return known_nodes.unionByName(new_n), known_edges.unionByName(new_e)


# --- upstream dataflow, as tables of resolved edges over which a walk is a plain reachability


def _outer_calls(p: Provenance, internal: Sequence[str]) -> DataFrame:
    """Calls but those of internal tasks, named by their full names."""
    if not internal:
        return p.call
    full = F.when(F.col("namespace") != "", F.concat("namespace", F.lit("."), "name")).otherwise(F.col("name"))
    return p.call.join(p.task.where(full.isin(list(internal))).select(F.col("hash").alias("task_hash")), "task_hash", "left_anti")


def value_origin(p: Provenance, internal: Sequence[str] = (), scratch: Scratch | None = None) -> DataFrame:
    """(value_hash, call_hash): of each value, the call it came from, null if none.

    Candidates are the calls, but of internal tasks, whose result it is or is a part of.  A candidate that is an ancestor of another only
    passed it on, unless they are on one cycle; of the rest the call of the latest job counts (ties: the greatest hash).
    """
    calls = _outer_calls(p, internal)
    direct = calls.select("value_hash", "call_hash")
    part = p.subvalue.join(calls.select(F.col("value_hash").alias("parent_value_hash"), "call_hash"), "parent_value_hash").select("value_hash", "call_hash")
    s = scratch or Scratch(p.spark, "origin")
    cand = s.cut(direct.unionByName(part).where("value_hash is not null").distinct())
    own = cand.join(passed_on(cand, p.call_edge, s), ["value_hash", "call_hash"], "left_anti")
    started = p.job.where("call_hash is not null").groupBy("call_hash").agg(F.max("start_time").alias("start_time"))
    best = own.join(started, "call_hash").groupBy("value_hash").agg(F.max_by("call_hash", F.struct("start_time", "call_hash")).alias("call_hash"))
    return p.value.select("value_hash").join(best, "value_hash", "left")


def passed_on(cand: DataFrame, call_edge: DataFrame, s: Scratch, core_links: int = hierarchy.CORE_LINKS, task_links: int = reach.LINKS) -> DataFrame:
    """(value_hash, call_hash): the candidates (value_hash, call_hash) that are ancestors of another candidate of the value by links
    (parent_id, child_id), by any parent and through cycles; calls of one cycle are no ancestors of each other.

    One task tells them if links and candidates are at most task_links; else the calls' intervals of positions do, with cycles as one node.
    """
    node = lambda c: hierarchy.node_id(F.lit("call"), F.col(c))
    links, n = s.counted(call_edge.where("child_id is not null and parent_id is not null").select(node("child_id").alias("c"), node("parent_id").alias("p")).distinct())
    several = cand.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value_hash")
    own = cand.join(several, "value_hash", "left_semi").withColumn("c", node("call_hash"))
    if n <= task_links:
        ends = links.select("c").union(links.select("p")).distinct()
        own, m = s.counted(own.join(ends, "c", "left_semi").select(hierarchy.node_id(F.lit("value"), F.col("value_hash")).alias("g"), "c", "value_hash", "call_hash"))
        if n + m <= task_links:
            none = F.lit(None).cast("binary")
            rows = links.select(none.alias("g"), "c", "p").unionByName(own.select("g", "c", none.alias("p")))
            above = s.cut(rows.coalesce(1).mapInArrow(reach.ancestors, "g binary, c binary"))
            return own.join(above, ["g", "c"], "left_semi").select("value_hash", "call_hash")
    comp = s.cut(hierarchy.components(links, s.cut(hierarchy.cyclic(links, s, core_links)), s, core_links))

    def whole(df: DataFrame, c: str) -> DataFrame:
        return df.join(comp.select(F.col("v").alias(c), "comp"), c, "left").withColumn(c, F.hex(F.coalesce("comp", c))).drop("comp")

    wide = s.cut(whole(whole(links, "c"), "p").where("c <> p").select(F.lit("call").alias("ns"), F.col("c").alias("child"), F.col("p").alias("parent")).distinct())
    at = s.cut(whole(own, "c").select(F.col("value_hash").alias("g"), F.col("c").alias("node"), "call_hash"))
    above = hierarchy.with_descendants(at, wide)
    return at.join(above, ["g", "node"], "left_semi").select(F.col("g").alias("value_hash"), "call_hash")


def _with_parts(p: Provenance, df: DataFrame) -> DataFrame:
    """df (value_hash, ...) with value: the value itself, and each part of it."""
    part = df.join(p.subvalue.select(F.col("parent_value_hash").alias("value_hash"), F.col("value_hash").alias("value")), "value_hash")
    return df.withColumn("value", F.col("value_hash")).unionByName(part).distinct()


def child_producer(p: Provenance, internal: Sequence[str] = ()) -> DataFrame:
    """(call_hash, value, child_hash): the one child call, of no internal task, whose result is or holds a value that the call's result is or holds; none unless exactly one."""
    results = _with_parts(p, p.call.where("value_hash is not null").select("call_hash", "value_hash")).select("call_hash", "value").distinct()
    inner = results.join(_outer_calls(p, internal).select("call_hash"), "call_hash", "left_semi").withColumnRenamed("call_hash", "child_id")
    child = p.call_edge.select("parent_id", "child_id").join(inner, "child_id")
    pairs = child.join(results.withColumnRenamed("call_hash", "parent_id"), ["parent_id", "value"])
    return pairs.groupBy(F.col("parent_id").alias("call_hash"), "value").agg(F.count(F.lit(1)).alias("n"), F.min("child_id").alias("child_hash")).where("n = 1").drop("n")


def argument_origin(p: Provenance, scratch: Scratch | None = None) -> DataFrame:
    """(arg_hash, value, edge_kind, to, to_value, call_order): each upstream edge of each argument's value, and of each part of it.

    ``result``: to an upstream call, with the value if the call's result is or holds it, else with the whole result; call_order is the
    upstream call's under the latest parent that all upstream calls and the call itself share, null without one.
    ``routed``: to an argument of the latest parent call that is or holds the value.  ``origin``, with null ends: neither.
    """
    s = scratch or Scratch(p.spark, "args")
    arg = s.cut(_with_parts(p, p.argument.select("arg_hash", "call_hash", "value_hash", "result_call_hash")).drop("value_hash"))
    called = p.call.select(F.col("call_hash").alias("parent_id"), "called_at")
    up = arg.where("result_call_hash is not null")
    whole = p.call.where("value_hash is not null").select(F.col("call_hash").alias("result_call_hash"), "value_hash")
    held = _with_parts(p, whole).select("result_call_hash", "value", F.lit(True).alias("holds"))
    result = up.join(whole, "result_call_hash").join(held, ["result_call_hash", "value"], "left").select(
        "arg_hash", "value", F.col("result_call_hash").alias("to"), F.when(F.col("holds"), F.col("value")).otherwise(F.col("value_hash")).alias("to_value"))
    # Parents of the call and of all its argument's upstream calls.
    ends = p.argument.select("arg_hash", F.explode(F.array("call_hash", "result_call_hash")).alias("child_id")).where("child_id is not null").distinct()
    of = ends.join(p.call_edge, "child_id")
    need = ends.groupBy("arg_hash").agg(F.count(F.lit(1)).alias("need"))
    shared = of.groupBy("arg_hash", "parent_id").agg(F.countDistinct("child_id").alias("n")).join(need, "arg_hash").where("n = need").join(called, "parent_id")
    context = shared.groupBy("arg_hash").agg(F.max_by("parent_id", F.struct("called_at", "parent_id")).alias("parent_id"))
    order = s.cut(of.join(context, ["arg_hash", "parent_id"]).groupBy("arg_hash", F.col("child_id").alias("to")).agg(F.min("call_order").alias("call_order")))
    result = result.join(order, ["arg_hash", "to"], "left").select("arg_hash", "value", F.lit("result").alias("edge_kind"), "to", "to_value", "call_order")
    parent = p.call_edge.join(called, "parent_id").groupBy(F.col("child_id").alias("call_hash")).agg(F.max_by("parent_id", F.struct("called_at", "parent_id")).alias("parent_call"))
    above = arg.select(F.col("call_hash").alias("parent_call"), F.col("arg_hash").alias("to"), "value").distinct()
    routed = arg.select("arg_hash", "call_hash", "value").distinct().join(parent, "call_hash").join(above, ["parent_call", "value"]).select(
        "arg_hash", "value", F.lit("routed").alias("edge_kind"), "to", F.col("value").alias("to_value"), F.lit(None).cast("int").alias("call_order"))
    s.sweep()
    known = s.cut(result.unionByName(routed))
    s.sweep()
    none = F.lit(None).cast("string")
    origin = arg.select("arg_hash", "value").distinct().join(known, ["arg_hash", "value"], "left_anti").select(
        "arg_hash", "value", F.lit("origin").alias("edge_kind"), none.alias("to"), none.alias("to_value"), F.lit(None).cast("int").alias("call_order"))
    return known.unionByName(origin).distinct()


def call_arguments(p: Provenance) -> DataFrame:
    """(call_hash, arg_hash, value_hash, position): the arguments of each call in order, by position and then by key; nulls for a call without any."""
    place = F.row_number().over(Window.partitionBy("call_hash").orderBy(F.col("arg_position").asc_nulls_last(), F.col("arg_key").asc_nulls_first(), "arg_hash")) - 1
    own = p.argument.select("arg_hash", "call_hash", "value_hash", "arg_position", "arg_key").distinct().withColumn("position", place)
    without = p.call.select("call_hash").join(own, "call_hash", "left_anti")
    return own.select("call_hash", "arg_hash", "value_hash", "position").unionByName(without, allowMissingColumns=True)


#: The nine kinds of dataflow edges.
EDGE_KINDS = ("data", "call_arg", "call_result", "call_result_routing", "call_arg_result_routing", "call_arg_routing", "call_origin", "call_arg_origin", "call_value_origin")


def edge_kind(src_type: str, dst_type: str | None, same_value: Column) -> Column:
    """The kind of an edge by the types of its ends; dst_type None is an origin."""
    if dst_type is None:
        return F.lit({"CallNode": "call_origin", "ArgumentValue": "call_arg_origin", "Value": "call_value_origin"}[src_type])
    if (src_type, dst_type) == ("ArgumentValue", "CallNodeValue"):
        return F.when(same_value, "call_arg_result_routing").otherwise("data")
    return F.lit({("CallNode", "ArgumentValue"): "call_arg", ("Value", "CallNode"): "call_result", ("CallNodeValue", "CallNode"): "call_result",
                  ("CallNodeValue", "CallNodeValue"): "call_result_routing", ("ArgumentValue", "ArgumentValue"): "call_arg_routing"}[src_type, dst_type])


def dataflow_edges(p: Provenance, internal: Sequence[str] = ()) -> DataFrame:
    """(src_type, src, src_value, edge_kind, dst_type, dst, dst_value, position): the classified edges of the upstream dataflow, from what
    came out to what went in; an origin has null ends.

    Nodes are values, calls, arguments with a value (their own or a part of it) and calls with a value (their result or a part).
    position orders the edges of a node: arguments by position and then by key, upstream calls by their call order.
    """
    none = F.lit(None).cast("string")

    def e(df: DataFrame, st: str, s: str, sv: str | None, dt: str | None, d: str | None, dv: str | None, position: Column | None = None) -> DataFrame:
        val = lambda c: none if c is None else F.col(c)
        return df.select(F.lit(st).alias("src_type"), F.col(s).alias("src"), val(sv).alias("src_value"), edge_kind(st, dt, val(sv).eqNullSafe(val(dv))).alias("edge_kind"),
                         F.lit(dt).cast("string").alias("dst_type"), val(d).alias("dst"), val(dv).alias("dst_value"), (F.lit(None) if position is None else position).cast("int").alias("position"))
    s = Scratch(p.spark, "flow")
    inner = Scratch(p.spark, "inner")
    origin = s.cut(value_origin(p, internal, inner))
    inner.close()
    deeper = s.cut(child_producer(p, internal))
    inner.sweep()
    args = s.cut(argument_origin(p, inner))
    inner.close()
    results = _with_parts(p, p.call.where("value_hash is not null").select("call_hash", "value_hash")).select("call_hash", "value").distinct()
    own = call_arguments(p)
    return union([
        e(origin.where("call_hash is not null"), "Value", "value_hash", None, "CallNode", "call_hash", None),
        e(origin.where("call_hash is null"), "Value", "value_hash", None, None, None, None),
        e(deeper, "CallNodeValue", "call_hash", "value", "CallNodeValue", "child_hash", "value"),
        e(results.join(deeper, ["call_hash", "value"], "left_anti").withColumn("to", F.col("call_hash")), "CallNodeValue", "call_hash", "value", "CallNode", "to", None),
        e(own.where("arg_hash is not null"), "CallNode", "call_hash", None, "ArgumentValue", "arg_hash", "value_hash", F.col("position")),
        e(own.where("arg_hash is null"), "CallNode", "call_hash", None, None, None, None),
        e(args.where("edge_kind = 'result'"), "ArgumentValue", "arg_hash", "value", "CallNodeValue", "to", "to_value", F.col("call_order")),
        e(args.where("edge_kind = 'routed'"), "ArgumentValue", "arg_hash", "value", "ArgumentValue", "to", "to_value"),
        e(args.where("edge_kind = 'origin'"), "ArgumentValue", "arg_hash", "value", None, None, None),
    ])


def merge_call_values(edges: DataFrame, results: DataFrame) -> DataFrame:
    """Dataflow edges with one call value for each call that several call values lead to: the one with the call's whole result.

    results (call_hash, value_hash).  Edges into the replaced nodes lead to the unified one, each once.
    """
    s = Scratch(edges.sparkSession, "merge")
    edges = s.cut(edges)
    s.sweep()
    into = (F.col("dst_type") == "CallNode") & (F.col("src_type") == "CallNodeValue")
    several = edges.where(into).groupBy(F.col("dst").alias("call_hash")).agg(F.countDistinct("src", "src_value").alias("n")).where("n > 1").join(results, "call_hash").select("call_hash", F.col("value_hash").alias("whole"))
    old = edges.where(into).join(several, F.col("dst") == F.col("call_hash")).select(F.col("src").alias("was"), F.col("src_value").alias("was_value"), F.col("dst").alias("merged"), "whole").distinct()
    old = s.cut(old)

    def moved(df: DataFrame, end: str) -> DataFrame:
        typ, key, value = f"{end}_type", end, f"{end}_value"
        j = df.join(old, (F.col(typ) == "CallNodeValue") & (F.col(key) == F.col("was")) & F.col(value).eqNullSafe(F.col("was_value")), "left")
        return j.withColumn(key, F.coalesce("merged", key)).withColumn(value, F.when(F.col("merged").isNotNull(), F.col("whole")).otherwise(F.col(value))).drop("was", "was_value", "merged", "whole")

    kind = F.when(F.col("edge_kind").isin("data", "call_arg_result_routing"), F.when(F.col("src_value").eqNullSafe(F.col("dst_value")), "call_arg_result_routing").otherwise("data")).otherwise(F.col("edge_kind"))
    out = moved(moved(edges, "src"), "dst").withColumn("edge_kind", kind)
    return out.groupBy("src_type", "src", "src_value", "edge_kind", "dst_type", "dst", "dst_value").agg(F.min("position").alias("position"))


def upstream(p: Provenance, values: DataFrame, internal: Sequence[str] = ()) -> DataFrame:
    """(type, id, value): all that the values (value_hash) came from."""
    both = lambda t, c, v: F.struct(F.col(t).alias("t"), F.col(c).alias("c"), F.col(v).alias("v"))
    key = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    e = dataflow_edges(p, internal).where("dst is not null").select(F.col("src_type"), key(both("src_type", "src", "src_value")).alias("src"), F.col("dst_type"), key(both("dst_type", "dst", "dst_value")).alias("dst"))
    start = values.select(F.lit("Value").alias("t"), F.col("value_hash").alias("c"), F.lit(None).cast("string").alias("v"))
    got = reachable(e, start.select(F.col("t").alias("type"), key(F.struct("t", "c", "v")).alias("id")))
    x = F.from_json("id", "t string, c string, v string")
    return got.select("type", x["c"].alias("id"), x["v"].alias("value"))


def describe(edges: DataFrame, limit: int = 200) -> str:
    """Dataflow edges as text, a line each, for a screen; at most limit lines."""
    rows = edges.orderBy("src_type", "src", "src_value", "position", "dst").limit(limit).collect()
    node = lambda t, k: f"{t} {(k or '')[:8]}" if t else "origin"
    return "\n".join(f"{node(r.src_type, r.src)} <-- {node(r.dst_type, r.dst)} [{r.edge_kind}]" for r in rows)


# --- ids and files


def find_file(p: Provenance) -> DataFrame:
    """(path, value_hash, job_id, kind): per path the job that last made a file (kind result), else that last took it (arg), whole or in a value."""
    whole = p.file.select("path", "value_hash", F.col("value_hash").alias("held"))
    part = p.file.join(p.subvalue, "value_hash").select("path", "value_hash", F.col("parent_value_hash").alias("held"))
    files = whole.unionByName(part)
    jobs = p.job.where("call_hash is not null").select("call_hash", F.col("id").alias("job_id"), "start_time", "end_time")
    made = p.call.select("call_hash", F.col("value_hash").alias("held")).join(jobs, "call_hash").select("held", "job_id", F.lit("result").alias("kind"), F.lit(1).alias("rank"), F.col("end_time").alias("at"))
    took = p.argument.select("call_hash", F.col("value_hash").alias("held")).join(jobs, "call_hash").select("held", "job_id", F.lit("arg").alias("kind"), F.lit(0).alias("rank"), F.col("start_time").alias("at"))
    best = F.max_by(F.struct("value_hash", "job_id", "kind"), F.struct("rank", "at", "job_id", "value_hash"))
    return files.join(made.unionByName(took), "held").groupBy("path").agg(best.alias("b")).select("path", "b.value_hash", "b.job_id", "b.kind")


def infer_id(p: Provenance, text: str) -> DataFrame:
    """(type, id) that a short form names: ``-`` the latest execution, ``~n`` the n-th latest, a path with ``/`` a file, else a prefix."""
    from tributary.plans.lineage import LineageQuery

    if text == "-" or (text.startswith("~") and text[1:].isdigit()):
        n = 1 if text == "-" else int(text[1:])
        q = LineageQuery(p).filter_types(["Execution"]).order_by("time")
        return q.ordered().offset(n - 1).limit(1).select("type", "id")
    if "/" in text:
        return find_file(p).where(F.col("path") == text).select(F.lit("Value").alias("type"), F.col("value_hash").alias("id"))
    return LineageQuery(p).like_id(text).select("type", "id")
