"""Heavy paths of a forest whose nodes (v) have one parent (up) or none.

*Sizes.*  Leaves are taken off round after round, each adding its size to its parent's; one shuffle of what is left a round.  Where a
round takes less than a quarter, the core that is left (long thin chains) gets its sizes by pointer doubling, in as many rounds
as the logarithm of its depth, and a node is out once its pointer is beyond the root.

*Heavy paths.*  Each node's largest child continues its chain, all others start one.  A node's position is its parent's plus an
offset: 1 for the heavy child, and for the others what comes before them, in an order by bucket and digest, so no task
adds up all children of one node.  So a chain is contiguous, and a node's descendants are the positions up to its own plus its size.

*Places.*  From the roots down, the core by doubling and then the rounds of leaves in reverse: depth, position, root, the head of
the chain, the place in the chain, and how many chains are above.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.scratch import Scratch

#: Parts in which the children of one node are ordered.
BUCKETS = 64
_PLACE = ("v", "up", "size", "depth", "pos", "root", "head", "idx", "light")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass
class _Sized:
    """Nodes (v, up, size) in the rounds in which they were taken off, and the core."""

    rounds: list[DataFrame]
    core: DataFrame | None


def _sizes(nodes: DataFrame, n: int, s: Scratch) -> _Sized:
    rounds: list[DataFrame] = []
    alive, total = nodes.select("v", "up", F.lit(1).cast("bigint").alias("size")), n
    while total:
        rows = [
            alive.select("v", "up", "size", F.lit(False).alias("kid")),
            alive.where("up is not null").select(F.col("up").alias("v"), _null("binary").alias("up"), F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("kid")),
        ]
        if rounds:
            rows.append(rounds[-1].where("up is not null").select(F.col("up").alias("v"), _null("binary").alias("up"), "size", F.lit(False).alias("kid")))
        got, kids = s.counted(union(rows).groupBy("v").agg(F.max("up").alias("up"), F.sum("size").alias("size"), F.max("kid").alias("kid")), F.col("kid"))
        rounds.append(got.where("not kid").select("v", "up", "size"))
        alive = got.where("kid").select("v", "up", "size")
        if kids * 4 > total * 3:
            return _Sized(rounds, _core(alive, rounds[-1], s))
        total = kids
    return _Sized(rounds, None)


def _core(alive: DataFrame, last: DataFrame, s: Scratch) -> DataFrame:
    """(v, up, size) of what is left; last are the leaves taken off last, which haven't been added yet."""
    more = last.where("up is not null").select(F.col("up").alias("v"), _null("binary").alias("up"), "size")
    own = s.cut(alive.unionByName(more).groupBy("v").agg(F.max("up").alias("up"), F.sum("size").alias("size")))
    done = [own.where("up is null").select("v", "size")]
    active, left = own.where("up is not null").select("v", F.col("up").alias("jump"), "size"), 1
    while left:
        far = active.select(F.col("v").alias("jump"), F.col("jump").alias("next"))
        looked = active.join(far, "jump", "left").select("v", F.col("next").alias("jump"), "size")
        sent = active.select(F.col("jump").alias("v"), _null("binary").alias("jump"), "size")
        new, left = s.counted(looked.unionByName(sent).groupBy("v").agg(F.max("jump").alias("jump"), F.sum("size").alias("size")), F.col("jump").isNotNull())
        done.append(new.where("jump is null").select("v", "size"))
        active = new.where("jump is not null")
    size = union(done).groupBy("v").agg(F.sum("size").alias("size"))
    return s.cut(own.select("v", "up").join(size, "v"))


def _offsets(sized: DataFrame) -> DataFrame:
    """(v, up, size, level, heavy, off) of the nodes with a parent."""
    bucket = lambda v: F.pmod(F.xxhash64(v), F.lit(BUCKETS))
    child = sized.where("up is not null").withColumn("bucket", bucket("v")).repartition("up", "bucket")
    # The level is only asked for so that both uses of the exchange have the same columns, and it is made once.
    part = child.groupBy("up", "bucket").agg(F.sum("size").alias("total"), F.max(F.struct("size", "v", "level")).alias("top"))
    best = F.max("top").over(Window.partitionBy("up"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("up").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select("up", "bucket", best.alias("best"), before.alias("before")).select(
        "up", "bucket", F.col("best.v").alias("best"), F.col("best.size").alias("best_size"), (F.col("before") - F.when(bucket(F.col("best.v")) < F.col("bucket"), F.col("best.size")).otherwise(0)).alias("before"))
    heavy = F.col("v") == F.col("best")
    run = F.sum(F.when(heavy, 0).otherwise(F.col("size"))).over(Window.partitionBy("up", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    off = F.when(heavy, 1).otherwise(F.col("best_size") + 1 + F.col("before") + F.coalesce(run, F.lit(0)))
    return child.join(part, ["up", "bucket"]).select("v", "up", "size", "level", heavy.alias("heavy"), off.alias("off"))


def _below(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Places of rows (v, up, size, heavy, off) whose parents are placed."""
    above = placed.select(F.col("v").alias("up"), "depth", "pos", "root", "head", "idx", "light")
    j = rows.join(above, "up")
    return j.select(
        "v", "up", "size", (F.col("depth") + 1).alias("depth"), (F.col("pos") + F.col("off")).alias("pos"), "root", F.when(F.col("heavy"), F.col("head")).otherwise(F.col("v")).alias("head"),
        F.when(F.col("heavy"), F.col("idx") + 1).otherwise(0).alias("idx"), (F.col("light") + F.when(F.col("heavy"), 0).otherwise(1)).alias("light"))


def _core_places(core: DataFrame, roots: DataFrame, s: Scratch) -> DataFrame:
    """Places of the nodes of a core (v, up, size, heavy, off) and its roots, by doubling: jump is a node so far up, the rest sums up the way there."""
    big = lambda c: c.cast("bigint")
    start = core.select(
        "v", "up", "size", F.col("up").alias("jump"), big(F.lit(1)).alias("depth"), big(F.col("off")).alias("pos"), F.when(~F.col("heavy"), F.col("v")).alias("head"),
        big(F.when(F.col("heavy"), 1).otherwise(0)).alias("idx"), big(F.when(F.col("heavy"), 0).otherwise(1)).alias("light"), _null("binary").alias("root"))
    top = roots.select("v", "up", "size", _null("binary").alias("jump"), "depth", "pos", "head", "idx", "light", "root")
    done, active, left = [top], start, 1
    while left:
        far = union([*done, active]).select(F.col("v").alias("jump"), F.col("jump").alias("next"), *[F.col(c).alias(f"{c}_") for c in ("depth", "pos", "head", "idx", "light", "root")])
        plus = lambda c: (F.col(c) + F.col(f"{c}_")).alias(c)
        new, left = s.counted(active.join(far, "jump").select(
            "v", "up", "size", F.col("next").alias("jump"), plus("depth"), plus("pos"), F.coalesce("head", "head_").alias("head"),
            F.when(F.col("head").isNull(), F.col("idx") + F.col("idx_")).otherwise(F.col("idx")).alias("idx"), plus("light"), F.coalesce("root", "root_").alias("root")), F.col("jump").isNotNull())
        done.append(new.where("jump is null"))
        active = new.where("jump is not null")
    return union(done[1:]).select(*_PLACE) if len(done) > 1 else core.limit(0)


def places(nodes: DataFrame, n: int, s: Scratch) -> DataFrame:
    """(v, up, size, depth, pos, root, head, idx, light) of nodes (v, up), n of them, each once and with its parent among them.

    size counts the node; pos is below its tree's size; root and head are nodes; idx is the place in the chain from its head, 0;
    light is the number of chains above the node's own.
    """
    sized = _sizes(nodes, n, s)
    parts = [r.withColumn("level", F.lit(i)) for i, r in enumerate(sized.rounds)]
    if sized.core is not None:
        parts.append(sized.core.select("v", "up", "size").withColumn("level", F.lit(len(parts))))
    if not parts:
        return nodes.select("v", "up", *[_null(t).alias(c) for c, t in (("size", "bigint"), ("depth", "bigint"), ("pos", "bigint"), ("root", "binary"), ("head", "binary"), ("idx", "bigint"), ("light", "bigint"))])
    every = union(parts)
    kids = s.cut(_offsets(every), "level")
    zero = F.lit(0).cast("bigint")
    roots = every.where("up is null").select("v", "up", "size", zero.alias("depth"), zero.alias("pos"), F.col("v").alias("root"), F.col("v").alias("head"), zero.alias("idx"), zero.alias("light"))
    placed = [s.cut(roots)]
    own = lambda i: kids.where(F.col("level") == i)
    if sized.core is not None:
        placed.append(s.cut(_core_places(own(len(sized.rounds)), placed[0], s)))
    for i in reversed(range(len(sized.rounds))):
        placed.append(s.cut(_below(own(i), union(placed)).select(*[F.col(c).cast("bigint") if c in ("depth", "pos", "idx", "light") else c for c in _PLACE])))
    return union([p.select(*_PLACE) for p in placed])
