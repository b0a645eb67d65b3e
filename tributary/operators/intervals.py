"""Overlapping intervals per entity: merged periods and the gaps between them, by dyadic blocks.

An interval of integers is cut into its canonical dyadic blocks (length 2**l, start a multiple of it).  Blocks that
lie in a larger block of the entity are removed, sibling pairs become their parent, level by level, and adjacent
blocks are joined; blocks are a mergeable form, so every task first does this on its own rows and only what is left
is shuffled.  Time is cut into slots of 2**SLOT_BITS units: the shuffle is by entity and slot, so one entity with a
large part of all rows is spread over its slots.  Whole slots travel as blocks of slots, of which an interval
has at most two a level however long it is.  Per entity there only remain the first and last period of each slot,
bounded by the span of time and not by the rows, and a window joins these.

Intervals are half open; those that touch are one.  Rows with a null entity, null bound or an end not after the start
are left out.  Repeated rows change nothing; an empty table gives no rows; columns but the three named are ignored.
Bounds are timestamps (microseconds, ``timestamp_ntz``) or integers between -2**60 and 2**60.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A slot of microseconds is 2**36, about 19 hours.
SLOT_BITS = 36
#: Intervals that a task holds before it merges them.
CHUNK_ROWS = 100_000
_OFFSET = 1 << 60  # makes all positions positive; a multiple of every slot


def dyadic(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, index) of the canonical blocks of all intervals [lo, hi), lo < hi, both at least 0."""
    levels, index, level = [], [], 0
    while len(lo):
        odd = (lo & 1).astype(bool)
        index.append(lo[odd])
        lo = lo + odd
        odd_hi = (hi & 1).astype(bool) & (lo < hi)
        hi = hi - odd_hi
        index.append(hi[odd_hi])
        levels.append(np.full(len(index[-1]) + len(index[-2]), level, np.int8))
        lo, hi, level = lo >> 1, hi >> 1, level + 1
        keep = lo < hi
        lo, hi = lo[keep], hi[keep]
    if not index:
        return np.zeros(0, np.int8), np.zeros(0, np.int64)
    return np.concatenate(levels), np.concatenate(index)


def uncovered(level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that no other block contains, each once, in order of start.  Blocks nest or are disjoint."""
    start = index << level.astype(np.int64)
    order = np.lexsort((-level, start))
    level, index, start = level[order], index[order], start[order]
    end = start + (np.int64(1) << level.astype(np.int64))
    reach = np.maximum.accumulate(end)
    keep = np.ones(len(start), bool)
    keep[1:] = start[1:] >= reach[:-1]
    return level[keep], index[keep]


def merge_siblings(level: np.ndarray, index: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace both halves of a block by the block, from below up to level top."""
    out_l, out_i = [], []
    up = np.zeros(0, np.int64)
    order = np.argsort(level, kind="stable")
    level, index = level[order], index[order]
    bounds = np.searchsorted(level, np.arange(top + 2))
    for l in range(top + 1):
        at = np.sort(np.concatenate([index[bounds[l]:bounds[l + 1]], up]))
        if l < top and len(at) > 1:
            pair = np.flatnonzero((at[:-1] & 1 == 0) & (at[1:] == at[:-1] + 1))
            up = at[pair] >> 1
            alone = np.ones(len(at), bool)
            alone[pair] = alone[pair + 1] = False
            at = at[alone]
        else:
            up = np.zeros(0, np.int64)
        out_l.append(np.full(len(at), l, np.int8))
        out_i.append(at)
    return np.concatenate(out_l), np.concatenate(out_i)


def merge(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal periods (group, lo, hi) of intervals, in order.  group: integers from 0."""
    if not len(lo):
        return group, lo, hi
    base = int(lo.min()) >> SLOT_BITS << SLOT_BITS
    bits = (int(hi.max()) - base).bit_length()
    if bits + int(group.max()).bit_length() > 62:  # too wide for one integer: by halves of the groups
        if group.min() == group.max():
            g, a, b = merge(np.zeros(len(group), np.int64), lo, hi)
            return g + group[0], a, b
        mid = (int(group.min()) + int(group.max())) // 2
        low = group <= mid
        first = merge(group[low], lo[low], hi[low])
        g2, a2, b2 = merge(group[~low] - (mid + 1), lo[~low], hi[~low])
        return tuple(np.concatenate(x) for x in zip(first, (g2 + mid + 1, a2, b2)))
    # Each group is an aligned block of 2**bits positions, so blocks of different groups never meet.
    at = (group << bits) - base
    level, index = merge_siblings(*uncovered(*dyadic(at + lo, at + hi)), bits)
    start = index << level.astype(np.int64)
    end = start + (np.int64(1) << level.astype(np.int64))
    order = np.argsort(start)
    start, end = start[order], end[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != end[:-1]) | (start[1:] >> bits != start[:-1] >> bits)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(start)) - 1
    g = start[at] >> bits
    return g, start[at] - (g << bits) + base, end[last] - (g << bits) + base


def _ints(col: pa.Array) -> np.ndarray:
    if pa.types.is_timestamp(col.type):
        col = col.cast(pa.timestamp("us")).cast(pa.int64())
    return col.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a task's rows (k, lo, hi), then cut what is left into slots (level -1) and blocks of slots."""
    names: dict[object, int] = {}
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        g, lo, hi = merge(*(np.concatenate(x) for x in zip(*held)))
        keys = pa.array(list(names))
        first, last = lo >> SLOT_BITS, (hi - 1) >> SLOT_BITS
        one = first == last
        rows = [(g[one], np.full(one.sum(), -1, np.int8), first[one], lo[one], hi[one])]
        g, lo, hi, first, last = (x[~one] for x in (g, lo, hi, first, last))
        full_lo, full_hi = -(-lo >> SLOT_BITS), hi >> SLOT_BITS  # slots that are wholly covered
        head = lo < full_lo << SLOT_BITS
        rows.append((g[head], np.full(head.sum(), -1, np.int8), first[head], lo[head], full_lo[head] << SLOT_BITS))
        tail = hi > full_hi << SLOT_BITS
        rows.append((g[tail], np.full(tail.sum(), -1, np.int8), last[tail], full_hi[tail] << SLOT_BITS, hi[tail]))
        for i in np.flatnonzero(full_lo < full_hi):
            level, index = dyadic(full_lo[i:i + 1], full_hi[i:i + 1])
            start = index << (level.astype(np.int64) + SLOT_BITS)
            rows.append((np.full(len(level), g[i]), level, index, start, start + (np.int64(1) << (level.astype(np.int64) + SLOT_BITS))))
        g, level, index, lo, hi = (np.concatenate(x) for x in zip(*rows))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(g)), pa.array(level, pa.int8()), pa.array(index), pa.array(lo), pa.array(hi)], ["k", "level", "slot", "lo", "hi"])
        held.clear()
        names.clear()

    n = 0
    for b in batches:
        codes, values = pd.factorize(b.column("k").to_numpy(zero_copy_only=False))
        ids = np.array([names.setdefault(v, len(names)) for v in values], np.int64)
        held.append((ids[codes], _ints(b.column("lo")) + _OFFSET, _ints(b.column("hi")) + _OFFSET))
        n += b.num_rows
        if n >= CHUNK_ROWS:
            yield from flush()
            n = 0
    yield from flush()


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all rows of some (k, level, slot): edge and inner periods, inner gaps and the span of each slot; blocks of slots once."""
    names: dict[object, int] = {}
    held: list[tuple[np.ndarray, ...]] = []
    size, limit = 0, CHUNK_ROWS

    def fold() -> tuple[np.ndarray, ...]:
        g, lo, hi = merge(*(np.concatenate(x) for x in zip(*held)))
        held[:] = [(g, lo, hi)]
        return g, lo, hi

    for b in batches:
        key = pd.MultiIndex.from_arrays([b.column("k").to_numpy(zero_copy_only=False), b.column("level").to_numpy(), b.column("slot").to_numpy()])
        codes, values = pd.factorize(key)
        ids = np.array([names.setdefault(v, len(names)) for v in values], np.int64)
        held.append((ids[codes], b.column("lo").to_numpy(), b.column("hi").to_numpy()))
        size += b.num_rows
        if size >= limit:
            size = len(fold()[0])
            limit = max(limit, 2 * size)
    if not held:
        return
    g, lo, hi = fold()
    same = g[1:] == g[:-1]
    edge = np.ones(len(g), bool)
    edge[1:-1] = ~(same[1:] & same[:-1])
    keys = list(names)
    k = pa.array([x[0] for x in keys])
    level, slot = np.array([x[1] for x in keys], np.int8), np.array([x[2] for x in keys], np.int64)
    gap = np.flatnonzero(same)
    kind = np.concatenate([np.where(level[g] >= 0, 2, np.where(edge, 1, 0)), np.full(len(gap), 3)]).astype(np.int8)
    first = np.flatnonzero(np.append(True, ~same))
    first = first[level[g[first]] < 0]
    last = np.append(np.flatnonzero(~same), len(g) - 1)
    last = last[level[g[last]] < 0]
    kind = np.concatenate([kind, np.full(len(first), 4, np.int8)])
    who = np.concatenate([g, g[gap], g[first]])
    a, z = np.concatenate([lo, hi[gap], lo[first]]), np.concatenate([hi, lo[gap + 1], hi[last]])
    for i in range(0, len(who), 50_000):
        w = who[i:i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [k.take(pa.array(w)), pa.array(kind[i:i + 50_000]), pa.array(level[w], pa.int8()), pa.array(slot[w]), pa.array(a[i:i + 50_000] - _OFFSET), pa.array(z[i:i + 50_000] - _OFFSET)],
            ["k", "kind", "level", "slot", "lo", "hi"],
        )


def _parts(df: DataFrame, key: str, start: str, end: str, cut: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(k, kind, level, slot, lo, hi): kinds inner period 0, edge (first or last) period 1, block of slots 2, inner gap 3, span 4.

    What lies in a slot that a block of slots covers is already removed.
    """
    rows = df.where(F.col(key).isNotNull() & (F.col(end) > F.col(start))).select(F.col(key).cast("string").alias("k"), F.col(start).alias("lo"), F.col(end).alias("hi"))
    local = rows.mapInArrow(_local, "k string, level tinyint, slot bigint, lo bigint, hi bigint")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = local.repartition(n, "k", "level", "slot").mapInArrow(_slots, "k string, kind tinyint, level tinyint, slot bigint, lo bigint, hi bigint")
    parts = cut(parts) if cut else parts
    # The ancestors of a slot in the tree of slots, for the few slots of entities that have blocks of slots at all.
    blocks = parts.where("kind = 2").select("k", "level", "slot").distinct()
    covered = (
        parts.where("kind = 1").select("k", "slot").distinct().join(blocks.select("k").distinct(), "k", "left_semi")
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(62 - SLOT_BITS))))
        .select("k", F.col("slot").alias("at"), F.col("level").cast("tinyint").alias("level"), F.expr("shiftright(slot, level)").alias("slot"))
        .join(blocks, ["k", "level", "slot"], "left_semi").select("k", F.col("at").alias("slot")).distinct()
    )
    return parts.where("kind = 2").unionByName(parts.where("kind <> 2").join(covered, ["k", "slot"], "left_anti"))


def _edges(parts: DataFrame, kind: int) -> DataFrame:
    """Rows of a kind and blocks of slots, with the furthest end before each among those of its entity."""
    w = Window.partitionBy("k").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return parts.where(F.col("kind").isin(kind, 2)).select("k", "lo", "hi", F.max("hi").over(w).alias("reach"))


def gaps(df: DataFrame, key: str, start: str, end: str, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, gap_start_us, gap_end_us): the gaps of positive length between successive periods of each entity.

    cut, if given, writes the merged parts once, since they are read several times.
    """
    parts = _parts(df, key, start, end, cut)
    inner = parts.where("kind = 3").select("k", "lo", "hi")
    between = _edges(parts, 4).where("reach < lo").select("k", F.col("reach").alias("lo"), F.col("lo").alias("hi"))
    return inner.unionByName(between).select(F.col("k").alias(key), F.col("lo").alias("gap_start_us"), F.col("hi").alias("gap_end_us"))


def periods(df: DataFrame, key: str, start: str, end: str, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, start_us, end_us): the maximal busy periods of each entity."""
    parts = _parts(df, key, start, end, cut)
    w = Window.partitionBy("k").orderBy("lo", "hi")
    chained = _edges(parts, 1).withColumn("new", F.coalesce((F.col("lo") > F.col("reach")).cast("int"), F.lit(1)))
    merged = chained.withColumn("island", F.sum("new").over(w)).groupBy("k", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return parts.where("kind = 0").select("k", "lo", "hi").unionByName(merged.select("k", "lo", "hi")).select(
        F.col("k").alias(key), F.col("lo").alias("start_us"), F.col("hi").alias("end_us")
    )
