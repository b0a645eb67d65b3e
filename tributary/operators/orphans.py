"""References to records that do not exist.

Keys are cut into ranges: equal parts of the space of their 64-bit hashes, so that ranges are even without a sample and
their bounds known to every task.  In each range the parents come first, sorted, and are kept as arrays; the
references follow in Arrow batches and are probed by binary search, vectorised.  Keys are compared in full where hashes agree.

Only the parents of one range are in memory, at most about RANGE_ROWS, as ranges are numbered by references and
parents together.  A key whose references fill more than a part of a range (a sketch finds all of them: there are fewer than
twice as many as ranges, and it has counters for that) is spread over as many ranges as it needs, with its one parent row in each.

A reference is an orphan if its key has no parent, if every parent came later than the reference, or if the key was
purged at or after its last parent came.  Null keys refer to nothing and are left out; '' is a key; repeated rows
are judged each for itself; an empty parent table makes every reference an orphan; other columns are ignored.  A parent or
purge without a time is a parent that came at no known time: it is no orphan's reason, but the key exists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: References and parents for one range; larger tables make more ranges.  A range's parents take about 120 bytes each.
RANGE_ROWS = 1_000_000
#: A key is spread if its references fill more than one in so many parts of a range.
SPREAD = 2


@dataclass(frozen=True)
class Target:
    """A table that is referred to: its rows, key, time of arrival and the name its purges have."""

    name: str
    rows: DataFrame
    key: str
    entity_type: str
    arrived: str = "recorded_at"


@dataclass(frozen=True)
class Reference:
    """A field of a table that names a key of a target."""

    table_name: str
    rows: DataFrame
    field: str
    target: str
    rec_id: str = "rec_id"
    arrived: str = "recorded_at"


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parents(targets: Sequence[Target], purges: DataFrame) -> DataFrame:
    """(k, known, first_at, last_at, purged_at): one row per target and key; a key with purges only isn't known."""
    parts, codes = [], {t.name: chr(65 + i) for i, t in enumerate(targets)}
    none, yes, no = F.lit(None).cast("timestamp_ntz"), F.lit(True).alias("known"), F.lit(False).alias("known")
    for t in targets:
        at = F.col(t.arrived).cast("timestamp_ntz")
        parts.append(t.rows.where(F.col(t.key).isNotNull()).select(F.concat(F.lit(codes[t.name]), F.col(t.key)).alias("k"), yes, at.alias("at"), none.alias("purged")))
    kind = F.create_map(*[x for t in targets for x in (F.lit(t.entity_type), F.lit(codes[t.name]))])
    parts.append(
        purges.where(F.col("entity_id").isNotNull() & F.col("entity_type").isin([t.entity_type for t in targets]))
        .select(F.concat(kind[F.col("entity_type")], F.col("entity_id")).alias("k"), no, none.alias("at"), F.col("purged_at").cast("timestamp_ntz").alias("purged"))
    )
    return _union(parts).groupBy("k").agg(F.max("known").alias("known"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("purged").alias("purged_at"))


def references(refs: Sequence[Reference], targets: Sequence[Target]) -> DataFrame:
    """(k, ref, rec_id, at) of all references with a key; ref is the place of the reference in the list.

    The rows of a table with several such fields are read once.
    """
    codes = {t.name: chr(65 + i) for i, t in enumerate(targets)}
    groups: dict[tuple[int, str, str], list[tuple[int, Reference]]] = {}
    for i, r in enumerate(refs):
        groups.setdefault((id(r.rows), r.rec_id, r.arrived), []).append((i, r))
    parts = []
    for members in groups.values():
        r0 = members[0][1]
        fields = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("ref"), F.concat(F.lit(codes[r.target]), F.col(r.field)).alias("k")) for i, r in members])
        parts.append(
            r0.rows.select(F.col(r0.rec_id).cast("bigint").alias("rec_id"), F.col(r0.arrived).cast("timestamp_ntz").alias("at"), F.explode(fields).alias("f"))
            .select("f.k", "f.ref", "rec_id", "at").where(F.col("k").isNotNull())
        )
    return _union(parts)


def _us(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Microseconds, the least integer for null."""
    ints = col.cast(pa.timestamp("us")).cast(pa.int64())
    return ints.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


class _Range:
    """The parents of one range as sorted arrays."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(parts)
        self.hash = t.column("h").to_numpy()
        self.key = t.column("k").cast(pa.large_string()).combine_chunks()
        self.known = t.column("known").to_numpy()
        self.first, self.last, self.purged = (_us(t.column(c)) for c in ("first_at", "last_at", "purged_at"))

    def find(self, h: np.ndarray, k: pa.Array) -> np.ndarray:
        """The place of each key, -1 for none; keys with one hash stand together."""
        at, found, todo = np.searchsorted(self.hash, h), np.full(len(h), -1), np.arange(len(h))
        while len(todo):
            todo = todo[at[todo] < len(self.hash)]
            todo = todo[self.hash[at[todo]] == h[todo]]
            same = pc.equal(self.key.take(pa.array(at[todo])), k.take(pa.array(todo))).to_numpy(zero_copy_only=False)
            found[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
        return found

    def misses(self, h: np.ndarray, k: pa.Array, at: np.ndarray) -> np.ndarray:
        none = np.iinfo(np.int64).min
        place = self.find(h, k)
        hit = np.flatnonzero(place >= 0)
        p, miss = place[hit], np.ones(len(h), bool)
        first, last, purged = self.first[p], self.last[p], self.purged[p]
        early = (first != none) & (at[hit] < first) & (at[hit] != none)
        gone = (purged != none) & (last != none) & (purged >= last)
        miss[hit] = ~self.known[p] | early | gone
        return miss


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range: parents (ref null) in order of h, then references.  Yields the references that miss."""
    parts, table = [], None
    for b in batches:
        n = b.column("ref").null_count  # parents come first
        if n:
            parts.append(b.slice(0, n))
        if n == b.num_rows:
            continue
        r = b.slice(n)
        if table is None and parts:
            table, parts = _Range(parts), []
        if table is not None:
            r = r.filter(pa.array(table.misses(r.column("h").to_numpy(), r.column("k").cast(pa.large_string()), _us(r.column("at")))))
        yield r.select(["ref", "rec_id", "at"])


def orphans(targets: Sequence[Target], refs: Sequence[Reference], purges: DataFrame, ranges: int | None = None) -> DataFrame:
    """(table_name, field_name, rec_id, period): each orphan reference, with the month it came in, as ``2025-03``."""
    h = F.xxhash64("k").alias("h")
    ref = references(refs, targets).select("k", h, "ref", "rec_id", "at")
    par = parents(targets, purges).select("*", h)
    spark = ref.sparkSession
    tables = {id(x.rows): x.rows.count() for x in [*targets, *refs]}
    total = sum(tables[id(x.rows)] for x in [*targets, *refs]) + purges.count()
    n = max(ranges or 0, int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / RANGE_ROWS))
    # Fewer than SPREAD * n keys have more references than a range over SPREAD; the sketch errs by less than half of that.
    counters = min(8 * SPREAD * n, 1_000_000)
    sketch = ref.agg(F.call_function("approx_top_k", F.col("h"), F.lit(min(SPREAD * n, counters)), F.lit(counters)).alias("top"), F.count(F.lit(1)).alias("n")).first()
    hot = [(x["item"], min(n, ceil(SPREAD * x["count"] * n / sketch.n))) for x in sketch.top or [] if x["item"] is not None and x["count"] * SPREAD * n > sketch.n]
    spread = F.broadcast(spark.createDataFrame(hot, "h bigint, ranges bigint"))  # at most SPREAD * n rows of two numbers
    own = F.shiftrightunsigned("h", 33) * n  # of the upper 31 bits of the hash
    par = par.join(spread, "h", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("ranges", F.lit(1)) - 1)))
    ref = ref.join(spread, "h", "left").withColumn("part", F.pmod(F.xxhash64("rec_id", "ref"), F.coalesce("ranges", F.lit(1))))
    none = F.lit(None).cast("timestamp_ntz")
    where = F.pmod(F.shiftright(own, 31) + F.col("part"), F.lit(n)).cast("int").alias("range")
    rows = par.select(where, "k", "h", F.lit(None).cast("tinyint").alias("ref"), F.lit(None).cast("bigint").alias("rec_id"), none.alias("at"), "known", "first_at", "last_at", "purged_at").unionByName(
        ref.select(where, "k", "h", "ref", "rec_id", "at", F.lit(None).cast("boolean").alias("known"), none.alias("first_at"), none.alias("last_at"), none.alias("purged_at")))
    ranged = rows.repartitionById(n, "range").sortWithinPartitions(F.when(F.col("ref").isNull(), F.col("h")).asc_nulls_last())
    names = F.array(*[F.struct(F.lit(r.table_name).alias("t"), F.lit(r.field).alias("f")) for r in refs])
    return ranged.drop("range").mapInArrow(_probe, "ref tinyint, rec_id bigint, at timestamp_ntz").withColumn("name", names[F.col("ref").cast("int")]).select(
        F.col("name.t").alias("table_name"), F.col("name.f").alias("field_name"), "rec_id",
        F.concat(F.lpad(F.year("at").cast("string"), 4, "0"), F.lit("-"), F.lpad(F.month("at").cast("string"), 2, "0")).alias("period"),
    )


def report(found: DataFrame) -> DataFrame:
    """(table_name, field_name, period, n_orphans) of ``orphans``."""
    return found.groupBy("table_name", "field_name", "period").agg(F.count(F.lit(1)).alias("n_orphans"))
