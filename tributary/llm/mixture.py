"""Mixing sources to target shares of tokens, by Poisson replication.

Each document gets a uniform number from a seeded hash of its id and appears as often as the Poisson distribution, whose
mean is its source's rate, has it at that number, at most max_copies times.  The count is inverted in its rate: a
document has its k-th copy from a rate on that is computed once (its threshold), so the tokens of a source as a function
of its rate are a sum over thresholds, and the rate whose tokens reach the target is found by histograms of fixed
size, narrowed in rounds, over all documents.  Thus the target is met by the actual draw and not only in the mean.
Copies are then exploded and ordered by another hash: a global shuffle.

Without a total the mix is as large as the caps allow.  Targets without tokens can't contribute: the other shares are
scaled up to one, and the report says so.  Documents of sources without a target, or with a null source, aren't used.
Null and empty texts have no tokens and may appear like others.  Empty tables give an empty mix.  A source given twice
among the targets has its greatest share and cap; rows with a null source, a share of 0 or less, or no copies don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm import tokens
from tributary.scratch import Scratch

#: Sources that may have a target; the table of targets is broadcast.
MAX_SOURCES = 10_000
#: Bins of a histogram and rounds of narrowing: rates are found to about BINS ** -ROUNDS of the first range.
BINS, ROUNDS = 2048, 4


@lru_cache(maxsize=256)
def _tail(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rates, and P(Poisson(rate) < k) at each, which falls."""
    rates = np.linspace(0, 2.0 * k + 100, 4097)
    return rates, _below(rates, k)


def _below(rate: np.ndarray, k: int) -> np.ndarray:
    """P(Poisson(rate) < k)."""
    i = np.arange(k)[:, None]
    logs = np.array([lgamma(x + 1) for x in range(k)])[:, None]
    return np.exp(i * np.log(np.maximum(rate, 1e-300)) - rate - logs).sum(0)


def thresholds(u: np.ndarray, cap: int) -> np.ndarray:
    """(n, cap): the rate from which on a document with uniform number u has its k-th copy, k from 1.

    The count at u is at least k if P(Poisson(rate) < k) is below u; that probability falls with the rate.  A table gives an
    interval, Newton's method, kept inside it, the rate; it depends on u and k only.
    """
    out = np.empty((len(u), cap))
    for k in range(1, cap + 1):
        rates, p = _tail(k)
        at = np.clip(np.searchsorted(-p, -u, "right"), 1, len(rates) - 1)
        lo, hi = rates[at - 1].copy(), rates[at].copy()
        r = (lo + hi) / 2
        for _ in range(8):
            f = _below(r, k)
            lo, hi = np.where(f < u, lo, r), np.where(f < u, r, hi)
            slope = -np.exp((k - 1) * np.log(np.maximum(r, 1e-300)) - r - lgamma(k))
            step = r - (f - u) / np.minimum(slope, -1e-300)
            there = np.abs(step - r) <= 1e-13 * (1 + r)
            r = np.where(there, r, np.where((step > lo) & (step < hi), step, (lo + hi) / 2))
        out[:, k - 1] = r
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _thresholds(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for u, cap in parts:
        out = pd.Series([None] * len(u), dtype=object)
        for c in cap.unique():
            at = (cap == c).to_numpy()
            out[at] = pd.Series(list(thresholds(u.to_numpy()[at], int(c))), index=out.index[at])
        yield out


def _uniform(column: str, seed: int) -> F.Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))


def _targets(targets: DataFrame) -> DataFrame:
    return targets.where("source is not null and target_share > 0 and max_copies > 0").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_copies").alias("max_copies"))


class Mix:
    """A mix of documents; ``copies`` and ``report`` are frames over tables in the shared folder."""

    def __init__(self, docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 17, path: str = tokens.BYTE_BPE_50K) -> None:
        spark = docs.sparkSession
        s = Scratch(spark, "mix")
        want = _targets(targets)
        rows = want.limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources have a target")
        self.targets = {r["source"]: r for r in rows}
        small = spark.createDataFrame([(r["source"], int(r["max_copies"])) for r in rows], "source string, cap int")
        used = docs.select("doc_id", "source", "text").join(F.broadcast(small.select("source")), "source", "left_semi")
        counted = tokens.count(used, ["doc_id", "source"], path=path)
        self.docs = s.cut(counted.join(F.broadcast(small), "source").select(
            "doc_id", "source", "n_tokens", _thresholds(_uniform("doc_id", seed), F.col("cap")).alias("from_rate")))
        have = {r["source"]: (r["n"], int(r["tokens"])) for r in self.docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
        self.have = {k: have.get(k, (0, 0)) for k in self.targets}
        self.able = {k for k, (_, t) in self.have.items() if t > 0}
        weight = sum(self.targets[k]["target_share"] for k in self.able)
        self.share = {k: self.targets[k]["target_share"] / weight if k in self.able else 0.0 for k in self.targets}
        most = min((self.have[k][1] * self.targets[k]["max_copies"] / self.share[k] for k in self.able), default=0.0)
        self.total = most if total_tokens is None else min(float(total_tokens), most)
        self.rate = self._rates()
        self.seed = seed

    def _rates(self) -> dict[str, float]:
        """Per source the rate whose copies have the source's share of the total."""
        spark = self.docs.sparkSession
        top = {k: 2.0 * self.targets[k]["max_copies"] + 101 for k in self.able}
        bracket = {k: (0.0, top[k], 0) for k in self.able}  # from, to, tokens of thresholds up to from
        upto: dict[str, int] = {}  # tokens of thresholds up to to
        long = self.docs.where("n_tokens > 0").select("source", "n_tokens", F.explode("from_rate").alias("r"))
        for _ in range(ROUNDS):
            if not bracket:
                break
            b = spark.createDataFrame([(k, lo, hi) for k, (lo, hi, _) in bracket.items()], "source string, lo double, hi double")
            inside = long.join(F.broadcast(b), "source").where("r > lo and r <= hi")
            width = (F.col("hi") - F.col("lo")) / BINS
            hist = inside.groupBy("source", F.least(F.floor((F.col("r") - F.col("lo")) / width), F.lit(BINS - 1)).alias("bin")).agg(F.sum("n_tokens").alias("t"))
            w = Window.partitionBy("source").orderBy("bin")
            need = spark.createDataFrame([(k, self.share[k] * self.total - bracket[k][2]) for k in bracket], "source string, need double")
            cum = hist.withColumn("upto", F.sum("t").over(w)).join(F.broadcast(need), "source")
            # The first bin that reaches the target; beyond the last, when rounding leaves the target a hair above all tokens.
            hit = cum.groupBy("source").agg(
                F.min(F.when(F.col("upto") >= F.col("need"), F.struct("bin", "upto", "t"))).alias("hit"), F.max(F.struct("bin", "upto", "t")).alias("last"))
            for r in hit.collect():
                x = r["hit"] or r["last"]
                lo, hi, before = bracket[r["source"]]
                step = (hi - lo) / BINS
                upto[r["source"]] = before + x["upto"]
                bracket[r["source"]] = (lo + step * x["bin"], lo + step * (x["bin"] + 1) if x["bin"] < BINS - 1 else hi, before + x["upto"] - x["t"])
        # One copy more or less decides at the end: the nearer side.
        near = {k: self.share[k] * self.total for k in bracket}
        return {k: hi if upto.get(k, 0) - near[k] <= near[k] - before else lo for k, (lo, hi, before) in bracket.items()}

    def _counted(self) -> DataFrame:
        spark = self.docs.sparkSession
        rate = spark.createDataFrame(list(self.rate.items()), "source string, rate double")
        return self.docs.join(F.broadcast(rate), "source").withColumn("copies", F.size(F.filter("from_rate", lambda r: r <= F.col("rate"))))

    def copies(self) -> DataFrame:
        """(doc_id, source, copy_no, n_tokens, shuffle_key): every copy, in the order of shuffle_key over all partitions."""
        out = self._counted().where("copies > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
        out = out.withColumn("shuffle_key", F.xxhash64(F.lit(self.seed + 1), "doc_id", "copy_no"))
        return out.orderBy("shuffle_key", "doc_id", "copy_no").select("doc_id", "source", "copy_no", "n_tokens", "shuffle_key")

    def report(self) -> DataFrame:
        """(source, target_share, aimed_share, max_copies, n_docs, rate, expected_copies, n_copies, most_copies, n_tokens, actual_share), a row per target.

        expected_copies is the mean of the distribution at the rate, cut off at the cap; n_copies what was drawn.
        """
        spark = self.docs.sparkSession

        def expected(k: str) -> float:
            rate, cap = self.rate.get(k, 0.0), int(self.targets[k]["max_copies"])
            return self.have[k][0] * float(sum(1 - _below(np.array([rate]), c)[0] for c in range(1, cap + 1))) if rate > 0 else 0.0

        plan = spark.createDataFrame(
            [(k, float(t["target_share"]), self.share[k], int(t["max_copies"]), self.have[k][0], self.rate.get(k), expected(k)) for k, t in self.targets.items()],
            "source string, target_share double, aimed_share double, max_copies int, n_docs bigint, rate double, expected_copies double")
        got = self._counted().groupBy("source").agg(F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"))
        joined = plan.join(F.broadcast(got), "source", "left").fillna(0, ["n_copies", "most_copies", "n_tokens"])
        total = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target, at most MAX_SOURCES
        return joined.withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(F.lit(0.0)))
