import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.operators import intervals as I

DAY = 86_400_000_000


def brute(rows):
    """Periods by a sweep, per key."""
    out = {}
    for k, a, b in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        own = out.setdefault(k, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    return out


@given(st.integers(0, 2**50), st.integers(1, 2**45))
def test_dyadic_is_canonical(lo, n):
    level, index = I.dyadic(np.array([lo]), np.array([lo + n]))
    size = np.int64(1) << level.astype(np.int64)
    start = index * size
    order = np.argsort(start)
    assert start[order][0] == lo and (start + size)[order][-1] == lo + n
    assert ((start + size)[order][:-1] == start[order][1:]).all()
    assert len(level) <= 2 * n.bit_length()


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60), st.integers(1, 30)), max_size=40))
def test_merge(rows):
    x = [(g, a, a + n) for g, a, n in rows]
    g, lo, hi = I.merge(*(np.array([r[i] for r in x], np.int64) for i in range(3)))
    assert list(zip(g, lo, hi)) == [(k, a, b) for k, v in brute(x).items() for a, b in v]


def test_merge_wide():
    """Positions and groups too wide for one integer."""
    g = np.array([0, 1, 1, 5_000_000, 5_000_000], np.int64)
    lo = np.array([0, 1, 2**59, 7, 8], np.int64)
    out = I.merge(g, lo, lo + 2)
    assert [tuple(map(int, r)) for r in zip(*out)] == [(0, 0, 2), (1, 1, 3), (1, 2**59, 2**59 + 2), (5_000_000, 7, 10)]


@pytest.mark.parametrize("scale", [1, DAY // 7, 40 * DAY])
def test_gaps_and_periods(spark, scale):
    rng = random.Random(scale)
    rows = []
    for _ in range(1500):
        a = rng.randrange(-50 * scale, 400 * scale)
        rows.append((rng.choice("aaaab"), a, a + rng.randrange(1, 6 * scale + 1)))
    rows += rows[:50] + [("z", 5, 6), ("y", 0, 1000 * 365 * DAY), ("y", 2000 * 365 * DAY, 2000 * 365 * DAY + 3)]
    df = spark.createDataFrame([*rows, (None, 1, 2), ("n", None, 3), ("n", 3, None), ("n", 4, 4), ("n", 9, 2)], "e string, lo bigint, hi bigint").repartition(5)
    want = brute(rows)
    got = {(r[0], r[1], r[2]) for r in I.periods(df, "e", "lo", "hi").collect()}
    assert got == {(k, a, b) for k, v in want.items() for a, b in v}
    got = sorted((r[0], r[1], r[2]) for r in I.gaps(df, "e", "lo", "hi").collect())
    assert got == sorted((k, x[1], y[0]) for k, v in want.items() for x, y in zip(v, v[1:]))


def test_timestamps_and_clashing_columns(spark):
    t = datetime(2025, 1, 1)
    rows = [("a", t, t + timedelta(seconds=2), 1, 2), ("a", t + timedelta(seconds=2), t + timedelta(seconds=3), 1, 2), ("a", t + timedelta(days=3), t + timedelta(days=4), None, None)]
    df = spark.createDataFrame(rows, "e string, s timestamp_ntz, t timestamp_ntz, k int, lo int")
    us = int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert [tuple(r) for r in I.gaps(df, "e", "s", "t").collect()] == [("a", us + 3_000_000, us + 3 * DAY)]
    assert I.gaps(df.limit(0), "e", "s", "t").collect() == [] and I.periods(df.limit(0), "e", "s", "t").collect() == []
