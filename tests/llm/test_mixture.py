import numpy as np
import pytest

from tributary.llm import mixture, queries

DOC = "doc_id bigint, source string, text string, rate int, cap int"
TARGET = "source string, target_share double, max_copies int"


def docs(spark, n):
    return spark.createDataFrame([(i, "big" if i % 10 else "small", "some words here " * (1 + i % 7), 1, 1) for i in range(n)] + [(-1, None, "x", 1, 1), (-2, "other", "x", 1, 1), (-3, "small", None, 1, 1)], DOC)


def test_thresholds_invert_the_distribution():
    rng = np.random.default_rng(0)
    u = rng.random(4000)
    t = mixture.thresholds(u, 6)
    assert (np.diff(t, axis=1) > 0).all()
    for rate in (0.3, 1.0, 2.5):
        counts = (t <= rate).sum(1)
        p = np.exp(-rate) * np.cumprod([1.0, *[rate / k for k in range(1, 6)]])
        want = np.searchsorted(np.cumsum(p), u)
        assert (counts == np.minimum(want, 6)).all()


def test_shares_and_caps(spark):
    target = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("small", 0.3, 3), ("absent", 0.2, 5), (None, 0.2, 1), ("zero", 0.0, 3)], TARGET)
    m = mixture.Mix(docs(spark, 3000), target)
    rows = {r["source"]: r for r in m.report().collect()}
    assert set(rows) == {"big", "small", "absent"} and rows["absent"]["actual_share"] == 0
    assert abs(rows["big"]["actual_share"] - 0.625) < 0.002 and abs(rows["small"]["actual_share"] - 0.375) < 0.002
    copies = m.copies().collect()
    per = {}
    for r in copies:
        per.setdefault((r["source"], r["doc_id"]), []).append(r["copy_no"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= {"big": 1, "small": 4}[s] for (s, _), c in per.items())
    assert sum(r["n_tokens"] for r in copies) == sum(r["n_tokens"] for r in rows.values())
    assert [r["shuffle_key"] for r in copies] == sorted(r["shuffle_key"] for r in copies)
    smaller = mixture.Mix(docs(spark, 3000), target, total_tokens=5000)
    assert abs(sum(r["n_tokens"] for r in smaller.report().collect()) - 5000) < 100


def test_empty(spark):
    d, t = docs(spark, 10), spark.createDataFrame([("big", 1.0, 1)], TARGET)
    for m in (mixture.Mix(d.limit(0), t), mixture.Mix(d, t.limit(0))):
        assert m.copies().collect() == [] and all(r["n_copies"] == 0 for r in m.report().collect())


def test_query(spark, data):
    got = queries.p9_shares(spark, data)
    assert got.count() == 8
    assert queries.p9_mix(spark, data).groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 5


@pytest.mark.parametrize("cap", [1, 40])
def test_large_cap(cap):
    assert np.isfinite(mixture.thresholds(np.array([1e-16, 0.5, 1 - 1e-16]), cap)).all()
