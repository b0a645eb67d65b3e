import random

import pytest

from tributary.llm import queries, repetition


def brute(text, run=8):
    w = repetition.words(text)
    seen, hit = set(), [False] * len(w)
    for i in range(len(w) - run + 1):
        x = tuple(w[i:i + run])
        if x in seen:
            hit[i:i + run] = [True] * run
        seen.add(x)
    return len(w), sum(hit)


def texts():
    rng = random.Random(3)
    out = [None, "", " !?", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "a " * 9, "a " * 8, "É ñ 漢字 x1 " * 5, "one " * 5000]
    out += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(200)]
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5, 8])
def test_against_brute_force(run):
    t = texts()
    n, again = repetition.measure_texts(t, run)
    assert list(zip(n.tolist(), again.tolist())) == [brute(x, run) for x in t]


def test_measure_in_chunks(spark, monkeypatch):
    t = texts()
    df = spark.createDataFrame([(i, x, "EN-x" if i % 2 else None, "s", 1.0) for i, x in enumerate(t)], "doc_id int, text string, lang string, source string, share double")
    got = {r["doc_id"]: r for r in repetition.measure(df).collect()}
    assert {i: (r["n_words"], r["n_repeated"]) for i, r in got.items()} == {i: brute(x) for i, x in enumerate(t)}
    assert got[0]["share"] is None and got[1]["lang"] == "en" and got[2]["lang"] is None
    assert repetition.measure(df.limit(0)).collect() == []


def rank_range(values, x):
    """The share of values below x, and the share not above it."""
    return sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)


def test_thresholds_against_brute_force(spark):
    """Own quantiles by rank, and thresholds from the brute-force quantiles of group, language and corpus."""
    rng = random.Random(8)
    groups = {("en", "a"): (3000, 0.1), ("en", "b"): (40, 0.5), ("de", "a"): (500, 0.3), ("de", None): (1, 0.0), (None, None): (2, 0.9), ("", "a"): (150, 0.2)}
    rows = [(lang, source, min(1.0, base + rng.random() ** 3 / 2)) for (lang, source), (n, base) in groups.items() for _ in range(n)] + [("en", "a", None)] * 9
    df = spark.createDataFrame([(i, lang, source, 10, 1, x) for i, (lang, source, x) in enumerate(rows)], "doc_id int, lang string, source string, n_words int, n_repeated int, share double")
    shares = lambda f: [x for lang, source, x in rows if x is not None and f(lang, source)]
    exact = lambda v: sorted(v)[min(len(v) - 1, int(0.9 * len(v)))]
    got = {(r["lang"], r["source"]): r for r in repetition.thresholds(df, 0.9, prior=100).collect()}
    assert {k: r["n_docs"] for k, r in got.items()} == {k: n for k, (n, _) in groups.items()}
    for (lang, source), r in got.items():
        low, high = rank_range(shares(lambda a, b: (a, b) == (lang, source)), r["own"])
        assert low - 0.03 <= 0.9 <= high + 0.03
        n_lang, in_lang = len(shares(lambda a, b: a == lang)), exact(shares(lambda a, b: a == lang))
        in_lang = (n_lang * in_lang + 100 * exact(shares(lambda a, b: True))) / (n_lang + 100)
        want = (r["n_docs"] * exact(shares(lambda a, b: (a, b) == (lang, source))) + 100 * in_lang) / (r["n_docs"] + 100)
        assert abs(r["threshold"] - want) < 0.04, (lang, source)


def test_above(spark):
    rows = [(i, "en", "a", 100, i % 100, (i % 100) / 100) for i in range(1000)] + [(-1, "en", "b", 10, 9, 0.9), (-2, None, None, 10, 10, 1.0), (-3, "en", "a", 0, 0, None)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, source string, n_words int, n_repeated int, share double")
    limits = repetition.thresholds(df, 0.9)
    cut = {(r["lang"], r["source"]): r["threshold"] for r in limits.collect()}
    assert {r["doc_id"] for r in repetition.above(df, limits).collect()} == {r[0] for r in rows if r[5] and r[5] >= cut[r[1], r[2]]}
    low = {r["doc_id"] for r in repetition.above(df, limits, at_most=0.25).collect()}
    assert low == {r[0] for r in rows if r[5] is not None and r[5] >= 0.25}
    empty = df.limit(0)
    assert repetition.above(empty, repetition.thresholds(empty, 0.9)).collect() == []


def test_flagged_query(spark, data):
    """p10_flagged over whole documents: its thresholds by rank, and just the documents that reach them."""
    shares = {r["doc_id"]: r for r in queries._p10(spark, data)[0].collect()}
    limits = {(r["lang"], r["source"]): r for r in queries.p10_thresholds(spark, data).collect()}
    want = {i for i, r in shares.items() if r["share"] and r["share"] >= limits[r["lang"], r["source"]]["threshold"]}
    assert {r["doc_id"] for r in queries.p10_flagged(spark, data).collect()} == want
    for key, r in limits.items():
        low, high = rank_range([x["share"] for x in shares.values() if x["share"] is not None and (x["lang"], x["source"]) == key], r["own"])
        assert low - 0.03 <= queries.P10_QUANTILE <= high + 0.03


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"] for r in docs if (x := brute(r["text"]))[1] and x[1] * 4 >= x[0]}
    assert {r["doc_id"] for r in queries.p10_found(spark, data).collect()} == want


@pytest.mark.parametrize("name", ["p10_found", "p10_shares"])
def test_query_with_sql(name, same):
    same(name, queries.QUERIES[name], queries.SQL[name])


def test_only_flagged_fits_thresholds(spark, data, monkeypatch):
    """Thresholds decide what p10_flagged gives, and are not made where they can't change a row."""
    few = {r["doc_id"] for r in queries.p10_flagged(spark, data).collect()}
    monkeypatch.setattr(queries, "P10_QUANTILE", 0.5)
    assert few < {r["doc_id"] for r in queries.p10_flagged(spark, data).collect()}
    made = []
    monkeypatch.setattr(repetition, "thresholds", lambda *a, f=repetition.thresholds: made.append("thresholds") or f(*a))
    monkeypatch.setattr(repetition, "above", lambda *a, f=repetition.above, **k: made.append("above") or f(*a, **k))
    assert queries.p10_found(spark, data).count() and queries.p10_shares(spark, data).count()
    assert made == []
    assert queries.p10_flagged(spark, data).count() and made == ["thresholds", "above"]
