import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import queries, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.BYTE_BPE_50K), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    v = tokens.vocabulary()
    return v, tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=80))
def test_any_text(both, text):
    v, ref = both
    assert v.encode(text) == ref.encode_ordinary(text) and v.decode(v.encode(text)) == text


@settings(deadline=None, max_examples=100)
@given(st.text("ab \n's1é=", max_size=40), st.integers(0, 40), st.integers(0, 8), st.text("ab \n's1é=", max_size=8))
def test_edits(both, text, at, n, new):
    v, ref = both
    d = tokens.Document(v, text)
    at = min(at, len(text))
    d.edit(at, min(len(text), at + n), new)
    d.append("s end")
    assert d.ids() == ref.encode_ordinary(d.text)


def test_prefixes(both):
    v, _ = both
    p = tokens.Prefixes(v, b"hello")
    p.append(b"worldwide")
    assert p.ids() == v.merge(b"helloworldwide")
    p.edit(3, 7, b"xyz")
    assert p.ids() == v.merge(b"helxyzrldwide")


def test_long_piece(both):
    v, ref = both
    rng = random.Random(0)
    for text in ("a" * 20_000, "".join(rng.choice("abcxyz") for _ in range(5000)), "=" * 3001, "<|endoftext|>"):
        assert v.encode(text) == ref.encode_ordinary(text)


def test_query(spark, data, both):
    got = {r["doc_id"]: r["ids"] for r in queries.p8_ids(spark, data).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert got == {i: both[1].encode_ordinary(t or "") for i, t in texts.items()}


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, [0], 1), (2, "", [0], 1), (2, "", None, None), (None, "a", None, None)], "doc_id int, text string, ids array<int>, id int")
    assert [tuple(r) for r in tokens.encode(df).orderBy("doc_id").collect()] == [(None, [64]), (1, []), (2, []), (2, [])]
    assert tokens.encode(df.limit(0)).collect() == []
    assert [r["n_tokens"] for r in tokens.count(df, ["doc_id"]).orderBy("doc_id").collect()] == [1, 0, 0, 0]
