"""Repetition inside a document: the share of words that lie in repeated runs, with thresholds fitted to the corpus.

A word is a longest run of a-z, 0-9 and characters from U+0080 on in the lower-cased text.  A word is repeated if it
lies in a run of RUN words that equals a run starting earlier in the text.  Equal runs are found exactly, by ranking pairs
of ranks (of words, then of runs of 2, 4 and 8), for all texts of a batch at once and in linear time.

A cutoff isn't fixed but comes from the corpus: a mergeable quantile sketch (KLL) of the shares per language and
source.  A group's quantile is drawn toward that of its language's merged sketch, and this toward the corpus', by as much as
PRIOR documents weigh, so small groups lean on larger ones and no size switches.  Documents are joined with the
threshold of their group and filtered.

A null or empty text, or one without words, has no words and a null share, and is never flagged.  Fewer than RUN words have no
repeated run.  Languages are compared by their lower-cased first subtag; null languages and sources are groups of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run.
RUN = 8
#: Characters that are ranked at once; a longer text is ranked alone.
CHUNK_CHARS = 2_000_000
#: Documents that the quantile of the next larger group counts for in a group's threshold.
PRIOR = 200
#: Groups that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 10_000
_WORD = re.compile("[a-z0-9\u0080-\U0010ffff]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return pd.factorize(a * (int(b.max()) + 1) + b)[0].astype(np.int64) if len(a) else a


def measure_texts(texts: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(words, repeated words) of each text."""
    lists = [words(t) for t in texts]
    lens = np.array([len(x) for x in lists], np.int64)
    n = int(lens.sum())
    repeated = np.zeros(len(lists), np.int64)
    if not n or lens.max() <= run:
        return lens, repeated
    doc = np.repeat(np.arange(len(lists)), lens)
    flat = np.empty(n, object)
    flat[:] = list(chain.from_iterable(lists))
    codes = pd.factorize(flat)[0].astype(np.int64)
    rank, width = _rank_pairs(doc, codes), 1  # equal ranks: equal runs of the same text
    while width * 2 <= run:
        rank, width = _rank_pairs(rank[:-width], rank[width:]), width * 2
    if width < run:
        rank = _rank_pairs(rank[:len(rank) - (run - width)], rank[run - width:])
    start = np.flatnonzero(doc[:n - run + 1] == doc[run - 1:])  # runs inside one text
    again = start[pd.Series(rank[start]).duplicated().to_numpy()]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + run, -1)
    hit = np.cumsum(cover[:n]) > 0
    return lens, np.bincount(doc[hit], minlength=len(lists)).astype(np.int64)


def measure(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, lang, source, n_words, n_repeated, share) of docs (doc_id, text, lang, source)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = np.cumsum([len(t or "") for t in texts])
            n, again, at = [], [], 0
            while at < len(texts):
                base = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, base + CHUNK_CHARS, "right")))
                x, y = measure_texts(texts[at:to], run)
                n.append(x)
                again.append(y)
                at = to
            n_words, n_again = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n, again))
            share = pa.array(n_again / np.maximum(n_words, 1), mask=n_words == 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), pa.array(n_words), pa.array(n_again), share], ["doc_id", "lang", "source", "n_words", "n_repeated", "share"])

    lang = F.regexp_extract(F.lower("lang"), "^[a-z]+", 0)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", lang.alias("lang"), "source").mapInArrow(work, f"doc_id {id_type}, lang string, source string, n_words bigint, n_repeated bigint, share double")


def thresholds(measured: DataFrame, quantile: float, prior: int = PRIOR) -> DataFrame:
    """(lang, source, n_docs, own, threshold) of each group: the quantile of its shares by its sketch, and the threshold.

    With n documents and weight w = prior a threshold is (n * own + w * of the language) / (n + w), that of a language likewise
    with the corpus.  A sketch's quantile is off by about 1.7 percent of the documents in rank.
    """
    q, w = F.lit(float(quantile)), F.lit(prior)
    at = lambda sketch: F.kll_sketch_get_quantile_double(sketch, q)
    group = measured.where("share is not null").groupBy("lang", "source").agg(F.kll_sketch_agg_double("share").alias("sketch"), F.count(F.lit(1)).alias("n_docs"))
    corpus = group.agg(at(F.kll_merge_agg_double("sketch")).alias("all")).scalar()
    lang = group.groupBy("lang").agg(at(F.kll_merge_agg_double("sketch")).alias("in_lang"), F.sum("n_docs").alias("lang_docs"))
    lang = lang.select(F.col("lang").alias("lang_"), ((F.col("lang_docs") * F.col("in_lang") + w * corpus) / (F.col("lang_docs") + w)).alias("in_lang"))
    own = group.select("lang", "source", "n_docs", at(F.col("sketch")).alias("own"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_")))
    return both.select("lang", "source", "n_docs", "own", ((F.col("n_docs") * F.col("own") + w * F.col("in_lang")) / (F.col("n_docs") + w)).alias("threshold"))


def above(measured: DataFrame, limits: DataFrame, at_most: float | None = None) -> DataFrame:
    """Documents whose share is positive and reaches the threshold of their group, or at_most if that is lower."""
    if limits.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        limits = F.broadcast(limits)
    t = limits.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "threshold")
    joined = measured.where("share > 0").join(t, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")))
    cut = F.col("threshold") if at_most is None else F.least("threshold", F.lit(float(at_most)))
    return joined.where(F.col("share") >= cut).select("doc_id", "lang", "source", "n_words", "n_repeated", "share", "threshold")
