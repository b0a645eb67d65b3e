"""The queries of the problems on training text and keys, over whole tables, with their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import mixture, repetition, seen, tokens
from tributary.scratch import Scratch
from tributary.sources.tables import table

# --- 2: has this key been seen before?


def _arrivals(d: str) -> list[seen.Arrivals]:
    return [seen.Arrivals("call_node", f"{d}/call_node.parquet", "call_hash"), seen.Arrivals("value_record", f"{d}/value_record.parquet", "value_hash")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.repeats(spark, _arrivals(d))


def p2_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_rate(spark, _arrivals(d))


_P2_SQL = """
WITH r AS (SELECT 'call_node' table_name, call_hash k, rec_id FROM call_node UNION ALL SELECT 'value_record', value_hash, rec_id FROM value_record),
f AS (SELECT *, min(rec_id) OVER (PARTITION BY table_name, k) lo FROM r WHERE k IS NOT NULL)
"""

# --- 8: encoding of the whole corpus with a public tokenizer


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents", "doc_id", "text"))


# --- 9: mixing sources to target weights


def _p9(spark: SparkSession, d: str) -> mixture.Mix:
    return mixture.Mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "source_target"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d).copies()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d).report()


# --- 10: repetition inside a single document

#: The quantile of the shares of a group from which on a document is flagged.
P10_QUANTILE = 0.98


def _p10_measured(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measure(table(spark, d, "documents", "doc_id", "text", "lang", "source"))


def _p10(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = Scratch(spark, "p10")
    measured = s.cut(_p10_measured(spark, d))
    return measured, s.cut(repetition.thresholds(measured, P10_QUANTILE))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    # Its quarter is given, so no threshold can change it; those fitted to the corpus are for p10_flagged.
    return _p10_measured(spark, d).where("n_repeated > 0 AND n_repeated * 4 >= n_words").select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p10_measured(spark, d).select("doc_id", "n_words", "n_repeated", "share")


def p10_flagged(spark: SparkSession, d: str) -> DataFrame:
    return repetition.above(*_p10(spark, d))


def p10_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _p10(spark, d)[1]


QUERIES = {
    "p2_found": p2_found, "p2_error_rate": p2_error_rate, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_shares": p10_shares, "p10_flagged": p10_flagged, "p10_thresholds": p10_thresholds,
}

# Runs of 8 words that start again, and the words in them.
_P10_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\u0080-\U0010ffff]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i + 7] AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS n FROM g) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_repeated FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM again) GROUP BY doc_id),
m AS (SELECT doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_repeated, 0) AS n_repeated FROM w LEFT JOIN hit USING (doc_id))
"""

SQL = {
    "p10_found": _P10_SQL + "SELECT doc_id FROM m WHERE n_repeated > 0 AND n_repeated * 4 >= n_words",
    "p10_shares": _P10_SQL + "SELECT doc_id, n_words, n_repeated, CASE WHEN n_words > 0 THEN n_repeated / n_words::DOUBLE END AS share FROM m",
    "p2_found": _P2_SQL + "SELECT table_name, rec_id FROM f WHERE rec_id > lo",
    # Told apart by the number among the rows of a key, and by a smaller number for the key elsewhere.
    "p2_error_rate": _P2_SQL + """, g AS (SELECT *, row_number() OVER (PARTITION BY table_name, k ORDER BY rec_id) > 1 AS said FROM f)
SELECT table_name, count(*) AS n_rows, count(*) FILTER (WHERE said) AS n_repeats, count(*) FILTER (WHERE said <> (rec_id > lo)) AS n_wrong,
  count(*) FILTER (WHERE said <> (rec_id > lo)) / count(*)::DOUBLE AS wrong_rate FROM g GROUP BY table_name""",
}
