"""Texts, words and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.scratch import Scratch

#: ASCII punctuation that is stripped from the ends of a word (fixed value).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def count_words(df: DataFrame, text: str) -> DataFrame:
    """(word, count) of words between white space."""
    words = df.select(F.explode(F.split(F.trim(F.col(text)), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def clean_word(word: Column) -> Column:
    """Lower case, without punctuation at the ends."""
    return F.lower(F.btrim(word, F.lit(PUNCTUATION)))


def links(html: Column) -> Column:
    """The targets of the anchors in a page, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def base_url(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def clean_url(url: Column, page: Column) -> Column:
    """Absolute, on the page's host if it has none, and without query and fragment."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), bare).when(bare.startswith("//"), F.concat(F.regexp_extract(page, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), bare)).when(
        bare.startswith("/"), F.concat(base_url(page), bare)).otherwise(F.concat(F.regexp_replace(page, "[^/]*$", ""), bare))


def group_read_pairs(files: DataFrame, name: str, pattern: str = r"^(.+?)[._]R?([12])[._].*$") -> DataFrame:
    """(sample, reads): file names grouped by the sample and read in them, reads a map from read to names in order; others are left out."""
    x = files.select(F.col(name).alias("file"), F.regexp_extract(name, pattern, 1).alias("sample"), F.regexp_extract(name, pattern, 2).alias("read")).where("sample <> ''")
    per_read = x.groupBy("sample", "read").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return per_read.groupBy("sample").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("read", "files")))).alias("reads"))


def crawl(pages: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(url, depth, found): what links lead to from the start pages (url) in at most so many steps, each once with its least depth.

    pages (url, html); a link to a page that isn't there is a url that wasn't found.  One round a step; each round reads the links of its own pages only.
    """
    s = Scratch(pages.sparkSession, "crawl")
    out = s.cut(pages.select("url", F.explode(links(F.col("html"))).alias("link")).select("url", clean_url(F.col("link"), F.col("url")).alias("to")).where("to is not null").distinct())
    front = s.cut(start.select("url", F.lit(0).alias("depth")).where("url is not null").distinct())
    seen = front
    for depth in range(1, most + 1):
        nxt = front.join(out, "url").select(F.col("to").alias("url")).distinct().join(seen, "url", "left_anti")
        front, more = s.counted(nxt.select("url", F.lit(depth).alias("depth")))
        if not more:
            break
        seen = s.cut(seen.unionByName(front))
    return seen.join(pages.select("url", F.lit(True).alias("found")).distinct(), "url", "left").select("url", "depth", F.coalesce("found", F.lit(False)).alias("found"))
