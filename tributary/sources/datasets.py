"""Datasets: folders of files in one format, read, written, listed and purged through Spark and the Hadoop file systems."""

from __future__ import annotations

import hashlib
import os
import re
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats with a reader; avro needs a package on the class path, xml a rowTag, grokLog a pattern.
FORMATS = ("avro", "csv", "grokLog", "json", "orc", "parquet", "text", "xml")
#: Formats that can be declared but that Spark has no reader for.
UNREADABLE = ("ion",)


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@dataclass(frozen=True)
class Dataset:
    """A table on a folder: only files with the format's suffix belong to it."""

    spark: SparkSession = field(compare=False)
    path: str
    format: str = "parquet"
    recurse: bool = False

    def __post_init__(self) -> None:
        if self.format not in (*FORMATS, *UNREADABLE):
            raise ValueError(f"unknown format {self.format}")

    def _list(self) -> Iterator[Any]:
        fs, p = file_system(self.spark, self.path)
        if not fs.exists(p):
            return
        it = fs.listFiles(p, True)
        depth = len(p.toUri().getPath().rstrip("/").split("/"))
        while it.hasNext():
            s = it.next()
            parts = s.getPath().toUri().getPath().split("/")
            inner, name = parts[depth:-1], parts[-1]
            hive = all("=" in x for x in inner)
            if name.endswith("." + self.format) and not name.startswith((".", "_")) and (self.recurse or not inner or hive):
                yield s

    def files(self) -> list[str]:
        """Paths of the files, in order."""
        return sorted(s.getPath().toString() for s in self._list())

    @property
    def hash(self) -> str:
        """Of the path and the names of the files: a file written in place doesn't change it."""
        return hashlib.sha512("\n".join([self.path, *self.files()]).encode()).hexdigest()[:40]

    def digest(self) -> str:
        """Of the files' names, sizes and times: a file written in place does change it."""
        rows = sorted(f"{s.getPath().toString()}\t{s.getLen()}\t{s.getModificationTime()}" for s in self._list())
        return hashlib.sha512("\n".join(rows).encode()).hexdigest()[:40]

    def is_valid(self, earlier: str) -> bool:
        return self.hash == earlier

    def read(self, validate: bool = False, schema: Any = None, **options: Any) -> DataFrame:
        """CSV files have a header unless told otherwise; validate fails on no rows."""
        if self.format in UNREADABLE:
            raise NotImplementedError(f"no reader for {self.format}")
        r = self.spark.read.format(self.format).option("pathGlobFilter", f"*.{self.format}")
        if self.recurse:
            r = r.option("recursiveFileLookup", "true")
        if self.format == "csv":
            options = {"header": "true"} | options
        if self.format == "grokLog":
            lines = r.format("text").load(self.path)
            df = lines.select(*grok_columns(F.col("value"), options["pattern"]))
            if validate and df.isEmpty():
                raise ValueError(f"no rows in {self.path}")
            return df
        if schema is not None:
            r = r.schema(schema)
        df = r.options(**options).load(self.path)
        if validate and df.isEmpty():
            raise ValueError(f"no rows in {self.path}")
        return df

    def pandas(self, max_shards: int | None = None) -> pd.DataFrame:
        return pd.concat(self.pandas_shards(max_shards), ignore_index=True)

    def pandas_shards(self, max_shards: int | None = None) -> Iterator[pd.DataFrame]:
        """A frame per file, in the order of their paths."""
        if self.format not in ("csv", "json", "orc", "parquet"):
            raise NotImplementedError(f"no frames from {self.format}")
        for f in self.files()[:max_shards]:
            r = self.spark.read.format(self.format)
            yield (r.option("header", "true") if self.format == "csv" else r).load(f).toPandas()

    def save(self, df: DataFrame | pd.DataFrame, partition_keys: Sequence[str] = (), table: str | None = None, mode: str = "overwrite", **options: Any) -> Dataset:
        """Write a Spark or pandas frame, partitioned by keys, and put it in the catalog if a table is named."""
        if isinstance(df, pd.DataFrame):
            df = self.spark.createDataFrame(df)
        if self.format == "csv":
            options = {"header": "true"} | options
        if self.format == "parquet":
            options = {"compression": "snappy"} | options
        w = df.write.format(self.format).mode(mode).options(**options)
        if partition_keys:
            w = w.partitionBy(*partition_keys)
        if table:
            w.option("path", self.path).saveAsTable(table)
        else:
            w.save(self.path)
        return self

    def purge(self, older_than_hours: float = 0) -> int:
        """Delete files last written more than so many hours ago; how many there were."""
        fs, _ = file_system(self.spark, self.path)
        limit = (time.time() - older_than_hours * 3600) * 1000
        old = [s.getPath() for s in self._list() if s.getModificationTime() <= limit]
        for p in old:
            fs.delete(p, False)
        return len(old)


def from_files(spark: SparkSession, files: Sequence[str], format: str | None = None, allow_additional_files: bool = False) -> Dataset:
    """The dataset on the common folder of files; fails on none, mixed suffixes, missing files and, unless allowed, others in the folder."""
    if not files:
        raise ValueError("no files")
    kinds = {f.rsplit(".", 1)[-1] for f in files}
    if format is None and len(kinds) > 1:
        raise ValueError(f"mixed formats {sorted(kinds)}")
    kind = format or kinds.pop()
    if any(not f.endswith("." + kind) for f in files):
        raise ValueError(f"not all files are {kind}")
    root = os.path.commonpath([os.path.dirname(f) for f in files]) if "://" not in files[0] else os.path.commonprefix([f.rsplit("/", 1)[0] + "/" for f in files]).rsplit("/", 1)[0]
    ds = Dataset(spark, root, kind, recurse=any(os.path.dirname(f).rstrip("/") != root.rstrip("/") for f in files))
    have = {f.replace("file:", "") for f in ds.files()}
    want = {f.replace("file://", "").replace("file:", "") for f in files}
    if want - have:
        raise FileNotFoundError(sorted(want - have)[0])
    if have - want and not allow_additional_files:
        raise ValueError(f"{len(have - want)} other files in {root}")
    return ds


def from_data(spark: SparkSession, df: DataFrame | pd.DataFrame, path: str, format: str = "parquet", **options: Any) -> Dataset:
    return Dataset(spark, path, format).save(df, **options)


def from_catalog(spark: SparkSession, database: str, name: str) -> DataFrame:
    return spark.table(f"{database}.{name}")


def clean_catalog_table(spark: SparkSession, name: str, older_than_hours: float = 0) -> int:
    """Purge the files of a catalog table by age."""
    where = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name in ('Location', 'Provider')").collect()
    found = {r["col_name"]: r["data_type"] for r in where}
    n = Dataset(spark, found["Location"], found["Provider"].lower(), recurse=True).purge(older_than_hours)
    spark.catalog.refreshTable(name)
    return n


def sql_query(df: DataFrame | Dataset, query: str, alias: str = "dataset") -> DataFrame:
    """Any SQL over a frame or dataset, which the query names by its alias; views of the session with this name stay as they are."""
    if alias not in query:
        raise ValueError(f"the query doesn't name {alias}")
    frame = df.read() if isinstance(df, Dataset) else df
    text = query.strip().replace("{", "{{").replace("}", "}}")
    rest = re.sub(r"(?is)^with\s+(?!recursive\b)", ", ", text)
    return frame.sparkSession.sql(f"WITH `{alias}` AS (SELECT * FROM {{frame__}}) {rest}", frame__=frame)


#: What names in a pattern of ``read_grok`` stand for.
GROK = {
    "WORD": r"\w+", "INT": r"[+-]?\d+", "NUMBER": r"[+-]?\d+(?:\.\d+)?", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": r".*?", "GREEDYDATA": r".*",
    "IP": r"\d{1,3}(?:\.\d{1,3}){3}", "LOGLEVEL": r"[A-Za-z]+", "TIMESTAMP_ISO8601": r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?(?:Z|[+-]\d\d:?\d\d)?",
}


def grok_columns(line: Column, pattern: str) -> list[Column]:
    """A text column for each ``%{NAME:column}`` of a pattern, all null where a line doesn't match; the rest of it is a regular expression without groups of its own."""
    names: list[str] = []

    def part(m: re.Match) -> str:
        kind, name = m.group(1), m.group(2)
        if name is None:
            return f"(?:{GROK[kind]})"
        names.append(name)
        return f"({GROK[kind]})"

    text = "^" + re.sub(r"%\{(\w+)(?::(\w+))?\}", part, pattern) + "$"
    return [F.when(line.rlike(text), F.regexp_extract(line, text, i)).alias(n) for i, n in enumerate(names, 1)]
