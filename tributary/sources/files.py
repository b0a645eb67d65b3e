"""Files of any Hadoop file system: text and bytes, listing by pattern, identity, copying, a write-once blob store.

The scheme of a path (file, hdfs, s3a, gs, abfss, http, https ...) chooses the file system; its connector must be on the class path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.scratch import Scratch
from tributary.sources.datasets import file_system


def scheme(path: str) -> str:
    return path.split("://", 1)[0] if "://" in path else "file"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").take(1)
    if not rows:
        raise FileNotFoundError(path)
    return bytes(rows[0]["content"])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of all files of a path or pattern, distributed."""
    return spark.read.text(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def file_set(spark: SparkSession, root: str, pattern: str = "*", recurse: bool = True) -> DataFrame:
    """(path, length, modificationTime) of files; their contents aren't read."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return (r.option("recursiveFileLookup", "true") if recurse else r).load(root).select("path", "length", "modificationTime")


def identities(files: DataFrame, by: str = "metadata") -> DataFrame:
    """(path, hash) of ``file_set``: of path, size and time (metadata), of the path alone (immutable), or of the content."""
    if by == "content":
        raise ValueError("use content_identities, which reads the contents")
    parts = [F.col("path")] if by == "immutable" else [F.col("path"), F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")]
    return files.select("path", F.substring(F.sha2(F.concat_ws("\n", *parts), 512), 1, 40).alias("hash"))


def content_identities(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, hash) by content, each file hashed where it's read."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return r.select("path", F.substring(F.sha2(F.col("content"), 512), 1, 40).alias("hash"))


def set_hash(ids: DataFrame) -> DataFrame:
    """(hash): one identity for a set of files, from those of its members in order (40 bytes a file in one row)."""
    return ids.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ","), 512), 1, 40).alias("hash"))


def copy(spark: SparkSession, src: str, dst: str, skip_same: bool = False) -> bool:
    """Copy a file or folder; with skip_same a target of the same size stays. Whether it was copied."""
    fs, p = file_system(spark, src)
    to, q = file_system(spark, dst)
    if skip_same and to.exists(q) and fs.getContentSummary(p).getLength() == to.getContentSummary(q).getLength():
        return False
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, True, spark.sparkContext._jsc.hadoopConfiguration())


def copy_files(spark: SparkSession, pairs: DataFrame, skip_same: bool = False) -> DataFrame:
    """(src, dst, n_bytes) of pairs (src, dst) of files, copied by the executors in streams; n_bytes is null for one that stayed (skip_same: a target of the same size)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            n: list[int | None] = []
            for src, dst in zip(b.column("src").to_pylist(), b.column("dst").to_pylist()):
                (a, p), (z, q) = (fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", x)) for x in (src, dst))
                size, there = a.get_file_info(p).size, z.get_file_info(q)
                if skip_same and there.type == fs.FileType.File and there.size == size:
                    n.append(None)
                    continue
                z.create_dir(q.rsplit("/", 1)[0], recursive=True)
                with a.open_input_stream(p) as i, z.open_output_stream(q) as o:
                    while chunk := i.read(8 << 20):
                        o.write(chunk)
                n.append(size)
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst"), pa.array(n, pa.int64())], ["src", "dst", "n_bytes"])

    s = Scratch(spark, "copy")  # written once: a plan that is run again would copy again
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return s.cut(pairs.select("src", "dst").where("src is not null and dst is not null").distinct().repartition(parts).mapInArrow(work, "src string, dst string, n_bytes bigint"))


def schemes(spark: SparkSession) -> dict[str, bool]:
    """Schemes of paths, and whether a file system for them is on the class path."""
    conf, fs = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.FileSystem
    out = {}
    for s in ("file", "hdfs", "http", "https", "ftp", "s3a", "gs", "abfss", "wasbs"):
        try:
            fs.getFileSystemClass(s, conf)
            out[s] = True
        except Exception:  # noqa: BLE001 - the connector's class isn't there
            out[s] = False
    return out


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.delete(p, True)


class BlobStore:
    """Blobs under ``root/ab/cdef...`` by their hash, each written once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key[2:]}"

    def has(self, key: str) -> bool:
        return exists(self.spark, self.path(key))

    def put(self, data: bytes, key: str | None = None) -> str:
        key = key or hashlib.sha512(data).hexdigest()[:40]
        if not self.has(key):
            fs, p = file_system(self.spark, self.path(key))
            out = fs.create(p, False)
            try:
                out.write(bytearray(data))
            finally:
                out.close()
        return key

    def get(self, key: str) -> bytes | None:
        return read_bytes(self.spark, self.path(key)) if self.has(key) else None

    def size(self, key: str) -> int:
        fs, p = file_system(self.spark, self.path(key))
        return fs.getFileStatus(p).getLen()

    def keys(self) -> Iterator[str]:
        for r in file_set(self.spark, self.root).toLocalIterator():
            a, b = r["path"].rsplit("/", 2)[-2:]
            yield a + b
