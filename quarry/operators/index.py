"""The index: Parquet tables of one corpus, published atomically.

``<root>/<stamp>/{files,trees,tags,ngrams,meta}`` hold a snapshot; the file
``<root>/CURRENT`` names the one in use.  Files are partitioned by tree, so that
repository filters prune folders.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import FILE_COLUMNS
from .ngram import pairs_of, posting_blocks

VERSION = 2


class IndexError_(ValueError):
    """A folder that holds no index of this version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside and rename, so that readers see the old or the new text."""
    target, fs = _fs(spark, path)
    temp, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE  # atomic where the file system's rename is
    files.rename(files.makeQualified(temp), files.makeQualified(target), how)


def _read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        size = int(fs.getFileStatus(p).getLen())
        data = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
        return bytes(data)[:size].decode()
    finally:
        stream.close()


def build_index(files: DataFrame, root: str, *, name: str = "", trees: DataFrame | None = None, tags: DataFrame | None = None, ngrams: bool = False, by_tree: bool = True) -> str:
    """Write a snapshot and make it the current one; its folder."""
    spark = files.sparkSession
    files = files.select(*FILE_COLUMNS)
    stamp = f"{root}/{int(time.time())}-{uuid.uuid4().hex[:8]}"
    # one sorted run of each tree in each task: few files a tree however many there are
    placed = files.repartitionByRange("tree", "file_no").sortWithinPartitions("tree", "file_no") if by_tree else files
    writer = placed.write.option("compression", "zstd")
    (writer.partitionBy("tree") if by_tree else writer).parquet(f"{stamp}/files")
    stored = spark.read.parquet(f"{stamp}/files")
    if trees is None:
        trees = stored.select(F.col("tree").cast("string").alias("name"), "version").distinct().withColumn("url_pattern", F.lit("")).withColumn("remote", F.lit("")).withColumn("github", F.lit("")).withColumn("labels", F.array().cast("array<string>"))
    trees.coalesce(1).write.parquet(f"{stamp}/trees")
    if tags is not None:
        tags.write.parquet(f"{stamp}/tags")
    if ngrams:
        posting_blocks(load_files(spark, stamp)).write.option("compression", "zstd").parquet(f"{stamp}/ngrams")
    meta = {"version": VERSION, "name": name, "index_time": int(time.time()), "has_tags": tags is not None, "has_ngrams": ngrams}
    _write_text(spark, f"{stamp}/meta.json", json.dumps(meta))
    _write_text(spark, f"{root}/CURRENT", stamp)
    return stamp


def current(spark: SparkSession, root: str) -> str:
    got = _read_text(spark, f"{root}/CURRENT")
    if got is None:
        raise IndexError_(f"no index in {root}")
    return got.strip()


def load_meta(spark: SparkSession, stamp: str) -> dict:
    text = _read_text(spark, f"{stamp}/meta.json")
    meta = json.loads(text) if text else {}
    if meta.get("version") != VERSION:
        raise IndexError_(f"{stamp} holds no index of version {VERSION}")
    return meta


def load_files(spark: SparkSession, stamp: str) -> DataFrame:
    df = spark.read.parquet(f"{stamp}/files")
    return df.select("file_no", F.col("tree").cast("string").alias("tree"), "version", "path", "lines", "content", "n_lines")


def load_ngrams(spark: SparkSession, stamp: str) -> DataFrame:
    """``tri, file_no``"""
    return pairs_of(spark.read.parquet(f"{stamp}/ngrams"))


def inspect(files: DataFrame) -> DataFrame:
    """Counts and sizes of an index, one row."""
    return files.agg(
        F.countDistinct("tree", "version").alias("trees"),
        F.count("*").alias("files"),
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0)).alias("content_bytes"),
        F.coalesce(F.sum(F.octet_length("path").cast("long") + 1), F.lit(0)).alias("path_bytes"),
    )


def dump_trees(files: DataFrame) -> DataFrame:
    return files.groupBy("tree", "version").agg(F.count("*").alias("files")).orderBy("tree", "version")


def dump_source(files: DataFrame) -> DataFrame:
    """Each distinct line once."""
    return files.select(F.explode("lines").alias("line")).distinct()


def dump_file(files: DataFrame, path: str) -> DataFrame:
    """The first file of exactly this path, whole."""
    return files.where(F.col("path") == path).orderBy("file_no").limit(1).select("file_no", "path", F.array_join("lines", "\n").alias("text"))
