"""Browsing: folder listings, file views, read-me files, and the state of backends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def dir_entries(files: DataFrame) -> DataFrame:
    """``tree, version, dir, name, is_dir``: every entry of every folder once."""
    path = F.regexp_replace("path", "^/+", "")
    parts = files.select("tree", "version", F.split(path, "/").alias("p"))
    level = parts.select("tree", "version", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"))
    return level.select("tree", "version", F.array_join(F.slice("p", 1, F.col("i") - 1), "/").alias("dir"), F.element_at("p", F.col("i")).alias("name"), (F.col("i") < F.size("p")).alias("is_dir")).distinct()


def list_dir(files: DataFrame, tree: str, folder: str = "") -> DataFrame:
    """One folder: folders first, then by name."""
    return dir_entries(files.where(F.col("tree") == tree)).where(F.col("dir") == folder.strip("/")).orderBy(F.desc("is_dir"), "name")


def readme_by_dir(files: DataFrame) -> DataFrame:
    """The first read-me file of each folder, by name."""
    named = files.select("tree", "version", S.dirname(F.col("path")).alias("dir"), S.basename(F.col("path")).alias("name"), "file_no").where(S.readme_extension(F.col("name")).isNotNull())
    w = Window.partitionBy("tree", "version", "dir").orderBy("name", "file_no")
    return named.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def file_views(files: DataFrame) -> DataFrame:
    """What a page about a file shows: name, language, number of lines, breadcrumbs."""
    first = F.when(F.size("lines") > 1, F.element_at("lines", 1))
    return files.select("file_no", "tree", "version", "path", S.basename(F.col("path")).alias("name"), S.language(F.col("path"), first).alias("language"), "n_lines", S.breadcrumbs(F.col("path")).alias("breadcrumbs"))


def stalest(infos: DataFrame, now: int) -> DataFrame:
    """Age of the oldest index in seconds; -1 if there is none or one has no time yet."""
    return infos.agg(F.when((F.count("*") == 0) | (F.count("index_time") < F.count("*")), F.lit(-1)).otherwise(F.max(F.lit(now) - F.col("index_time"))).cast("long").alias("age"))


def healthy(infos: DataFrame) -> DataFrame:
    return infos.agg(F.coalesce(F.min((F.coalesce("index_time", F.lit(0)) > 0).cast("int")), F.lit(1)).cast("boolean").alias("healthy"))


def repo_groups(trees: DataFrame) -> DataFrame:
    """Repository names by owner (what precedes the last slash), sorted."""
    owner = F.regexp_extract("name", "^(.*/)", 1)
    return trees.select(owner.alias("owner"), "name").distinct().orderBy("owner", "name")
