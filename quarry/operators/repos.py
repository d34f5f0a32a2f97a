"""Repository lists: filters, order, and the index specification made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_repos(repos: DataFrame, ignored: DataFrame | None = None, *, forks: bool = True, archived: bool = False) -> DataFrame:
    """Without forks or archived repositories as asked, and without those on the ignore list."""
    out = repos
    if not forks:
        out = out.where(~F.coalesce("fork", F.lit(False)))
    if not archived:
        out = out.where(~F.coalesce("archived", F.lit(False)))
    if ignored is not None:
        out = out.join(ignored.select("full_name"), "full_name", "left_anti")
    return out.orderBy("full_name")


def union_repos(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates(["full_name"]).orderBy("full_name")


def repo_specs(repos: DataFrame, folder: str, *, http: bool = False, revisions: tuple[str, ...] = ("HEAD",), password_env: str = "", depth: int = 0) -> DataFrame:
    """``name, path, revisions, metadata, clone_options`` of each repository."""
    name = F.col("full_name")
    remote = F.col("clone_url") if http else F.col("ssh_url")
    options = F.struct(F.lit(depth).alias("depth"), F.lit(password_env if http else "").alias("password_env"))
    meta = F.struct(F.concat(F.col("html_url"), F.lit("/blob/{version}/{path}#L{lno}")).alias("url_pattern"), remote.alias("remote"), name.alias("github"))
    return repos.select(name.alias("name"), F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("path"), F.array(*[F.lit(r) for r in revisions]).alias("revisions"), meta.alias("metadata"), options.alias("clone_options")).orderBy("name")


def ordered_contents(files: DataFrame) -> DataFrame:
    """Files by worth: 100, less 10 for a path with ``test``, less 5 for a build file."""
    score = 100 - F.when(F.col("path").rlike("test"), 10).otherwise(0) - F.when(F.col("path").rlike("BUILD"), 5).otherwise(0)
    return files.select("file_no", "path", score.alias("score")).orderBy(F.desc("score"), "path")
