"""Symbol tags: parsing, joining to files, and the ranked passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import Query, has_upper
from .search import Pattern, context, file_condition

_ROW = '^([^\\t]+)\\t([^\\t]+)\\t(\\d+);"\\t(.+)$'
#: a line pattern with one of these can match no tag name
_NOT_IN_NAMES = set(" !\"#%&',-/;<=>@`")


def parse_tags(rows: DataFrame, line: str = "value") -> DataFrame:
    """``tag, tag_path, lno, fields`` (and the other columns) from rows of a tags file; others are dropped."""
    c = F.col(line)
    part = lambda i: F.regexp_extract(c, _ROW, i)
    rest = [x for x in rows.columns if x != line]
    return rows.where(c.rlike(_ROW)).select(*rest, part(1).alias("tag"), part(2).alias("tag_path"), part(3).cast("long").alias("lno"), part(4).alias("fields"))


def tags_of_files(files: DataFrame) -> DataFrame:
    """``tree, path, lno, tag, fields`` from an index whose files are tags files."""
    rows = files.select("tree", F.col("path").alias("tags_path"), F.explode("lines").alias("value"))
    return parse_tags(rows).select("tree", tag_file_path(F.col("tags_path"), F.col("tag_path")).alias("path"), "lno", "tag", "fields")


def tag_file_path(tags_path: Column, tag_path: Column) -> Column:
    """Path of the tagged file: relative to the folder of the tags file."""
    folder = F.regexp_replace(tags_path, "/?[^/]*$", "")
    return F.when(folder == "", tag_path).otherwise(F.concat_ws("/", folder, tag_path))


def join_tags(tags: DataFrame, files: DataFrame) -> DataFrame:
    """Tags with their file, line and lines; tags of unknown files or stale line numbers are dropped.

    ``tags``: tree, path, lno, tag, fields.
    """
    t = tags.select("tree", "path", F.col("lno").alias("tag_lno"), "tag", "fields")
    return files.join(t, ["tree", "path"]).where((F.col("tag_lno") >= 1) & (F.col("tag_lno") <= F.size("lines"))).withColumn("line", F.element_at("lines", F.col("tag_lno").cast("int")))


def might_match_tags(pattern: str) -> bool:
    return bool(pattern) and not (set(pattern) & _NOT_IN_NAMES) and not pattern.startswith("^") and not pattern.endswith("$")


def tag_pass(joined: DataFrame, q: Query, name: Pattern, rank: int, k: int) -> DataFrame:
    """Matches of one pass: tags whose name fits, filtered by fields and files."""
    out = joined.where(file_condition(q) & name.matches(F.col("tag")))
    if q.tags:
        out = out.where(Pattern.compile(q.tags, not has_upper(q.tags), "tags").matches(F.col("fields")))
    if q.not_tags:
        out = out.where(~Pattern.compile(q.not_tags, not has_upper(q.not_tags), "-tags").matches(F.col("fields")))
    lno = F.col("tag_lno").cast("int")
    before, after = context(F.col("lines"), lno, k)
    left = F.greatest(F.expr("locate(tag, line)") - 1, F.lit(0))
    bounds = F.array(left.cast("int"), (left + F.when(F.expr("locate(tag, line)") > 0, F.length("tag")).otherwise(0)).cast("int"))
    return out.select("file_no", "tree", "version", "path", lno.alias("lno"), before.alias("context_before"), after.alias("context_after"), bounds.alias("bounds"), "line", F.lit(rank).alias("pass"))


def name_passes(line: str, fold: bool) -> list[Pattern]:
    """Exact names, then names that begin with a match."""
    return [Pattern.compile(f"^(?:{line})$", fold, guarded=False), Pattern.compile(f"^(?:{line})", fold, guarded=False)]


def first_of_passes(passes: list[DataFrame]) -> DataFrame:
    """Union of passes where the first occurrence of a (file, line) wins, best pass first."""
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("file_no", "lno").orderBy("pass", F.col("bounds")[0], F.col("bounds")[1])
    return out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
