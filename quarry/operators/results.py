"""What is done with results: grouping, facets, context clipping, links, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def group_by_file(matches: DataFrame) -> DataFrame:
    """One row a file with its matches in line order, files in order of their first match."""
    item = F.struct("lno", "bounds", "line", "context_before", "context_after")
    return matches.groupBy("file_no", "tree", "version", "path").agg(F.sort_array(F.collect_list(item)).alias("matches"), F.count("*").alias("n_matches")).orderBy("file_no")


def total_matches(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.sum("n_matches"), F.lit(0)).alias("total"), F.count("*").alias("files"))


def clip_contexts(matches: DataFrame) -> DataFrame:
    """Adds ``clip_before`` and ``clip_after``: how many context lines to show so
    that neighbours in a file neither repeat nor hide lines (null: all)."""
    w = Window.partitionBy("tree", "version", "path").orderBy("lno")
    own = matches.withColumn("_nb", F.size("context_before")).withColumn("_na", F.size("context_after"))
    for name, way in (("p", F.lag), ("n", F.lead)):
        for c in ("lno", "_na", "_nb"):
            own = own.withColumn(f"_{name}{c}", way(c).over(w))

    def split_at(lno_a: Column, after_a: Column, lno_b: Column, before_b: Column) -> tuple[Column, Column, Column]:
        last, first = lno_a + after_a, lno_b - before_b
        middle = F.ceil((lno_a + lno_b) / 2)
        return F.least(F.greatest(middle, first), last + 1), last, first

    at, last, first = split_at(F.col("_plno"), F.col("_p_na"), F.col("lno"), F.col("_nb"))
    before = F.when(F.col("_plno").isNotNull() & (last - first + 1 >= 0), at - first)
    at, last, first = split_at(F.col("lno"), F.col("_na"), F.col("_nlno"), F.col("_n_nb"))
    after = F.when(F.col("_nlno").isNotNull() & (last - first + 1 >= 0), last - (at - 1))
    return own.select(*matches.columns, before.cast("int").alias("clip_before"), after.cast("int").alias("clip_after"))


def extension_facet(matches: DataFrame, file_matches: DataFrame, top: int = 5) -> DataFrame:
    """Commonest extensions, one count for each matching file and each path hit; by count, then name."""
    seen = matches.select("tree", "version", "path").distinct().unionAll(file_matches.select("tree", "version", "path"))
    ext = seen.select(S.extension(F.col("path")).alias("ext")).where("ext <> ''")
    return ext.groupBy("ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(top)


def shown_facet(facet: DataFrame, has_file_filter: bool) -> DataFrame:
    """Alphabetical; empty if there are fewer than two or the query has a file filter already."""
    many = Window.partitionBy(F.lit(0))
    kept = facet.withColumn("_c", F.count("*").over(many)).where(F.lit(not has_file_filter) & (F.col("_c") >= 2))
    return kept.drop("_c").orderBy("ext")


def highlights(matches: DataFrame, text: str = "line") -> DataFrame:
    """Adds ``pre``, ``hit`` and ``post``: the text around and in the bounds."""
    c, left, right = F.col(text), F.col("bounds")[0], F.col("bounds")[1]
    return matches.withColumn("pre", F.substring(c, F.lit(1), left)).withColumn("hit", F.substring(c, left + 1, right - left)).withColumn("post", F.substring(c, right + 1, F.length(c)))


def with_links(matches: DataFrame, trees: DataFrame) -> DataFrame:
    """Adds ``url`` from the url pattern of the tree's metadata; trees are few, and joined by name."""
    t = trees.select("name", "url_pattern").dropDuplicates(["name"])
    joined = matches.join(t, matches.tree == t.name, "left")
    return joined.withColumn("url", S.external_url(F.col("url_pattern"), F.col("version"), F.col("tree"), F.col("path"), F.col("lno"))).drop("name", "url_pattern")


def custom_links(matches: DataFrame, links: list[dict]) -> DataFrame:
    """Adds ``links``: label and url of each configured link whose whitelist fits
    ``tree:version:path``; a template with {lno} is for single lines."""
    where = F.concat_ws(":", "tree", "version", "path")
    made = []
    for link in links:
        fits = where.rlike(link["whitelist_pattern"]) if link.get("whitelist_pattern") else F.lit(True)
        url = S.external_url(F.lit(link["url_template"]), F.col("version"), F.col("tree"), F.col("path"), F.col("lno"))
        made.append(F.when(fits, F.struct(F.lit(link["label"]).alias("label"), url.alias("url"), F.lit("{lno}" in link["url_template"]).alias("by_line"))))
    empty = F.array().cast("array<struct<label:string,url:string,by_line:boolean>>")
    return matches.withColumn("links", F.filter(F.array(*made), lambda x: x.isNotNull()) if made else empty)


def cli_lines(matches: DataFrame, show_version: bool = False) -> DataFrame:
    """``tree:[version:]path:lno: line``"""
    head = [F.when(F.col("tree") != "", F.concat(F.col("tree"), F.lit(":"))).otherwise("")]
    if show_version:
        head.append(F.when(F.col("version") != "", F.concat(F.col("version"), F.lit(":"))).otherwise(""))
    return matches.select("file_no", "lno", F.concat(*head, F.col("path"), F.lit(":"), F.col("lno").cast("string"), F.lit(": "), F.col("line")).alias("text"))


def json_rows(matches: DataFrame) -> DataFrame:
    """Rows as JSON objects whose arrays are never null."""
    a = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    return matches.select("file_no", "lno", F.to_json(F.struct("tree", "version", "path", "lno", a("context_before"), a("context_after"), "bounds", "line")).alias("json"))


def count_label(n: int, why: str) -> str:
    return f"{n}+" if why != "NONE" else str(n)
