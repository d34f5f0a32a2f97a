"""The registered queries over the driver's tables, each with its SQL oracle.

Corpora: ``documents`` (tree = source, version = language), ``pages`` (tree =
host, path = url) and ``conversations`` (tree = role).  DuckDB's patterns have
the semantics of the search dialect, so it is an independent judge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import browse, index as ix, ingest, ngram, repos, results as R, tags as tg
from ..operators.search import Pattern, file_condition, files_density, first_lines, search_lines, search_paths
from . import planner
from .engine import Engine
from .query import Query, parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE_SQL[name] = sql


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.documents_as_files(_table(spark, sf, "documents"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.pages_as_files(_table(spark, sf, "pages"))


def chats(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.conversations_as_files(_table(spark, sf, "conversations"))


# -- SQL of the corpora ------------------------------------------------------

_SOURCE = {
    "docs": "SELECT doc_id AS file_no, source AS tree, lang AS version, lang || '/' || source || '/' || doc_id || '.txt' AS path, text FROM documents",
    "pages": "SELECT page_id AS file_no, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS tree, '' AS version, url AS path, html AS text FROM pages",
    "chats": "SELECT conv_id * 1000 + turn AS file_no, role AS tree, '' AS version, conv_id || '/' || turn AS path, text FROM conversations",
}


def pre(corpus: str = "docs") -> str:
    """F: files; L: their numbered lines; A: their lines as lists."""
    return f"""WITH F AS (SELECT file_no, tree, version, path, string_split(text, chr(10)) AS p FROM ({_SOURCE[corpus]}) WHERE text IS NOT NULL AND NOT contains(text, chr(0))),
L0 AS (SELECT file_no, tree, version, path, len(p) AS n, unnest(p) AS raw, generate_subscripts(p, 1)::INT AS lno FROM F),
L AS (SELECT file_no, tree, version, path, lno, CASE WHEN strlen(raw) >= 1023 THEN '' ELSE raw END AS line FROM L0 WHERE NOT (lno = n AND raw = '')),
A AS (SELECT file_no, list(line ORDER BY lno) AS lines FROM L GROUP BY file_no)"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, pattern: str, fold: bool = False) -> str:
    return f"regexp_matches({column}, {q(('(?i)' if fold else '') + pattern)})"


def bounds_sql(column: str, pattern: str, fold: bool = False) -> str:
    both = q(f"(?s{'i' if fold else ''})^(.*?)({pattern})")
    left, hit = (f"length(regexp_extract({column}, {both}, {i}))" for i in (1, 2))
    return f"{left}::INT AS lo, ({left} + {hit})::INT AS hi"


def lines_sql(pattern: str, fold: bool = False, where: str = "true", corpus: str = "docs", ctx: int = 0) -> str:
    extra, join = "", ""
    if ctx:
        extra = f", array_to_string(list_reverse(lines[greatest(1, lno - {ctx}):lno - 1]), chr(10)) AS before, array_to_string(lines[lno + 1:lno + {ctx}], chr(10)) AS after"
        join = " JOIN A USING (file_no)"
    return f"{pre(corpus)} SELECT L.file_no, tree, version, path, lno, {bounds_sql('line', pattern, fold)}, line{extra} FROM L{join} WHERE {has('line', pattern, fold)} AND ({where})"


def flat(matches: DataFrame, ctx: bool = False) -> DataFrame:
    """Matches with bounds and contexts as plain columns."""
    more = [F.array_join("context_before", "\n").alias("before"), F.array_join("context_after", "\n").alias("after")] if ctx else []
    return matches.select("file_no", "tree", "version", "path", "lno", F.col("bounds")[0].alias("lo"), F.col("bounds")[1].alias("hi"), "line", *more)


def flat_paths(hits: DataFrame) -> DataFrame:
    return hits.select("file_no", "tree", "version", "path", F.col("bounds")[0].alias("lo"), F.col("bounds")[1].alias("hi"))


def run(files: DataFrame, query: Query, ctx: bool = False) -> DataFrame:
    return flat(search_lines(files, Pattern.compile(query.line, query.fold_case), file_condition(query), query.context_lines or 3), ctx)


def search(name: str, pattern: str, fold: bool = False, *, corpus: str = "docs", where: str = "true", ctx: int = 0, **filters) -> None:
    files = {"docs": docs, "pages": pages, "chats": chats}[corpus]
    query = Query(line=pattern, fold_case=fold, context_lines=ctx, **filters)
    add(name, lambda s, d: run(files(s, d), query, bool(ctx)), lines_sql(pattern, fold, where, corpus, ctx))


# -- ingest --------------------------------------------------------------------

add("line_numbering", lambda s, d: ingest.lines_of(docs(s, d)).select("file_no", "lno", "line"), f"{pre()} SELECT file_no, lno, line FROM L")
add(
    "long_line_blanking",
    lambda s, d: _table(s, d, "documents").select(F.col("source").alias("tree"), F.explode(F.split("text", "\n")).alias("raw")).groupBy("tree").agg(F.sum((F.octet_length("raw") >= ingest.LINE_LIMIT - 1).cast("long")).alias("blanked")),
    f"{pre()} SELECT tree, count(*) FILTER (strlen(raw) >= 1023) AS blanked FROM L0 GROUP BY tree",
)
add("nul_file_filter", lambda s, d: docs(s, d).groupBy("tree").agg(F.count("*").alias("files")), f"{pre()} SELECT tree, count(*) AS files FROM F GROUP BY tree")
add("pages_as_files", lambda s, d: pages(s, d).select("file_no", "tree", "path", "n_lines"), f"{pre('pages')} SELECT F.file_no, tree, path, coalesce(len(lines), 0)::INT AS n_lines FROM F LEFT JOIN A USING (file_no)")
add("conversations_as_files", lambda s, d: chats(s, d).select("file_no", "tree", "path", "n_lines"), f"{pre('chats')} SELECT F.file_no, tree, path, coalesce(len(lines), 0)::INT AS n_lines FROM F LEFT JOIN A USING (file_no)")
add(
    "ingest_metrics",
    lambda s, d: ingest.ingest_metrics(docs(s, d)),
    f"""{pre()}, D AS (SELECT line, count(*) AS n FROM L GROUP BY line), S AS (SELECT coalesce(sum(strlen(line) + 1) - 1, 0) AS bytes, 4 * (1 + 3 * count(line)) AS ranges FROM F LEFT JOIN L USING (file_no) GROUP BY F.file_no)
SELECT * FROM (SELECT 'index.bytes' AS name, sum(strlen(line) * n)::BIGINT AS value FROM D UNION ALL SELECT 'index.bytes.dedup', sum(strlen(line) + 1)::BIGINT FROM D
UNION ALL SELECT 'index.files', count(*) FROM F UNION ALL SELECT 'index.lines', count(*) FROM L UNION ALL SELECT 'index.lines.dedup', count(*) FROM D UNION ALL SELECT 'index.content.ranges', count(*) FROM L
UNION ALL SELECT 'index.data.chunks', ceil(sum(bytes) / 134217728.0)::BIGINT FROM S UNION ALL SELECT 'index.content.chunks', ceil(sum(ranges) / 4194304.0)::BIGINT FROM S)""",
)
add("line_dictionary", lambda s, d: ingest.line_dictionary(docs(s, d)), f"{pre()} SELECT line, count(*) AS occurrences, count(DISTINCT file_no) AS files FROM L GROUP BY line")
def _byte_ranges(s: SparkSession, d: str) -> DataFrame:
    """Byte ranges of the lines that are not empty, in their file."""
    at = F.sum(F.octet_length("line").cast("long") + 1).over(Window.partitionBy("file_no").orderBy("lno"))
    placed = ingest.lines_of(docs(s, d)).withColumn("right", at).withColumn("left", F.col("right") - F.octet_length("line") - 1)
    return placed.where("line <> ''").select("file_no", "left", "right")


_RANGES = f"{pre()}, P AS (SELECT file_no, line, sum(strlen(line) + 1) OVER (PARTITION BY file_no ORDER BY lno)::BIGINT AS r FROM L), G AS (SELECT file_no, r - strlen(line) - 1 AS l, r FROM P WHERE line <> '')"
add(
    "posting_range_merge",
    lambda s, d: ingest.merge_ranges(_byte_ranges(s, d), 256),
    f"""{_RANGES}, N AS (SELECT *, CASE WHEN l - max(r) OVER (PARTITION BY file_no ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 256 THEN 0 ELSE 1 END AS fresh FROM G),
I AS (SELECT *, sum(fresh) OVER (PARTITION BY file_no ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS island FROM N)
SELECT file_no, min(l)::BIGINT AS "left", max(r)::BIGINT AS "right", count(*) AS parts FROM I GROUP BY file_no, island""",
)
add(
    "posting_range_share",
    lambda s, d: ingest.shared_ranges(_byte_ranges(s, d)).select("left", "right", F.array_join(F.transform("files", lambda f: f.cast("string")), ",").alias("files")),
    f"""{_RANGES} SELECT l::BIGINT AS "left", r::BIGINT AS "right", string_agg(DISTINCT file_no::VARCHAR, ',' ORDER BY file_no::VARCHAR) AS files FROM G GROUP BY l, r""",
)
QUERIES["posting_range_share"] = lambda s, d: ingest.shared_ranges(_byte_ranges(s, d)).select("left", "right", F.array_join(F.sort_array(F.transform("files", lambda f: f.cast("string"))), ",").alias("files"))
add(
    "file_numbering",
    lambda s, d: ingest.number_files(_table(s, d, "documents").select("source", "doc_id"), "source", "doc_id"),
    "SELECT (row_number() OVER (ORDER BY source, doc_id) - 1)::BIGINT AS file_no, source, doc_id FROM documents",
)

# -- line search -----------------------------------------------------------------

search("search_literal", "thing")
search("search_regex_class", "[xyz][a-e]+[0-9]")
search("search_unicode_class", "[À-ÿ]{2}")
search("search_empty_line", "^$")
search("search_casefold", "licensed under", True)
search("search_alternation", "(Apache|MIT) License|idiot")
search("search_word_boundary", r"\bthe\b.*\bof\b")
search("search_not_word_boundary", r"\Bth\B")
search("search_anchors", r"^[A-Z][a-z]+\.$")
search("search_digits", r"\d{3}-\d{4}")
search("search_perl_negations", r"\S\W\S$")
search("search_posix_class", "[[:upper:]]{2}[[:punct:]]")
search("search_bracket_literals", r"[[|&]")
search("search_lazy", "th.*?ng")
search("search_bounded_repeat", "(an|en){3,5}")
add("search_repeat_of_repeat", lambda s, d: run(docs(s, d), Query(line="(?:ea)++[.]")), lines_sql("(?:(?:ea)+)+[.]"))
search("search_named_group", r"(?P<head>token) = (?P<q>\")")
search("search_inline_flag", "(?i:MIT) license")
search("search_hex_escape", r"\x65\x{e9}")
search("search_context", "idiot", ctx=3)
search("search_context_wide", r"@mail\d", ctx=7)
search("search_pages", r"<title>[^<]*&amp;", corpus="pages")
search("search_conversations", r"^[A-Z].*[.]$", corpus="chats", ctx=2)
search("utf8_code_point_bounds", "ß[a-z]")
add(
    "search_smartcase_sensitive",
    lambda s, d: run(docs(s, d), parse("Licensed")),
    lines_sql("Licensed"),
)


def _window_context(s: SparkSession, d: str) -> DataFrame:
    """The context by a window frame over the lines, instead of a slice."""
    w = Window.partitionBy("file_no").orderBy("lno")
    lines = ingest.lines_of(docs(s, d))
    near = lines.withColumn("before", F.reverse(F.collect_list("line").over(w.rowsBetween(-2, -1)))).withColumn("after", F.collect_list("line").over(w.rowsBetween(1, 2)))
    return near.where(Pattern.compile("moron", False).matches(F.col("line"))).select("file_no", "lno", "line", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


add("search_context_window", _window_context, f"{pre()} SELECT file_no, lno, line, array_to_string(list_reverse(lines[greatest(1, lno - 2):lno - 1]), chr(10)) AS before, array_to_string(lines[lno + 1:lno + 2], chr(10)) AS after FROM L JOIN A USING (file_no) WHERE contains(line, 'moron')")

# -- filters -------------------------------------------------------------------

search("filter_file_all", "idiot", file=("^en/", "1[.]txt"), where=f"{has('path', '^en/', True)} AND {has('path', '1[.]txt', True)}")
search("filter_file_smart_case", "idiot", file=("EN/",), where="regexp_matches(path, 'EN/')")
search("filter_not_file", "idiot", not_file=("src1", "7"), where=f"NOT {has('path', 'src1', True)} AND NOT {has('path', '7', True)}")
search("filter_repo", "idiot", repo="^src1.$", where=has("tree", "^src1.$", True))
search("filter_not_repo", "idiot", not_repo="src1|2", where=f"NOT {has('tree', 'src1|2', True)}")
search("filter_repo_multi", "idiot", repos=("src0", "src7"), where="tree IN ('src0', 'src7')")
search("filter_combined", "clown", True, file=("txt",), not_file=("9",), repo="src", not_repo="src0", where=f"{has('path', 'txt', True)} AND NOT {has('path', '9', True)} AND {has('tree', 'src', True)} AND NOT {has('tree', 'src0', True)}")
add(
    "accept_any_file",
    lambda s, d: ingest.line_dictionary(docs(s, d)).join(ingest.lines_of(docs(s, d).where(file_condition(Query(file=("^de/",))))).select("line").distinct(), "line", "left_semi").select("line", "files"),
    f"{pre()} SELECT line, count(DISTINCT file_no) AS files FROM L GROUP BY line HAVING count(*) FILTER ({has('path', '^de/')}) > 0",
)
add(
    "files_density",
    lambda s, d: files_density(docs(s, d), file_condition(Query(file=("1",), not_repo="src1"))).select("files", "accepted", F.round("density", 6).alias("density")),
    f"{pre()} SELECT count(*) AS files, count(*) FILTER ({has('path', '1')} AND NOT {has('tree', 'src1')}) AS accepted, round(avg(CASE WHEN {has('path', '1')} AND NOT {has('tree', 'src1')} THEN 1 ELSE 0 END), 6) AS density FROM F",
)
add("utf8_validity", lambda s, d: ingest.lines_of(docs(s, d)).groupBy("tree").agg(F.sum(F.is_valid_utf8("line").cast("long")).alias("valid")), f"{pre()} SELECT tree, count(*) AS valid FROM L GROUP BY tree")

# -- paths, limits, unions ------------------------------------------------------

add("filename_search", lambda s, d: flat_paths(search_paths(docs(s, d), Pattern.compile("src1/.*9", False))), f"{pre()} SELECT file_no, tree, version, path, {bounds_sql('path', 'src1/.*9')} FROM F WHERE {has('path', 'src1/.*9')}")


def _names(s: SparkSession, d: str) -> DataFrame:
    query = parse("file:src1 file:9 file:en")
    return flat_paths(Engine(docs(s, d)).file_matches(query))


add("filename_only_and", _names, f"{pre()} SELECT file_no, tree, version, path, {bounds_sql('path', 'src1', True)} FROM F WHERE {has('path', 'src1')} AND {has('path', '9')} AND {has('path', 'en')}")
add("filename_urls", lambda s, d: flat_paths(search_paths(pages(s, d), Pattern.compile(r"[?]page=\d", False))), f"{pre('pages')} SELECT file_no, tree, version, path, {bounds_sql('path', '[?]page=[0-9]')} FROM F WHERE {has('path', '[?]page=[0-9]')}")


def _both(s: SparkSession, d: str) -> DataFrame:
    p = Pattern.compile("7[.]txt|moron", False)
    a = flat(search_lines(docs(s, d), p)).select(F.lit("line").alias("kind"), "file_no", "path", "lno", "lo", "hi")
    b = flat_paths(search_paths(docs(s, d), p)).select(F.lit("path").alias("kind"), "file_no", "path", F.lit(0).alias("lno"), "lo", "hi")
    return a.unionByName(b)


add(
    "search_union_files",
    _both,
    f"{pre()} SELECT 'line' AS kind, file_no, path, lno, {bounds_sql('line', '7[.]txt|moron')} FROM L WHERE {has('line', '7[.]txt|moron')} UNION ALL SELECT 'path', file_no, path, 0, {bounds_sql('path', '7[.]txt|moron')} FROM F WHERE {has('path', '7[.]txt|moron')}",
)
add("search_limit_ordered", lambda s, d: flat(first_lines(docs(s, d), Pattern.compile("the", False), None, 3, 50)), lines_sql("the") + " ORDER BY L.file_no, lno LIMIT 50")
add(
    "exit_reason",
    lambda s, d: s.createDataFrame([("idiot", 10**9), ("the", 50)], "pattern string, most long").join(
        search_lines(docs(s, d), Pattern.compile("idiot", False)).agg(F.count("*").alias("n")).withColumn("pattern", F.lit("idiot")).unionByName(search_lines(docs(s, d), Pattern.compile("the", False)).agg(F.count("*").alias("n")).withColumn("pattern", F.lit("the"))), "pattern"
    ).select("pattern", F.when(F.col("n") >= F.col("most"), "MATCH_LIMIT").otherwise("NONE").alias("why"), F.least("n", "most").alias("shown")),
    f"""{pre()}, C AS (SELECT 'idiot' AS pattern, 1000000000 AS most, count(*) AS n FROM L WHERE contains(line, 'idiot') UNION ALL SELECT 'the', 50, count(*) FROM L WHERE contains(line, 'the'))
SELECT pattern, CASE WHEN n >= most THEN 'MATCH_LIMIT' ELSE 'NONE' END AS why, least(n, most) AS shown FROM C""",
)

# -- the query language ----------------------------------------------------------


def language(name: str, text: str, pattern: str, fold: bool, where: str = "true", regex: bool = True) -> None:
    add(name, lambda s, d: run(docs(s, d), parse(text, regex)), lines_sql(pattern, fold, where))


language("qlang_regex", "idiot.*the file:^en repo:src", "idiot.*the", True, f"{has('path', '^en')} AND {has('tree', 'src')}")
language("qlang_literal", "lit:e. ", r"e\.", False)
language("qlang_literal_mode", "ing. file:src1", r"ing\.", True, "contains(path, 'src1')", regex=False)
language("qlang_negations", "worthless -file:^fr -repo:src1", "worthless", True, f"NOT {has('path', '^fr')} AND NOT {has('tree', 'src1')}")
language("qlang_paren_escape", r"(the of) file:(en/src(2|3))", "(the of)", True, has("path", "en/src(2|3)"))
language("qlang_case", "case:en file:src4", "en", False, has("path", "src4"))
language("qlang_path_synonym", "idiot path:src2 file:en -path:7", "idiot", True, f"{has('path', 'src2')} AND {has('path', 'en')} AND NOT {has('path', '7')}")
add("qlang_max_matches", lambda s, d: _limited_query(s, d, "the max_matches:7"), lines_sql("the", True) + " ORDER BY L.file_no, lno LIMIT 7")


def _limited_query(s: SparkSession, d: str, text: str) -> DataFrame:
    query = parse(text)
    return flat(first_lines(docs(s, d), Pattern.compile(query.line, query.fold_case), file_condition(query), 3, query.max_matches))


# -- tags ------------------------------------------------------------------------


def tag_rows(s: SparkSession, d: str) -> DataFrame:
    """Tags made of the corpus: the first word of each line, as rows of a tags file."""
    x = ingest.lines_of(docs(s, d)).withColumn("w", F.regexp_extract("line", "^([A-Za-z]+)", 1))
    fields = F.when(F.col("lno") % 2 == 0, "f\tkind:function").otherwise("v\tkind:variable")
    return x.where("w <> ''").select("file_no", "tree", F.lit("tags").alias("tags_path"), F.concat_ws("\t", "w", "path", F.concat(F.col("lno").cast("string"), F.lit(';"')), fields).alias("value"))


def tag_table(s: SparkSession, d: str) -> DataFrame:
    t = tg.parse_tags(tag_rows(s, d))
    return t.select("tree", tg.tag_file_path(F.col("tags_path"), F.col("tag_path")).alias("path"), "lno", "tag", "fields")


_TAGS = f"""{pre()}, T AS (SELECT tree, path, lno::BIGINT AS lno, regexp_extract(line, '^([A-Za-z]+)', 1) AS tag, CASE WHEN lno % 2 = 0 THEN 'f' || chr(9) || 'kind:function' ELSE 'v' || chr(9) || 'kind:variable' END AS fields FROM L WHERE regexp_matches(line, '^[A-Za-z]'))"""
add("tags_parse", tag_table, f"{_TAGS} SELECT tree, path, lno, tag, fields FROM T")


def _tagged(s: SparkSession, d: str, query: Query, rank: int) -> DataFrame:
    joined = tg.join_tags(tag_table(s, d), docs(s, d))
    return flat(tg.tag_pass(joined, query, tg.name_passes(query.line, query.fold_case)[rank - 1], rank, 3), True)


def _tag_sql(where: str) -> str:
    return f"""{_TAGS} SELECT L.file_no, L.tree, L.version, L.path, L.lno, 0 AS lo, length(tag)::INT AS hi, line, array_to_string(list_reverse(lines[greatest(1, L.lno - 3):L.lno - 1]), chr(10)) AS before, array_to_string(lines[L.lno + 1:L.lno + 3], chr(10)) AS after
FROM T JOIN L ON T.tree = L.tree AND T.path = L.path AND T.lno = L.lno JOIN A USING (file_no) WHERE {where}"""


add("tags_join_context", lambda s, d: _tagged(s, d, Query(line="The[a-z]*"), 1), _tag_sql(has("tag", "^(?:The[a-z]*)$")))
add("tags_filter_kind", lambda s, d: _tagged(s, d, Query(line="T", tags="kind:function"), 2), _tag_sql(f"{has('tag', '^T')} AND {has('fields', 'kind:function')}"))
add("tags_not_filter", lambda s, d: _tagged(s, d, Query(line="T", not_tags="function"), 2), _tag_sql(f"{has('tag', '^T')} AND NOT {has('fields', 'function')}"))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    e = Engine(docs(s, d), tag_table(s, d))
    return e.matches(Query(line="Than")).select("file_no", "lno", "line", "pass", F.col("bounds")[0].alias("lo"), F.col("bounds")[1].alias("hi"))


add(
    "tags_first_ranked",
    _ranked,
    f"""{_TAGS}, J AS (SELECT L.file_no, L.lno, L.line, tag FROM T JOIN L ON T.tree = L.tree AND T.path = L.path AND T.lno = L.lno),
U AS (SELECT file_no, lno, line, 1 AS pass, 0 AS lo, length(tag) AS hi FROM J WHERE tag = 'Than' UNION ALL SELECT file_no, lno, line, 2, 0, length(tag) FROM J WHERE starts_with(tag, 'Than')
  UNION ALL SELECT file_no, lno, line, 3, {bounds_sql('line', 'Than').replace(' AS lo', '').replace(' AS hi', '')} FROM L WHERE contains(line, 'Than'))
SELECT file_no, lno, line, pass, lo::INT AS lo, hi::INT AS hi FROM U QUALIFY row_number() OVER (PARTITION BY file_no, lno ORDER BY pass) = 1""",
)

# -- results -----------------------------------------------------------------------


def hits(s: SparkSession, d: str, pattern: str = "idiot|clown", k: int = 3, **filters) -> DataFrame:
    query = Query(line=pattern, **filters)
    return search_lines(docs(s, d), Pattern.compile(pattern, False), file_condition(query), k)


_HITS = f"{pre()}, M AS (SELECT L.*, lines, {bounds_sql('line', 'idiot|clown')} FROM L JOIN A USING (file_no) WHERE {has('line', 'idiot|clown')})"
add(
    "group_by_file",
    lambda s, d: R.group_by_file(hits(s, d)).select("file_no", "path", "n_matches", F.array_join(F.transform("matches", lambda m: m["lno"].cast("string")), ",").alias("lnos")),
    f"{_HITS} SELECT file_no, any_value(path) AS path, count(*) AS n_matches, string_agg(lno::VARCHAR, ',' ORDER BY lno) AS lnos FROM M GROUP BY file_no",
)
add("group_total", lambda s, d: R.total_matches(R.group_by_file(hits(s, d))), f"{_HITS} SELECT count(*)::BIGINT AS total, count(DISTINCT file_no) AS files FROM M")
add(
    "context_clip",
    lambda s, d: R.clip_contexts(hits(s, d, "the", 3)).select("file_no", "lno", "clip_before", "clip_after"),
    f"""{pre()}, M AS (SELECT file_no, tree, version, path, lno, least(3, lno - 1) AS nb, least(3, len(lines) - lno) AS na FROM L JOIN A USING (file_no) WHERE contains(line, 'the')),
X AS (SELECT *, lag(lno) OVER w AS pl, lag(na) OVER w AS pa, lead(lno) OVER w AS nl, lead(nb) OVER w AS nnb FROM M WINDOW w AS (PARTITION BY tree, version, path ORDER BY lno)),
Y AS (SELECT *, least(greatest(ceil((pl + lno) / 2.0), lno - nb), pl + pa + 1) AS s1, least(greatest(ceil((lno + nl) / 2.0), nl - nnb), lno + na + 1) AS s2 FROM X)
SELECT file_no, lno, CASE WHEN pl IS NOT NULL AND pl + pa - (lno - nb) + 1 >= 0 THEN (s1 - (lno - nb))::INT END AS clip_before,
  CASE WHEN nl IS NOT NULL AND lno + na - (nl - nnb) + 1 >= 0 THEN (lno + na - (s2 - 1))::INT END AS clip_after FROM Y""",
)


def _facet(s: SparkSession, d: str) -> DataFrame:
    p = Pattern.compile("[a-z]", False)
    return R.extension_facet(search_lines(pages(s, d), p), search_paths(pages(s, d), p))


add(
    "extension_facets_top5",
    _facet,
    f"""{pre('pages')}, H AS (SELECT DISTINCT tree, version, path FROM L WHERE {has('line', '[a-z]')} UNION ALL SELECT tree, version, path FROM F WHERE {has('path', '[a-z]')}),
E AS (SELECT lower(regexp_extract(path, '(?i)[^/](\\.[a-z.]{{1,6}})$', 1)) AS ext FROM H) SELECT ext, count(*) AS n FROM E WHERE ext <> '' GROUP BY ext ORDER BY n DESC, ext LIMIT 5""",
)
add("extension_facets_shown", lambda s, d: R.shown_facet(_facet(s, d), False), f"SELECT * FROM ({ORACLE_SQL['extension_facets_top5']}) WHERE (SELECT count(*) FROM ({ORACLE_SQL['extension_facets_top5']})) >= 2")
add("highlight_split", lambda s, d: R.highlights(hits(s, d)).select("file_no", "lno", "pre", "hit", "post"), f"{_HITS} SELECT file_no, lno, line[1:lo] AS pre, line[lo + 1:hi] AS hit, line[hi + 1:] AS post FROM M")
add("cli_output", lambda s, d: R.cli_lines(hits(s, d), True), f"{_HITS} SELECT file_no, lno, tree || ':' || version || ':' || path || ':' || lno || ': ' || line AS text FROM M")
add(
    "json_reply_rows",
    lambda s, d: R.json_rows(hits(s, d)).select("file_no", "lno", F.get_json_object("json", "$.path").alias("path"), F.get_json_object("json", "$.bounds[0]").cast("int").alias("lo"), F.get_json_object("json", "$.line").alias("line"), F.json_array_length(F.get_json_object("json", "$.context_after")).alias("n_after")),
    f"{_HITS} SELECT file_no, lno, path, lo, line, len(lines[lno + 1:lno + 3])::INT AS n_after FROM M",
)


def _trees(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d).select(F.col("tree").alias("name")).distinct()
    return t.select("name", S.url_pattern_of(F.when(F.col("name") < "src3", F.concat(F.lit("org/"), "name")).otherwise(F.lit("")), F.when(F.col("name") >= "src3", "https://code.example.com/{name}/{version}/{path}#{lno}")).alias("url_pattern"))


add(
    "url_template",
    lambda s, d: R.with_links(hits(s, d), _trees(s, d)).select("file_no", "lno", "url"),
    f"{_HITS} SELECT file_no, lno, CASE WHEN tree < 'src3' THEN 'https://github.com/org/' || tree || '/blob/' || version || '/' || path || '#L' || lno ELSE 'https://code.example.com/' || tree || '/' || version || '/' || path || '#' || lno END AS url FROM M",
)
add(
    "custom_links",
    lambda s, d: R.custom_links(hits(s, d), [{"label": "blame", "url_template": "b/{path}/{lno}", "whitelist_pattern": "^src1:"}, {"label": "raw", "url_template": "r/{name}/{path}"}]).select("file_no", "lno", F.array_join(F.transform("links", lambda x: F.concat_ws("=", x["label"], x["url"])), " ").alias("links")),
    f"{_HITS} SELECT file_no, lno, CASE WHEN tree = 'src1' THEN 'blame=b/' || path || '/' || lno || ' ' ELSE '' END || 'raw=r/' || tree || '/' || path AS links FROM M",
)

# -- browsing and scalars -----------------------------------------------------------


def paths(s: SparkSession, d: str, *columns: Column) -> DataFrame:
    return docs(s, d).select("file_no", *columns)


add("basename_dirname", lambda s, d: paths(s, d, S.basename(F.col("path")).alias("base"), S.dirname(F.col("path")).alias("dir")), f"{pre()} SELECT file_no, regexp_extract(path, '[^/]*$') AS base, regexp_extract(path, '^(.*/)?') AS dir FROM F")
add("breadcrumbs", lambda s, d: paths(s, d, F.array_join(S.breadcrumbs(F.col("path")), "|").alias("crumbs")), f"{pre()} SELECT file_no, version || '|' || version || '/' || tree || '|' || path AS crumbs FROM F")
add("dir_listing", lambda s, d: browse.dir_entries(docs(s, d)), f"{pre()} SELECT DISTINCT tree, version, '' AS dir, version AS name, true AS is_dir FROM F UNION ALL SELECT DISTINCT tree, version, version, tree, true FROM F UNION ALL SELECT tree, version, version || '/' || tree, file_no || '.txt', false FROM F")
add("dir_listing_one", lambda s, d: browse.list_dir(docs(s, d), "src1", "en/src1"), f"{pre()} SELECT tree, version, 'en/src1' AS dir, file_no || '.txt' AS name, false AS is_dir FROM F WHERE tree = 'src1' AND version = 'en'")
add(
    "readme_first",
    lambda s, d: browse.readme_by_dir(docs(s, d).withColumn("path", F.concat(F.col("tree"), F.lit("/"), F.when(F.col("file_no") % 3 == 0, F.concat(F.lit("ReadMe."), F.when(F.col("file_no") % 2 == 0, "md").otherwise("txt"))).otherwise("code.c")))),
    f"{pre()}, N AS (SELECT tree, version, tree || '/' AS dir, 'ReadMe.' || CASE WHEN file_no % 2 = 0 THEN 'md' ELSE 'txt' END AS name, file_no FROM F WHERE file_no % 3 = 0) SELECT * FROM N QUALIFY row_number() OVER (PARTITION BY tree, version, dir ORDER BY name, file_no) = 1",
)
add(
    "lang_detect",
    lambda s, d: paths(s, d, S.language(F.concat(F.lit("a/"), F.element_at(F.array(*[F.lit(x) for x in ("x.py", "BUILD", "y.go", "none", "z.unknown")]), (F.col("file_no") % 5 + 1).cast("int"))), F.when(F.col("file_no") % 2 == 0, "#!/bin/bash").otherwise(F.lit(None))).alias("language")),
    f"{pre()} SELECT file_no, CASE file_no % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE CASE WHEN file_no % 2 = 0 THEN 'bash' ELSE '' END END AS language FROM F",
)
add("file_views", lambda s, d: browse.file_views(docs(s, d)).select("file_no", "name", "n_lines", F.size("breadcrumbs").alias("depth")), f"{pre()} SELECT F.file_no, F.file_no || '.txt' AS name, coalesce(len(lines), 0)::INT AS n_lines, 3 AS depth FROM F LEFT JOIN A USING (file_no)")
add(
    "ref_shorten",
    lambda s, d: paths(s, d, S.shorten_ref(F.element_at(F.array(F.concat(F.lit("refs/tags/v"), F.col("file_no").cast("string")), F.sha1(F.col("path").cast("binary")), F.lit("origin/main"), F.lit("refs/branches/origin/x")), (F.col("file_no") % 4 + 1).cast("int"))).alias("ref")),
    f"{pre()} SELECT file_no, CASE file_no % 4 WHEN 0 THEN 'v' || file_no WHEN 1 THEN substr(sha1(path), 1, 12) WHEN 2 THEN 'main' ELSE 'x' END AS ref FROM F",
)
add("internal_url", lambda s, d: paths(s, d, S.internal_url(F.col("tree"), F.col("path"), F.col("n_lines")).alias("url")), f"{pre()} SELECT F.file_no, '/view/' || tree || '/' || path || '#L' || coalesce(len(lines), 0) AS url FROM F LEFT JOIN A USING (file_no)")
add("view_url", lambda s, d: paths(s, d, S.view_url(F.col("tree"), F.col("path"), F.col("file_no") % 2 == 0).alias("url")), f"{pre()} SELECT file_no, '/view/' || tree || '/' || path || CASE WHEN file_no % 2 = 0 THEN '/' ELSE '' END AS url FROM F")
add("permalink", lambda s, d: paths(s, d, S.permalink(F.col("path"), F.sha1(F.col("path").cast("binary")), F.when(F.col("file_no") % 2 == 0, F.substring(F.sha1(F.col("path").cast("binary")), 1, 7)).otherwise("HEAD")).alias("url")), f"{pre()} SELECT file_no, CASE WHEN file_no % 2 = 0 THEN path ELSE path || '?commit=' || substr(sha1(path), 1, 16) END AS url FROM F")
add("external_domain", lambda s, d: _table(s, d, "pages").select("page_id", S.external_domain(F.col("url")).alias("domain")), "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain FROM pages")
add(
    "line_range_parse",
    lambda s, d: paths(s, d, F.array_join(F.transform(S.line_range(F.concat(F.lit("#L"), F.col("n_lines").cast("string"), F.lit("-L5"))), lambda x: x.cast("string")), "-").alias("range")),
    f"{pre()}, N AS (SELECT F.file_no, coalesce(len(lines), 0) AS n FROM F LEFT JOIN A USING (file_no)) SELECT file_no, n || '-' || greatest(n, 5) AS range FROM N",
)
add(
    "repo_url_split",
    lambda s, d: paths(s, d, S.split_repo_url(F.concat(F.lit("/view/"), F.col("tree"), F.lit("/"), F.col("path")), ["src1", "src1/en", "src10"]).alias("r")).select("file_no", "r.repo", "r.path"),
    f"{pre()} SELECT file_no, CASE WHEN tree = 'src1' AND version = 'en' THEN 'src1/en' WHEN tree IN ('src1', 'src10') THEN tree END AS repo, CASE WHEN tree = 'src1' AND version = 'en' THEN substr(path, 4) WHEN tree IN ('src1', 'src10') THEN path END AS path FROM F",
)
add("tree_entry_parse", lambda s, d: paths(s, d, S.tree_entry(F.concat(F.when(F.col("file_no") % 2 == 0, "120000").otherwise("100644"), F.lit(" blob "), F.sha1(F.col("path").cast("binary")), F.lit("\t"), F.col("path"))).alias("e")).select("file_no", "e.*"), f"{pre()} SELECT file_no, CASE WHEN file_no % 2 = 0 THEN '120000' ELSE '100644' END AS mode, 'blob' AS type, sha1(path) AS id, path AS name, file_no % 2 = 0 AS symlink FROM F")
add("html_escape", lambda s, d: _table(s, d, "pages").select("page_id", S.escape_html(F.col("html")).alias("escaped")), """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
add("version_order", lambda s, d: paths(s, d, S.version_key(F.concat(F.lit("v"), (F.col("file_no") % 13).cast("string"), F.lit("."), F.col("file_no").cast("string"))).alias("key")), f"{pre()} SELECT file_no, 'v' || lpad((file_no % 13)::VARCHAR, 18, '0') || '.' || lpad(file_no::VARCHAR, 18, '0') AS key FROM F")
add("repo_groups", lambda s, d: browse.repo_groups(docs(s, d).select(F.concat_ws("/", "version", "tree").alias("name"))), f"{pre()} SELECT DISTINCT version || '/' AS owner, version || '/' || tree AS name FROM F")
add(
    "backend_age",
    lambda s, d: browse.stalest(_table(s, d, "documents").groupBy("source").agg(F.max("doc_id").alias("index_time")), 10**9).crossJoin(browse.healthy(_table(s, d, "documents").groupBy("source").agg(F.max("doc_id").alias("index_time")))),
    "WITH I AS (SELECT source, max(doc_id) AS t FROM documents GROUP BY source) SELECT (max(1000000000 - t))::BIGINT AS age, bool_and(t > 0) AS healthy FROM I",
)

# -- the index -------------------------------------------------------------------


add(
    "trigram_table",
    lambda s, d: ngram.trigrams(docs(s, d)).groupBy("tri").agg(F.count("*").alias("files")),
    f"{pre()}, G AS (SELECT DISTINCT file_no, unnest([line[i:i + 2] FOR i IN range(1, length(line) - 1)]) AS tri FROM L) SELECT tri, count(*) AS files FROM G GROUP BY tri",
)
add("inspect_index", lambda s, d: ix.inspect(docs(s, d)), f"{pre()}, N AS (SELECT F.*, coalesce(lines, []) AS lines FROM F LEFT JOIN A USING (file_no)) SELECT count(DISTINCT tree || '/' || version) AS trees, count(*) AS files, sum(len(lines))::BIGINT AS lines, sum(strlen(array_to_string(lines, chr(10))))::BIGINT AS content_bytes, sum(strlen(path) + 1)::BIGINT AS path_bytes FROM N")
add("dump_trees", lambda s, d: ix.dump_trees(docs(s, d)), f"{pre()} SELECT tree, version, count(*) AS files FROM F GROUP BY tree, version")
add("dump_source", lambda s, d: ix.dump_source(docs(s, d)), f"{pre()} SELECT DISTINCT line FROM L")
add("dump_file", lambda s, d: ix.dump_file(docs(s, d), "en/src1/1.txt"), f"{pre()} SELECT file_no, path, array_to_string(lines, chr(10)) AS text FROM F JOIN A USING (file_no) WHERE path = 'en/src1/1.txt'")
add(
    "ordered_contents",
    lambda s, d: repos.ordered_contents(pages(s, d).withColumn("path", F.concat("path", F.when(F.col("file_no") % 3 == 0, "/test/BUILD").when(F.col("file_no") % 3 == 1, "/BUILD").otherwise("")))),
    f"{pre('pages')}, N AS (SELECT file_no, path || CASE file_no % 3 WHEN 0 THEN '/test/BUILD' WHEN 1 THEN '/BUILD' ELSE '' END AS path FROM F) SELECT file_no, path, (100 - CASE WHEN contains(path, 'test') THEN 10 ELSE 0 END - CASE WHEN contains(path, 'BUILD') THEN 5 ELSE 0 END)::INT AS score FROM N",
)


def _repos(s: SparkSession, d: str) -> DataFrame:
    c = F.col("s_suppkey")
    name = F.concat(F.lit("org"), (c % 5).cast("string"), F.lit("/r"), c.cast("string"))
    return _table(s, d, "supplier").select(name.alias("full_name"), F.when(c % 7 != 0, c % 3 == 0).alias("fork"), (c % 4 == 0).alias("archived"), F.concat(F.lit("https://h/"), name).alias("html_url"), F.concat(F.lit("https://h/"), name, F.lit(".git")).alias("clone_url"), F.concat(F.lit("git@h:"), name).alias("ssh_url"))


_REPOS = "WITH R AS (SELECT 'org' || (s_suppkey % 5) || '/r' || s_suppkey AS full_name, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 3 = 0 END AS fork, s_suppkey % 4 = 0 AS archived, s_suppkey AS k FROM supplier)"
add("repo_filter_antijoin", lambda s, d: repos.filter_repos(_repos(s, d), _repos(s, d).where("full_name like 'org1/%'").select("full_name"), forks=False).select("full_name"), f"{_REPOS} SELECT full_name FROM R WHERE NOT coalesce(fork, false) AND NOT archived AND full_name NOT LIKE 'org1/%'")
add("repo_union", lambda s, d: repos.union_repos(_repos(s, d).where("fork"), _repos(s, d).where("archived")).select("full_name"), f"{_REPOS} SELECT DISTINCT full_name FROM R WHERE fork OR archived")
add(
    "repo_specs",
    lambda s, d: repos.repo_specs(_repos(s, d), "/repos/", http=False).select("name", "path", F.array_join("revisions", ",").alias("revisions"), "metadata.remote", "metadata.url_pattern"),
    f"{_REPOS} SELECT full_name AS name, '/repos/' || full_name AS path, 'HEAD' AS revisions, 'git@h:' || full_name AS remote, 'https://h/' || full_name || '/blob/{{version}}/{{path}}#L{{lno}}' AS url_pattern FROM R".replace("{{", "{").replace("}}", "}"),
)

# -- the benchmark patterns -------------------------------------------------------

BENCH = {
    "bench_word": ("dazed", False),
    "bench_word_fold": ("dazed", True),
    "bench_kmalloc": (r"^(\s.*\S)?kmalloc\s*\(", False),
    "bench_space_eol": (r"\s$", False),
    "bench_spaces_eol": (r"\s{10}$", False),
    "bench_uuid": ("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", False),
    "bench_uuid_fold": ("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", True),
    "bench_hex20": ("[0-9a-f]{20}", False),
    "bench_hex50": ("[0-9a-f]{50}", False),
    "bench_hex100": ("[0-9a-f]{100}", False),
}
SLOW = {
    "bench_slow_space_hex": (r"\s[0-9a-f]{199}", False),
    "bench_slow_hex200": ("[0-9a-fA-F]{200}", False),
    "bench_slow_chain": (".*".join("abcdefghijklmnopqrss"), False),
    "bench_chain_hit": ("t.*h.*e.*a.*n.*n", False),
}
for _name, (_pattern, _fold) in {**BENCH, **SLOW}.items():
    search(_name, _pattern, _fold)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language's own example: a pattern with file and repository filters, with context."""
    query = parse(r"\bth\w+ing\b file:^en/ -file:7 repo:src max_matches:50")
    return flat(first_lines(docs(spark, sf_dir), Pattern.compile(query.line, query.fold_case), file_condition(query), 3, query.max_matches), True)


add("flagship", flagship, lines_sql(r"\bth\w+ing\b", True, f"{has('path', '^en/')} AND NOT {has('path', '7')} AND {has('tree', 'src')}", ctx=3) + " ORDER BY L.file_no, lno LIMIT 50")
__all__ = ["BENCH", "ORACLE_SQL", "QUERIES", "SLOW", "flagship"]

from . import catalogue_io  # noqa: E402, F401  (registers its queries)
