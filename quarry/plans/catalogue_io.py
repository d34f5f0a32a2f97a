"""Registered queries over sources, sinks, the planner, the engine and the service.

What they read is first written from the driver's tables into the shared folder:
trees of files, git repositories, saved pages, indexes.  Their SQL looks at the
tables alone, so a whole round trip is judged.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regex as rx
from ..functions.frames import Frames, integrity, request_id
from ..functions.scalar import upper
from ..operators import index as ix, ingest, ngram, results as R, tags as tg
from ..operators.search import Pattern, file_condition, matching_lines, search_lines
from ..operators.store import own_folder
from ..sources import files as fsrc, git, listing, spec as sp
from ..streaming import ingest as stream
from . import planner
from .catalogue import _REPOS, _TAGS, _repos, _table, add, docs, flat, has, lines_sql, pre, q, tag_rows
from .engine import Config, Engine, Service
from .query import Query

_indexes: dict[tuple[str, str], str] = {}


def local_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one, as all machines see it in their file system."""
    path = own_folder(spark, name).removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def write_tree(files: DataFrame, root: str) -> None:
    """Write the text of each file under ``root``, by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (folder := os.path.dirname(f"{root}/{path}")) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(f"{root}/{path}", "wb") as f:
                    f.write(text.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows])})

    files.select("path", "raw").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def index_of(spark: SparkSession, sf: str) -> str:
    """An index of the documents with trigrams and tags; built once an application for each data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        root = own_folder(spark, "index")
        t = tg.parse_tags(tag_rows(spark, sf))
        tags = t.select("tree", tg.tag_file_path(F.col("tags_path"), F.col("tag_path")).alias("path"), "lno", "tag", "fields")
        ix.build_index(docs(spark, sf), root, name="documents", tags=tags, ngrams=True)
        _indexes[key] = root
    return _indexes[key]


# -- the index -------------------------------------------------------------------


def _index_build(s: SparkSession, d: str) -> DataFrame:
    e = Engine.open(s, index_of(s, d))
    return e.files.agg(F.count("*").alias("files"), F.sum("n_lines").alias("lines")).crossJoin(e.ngrams.agg(F.count("*").alias("trigrams"))).crossJoin(e.tags.agg(F.count("*").alias("tags")))


add(
    "index_build",
    _index_build,
    f"""{_TAGS}, G AS (SELECT DISTINCT file_no, unnest([line[i:i + 2] FOR i IN range(1, length(line) - 1)]) AS tri FROM L)
SELECT (SELECT count(*) FROM F) AS files, (SELECT count(*) FROM L)::BIGINT AS lines, (SELECT count(*) FROM G) AS trigrams, (SELECT count(*) FROM T) AS tags""",
)


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    """Search of an index as it is read back."""
    e = Engine.open(s, index_of(s, d))
    return flat(search_lines(e.files, Pattern.compile("idiot|clown", False), file_condition(Query(repo="src1")), 3), True)


add("index_round_trip", _round_trip, lines_sql("idiot|clown", where=has("tree", "src1"), ctx=3))


def _trigram_search(s: SparkSession, d: str) -> DataFrame:
    """A search that reads the stored trigrams, sorted by trigram, and then the files that they name."""
    e = Engine.open(s, index_of(s, d))
    p = Pattern.compile("worthless|idiot", False)
    return flat(search_lines(ngram.with_candidates(e.files, e.ngrams, planner.need_of(p.node)), p))


add("trigram_prefilter_search", _trigram_search, lines_sql("worthless|idiot"))
add("index_trees", lambda s, d: s.createDataFrame([(t["name"], t["version"]) for t in Engine.open(s, index_of(s, d)).info()["trees"]], "name string, version string"), f"{pre()} SELECT DISTINCT tree AS name, version FROM F")


def _reload(s: SparkSession, d: str) -> DataFrame:
    """A reopened engine sees the snapshot that was published meanwhile, an open one the old."""
    root = own_folder(s, "index")
    half = docs(s, d).where("pmod(file_no, 2) = 0")
    ix.build_index(half, root)
    e, seen = Engine.open(s, root), []
    poll = stream.on_change(s, root, e.reload)
    seen.append(("before", poll(), e.files.count()))
    ix.build_index(docs(s, d), root)
    seen.append(("open", False, e.files.count()))
    seen.append(("after", poll(), e.files.count()))
    return s.createDataFrame(seen, "step string, reloaded boolean, files long")


add("index_reload", _reload, f"{pre()} SELECT 'before' AS step, false AS reloaded, count(*) FILTER (file_no % 2 = 0) AS files FROM F UNION ALL SELECT 'open', false, count(*) FILTER (file_no % 2 = 0) FROM F UNION ALL SELECT 'after', true, count(*) FROM F")


def tags_files(rows: DataFrame) -> DataFrame:
    """``tree, part, text``: rows of tags as tags files, sorted, as the programs write them; a large tree has several, so that each fits a task."""
    part = F.floor(F.col("file_no") / ingest.BUCKET_FILES).alias("part")
    return rows.groupBy("tree", part).agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("text"))


def _second_index(s: SparkSession, d: str) -> DataFrame:
    """Tags from an index of tags files, joined to the files of another."""
    rows = tags_files(tag_rows(s, d))
    root = own_folder(s, "index")
    named = ingest.number_files(rows, "tree", "part")
    path = F.concat(F.lit("tags-"), F.col("part").cast("string"))
    ix.build_index(ingest.text_files(named, file_no=F.col("file_no"), tree=F.col("tree"), version=F.lit(""), path=path, text=F.col("text")), root)
    e = Engine.open(s, index_of(s, d), tags_root=root)
    joined = tg.join_tags(e.tags, e.files)
    return joined.where("tag = 'The'").select("file_no", "tag_lno", "line")


add("tags_of_second_index", _second_index, f"{_TAGS} SELECT L.file_no, T.lno AS tag_lno, line FROM T JOIN L ON T.tree = L.tree AND T.path = L.path AND T.lno = L.lno WHERE tag = 'The'")

# -- layout ----------------------------------------------------------------------

#: Next-fit as a recursion over the files of a bucket, one after the other.
_FIT = f"""{pre().replace("WITH F", "WITH RECURSIVE F", 1)}, B AS (SELECT F.file_no, tree, strlen(coalesce(array_to_string(lines, chr(10)), ''))::BIGINT AS bytes, (F.file_no // 16384)::BIGINT AS bucket FROM F LEFT JOIN A USING (file_no)),
O AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY file_no) AS i FROM B),
C AS (SELECT file_no, tree, bytes, bucket, i, 0::BIGINT AS chunk, bytes AS used FROM O WHERE i = 1
  UNION ALL SELECT O.file_no, O.tree, O.bytes, O.bucket, O.i, CASE WHEN C.used + O.bytes > 100000 THEN C.chunk + 1 ELSE C.chunk END, CASE WHEN C.used + O.bytes > 100000 THEN O.bytes ELSE C.used + O.bytes END FROM C JOIN O ON O.bucket = C.bucket AND O.i = C.i + 1)"""
add("chunk_packing", lambda s, d: ingest.chunk_files(docs(s, d), 100_000), f"{_FIT} SELECT file_no, tree, bytes, bucket, chunk FROM C")
add("trees_per_chunk", lambda s, d: ingest.trees_per_chunk(ingest.chunk_files(docs(s, d), 100_000)), f"{_FIT} SELECT bucket, chunk, string_agg(DISTINCT tree, ',' ORDER BY tree) AS trees, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM C GROUP BY bucket, chunk")
add("span_table", lambda s, d: ingest.span_table(ingest.chunk_files(docs(s, d), 100_000)), f'{_FIT} SELECT bucket, chunk, (used - bytes)::BIGINT AS "left", used::BIGINT AS "right", file_no FROM C WHERE bytes > 0')
add(
    "line_postings",
    lambda s, d: ingest.line_postings(docs(s, d), 100).select("line", "block", F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["file_no"].cast("string"), p["lno"].cast("string"))), " ").alias("places")),
    f"{pre()} SELECT line, file_no // 100 AS block, string_agg(file_no || ':' || lno, ' ' ORDER BY file_no, lno) AS places FROM L GROUP BY line, file_no // 100",
)
add("postings_to_files", lambda s, d: ingest.postings_to_files(ingest.line_postings(docs(s, d)), docs(s, d)).groupBy("tree", "version", "path").agg(F.count("*").alias("lines"), F.sum("lno").alias("numbers")), f"{pre()} SELECT tree, version, path, count(*) AS lines, sum(lno)::BIGINT AS numbers FROM L GROUP BY tree, version, path")

# -- files and repositories ---------------------------------------------------------


def _digest(raw: DataFrame) -> DataFrame:
    return raw.select("tree", "version", "path", F.md5("content").alias("md5"))


def _fs(s: SparkSession, d: str) -> DataFrame:
    root = local_folder(s, "tree")
    write_tree(docs(s, d), root)
    return _digest(fsrc.read_fs(s, root, tree="corpus"))


_FILES = "SELECT 'corpus' AS tree, '{v}' AS version, path, md5(text) AS md5 FROM (SELECT *, lang || '/' || source || '/' || doc_id || '.txt' AS path FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0)))"
add("source_files", _fs, _FILES.format(v=""))


def _ordered(s: SparkSession, d: str) -> DataFrame:
    """A listing in descending order, with blank rows, gives the ranks."""
    root = local_folder(s, "tree")
    files = docs(s, d).where("tree = 'src1'")
    write_tree(files, root)
    names = [r.path for r in files.select("path").orderBy(F.desc("file_no")).collect()]
    with open(f"{root}.list", "w") as f:
        f.write("\n\n".join(names) + "\n")
    return fsrc.read_ordered(s, root, f"{root}.list", tree="corpus").select("path", "rank", F.md5("content").alias("md5"))


add("source_ordered", _ordered, "SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, row_number() OVER (ORDER BY doc_id DESC) - 1 AS rank, md5(text) AS md5 FROM documents WHERE source = 'src1' AND text IS NOT NULL AND NOT contains(text, chr(0))")


def _commit(root: str) -> None:
    for args in (("init", "-q", "-b", "main"), ("add", "-A"), ("-c", "user.name=n", "-c", "user.email=e@example.org", "commit", "-q", "-m", "files")):
        subprocess.run(["git", "-C", root, *args], check=True, capture_output=True)


def _git_tree(s: SparkSession, d: str) -> str:
    root = local_folder(s, "repo")
    git.write_repository(docs(s, d), root)
    return root


add("source_git", lambda s, d: _digest(git.read_git(s, _git_tree(s, d), "main", tree="corpus")), _FILES.format(v="main"))


def _mirror(s: SparkSession, d: str) -> DataFrame:
    """A mirror of a mirror, brought up to date once, read at its HEAD."""
    origin, copy = _git_tree(s, d), local_folder(s, "mirror")
    heads = [git.mirror(origin, copy), git.mirror(origin, copy)]
    return _digest(git.read_git(s, copy, "HEAD", tree="corpus")).withColumn("head", F.lit(",".join(heads)))


add("source_mirror", _mirror, f"SELECT *, 'refs/heads/main,refs/heads/main' AS head FROM ({_FILES.format(v='HEAD')})")


def _submodule(s: SparkSession, d: str) -> DataFrame:
    """A repository within another; its files are read from its objects, so that none is checked out."""
    inner, outer = _git_tree(s, d), local_folder(s, "outer")
    subprocess.run(["git", "init", "-q", "-b", "main", outer], check=True, capture_output=True)
    subprocess.run(["git", "clone", "-q", "--no-checkout", inner, f"{outer}/lib"], check=True, capture_output=True)
    subprocess.run(["git", "-C", outer, "-c", "protocol.file.allow=always", "submodule", "--quiet", "add", inner, "lib"], check=True, capture_output=True)
    with open(f"{outer}/top.txt", "w") as f:
        f.write("top\n")
    _commit(outer)
    raw = git.read_git(s, outer, "main", tree="corpus", submodules=True)
    return raw.where("path <> '.gitmodules'").select("tree", "path", F.md5("content").alias("md5"))


add("source_submodule", _submodule, f"SELECT 'lib' AS tree, 'lib/' || path AS path, md5 FROM ({_FILES.format(v='')}) UNION ALL SELECT 'corpus', 'top.txt', md5('top' || chr(10))")


def _spec(s: SparkSession, d: str) -> DataFrame:
    """An index specification, written and read again: a folder and a repository with a revision that is missing."""
    root, repo = local_folder(s, "tree"), _git_tree(s, d)
    write_tree(docs(s, d).where("tree = 'src0'"), root)
    spec = sp.IndexSpec("both", [sp.PathSpec(root, "folder")], [sp.RepoSpec(repo, "repo", ["main", "gone"])])
    with open(f"{root}.json", "w") as f:
        f.write(sp.spec_json(spec))
    files, _ = sp.ingest(s, sp.load_spec(f"{root}.json"))
    return files.groupBy("tree", "version").agg(F.count("*").alias("files"), F.min("file_no").alias("first"), F.max("file_no").alias("last"))


add(
    "source_specification",
    _spec,
    f"WITH N AS ({_FILES.format(v='')}), C AS (SELECT count(*) FILTER (contains(path, '/src0/')) AS a, count(*) AS b FROM N) SELECT 'folder' AS tree, '' AS version, a AS files, 0::BIGINT AS first, a - 1 AS last FROM C WHERE a > 0 UNION ALL SELECT 'repo', 'main', b, a, a + b - 1 FROM C",
)


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Repositories through the paged client and through saved pages."""
    root = local_folder(s, "pages")
    by_org: dict[str, list[dict]] = {}
    for r in _repos(s, d).orderBy("full_name").collect():
        by_org.setdefault(r.full_name.split("/")[0], []).append(r.asDict())

    def get(kind: str, name: str, page: int) -> tuple[list[dict], int]:
        rows = by_org[name]
        return rows[(page - 1) * 3 : page * 3], -(-len(rows) // 3)

    for org, rows in by_org.items():
        os.makedirs(f"{root}/org/{org}", exist_ok=True)
        for page in range(-(-len(rows) // 3)):
            with open(f"{root}/org/{org}/{page + 1}.json", "w") as f:
                f.write(listing.save_page(get("org", org, page + 1)[0]))
    asked = s.createDataFrame([(i, r["full_name"]) for i, r in enumerate(listing.fetch_listing(get, orgs=sorted(by_org)))], "asked long, full_name string")
    saved = listing.read_pages(s, root).select("name", "page", "place", "full_name", "fork")
    return saved.join(asked, "full_name")


add(
    "source_listing",
    _pages,
    f"{_REPOS}, N AS (SELECT *, split_part(full_name, '/', 1) AS name, row_number() OVER (PARTITION BY split_part(full_name, '/', 1) ORDER BY full_name) - 1 AS i, row_number() OVER (ORDER BY split_part(full_name, '/', 1), full_name) - 1 AS asked FROM R) SELECT name, (i // 3 + 1)::INT AS page, (i % 3)::INT AS place, full_name, fork, asked FROM N",
)

# -- planner and guards -------------------------------------------------------------

_PLANS = [("idiot", False), ("idiot|clown", False), ("wor(th|d)less", False), ("[ab]cde+f", False), ("x*thing", False), (r"\bth\w+ing\b", False), ("(an|en){3,5}", False), ("licensed under", True), ("^The.*end$", False), ("a.b", False), ("[0-9a-f]{20}", False)]


def _soundness(s: SparkSession, d: str) -> DataFrame:
    """No planned condition excludes a match: matching lines, and those of them that meet it."""
    lines = ingest.lines_of(docs(s, d))
    counts = []
    for i, (p, fold) in enumerate(_PLANS):
        c = Pattern.compile(p, fold)
        want = planner.condition(planner.need_of(c.node), F.col("line"))
        hit = c.matches(F.col("line"))
        counts += [F.sum(hit.cast("long")).alias(f"m{i}"), F.sum((hit & (want if want is not None else F.lit(True))).cast("long")).alias(f"k{i}")]
    one = lines.agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"m{i}").alias("matches"), F.col(f"k{i}").alias("kept")) for i, (p, _) in enumerate(_PLANS)])).alias("r")).select("r.*")


add("planner_soundness", _soundness, f"{pre()} " + " UNION ALL ".join(f"SELECT {q(p)} AS pattern, count(*) AS matches, count(*) AS kept FROM L WHERE {has('line', p, fold)}" for p, fold in _PLANS))

#: By hand: pattern, what it needs, greatest width.
_NEEDS = [
    ("kmalloc", "'kmalloc'", 7), ("a|bcd", "anything", 3), ("ab|cd", "('ab' or 'cd')", 2), ("ab.*cd", "('ab' and 'cd')", 5), ("x?abc", "'abc'", 4), ("(ab){2}", "'abab'", 4), ("[ab]cd", "('acd' or 'bcd')", 3),
    ("a*", "anything", 1), ("abc+d", "('abc' and 'cd')", 4), (r"\d\d", "anything", 2), ("(foo|bar)baz", "('barbaz' or 'foobaz')", 6),
]


def _explain(s: SparkSession, d: str) -> DataFrame:
    rows = [(p, e["need"], e["width"], e["weight"] >= planner.LEAST_WEIGHT, planner.to_dot(planner.need_of(rx.parse(p))).count("->")) for p, _, _ in _NEEDS for e in [planner.explain(p)]]
    return s.createDataFrame(rows, "pattern string, need string, width int, useful boolean, edges int")


add(
    "planner_explain",
    _explain,
    " UNION ALL ".join(f"SELECT {q(p)} AS pattern, {q(n)} AS need, {w} AS width, {n != 'anything'} AS useful, {n.count(' or ') + n.count(' and ') + (1 if ' or ' in n or ' and ' in n else 0)} AS edges" for p, n, w in _NEEDS),
)
_GUARDS = [("(", "query"), ("a{1001}", "query"), ("[0-9a-f]{201}", "query"), ("((a{20}){20}){20}", "file"), (r"(?=x)", "query"), (r"(a)\1", "repo"), ("fine", ""), ("[0-9a-f]{200}", ""), ("a**", "")]


def _guards(s: SparkSession, d: str) -> DataFrame:
    def label(pattern: str, where: str) -> str:
        try:
            rx.guard([rx.parse(pattern, False, where or "query")], where or "query")
        except rx.QueryError as e:
            return e.label
        return ""

    return s.createDataFrame([(p, label(p, w)) for p, w in _GUARDS], "pattern string, error string")


add("pattern_guards", _guards, " UNION ALL ".join(f"SELECT {q(p)} AS pattern, {q(w)} AS error" for p, w in _GUARDS))
add(
    "linear_engine",
    lambda s, d: flat(search_lines(docs(s, d), Pattern.compile("(th(e|is|at) ?)+.*([aeiou]+[^aeiou]+)+ing", False))),
    lines_sql("(?:th(?:e|is|at) ?)+.*(?:[aeiou]+[^aeiou]+)+ing"),
)

# -- engine and service --------------------------------------------------------------

_SEARCHES = [("idiot", [], 20, False), ("the", ["src1"], 5, False), ("zzz no such line", [], 20, False), ("", ["en/", "7[.]txt"], 30, True)]


def _service(s: SparkSession, d: str) -> DataFrame:
    """Replies to requests by parameters, lines and paths in one table."""
    service = Service({"docs": Engine(docs(s, d), config=Config(context_lines=2))})
    out = []
    for i, (line, file, most, _) in enumerate(_SEARCHES):
        words = [line, *(f"file:{f}" for f in file), f"max_matches:{most}"]
        reply = service.request({"q": [" ".join(w for w in words if w)]}, "docs")
        out += [(i, "line", r["path"], r["lno"], r["bounds"][0], r["bounds"][1], len(r["context_before"]), len(r["context_after"]), reply["info"]["why"]) for r in reply["results"]]
        out += [(i, "path", r["path"], 0, r["bounds"][0], r["bounds"][1], 0, 0, reply["info"]["why"]) for r in reply["file_results"]]
    return s.createDataFrame(out, "request int, kind string, path string, lno int, lo int, hi int, before int, after int, why string")


def _service_sql() -> str:
    out = []
    for i, (line, file, most, names) in enumerate(_SEARCHES):
        pattern = file[0] if names else line
        where = " AND ".join(["true", *(has("path", f, True) for f in file)])
        lo = f"length(regexp_extract(X, {q(f'(?si)^(.*?)({pattern})')}, 1))::INT"
        hi = f"({lo[:-5]} + length(regexp_extract(X, {q(f'(?si)^(.*?)({pattern})')}, 2)))::INT"
        at = lambda x, c: x.replace("(X,", f"({c},")
        lines = f"SELECT {i} AS request, 'line' AS kind, path, lno, {at(lo, 'line')} AS lo, {at(hi, 'line')} AS hi, least(2, lno - 1)::INT AS before, least(2, len(lines) - lno)::INT AS after FROM L JOIN A USING (file_no) WHERE {'false' if names else has('line', pattern, True)} AND {where} ORDER BY L.file_no, lno LIMIT {most}"
        paths = f"SELECT {i}, 'path', path, 0, {at(lo, 'path')}, {at(hi, 'path')}, 0, 0 FROM F WHERE {has('path', pattern, True)} AND {where} ORDER BY file_no LIMIT {most}"
        out.append(f"SELECT *, CASE WHEN count(*) FILTER (kind = 'line') OVER () >= {most} OR count(*) FILTER (kind = 'path') OVER () >= {most} THEN 'MATCH_LIMIT' ELSE 'NONE' END AS why FROM ((FROM ({lines})) UNION ALL (FROM ({paths})))")
    return f"{pre()} " + " UNION ALL ".join(f"({x})" for x in out)


add("service_replies", _service, _service_sql())


def _errors(s: SparkSession, d: str) -> DataFrame:
    service = Service({"a": Engine(docs(s, d).where("false")), "b": Engine(docs(s, d).where("false"))})
    asked = [("bad pattern", {"q": ["("]}, None), ("no such backend", {"q": ["x"]}, "c"), ("nothing asked", {"regex": ["true"]}, None), ("two values", {"q": ["x repo:a repo:b"]}, None), ("fine", {"q": ["x"]}, "b"), ("literal", {"line": ["("], "regex": ["false"]}, "a")]
    rows = [(name, service.request(p, b).get("error", {}).get("code", "")) for name, p, b in asked]
    stats = service.stats()
    return s.createDataFrame([*rows, ("requests", str(stats["requests"])), ("errors", str(stats["errors"])), ("healthy", str(service.healthy()))], "what string, code string")


add("service_errors", _errors, "SELECT * FROM (VALUES ('bad pattern', 'query'), ('no such backend', 'bad_backend'), ('nothing asked', 'bad_query'), ('two values', 'query'), ('fine', ''), ('literal', ''), ('requests', '6'), ('errors', '4'), ('healthy', 'True')) AS t(what, code)")


def _logged(s: SparkSession, d: str) -> DataFrame:
    """The stored log of queries."""
    folder = own_folder(s, "log")
    service = Service({"docs": Engine(docs(s, d))}, log_path=folder)
    for line, most in (("idiot", 3), ("The", 4), ("zzz no such line", 5)):
        service.request({"q": [f"{line} max_matches:{most}"]}, "docs")
    return service.query_log(s).select("backend", "line", "fold_case", "results", "why")


add(
    "query_log",
    _logged,
    f"{pre()} SELECT 'docs' AS backend, 'idiot' AS line, true AS fold_case, least(3, count(*))::INT AS results, CASE WHEN count(*) >= 3 OR (SELECT count(*) FROM F WHERE {has('path', 'idiot', True)}) >= 3 THEN 'MATCH_LIMIT' ELSE 'NONE' END AS why FROM L WHERE {has('line', 'idiot', True)} UNION ALL SELECT 'docs', 'The', false, least(4, count(*))::INT, CASE WHEN count(*) >= 4 THEN 'MATCH_LIMIT' ELSE 'NONE' END FROM L WHERE contains(line, 'The') UNION ALL SELECT 'docs', 'zzz no such line', true, 0, 'NONE'",
)


def _shown(s: SparkSession, d: str) -> DataFrame:
    """Ten path results are shown beside lines, all in a search for names."""
    e = Engine(docs(s, d), config=Config(max_matches=40))
    both, names = e.search(Query(line="src")), e.search(Query(line="src", filename_only=True))
    label = lambda r: R.count_label(len(r.file_results), r.info["why"])
    rows = [("both", x.path, label(both)) for x in both.shown_paths()] + [("names", x.path, label(names)) for x in names.shown_paths()]
    return s.createDataFrame(rows, "search string, path string, label string")


add(
    "shown_paths",
    _shown,
    f"{pre()}, N AS (SELECT path, row_number() OVER (ORDER BY file_no) AS i, count(*) OVER () AS n FROM F WHERE contains(path, 'src')), X AS (SELECT *, CASE WHEN n >= 40 THEN '40+' ELSE n::VARCHAR END AS label FROM N) SELECT 'both' AS search, path, label FROM X WHERE i <= 10 UNION ALL SELECT 'names', path, label FROM X WHERE i <= 40",
)


def _callbacks(s: SparkSession, d: str) -> DataFrame:
    """Rows by callbacks, with a transformation that drops and changes some."""
    seen: list[tuple] = []
    e = Engine(docs(s, d))
    e.for_each(Query(line="moron"), lambda r: seen.append(("line", r.path, r.lno, r.line)), lambda r: seen.append(("path", r.path, 0, "")), lambda m: m.where("lno > 1").withColumn("line", upper(F.col("line"))))
    e.for_each(Query(line="src1/.*9"), lambda r: None, lambda r: seen.append(("path", r.path, 0, "")))
    return s.createDataFrame(seen, "kind string, path string, lno int, line string")


add("callbacks", _callbacks, f"{pre()} SELECT 'line' AS kind, path, lno, upper(line) AS line FROM L WHERE contains(line, 'moron') AND lno > 1 UNION ALL SELECT 'path', path, 0, '' FROM F WHERE contains(path, 'moron') UNION ALL SELECT 'path', path, 0, '' FROM F WHERE {has('path', 'src1/.*9')}")


def write_arrivals(documents: DataFrame, folder: str, rows: int = 4_096) -> None:
    """The documents as the files of a stream, so many rows in each: tasks write what they read, and nothing is exchanged."""
    documents.write.option("maxRecordsPerFile", rows).parquet(folder)


def _standing(s: SparkSession, d: str) -> DataFrame:
    """A standing query over the documents as a stream of files."""
    source, out, state = (own_folder(s, f"stream-{x}") for x in ("in", "out", "state"))
    write_arrivals(_table(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), source)
    found = stream.standing_query(stream.stream_documents(s, source), Query(line="idiot", file=("^en",)))
    stream.append_matches(found, out, state).awaitTermination()
    return flat(s.read.parquet(out))


add("standing_query", _standing, lines_sql("idiot", where=has("path", "^en", True)))


def _frames(s: SparkSession, d: str) -> DataFrame:
    codec = Frames()
    codec.register("doc", "id long, lang string")
    codec.register("ping", "n int")
    made = _table(s, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, codec.encode("doc", F.struct(F.col("doc_id").alias("id"), "lang"))).otherwise(codec.encode("ping", F.struct((F.col("doc_id") % 5).cast("int").alias("n")))).alias("f"))
    return made.select(codec.opcode(F.col("f")).alias("opcode"), codec.body("doc", F.col("f"))["id"].alias("id"), codec.body("doc", F.col("f"))["lang"].alias("lang"), codec.body("ping", F.col("f"))["n"].alias("n"))


add("frames", _frames, "SELECT CASE WHEN doc_id % 2 = 0 THEN 'doc' ELSE 'ping' END AS opcode, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 <> 0 THEN (doc_id % 5)::INT END AS n FROM documents")
add("integrity", lambda s, d: docs(s, d).select("file_no", integrity(F.sha2("path", 256)).alias("value")), f"{pre()} SELECT file_no, 'sha256-' || to_base64(unhex(sha256(path))) AS value FROM F")
add("request_ids", lambda s, d: _table(s, d, "documents").select(request_id().alias("id")).agg(F.count_distinct("id").alias("ids"), F.min(F.col("id").rlike("^[0-9a-f]{32}$")).alias("fine")), "SELECT count(*) AS ids, true AS fine FROM documents")
add("matching_line_numbers", lambda s, d: matching_lines(docs(s, d), Pattern.compile("idiot", False)).groupBy("file_no").agg(F.sum("lno").alias("numbers")), f"{pre()} SELECT file_no, sum(lno)::BIGINT AS numbers FROM L WHERE contains(line, 'idiot') GROUP BY file_no")
__all__: list[str] = ["index_of", "write_tree"]
