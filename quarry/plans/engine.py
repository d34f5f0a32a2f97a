"""The engine: named indexes, and search, info and reload over them."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import QueryError
from ..operators import index as ix
from ..operators import ngram, tags as tg
from ..operators.search import Pattern, file_condition, first_lines, limited, search_lines, search_paths
from . import planner
from .query import DEFAULT_CONTEXT, DEFAULT_LIMIT, Query, effective_context, effective_limit, from_params


@dataclass(frozen=True)
class Config:
    line_limit: int = 1024
    max_matches: int = DEFAULT_LIMIT
    context_lines: int = DEFAULT_CONTEXT
    default_max_matches: int = 0
    timeout_ms: int = 0  # of each search; 0: none
    request_ms: int = 30_000  # of a request to the service; 0: none


@dataclass
class Reply:
    """Results as rows, how long they took, and why the search ended."""

    results: list
    file_results: list
    info: dict = field(default_factory=dict)
    search_type: str = "normal"

    def shown_paths(self, most: int = 10) -> list:
        """The path results that a page shows: all of a search for names, else ten."""
        return self.file_results if self.search_type == "filename_only" else self.file_results[:most]

    def as_dict(self) -> dict:
        row = lambda r: {k: v for k, v in r.asDict(recursive=True).items() if k != "file_no"}
        return {"info": self.info, "results": [row(r) for r in self.results], "file_results": [row(r) for r in self.file_results], "search_type": self.search_type}


class Engine:
    """Search over one corpus: a ``files`` DataFrame, or an index folder.

    ``tags``: tree, path, lno, tag, fields.
    """

    def __init__(self, files: DataFrame, tags: DataFrame | None = None, ngrams: DataFrame | None = None, trees: DataFrame | None = None, config: Config = Config(), meta: dict | None = None):
        self.files, self.tags, self.ngrams, self.trees, self.config = files, tags, ngrams, trees, config
        self.meta = meta or {"name": "", "index_time": int(time.time()), "has_tags": tags is not None}
        self.root: str | None = None
        self.stamp: str | None = None
        self.tags_root: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: Config = Config(), eager: bool = False, tags_root: str | None = None) -> Engine:
        """The current snapshot of an index; ``tags_root`` is another whose files are tags files."""
        stamp = ix.current(spark, root)
        meta = ix.load_meta(spark, stamp)
        files = ix.load_files(spark, stamp)
        if eager:
            files = files.cache()
        e = cls(
            files,
            tg.tags_of_files(ix.load_files(spark, ix.current(spark, tags_root))) if tags_root else spark.read.parquet(f"{stamp}/tags") if meta["has_tags"] else None,
            ix.load_ngrams(spark, stamp) if meta.get("has_ngrams") else None,
            spark.read.parquet(f"{stamp}/trees"),
            config,
            meta,
        )
        e.root, e.stamp, e.tags_root = root, stamp, tags_root
        return e

    def reload(self) -> bool:
        """Open the current snapshot if another has been published; whether it was."""
        if self.root is None or ix.current(self.files.sparkSession, self.root) == self.stamp:
            return False
        self.files.unpersist()
        self.__dict__.update(Engine.open(self.files.sparkSession, self.root, self.config, tags_root=self.tags_root).__dict__)
        return True

    # -- plans -----------------------------------------------------------

    def _compiled(self, q: Query) -> Pattern:
        if not q.line:
            raise QueryError("the query has no pattern")
        return Pattern.compile(q.line, q.fold_case)

    def _candidates(self, pattern: Pattern) -> DataFrame:
        if self.ngrams is None:
            return self.files
        return ngram.with_candidates(self.files, self.ngrams, planner.need_of(pattern.node))

    def matches(self, q: Query) -> DataFrame:
        """Matching lines without limit or order; with tags, ranked by pass."""
        pattern = self._compiled(q)
        k = effective_context(q, self.config.context_lines)
        plain = search_lines(self._candidates(pattern), pattern, file_condition(q), k)
        if q.tags and self.tags is None:
            raise QueryError("the index has no tags", "tags")
        if self.tags is None or (not q.tags and not tg.might_match_tags(q.line)):
            return plain.withColumn("pass", F.lit(3))
        joined = tg.join_tags(self.tags, self.files)
        passes = [tg.tag_pass(joined, q, p, i + 1, k) for i, p in enumerate(tg.name_passes(q.line, q.fold_case))]
        if q.tags:
            anywhere = tg.tag_pass(joined, q, Pattern.compile(q.line, q.fold_case, guarded=False), 3, k)
            return tg.first_of_passes([*passes, anywhere])
        return tg.first_of_passes([*passes, plain.withColumn("pass", F.lit(3))])

    def limited_matches(self, q: Query, limit: int | None) -> DataFrame:
        """The first matches by pass, file and line; without tags the search stops where there are enough."""
        if limit is None or q.tags or (self.tags is not None and tg.might_match_tags(q.line)):
            return limited(self.matches(q), limit, "pass", "file_no", "lno").drop("pass")
        pattern = self._compiled(q)
        return first_lines(self._candidates(pattern), pattern, file_condition(q), effective_context(q, self.config.context_lines), limit)

    def file_matches(self, q: Query) -> DataFrame:
        return search_paths(self.files, self._compiled(q), file_condition(q))

    # -- actions ---------------------------------------------------------

    def search(self, q: Query, most_ms: int = 0) -> Reply:
        """Run a query, in at most ``most_ms`` if that is less than the configured time.  Lines and paths have a limit each; lines come in order of
        pass, file and number.  On a timeout the reply has what came until then."""
        began = time.time()
        limit = effective_limit(q, self.config.max_matches)
        jobs = [lambda: limited(self.file_matches(q), limit, "file_no")]
        if not q.filename_only:
            jobs.insert(0, lambda: self.limited_matches(q, limit))
        self._compiled(q)
        planned = time.time()
        rows, names, why = self._collect(jobs, most_ms)
        if q.filename_only:
            rows, names = [], rows
        if why == "NONE" and limit is not None and (len(rows) >= limit or len(names) >= limit):
            why = "MATCH_LIMIT"
        ms = lambda a, b: int((b - a) * 1000)
        now = time.time()
        info = {"re2_time": ms(planned, now), "git_time": 0, "sort_time": 0, "index_time": 0, "analyze_time": ms(began, planned), "total_time": ms(began, now), "why": why}
        return Reply(rows, names, info, "filename_only" if q.filename_only else "normal")

    def _collect(self, jobs: list[Callable[[], DataFrame]], most_ms: int = 0) -> tuple[list, list, str]:
        sc = self.files.sparkSession.sparkContext
        out: list[list] = [[], []]
        limits = [ms for ms in (self.config.timeout_ms, most_ms) if ms]
        if not limits:
            for i, job in enumerate(jobs):
                out[i] = job().collect()
            return out[0], out[1], "NONE"
        tag, why = f"search-{uuid.uuid4().hex}", "NONE"
        timer = threading.Timer(min(limits) / 1000, lambda: sc.cancelJobsWithTag(tag))
        sc.addJobTag(tag)
        timer.start()
        try:
            for i, job in enumerate(jobs):
                out[i] = job().collect()
        except Exception as e:  # a cancelled job has no class of its own here
            if "cancel" not in str(e).lower():
                raise
            why = "TIMEOUT"
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
        return out[0], out[1], why

    def info(self) -> dict:
        names = self.trees.select("name", "version").distinct() if self.trees is not None else self.files.select(F.col("tree").alias("name"), "version").distinct()
        return {"name": self.meta["name"], "index_time": self.meta["index_time"], "has_tags": self.tags is not None, "trees": [r.asDict() for r in names.orderBy("name", "version").collect()]}

    def for_each(self, q: Query, fn, on_path=None, transform=None) -> int:
        """Call ``fn(row)`` for each matching line, as partitions arrive, and ``on_path(row)``
        for each matching path; how many lines.  ``transform`` takes and returns the
        DataFrame of matches: it may change rows or drop them."""
        found = self.matches(q).drop("pass")
        n = 0
        for row in (found.transform(transform) if transform else found).toLocalIterator():
            fn(row)
            n += 1
        if on_path is not None:
            for row in self.file_matches(q).toLocalIterator():
                on_path(row)
        return n


LOG_SCHEMA = "time long, backend string, line string, file array<string>, repo string, fold_case boolean, results int, why string"
LOG_ROWS = 1_000


class Service:
    """Several engines by name, requests by parameters, and a log of queries.

    The log keeps the last ``LOG_ROWS`` queries; with ``log_path`` it is appended to
    that folder as Parquet whenever so many have come, and by ``flush``.
    """

    def __init__(self, engines: dict[str, Engine], config: Config = Config(), log_path: str | None = None):
        self.engines, self.config, self.log_path = engines, config, log_path
        self.log: deque = deque(maxlen=LOG_ROWS)
        self.unwritten: list = []
        self.counts = {"requests": 0, "errors": 0, "total_ms": 0}
        self.newest: dict[str, str] = {}

    def engine(self, name: str | None = None) -> Engine:
        if name is None and self.engines:
            return self.engines[sorted(self.engines)[0]]
        if name not in self.engines:
            raise QueryError(f"unknown backend {name}", "bad_backend")
        return self.engines[name]

    def request(self, params: dict[str, list[str]], backend: str | None = None, session: str | None = None) -> dict:
        """A reply as JSON-like data, or ``{"error": {"code", "message"}}``.

        A request ends after ``request_ms``.  Of the requests of a ``session`` only
        the newest goes on: a new one cancels the one before.
        """
        self.counts["requests"] += 1
        tag = f"request-{uuid.uuid4().hex}"
        try:
            q = from_params(params, self.config.default_max_matches)
            engine = self.engine(backend)
            sc = engine.files.sparkSession.sparkContext
            if session is not None:
                before, self.newest[session] = self.newest.get(session), tag
                if before:
                    sc.cancelJobsWithTag(before)
            sc.addJobTag(tag)
            try:
                found = engine.search(q, self.config.request_ms)
            finally:
                sc.removeJobTag(tag)
                if session is not None and self.newest.get(session) == tag:
                    del self.newest[session]
            reply = found.as_dict()
        except QueryError as e:
            self.counts["errors"] += 1
            code = "bad_backend" if str(e).startswith("bad_backend") else "bad_query" if "no pattern" in str(e) else "query"
            return {"error": {"code": code, "message": str(e)}}
        self.counts["total_ms"] += reply["info"]["total_time"]
        row = {"time": int(time.time()), "backend": backend or "", "line": q.line, "file": list(q.file), "repo": q.repo, "fold_case": q.fold_case, "results": len(reply["results"]), "why": reply["info"]["why"]}
        self.log.append(row)
        if self.log_path:
            self.unwritten.append(row)
            if len(self.unwritten) >= LOG_ROWS:
                self.flush(engine.files.sparkSession)
        return reply

    def repos(self) -> dict[str, list[str]]:
        return {n: sorted({t["name"] for t in e.info()["trees"]}) for n, e in self.engines.items()}

    def stats(self) -> dict:
        """Requests, errors and milliseconds so far, and the age of the oldest index in seconds (-1: unknown)."""
        times = [e.meta.get("index_time", 0) for e in self.engines.values()]
        return {**self.counts, "index_age": int(time.time()) - min(times) if times and all(times) else -1}

    def healthy(self) -> bool:
        """Whether every engine has an index."""
        return all(e.meta.get("index_time", 0) > 0 for e in self.engines.values())

    def flush(self, spark: SparkSession) -> None:
        """Append what the log folder lacks."""
        if self.log_path and self.unwritten:
            rows, self.unwritten = self.unwritten, []
            spark.createDataFrame([tuple(r.values()) for r in rows], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self.log_path)

    def query_log(self, spark: SparkSession) -> DataFrame:
        """All logged queries of the log folder, or without one those still held."""
        if self.log_path:
            self.flush(spark)
            return spark.read.schema(LOG_SCHEMA).parquet(self.log_path)
        return spark.createDataFrame([tuple(r.values()) for r in self.log], LOG_SCHEMA)
