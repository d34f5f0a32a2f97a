"""Line search, path search and file filters, as plans over ``files``."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex as rx
from ..plans import planner
from ..plans.query import Query, has_upper

INVALID = "<invalid utf-8>"
MATCH_COLUMNS = ["file_no", "tree", "version", "path", "lno", "context_before", "context_after", "bounds", "line"]


def _linear_matches(pattern: str):
    """A predicate by the linear-time engine in Arrow, whose stack does not grow with the text."""

    @F.arrow_udf("boolean")
    def matches(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return matches


def _linear_bounds(pattern: str):
    @F.arrow_udf("array<int>")
    def bounds(texts: pa.Array) -> pa.Array:
        found = pc.extract_regex(texts, pattern)
        left = pc.utf8_length(pc.struct_field(found, "a"))
        right = pc.add(left, pc.utf8_length(pc.struct_field(found, "m")))
        return pa.array([None if a is None else [a, b] for a, b in zip(left.to_pylist(), right.to_pylist())], pa.list_(pa.int32()))

    return bounds


@dataclass(frozen=True)
class Pattern:
    """A compiled pattern: predicates and bounds for a column of lines or paths.

    Most patterns run in the JVM, inside generated code.  Those whose repeated
    groups would make its engine recurse for each character, or retry without
    end, run in Arrow's linear-time engine instead.
    """

    source: str
    fold: bool
    node: rx.Node

    @classmethod
    def compile(cls, source: str, fold: bool, label: str = "query", guarded: bool = True) -> Pattern:
        node = rx.parse(source, fold, label)
        if guarded:
            rx.guard([node], label, rx.MAX_WIDTH if label == "query" else None)
        return cls(source, fold, node)

    @property
    def body(self) -> str:
        return rx.to_java(self.node, self.fold)

    @property
    def linear(self) -> bool:
        return rx.needs_linear(self.node)

    @property
    def re2(self) -> str:
        return rx.to_re2(self.node, self.fold)

    def matches(self, text: Column) -> Column:
        if self.linear:
            return _linear_matches(("(?i)" if self.fold else "") + self.re2)(text)
        last = rx.tail(self.node)
        if last is not None:
            text = F.substring(text, -last, last)
        pieces = rx.chain(self.node)
        if pieces is None:
            return text.rlike(rx.prefix(self.fold) + self.body)
        java = [rx.to_java(p, self.fold) for p in pieces]
        # each piece at its earliest place: decides a chain in one pass
        return text.rlike(rx.prefix(self.fold) + "^" + "".join(f"(?>.*?{p})" for p in java))

    def bounds(self, text: Column) -> Column:
        """[left, right) of the leftmost match, in code points; only for texts that match."""
        if self.linear:
            flags = "i" if self.fold else ""
            return _linear_bounds(f"(?s{flags})^(?P<a>.*?)(?P<m>(?-s:{self.re2}))")(text)
        flags = rx.prefix(self.fold)
        last, before = rx.tail(self.node), F.lit(0)
        if last is not None:
            before, text = F.greatest(F.length(text) - last, F.lit(0)), F.substring(text, -last, last)
        pieces = rx.chain(self.node)
        if pieces is None:
            # one evaluation of the pattern: what precedes the match, and the match
            both = f"{flags}^(.*?)({self.body})"
            left = before + F.length(F.regexp_extract(text, both, 1))
            right = left + F.length(F.regexp_extract(text, both, 2))
        else:
            first, last = rx.to_java(pieces[0], self.fold), rx.to_java(pieces[-1], self.fold)
            left = F.length(F.regexp_extract(text, f"{flags}^(.*?){first}", 1))
            right = F.length(F.regexp_extract(text, f"{flags}^.*{last}", 0))
        return F.array(left, right)

    def prefilter(self, files: DataFrame) -> DataFrame:
        """Files that may hold a matching line: required literals, which reach the
        scan, then the pattern itself over the whole text where that is sound,
        no try can run on beyond a line, and the ends of lines do not tell by themselves."""
        text = F.col("raw" if "raw" in files.columns else "content")
        want = planner.condition(planner.need_of(self.node), text)
        out = files if want is None else files.where(want)
        if not self.linear and rx.tail(self.node) is None and not rx.can_be_empty(self.node) and rx.unbounded(self.node) < 2 and rx.stays_in_line(self.node) and not {"begin", "end"} & rx.kinds(self.node):
            out = out.where(text.rlike(rx.prefix(self.fold, lines=True) + self.body))
        return out


def any_case(patterns: tuple[str, ...]) -> bool:
    """Smart case of filters: fold unless one of the patterns has a capital."""
    return not has_upper(*patterns)


def filter_patterns(patterns: tuple[str, ...], label: str) -> list[Pattern]:
    got = [Pattern.compile(p, any_case(patterns), label, guarded=False) for p in patterns]
    rx.guard([p.node for p in got], label, None)
    return got


def file_condition(q: Query) -> Column:
    """All ``file`` patterns, no ``-file`` pattern, the repository filters."""
    path, tree = F.col("path"), F.col("tree")
    out = F.lit(True)
    for p in filter_patterns(q.file, "file"):
        out = out & p.matches(path)
    for p in filter_patterns(q.not_file, "-file"):
        out = out & ~p.matches(path)
    if q.repo:
        out = out & Pattern.compile(q.repo, not has_upper(q.repo), "repo").matches(tree)
    elif q.repos:
        out = out & tree.isin(list(q.repos))
    if q.not_repo:
        out = out & ~Pattern.compile(q.not_repo, not has_upper(q.not_repo), "-repo").matches(tree)
    return out


def context(lines: Column, lno: Column, k: int) -> tuple[Column, Column]:
    """``k`` lines before (nearest first) and after, with a mark for lines that are not UTF-8."""
    shown = lambda a: F.transform(a, lambda x: F.when(F.is_valid_utf8(x), x).otherwise(F.lit(INVALID)))
    count = F.least(F.lit(k), lno - 1)
    before = F.reverse(F.slice(lines, F.greatest(F.lit(1), lno - k), F.greatest(count, F.lit(0))))
    after = F.slice(lines, lno + 1, F.lit(k))
    return shown(before), shown(after)


def matching_lines(files: DataFrame, pattern: Pattern, where: Column | None = None, *keep: str) -> DataFrame:
    """``file_no, tree, version, path, lno, line`` of each line with a match, and the columns ``keep``.

    File predicates and required literals run below the split into lines.
    """
    chosen = files if where is None else files.where(where)
    chosen = pattern.prefilter(chosen)
    x = chosen.select("file_no", "tree", "version", "path", *keep, F.posexplode_outer("lines").alias("pos", "line"))
    x = x.where(F.col("line").isNotNull())
    want = planner.condition(planner.need_of(pattern.node), F.col("line"))
    if want is not None:
        x = x.where(want)
    x = x.where(F.is_valid_utf8("line")).where(pattern.matches(F.col("line")))
    return x.select("file_no", "tree", "version", "path", (F.col("pos") + 1).alias("lno"), "line", *keep)


def search_lines(files: DataFrame, pattern: Pattern, where: Column | None = None, context_lines: int = 3) -> DataFrame:
    """One row for each line with a match: MATCH_COLUMNS.

    The context is a slice of the file's own array, so nothing is shuffled.
    """
    x = matching_lines(files, pattern, where, "lines")
    before, after = context(F.col("lines"), F.col("lno"), context_lines)
    return x.select("file_no", "tree", "version", "path", "lno", before.alias("context_before"), after.alias("context_after"), pattern.bounds(F.col("line")).alias("bounds"), "line")


#: Shares of the file numbers that a limited search looks at before the rest.
STEPS = (1 / 64, 1 / 8, 1.0)


def first_lines(files: DataFrame, pattern: Pattern, where: Column | None, context_lines: int, limit: int) -> DataFrame:
    """The first ``limit`` hits by file and line, like ``limited(search_lines(...))``.

    Looks through ranges of file numbers, of growing size, and stops where there
    are enough: a range is a predicate on the scan.  Only numbers of files and
    lines are collected, ``limit`` at most; contexts and bounds are made of those
    alone, in the returned plan.
    """
    ends = files.agg(F.min("file_no"), F.max("file_no")).first()
    if ends[0] is None or limit <= 0:
        return search_lines(files.where("false"), pattern, where, context_lines)
    hits: list[tuple[int, int]] = []
    low = ends[0]
    for share in STEPS:
        high = ends[0] + int((ends[1] - ends[0]) * share)
        if high >= low:
            part = matching_lines(files.where(F.col("file_no").between(low, high)), pattern, where).select("file_no", "lno")
            hits += [tuple(r) for r in part.orderBy("file_no", "lno").limit(limit - len(hits)).collect()]
            low = high + 1
        if len(hits) >= limit:
            break
    numbers = sorted({n for n, _ in hits})
    if not numbers:
        return search_lines(files.where("false"), pattern, where, context_lines)
    some = files.where(F.col("file_no").between(numbers[0], numbers[-1]) & F.col("file_no").isin(numbers))
    return search_lines(some, pattern, None, context_lines).orderBy("file_no", "lno").limit(limit)


def search_paths(files: DataFrame, pattern: Pattern, where: Column | None = None) -> DataFrame:
    """One row for each file whose path matches: file_no, tree, version, path, bounds."""
    chosen = files if where is None else files.where(where)
    hits = chosen.select("file_no", "tree", "version", "path").where(pattern.matches(F.col("path")))
    return hits.select("*", pattern.bounds(F.col("path")).alias("bounds"))


def limited(hits: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first ``limit`` hits in file and line order (``TakeOrderedAndProject``)."""
    ordered = hits.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def files_density(files: DataFrame, where: Column) -> DataFrame:
    """Share of files that pass the filters."""
    return files.agg(F.count("*").alias("files"), F.sum(where.cast("long")).alias("accepted"), F.avg(where.cast("int")).alias("density"))
