"""Behaviour of searches on small corpora."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.regex import QueryError
from quarry.operators.ingest import binary_files
from quarry.operators.search import INVALID
from quarry.plans.engine import Config, Engine, Service
from quarry.plans.query import Query, parse


def engine(spark, *files, **more):
    """Files are (tree, path, content)."""
    rows = [(i, t, "REV0", p, c.encode() if isinstance(c, str) else c) for i, (t, p, c) in enumerate(files)]
    return Engine(binary_files(spark.createDataFrame(rows, "file_no long, tree string, version string, path string, content binary")), **more)


def found(e, **q):
    r = e.search(Query(**q))
    return [(x.tree, x.path, x.lno) for x in r.results]


def named(e, **q):
    return [(x.path, x.bounds) for x in e.search(Query(**q)).file_results]


def test_lines_survive_the_round_trip(spark):
    text = "first\n\n\nfourth\nlast\n"
    e = engine(spark, ("repo", "/data/f", text))
    assert e.files.collect()[0].lines == ["first", "", "", "fourth", "last"]


def test_bad_pattern(spark):
    with pytest.raises(QueryError):
        engine(spark, ("repo", "/f", "x")).search(Query(line="("))


def test_without_a_final_line_feed(spark):
    assert found(engine(spark, ("repo", "/f", "no newline")), line="no newline") == [("repo", "/f", 1)]
    assert found(engine(spark, ("repo", "/f", "a\nb")), line="b") == [("repo", "/f", 2)]


def test_equal_lines_of_a_file_are_all_found(spark):
    assert [x[2] for x in found(engine(spark, ("repo", "/f", "line 1\nline 1\nother\n")), line="line 1")] == [1, 2]


def test_long_lines_are_blank_but_count(spark):
    e = engine(spark, ("repo", "/f", "short\n" + "x" * 1024 + "NEEDLE\nshort\nNEEDLE\n"))
    assert found(e, line="NEEDLE") == [("repo", "/f", 4)]
    edge = engine(spark, ("repo", "/f", "a" * 1022 + "\n" + "a" * 1023 + "\n" + "ä" * 511 + "\n" + "ä" * 512))
    assert [len(x) for x in edge.files.collect()[0].lines] == [1022, 0, 511, 0]


def test_file_and_repo_filters(spark):
    e = engine(spark, *[(t, p, "contents") for t in ("repo", "OTHER") for p in ("/file1", "/file2")])
    assert len(found(e, line="contents", file=("file1",))) == 2
    assert found(e, line="contents", repo="repo") == [("repo", "/file1", 1), ("repo", "/file2", 1)]
    assert {p for _, p, _ in found(e, line="contents", not_file=("file1",))} == {"/file2"}
    assert {t for t, _, _ in found(e, line="contents", not_repo="repo")} == {"OTHER"}


def test_several_file_filters(spark):
    e = engine(spark, *[("repo", f"/file{i}", "contents") for i in (1, 2, 3)], ("OTHER", "/path1", "contents"), ("OTHER", "/path2", "contents"))
    assert [p for _, p, _ in found(e, line="contents", file=("file", "1|2"))] == ["/file1", "/file2"]
    assert [p for _, p, _ in found(e, line="contents", not_file=("2", r"p\w{3}"))] == ["/file1", "/file3"]


def test_limits(spark):
    e = engine(spark, *[("repo", f"/f{i}", "contents") for i in range(3)])
    assert len(found(e, line="contents")) == 3 and len(found(e, line="contents", max_matches=2)) == 2
    assert e.search(Query(line="contents", max_matches=2)).info["why"] == "MATCH_LIMIT"
    assert e.search(Query(line="contents", max_matches=-1)).info["why"] == "NONE"
    many = engine(spark, ("repo", "/f", "x\n" * 80))
    assert len(found(many, line="x")) == 50 and len(found(many, line="x", max_matches=-1)) == 80


def test_cases_of_line_file_and_repo_are_independent(spark):
    e = engine(spark, ("repo", "/file1", "contents"), ("REPO", "/FILE2", "CONTENTS"))
    assert len(found(e, line="contents", fold_case=True)) == 2
    assert found(e, line="contents", fold_case=False, file=("file",)) == [("repo", "/file1", 1)]
    assert len(found(e, line="contents", fold_case=True, file=("file",))) == 2
    assert found(e, line="contents", fold_case=True, file=("FILE",)) == [("REPO", "/FILE2", 1)]
    assert found(e, line="contents", fold_case=True, repo="REPO") == [("REPO", "/FILE2", 1)]
    assert found(e, line="CONTENTS", fold_case=False, repo="repo") == [("REPO", "/FILE2", 1)]


def test_paths(spark):
    e = engine(spark, ("repo", "/file1", "contents"), ("repo", "/file2", "see /file1"))
    r = e.search(Query(line="file1"))
    assert [x.path for x in r.results] == ["/file2"] and [x.path for x in r.file_results] == ["/file1"]
    only = e.search(Query(line="file1", filename_only=True))
    assert only.results == [] and len(only.file_results) == 1 and only.search_type == "filename_only"


def test_path_at_the_edge_of_many(spark):
    e = engine(spark, *[("repo", f"file{i}", f"file{i}") for i in range(1000)])
    assert [x[1] for x in found(e, line="ile999")] == ["file999"] and [p for p, _ in named(e, line="ile999")] == ["file999"]


def test_a_path_is_given_once_with_its_leftmost_match(spark):
    e = engine(spark, *[("repo", f"d{i:03d}", "x") for i in range(200)], ("repo", "/filename", "x"))
    assert named(e, line="e") == [("/filename", [4, 5])]
    b = engine(spark, ("repo", "main/build", ""), ("repo", "in/a/build.sh", "x"), ("repo", "other", "x"))
    assert sorted(named(b, line="in/", file=("build",))) == [("in/a/build.sh", [0, 3]), ("main/build", [2, 5])]


def test_bytes_that_are_not_utf8(spark):
    e = engine(spark, ("repo", "/f", b"line 0 \xe9\nline 1\nline 2\n"))
    (hit,) = e.search(Query(line="line 1")).results
    assert hit.lno == 2 and hit.context_before == [INVALID] and hit.context_after == ["line 2"]
    assert found(e, line="line 0") == []


def test_nul_bytes_empty_files_and_carriage_returns(spark):
    e = engine(spark, ("repo", "/nul", b"a\0b"), ("repo", "/empty", ""), ("repo", "/cr", "foo\r\nbar\vx"), ("repo", "/one", "q"))
    assert [r.path for r in e.files.orderBy("file_no").collect()] == ["/empty", "/cr", "/one"]
    assert found(e, line="foo.$") == [("repo", "/cr", 1)] and found(e, line="foo$") == [] and found(e, line=r"bar\sx") == []
    assert found(e, line="^q$") == [("repo", "/one", 1)] and named(e, line="empty") == [("/empty", [1, 6])]


def test_bounds_count_code_points(spark):
    (hit,) = engine(spark, ("repo", "/f", "😀é😀needle😀")).search(Query(line="n..d")).results
    assert hit.bounds == [3, 7]


def test_context_is_nearest_first_and_ends_with_the_file(spark):
    e = engine(spark, ("repo", "/f", "\n".join("abcdefg")))
    (hit,) = e.search(Query(line="d", context_lines=2)).results
    assert hit.context_before == ["c", "b"] and hit.context_after == ["e", "f"]
    (top,) = e.search(Query(line="a")).results
    assert top.context_before == [] and top.context_after == ["b", "c", "d"]


def tag_engine(spark):
    body = "int helper(void);\nint helper(void) {\n  return other_helper();\n}\nhelper_two\n"
    tags = spark.createDataFrame([("repo", "file.c", 2, "helper", "f\tkind:function"), ("repo", "file.c", 5, "helper_two", "v\tkind:variable"), ("repo", "file.c", 99, "stale", "f"), ("repo", "gone.c", 1, "helper", "f")], "tree string, path string, lno long, tag string, fields string")
    return engine(spark, ("repo", "file.c", body), tags=tags)


def test_tags(spark):
    e = tag_engine(spark)
    rank = {r.lno: r["pass"] for r in e.matches(Query(line="helper")).collect()}
    assert rank == {1: 3, 2: 1, 3: 3, 5: 2}
    assert [x[2] for x in found(e, line="helper")] == [2, 5, 1, 3]
    assert [x[2] for x in found(e, line="helper", tags="kind:function")] == [2]
    assert [x[2] for x in found(e, line="elper", tags="kind")] == [2, 5]
    (hit,) = e.search(Query(line="helper", tags="function")).results
    assert hit.bounds == [4, 10] and hit.context_before == ["int helper(void);"]
    assert {r.lno: r["pass"] for r in e.matches(Query(line="helper", not_tags="function")).collect()}[2] == 3
    with pytest.raises(QueryError):
        engine(spark, ("repo", "f", "x")).search(Query(line="x", tags="t"))


def test_requests(spark):
    s = Service({"main": engine(spark, ("repo", "/a.rb", "Hello (world)\nhello"), ("other", "/b.c", "hello"))})
    assert [r["lno"] for r in s.request({"q": ["hello repo:repo"]})["results"]] == [1, 2]
    assert [r["lno"] for r in s.request({"q": ["(world)"], "regex": ["false"]})["results"]] == [1]
    assert len(s.request({"line": ["HELLO"], "fold_case": ["true"], "repo[]": ["repo", "nope"]})["results"]) == 2
    assert [r["path"] for r in s.request({"line": ["hello"], "file": ["b.c"]})["results"]] == ["/b.c"]
    assert s.request({"q": ["x"]}, "nowhere")["error"]["code"] == "bad_backend"
    assert s.request({"q": [""]})["error"]["code"] == "bad_query" and s.request({"q": ["a("]})["error"]["code"] == "query"
    assert s.repos() == {"main": ["other", "repo"]} and s.query_log(spark).count() == len(s.log) == 4


def test_timeouts_and_callbacks(spark):
    e = engine(spark, ("repo", "/f", "a\nb\na"), config=Config(timeout_ms=60_000))
    assert e.search(Query(line="a")).info["why"] == "NONE"
    seen = []
    assert e.for_each(Query(line="a"), lambda r: seen.append(r.lno)) == 2 and seen == [1, 3]


def test_the_language_end_to_end(spark):
    e = engine(spark, ("repo", "/src/a.py", "def run(x):\n  return x.y"), ("repo", "/test/a.py", "def run(x):"))
    assert [(x.path, x.lno) for x in e.search(parse("def run -file:test")).results] == [("/src/a.py", 1)]
    assert [x.lno for x in e.search(parse("lit:x.y")).results] == [2]
    assert [x.path for x in e.search(parse("file:test")).file_results] == ["/test/a.py"]


def test_patterns_that_would_overflow_a_backtracking_engine(spark):
    lines = "\n".join(f"word {i} qq and more" for i in range(20_000))
    e = engine(spark, ("repo", "/many", lines), ("repo", "/long", "ab" * 500_000 + "\n" + "qq" * 400 + "z\n" + "a" * 1000), ("repo", "/blank", "\n" * 500_000))
    assert found(e, line="([^q]|qq)+z") == [("repo", "/long", 2)]
    assert found(e, line="(a|b|ab)*c") == [] and found(e, line="(a*)*b$") == [] and found(e, line="(x+x+)+y") == []
    assert found(e, line=r"[^q]+~") == [] and found(e, line=r"\s+x~") == []
    assert [h[1:] for h in found(e, line="((a|aa)+)+$", max_matches=3)] == [("/long", 3)]


def test_the_first_hits_are_those_of_a_whole_search(spark):
    from quarry.operators.search import Pattern, first_lines, limited, search_lines

    rows = [("repo", f"/f{i}", "\n".join(["hit" if (i * j) % 7 == 0 else "other"] * 3)) for i, j in zip(range(300), range(7, 307))]
    files = engine(spark, *rows).files.withColumn("file_no", F.col("file_no") * 3 + 5)
    p = Pattern.compile("hit", False)
    for limit in (1, 4, 50, 1000):
        want = limited(search_lines(files, p), limit, "file_no", "lno").collect()
        assert first_lines(files, p, None, 3, limit).collect() == want
    assert first_lines(files, Pattern.compile("none", False), None, 3, 5).count() == 0 and first_lines(files.where("false"), p, None, 3, 5).count() == 0
