"""Files, git trees, specifications, the index, streams and the command line."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.operators import browse, index as ix, repos
from quarry.operators.ingest import documents_as_files, number_files
from quarry.operators.search import search_lines, Pattern
from quarry.plans.engine import Engine
from quarry.plans.query import Query, parse
from quarry.sources import files as fsrc, git, spec as sp
from quarry.streaming import ingest as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    def run(*a):
        return subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)

    run("init", "-q")
    for path, text in {"src/main.c": "int main(void) {\n  return kmalloc(4);\n}\n", "src/util.c": "static int x;\nint kmalloc(int n);\n", "doc/README.md": "# Title\nuses kmalloc\n", "Makefile": "all:\n\tcc\n", "bin/data": "a\0b kmalloc"}.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    run("add", "-A")
    run("commit", "-qm", "one")
    return str(root)


def test_git_agrees_with_git_grep(spark, repo):
    s = sp.IndexSpec("x", [], [sp.RepoSpec(repo, "me/repo", ["HEAD", "nope"])])
    files, trees = sp.ingest(spark, s)
    e = Engine(files, trees=trees)
    for pattern, fold in (("kmalloc", False), ("^int", False), ("TITLE|x;", True), (r"\($", False), (r"[a-z]+\(", False)):
        args = ["git", "-C", repo, "grep", "-n", "-I", "-E", *(["-i"] if fold else []), "-e", pattern]
        want = {tuple(r.split(":")[:2]) for r in subprocess.run(args, capture_output=True, text=True).stdout.splitlines()}
        assert {(r.path, str(r.lno)) for r in e.search(Query(line=pattern, fold_case=fold, max_matches=-1)).results} == want


def test_git_order_hashes_and_missing_revisions(spark, repo):
    raw = git.read_git(spark, repo, "HEAD", tree="r", order_root=["src", "doc"], use_hash=True)
    got = [r.path for r in number_files(raw, "rank").orderBy("file_no").collect()]
    assert got == ["src/main.c", "src/util.c", "doc/README.md", "Makefile", "bin/data"]
    assert len(raw.first().version) == 40 and git.existing(repo, ["HEAD", "gone"]) == ["HEAD"]
    assert git.read_git(spark, repo, "gone", tree="r").count() == 0


def test_files_listings_and_links(spark, repo, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("A")
    (tmp_path / "b.txt").write_text("B")
    os.symlink(tmp_path / "b.txt", tmp_path / "link.txt")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken")
    assert fsrc.walk(str(tmp_path)) == ["b.txt", "d/a.txt", "link.txt"] and fsrc.walk(str(tmp_path), True) == ["b.txt", "d/a.txt"]
    read = lambda df: sorted((r.path, bytes(r.content).decode()) for r in df.collect())
    assert read(fsrc.read_fs(spark, str(tmp_path), tree="t")) == [("b.txt", "B"), ("d/a.txt", "A"), ("link.txt", "B")]
    assert read(fsrc.read_fs(spark, str(tmp_path / "b.txt"), tree="t")) == [("b.txt", "B")]
    assert read(fsrc.read_fs(spark, str(tmp_path / "missing"), tree="t")) == []
    (tmp_path / "list").write_text("d/a.txt\n\nb.txt\n")
    ranked = fsrc.read_ordered(spark, str(tmp_path), "list", tree="t", base=str(tmp_path)).orderBy("rank").collect()
    assert [r.path for r in ranked] == ["d/a.txt", "b.txt"]
    with pytest.raises(OSError):
        fsrc.read_ordered(spark, str(tmp_path), "no-list", tree="t")


def test_specifications(tmp_path):
    text = json.dumps({"name": "n", "fs_paths": [{"path": "p", "name": "x", "metadata": {"url_pattern": "u", "labels": ["l"]}}], "repositories": [{"path": "r", "revisions": ["HEAD"], "unknown": 1}]})
    spec = sp.parse_spec(text)
    assert spec.fs_paths[0].metadata.labels == ["l"] and sp.parse_spec(sp.spec_json(spec)) == spec
    with pytest.raises(ValueError):
        sp.parse_spec("{}")
    (tmp_path / "c.json").write_text('{"default_max_matches": 7, "listen": "x"}')
    c = sp.load_config(str(tmp_path / "c.json"), default_max_matches=3, default_search_repos=["r"])
    assert (c.default_max_matches, c.default_search_repos, c.other) == (7, ["r"], {"listen": "x"})


def test_index_round_trip_pruning_and_reload(spark, tmp_path):
    docs = documents_as_files(spark.read.parquet(f"{SF}/documents.parquet"))
    root = str(tmp_path / "index")
    ix.build_index(docs, root, name="docs", ngrams=True)
    e = Engine.open(spark, root)
    cols = ["file_no", "tree", "version", "path", "lines", "content", "n_lines"]
    assert sorted(map(str, e.files.select(cols).collect())) == sorted(map(str, docs.select(cols).collect()))
    q = Query(line="idiot", repo="^src1$", max_matches=-1)
    plain = Engine(docs)
    key = lambda df: sorted((r.file_no, r.lno, tuple(r.bounds)) for r in df.collect())
    for query in (q, Query(line="ing|thou", max_matches=-1), Query(line="[a-c]+x", max_matches=-1), parse("the file:en")):
        assert key(e.matches(query)) == key(plain.matches(query))
    plan = search_lines(e.files, Pattern.compile("idiot", False), F.col("tree").rlike("^src1$"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tree" in plan and "StringContains(content,idiot)" in plan
    assert e.reload() is False
    ix.build_index(docs.limit(3), root, name="docs2")
    assert e.reload() is True and e.files.count() == 3 and e.info()["name"] == "docs2"
    with pytest.raises(ix.IndexError_):
        Engine.open(spark, str(tmp_path / "none"))
    assert ix.dump_file(docs, docs.first().path).count() == 1 and ix.dump_file(docs, "no").count() == 0


def test_one_stage_searches(spark):
    """No exchange between the scan and the rows of a plain search."""
    docs = documents_as_files(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = search_lines(docs, Pattern.compile("idiot", False))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_repositories_and_listings(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(json.dumps({"full_name": n, "fork": f, "archived": a, "html_url": "h/" + n, "clone_url": "c/" + n, "ssh_url": "s/" + n}) for n, f, a in [("b/x", True, False), ("a/y", None, None), ("c/z", False, True), ("d/w", False, False)]))
    (tmp_path / "ignore").write_text("d/w\n\n")
    table, ignored = sp.read_repos(spark, str(tmp_path / "r.json")), sp.read_ignorelist(spark, str(tmp_path / "ignore"))
    names = lambda df: [r[0] for r in df.select("full_name").collect()]
    assert names(repos.filter_repos(table, ignored)) == ["a/y", "b/x"] and names(repos.filter_repos(table, forks=False, archived=True)) == ["a/y", "c/z", "d/w"]
    spec = {r.name: r for r in repos.repo_specs(table, "/m", http=True, password_env="PW").collect()}
    assert spec["a/y"].metadata.remote == "c/a/y" and spec["a/y"].clone_options.password_env == "PW"
    files = spark.createDataFrame([(0, "t", "", "/z/readme.md", ["a"]), (1, "t", "", "/z/README.rst", []), (2, "t", "", "/a.c", [])], "file_no long, tree string, version string, path string, lines array<string>")
    assert [(r.name, r.is_dir) for r in browse.list_dir(files, "t").collect()] == [("z", True), ("a.c", False)]
    assert [r.name for r in browse.readme_by_dir(files).collect()] == ["README.rst"]


def test_stream(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.where("doc_id < 100").write.parquet(folder)
    q = Query(line="idiot")
    start = lambda: stream.append_matches(stream.standing_query(stream.stream_documents(spark, folder), q), out, str(tmp_path / "ckpt")).awaitTermination()
    start()
    docs.where("doc_id >= 100").write.mode("append").parquet(folder)
    start()
    want = search_lines(documents_as_files(docs), Pattern.compile("idiot", False))
    key = lambda df: sorted((r.file_no, r.lno) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(want)


def test_command_line(spark, tmp_path, capsys, repo):
    root = str(tmp_path / "ix")
    (tmp_path / "s.json").write_text(json.dumps({"name": "n", "repositories": [{"path": repo, "name": "me/repo", "revisions": ["HEAD"]}]}))
    assert cli.main(["build", root, "--spec", str(tmp_path / "s.json")]) == 0
    assert cli.main(["search", root, "kmalloc", "file:src", "--show-version"]) == 0
    out = capsys.readouterr().out
    assert "me/repo:HEAD:src/main.c:2:   return kmalloc(4);" in out
    assert cli.main(["search", root, "kmalloc", "--json"]) == 0 and len(json.loads(capsys.readouterr().out)["results"]) == 3
    assert cli.main(["dump-file", root, "Makefile"]) == 0 and capsys.readouterr().out == "all:\n\tcc\n"
    assert cli.main(["dump-file", root, "none"]) == 1
    for extra in ([], ["--trees"], ["--spans"], ["--source"], ["--metrics"]):
        assert cli.main(["inspect", root, *extra]) == 0
    assert cli.main(["explain", "kmalloc|x", "--dot"]) == 0 and "digraph" in capsys.readouterr().out
