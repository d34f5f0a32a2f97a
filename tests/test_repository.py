"""Repositories written by tasks, and listed without a row of Python a file."""

import glob

from quarry.sources import git

NAMES = ["b/x", "a.txt", "a-b", "a/b", 'q"uote', "tab\tand\nline", "ß/ü", "b/a/z"]


def written(spark, root, copies=1):
    rows = [(name if not i else f"{name}.{i}", f"text of {name} {i}\n") for i in range(copies) for name in NAMES]
    return git.write_repository(spark.createDataFrame(rows, "path string, raw string").repartition(3), str(root)), dict(rows)


def test_what_was_written_is_read(spark, tmp_path):
    """blobs lie in a pack for each task, not in a file each."""
    commit, want = written(spark, tmp_path, 20)
    got = git.read_git(spark, str(tmp_path), "main", tree="t").collect()
    assert {r.path: bytes(r.content).decode() for r in got} == want and len(got) == len(want)
    assert git.resolve(str(tmp_path), "main") == commit
    assert len(glob.glob(f"{tmp_path}/objects/pack/*.pack")) == 3
    assert len(glob.glob(f"{tmp_path}/objects/??/*")) < len(NAMES)


def test_listing_and_order_agree_with_the_plain_ones(spark, tmp_path):
    commit, want = written(spark, tmp_path)
    table = git._listing(str(tmp_path), commit)
    assert [(k, o, p) for _, k, o, p in git.list_tree(str(tmp_path), commit)] == list(zip(*(table[c].to_pylist() for c in ("kind", "oid", "path"))))
    for roots in ([], ["ß", "b"]):
        got = git._ordered(table.select(["path", "oid"]), roots)
        assert got["path"].to_pylist() == git.in_order(list(want), roots)
        assert got["rank"].to_pylist() == list(range(len(want)))


def test_an_empty_repository(spark, tmp_path):
    git.write_repository(spark.createDataFrame([], "path string, raw string"), str(tmp_path))
    assert git.read_git(spark, str(tmp_path), "main", tree="t").count() == 0
