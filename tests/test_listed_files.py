"""Files read in the order of a listing."""

from quarry.sources import files as fsrc


def test_listed_names_are_no_patterns(spark, tmp_path):
    """names with signs of patterns, hidden ones, and one listed twice."""
    for name in ("a[1].txt", "a1.txt", "_x.txt", "b.txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "list").write_text("b.txt\na[1].txt\n\n_x.txt\nb.txt\n")
    got = fsrc.read_ordered(spark, str(tmp_path), str(tmp_path / "list"), tree="t").orderBy("rank").collect()
    assert [(r["rank"], r["path"], bytes(r.content).decode()) for r in got] == [(0, "b.txt", "b.txt"), (1, "a[1].txt", "a[1].txt"), (2, "_x.txt", "_x.txt"), (3, "b.txt", "b.txt")]
