"""an ingest numbers names; contents are read by name afterwards, and neither exchanged nor stored."""

import os
import random
import subprocess

from quarry.sources import git, spec as sp
from quarry.sources.files import read_fs


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)


def sources(spark, tmp_path):
    """A folder and a repository of 601 files each, the first of 5 MB that hardly compress."""
    rng = random.Random(1)
    noise = "".join(rng.randbytes(50).hex() + "\n" for _ in range(50_000))
    rows = [(f"d{i % 3}/{i:04}.txt", f"text {i}\n" if i else noise) for i in range(601)]
    for path, text in rows:
        for root in ("folder", "repo"):
            (tmp_path / root / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / root / path).write_text(text)
    repo = str(tmp_path / "repo")
    for args in (("init", "-q", "-b", "main"), ("add", "-A"), ("-c", "user.name=n", "-c", "user.email=e@example.org", "commit", "-q", "-m", "m")):
        subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True)
    return str(tmp_path / "folder"), repo, sorted(p for p, _ in rows), dict(rows)


def test_no_content_is_stored_before_it_is_read(spark, tmp_path):
    folder, repo, paths, texts = sources(spark, tmp_path)
    kept = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    kept = kept.removeprefix("file:")
    before = size(kept)
    files, _ = sp.ingest(spark, sp.IndexSpec("n", [sp.PathSpec(folder, "folder")], [sp.RepoSpec(repo, "repo", ["main", "gone"])]))
    assert size(kept) - before < 1_000_000
    got = {r.file_no: (r.tree, r.path, r.n_lines) for r in files.select("file_no", "tree", "path", "n_lines").collect()}
    assert got == {i: (tree, p, texts[p].count("\n")) for i, (tree, p) in enumerate((t, p) for t in ("folder", "repo") for p in paths)}


def test_what_is_missing_takes_no_number(spark, tmp_path):
    folder, repo, paths, texts = sources(spark, tmp_path)
    for p in paths[300:302]:
        oid = subprocess.run(["git", "-C", repo, "rev-parse", f"main:{p}"], check=True, capture_output=True, text=True).stdout.strip()
        os.remove(f"{repo}/.git/objects/{oid[:2]}/{oid[2:]}")
    os.symlink(f"{folder}/nowhere", f"{folder}/d0/broken")
    left = paths[:300] + paths[302:]
    files, _ = sp.ingest(spark, sp.IndexSpec("n", [sp.PathSpec(folder, "folder"), sp.PathSpec(f"{folder}/{paths[1]}", "one"), sp.PathSpec(f"{folder}/none", "none")], [sp.RepoSpec(repo, "repo", ["main"])]))
    want = [("folder", p) for p in paths] + [("one", os.path.basename(paths[1]))] + [("repo", p) for p in left]
    assert [(r.file_no, r.tree, r.path) for r in files.select("file_no", "tree", "path").orderBy("file_no").collect()] == [(i, *x) for i, x in enumerate(want)]
    for raw, names in ((git.read_git(spark, repo, "main", tree="t"), left), (read_fs(spark, folder, tree="t"), paths)):
        assert {r.path: bytes(r.content).decode() for r in raw.collect()} == {p: texts[p] for p in names}
