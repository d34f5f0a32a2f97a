"""Git trees as raw files, through the git program."""

from __future__ import annotations

import hashlib
import os
import subprocess
import tempfile
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import own_folder
from .files import NAMED, read_named


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def resolve(repo: str, revision: str) -> str | None:
    """The commit that a revision names, or None."""
    try:
        return _git(repo, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{revision}^0").decode().strip()
    except (subprocess.CalledProcessError, FileNotFoundError):
        return None


def existing(repo: str, revisions: list[str]) -> list[str]:
    return [r for r in revisions if resolve(repo, r)]


def list_tree(repo: str, commit: str) -> list[tuple[str, str, str, str]]:
    """mode, type, id and path of all entries below a commit."""
    out = []
    for row in _git(repo, "ls-tree", "-r", "-z", "--full-tree", commit).decode("utf-8", "replace").split("\0"):
        if row:
            head, path = row.split("\t", 1)
            mode, kind, oid = head.split(" ")
            out.append((mode, kind, oid, path))
    return out


def in_order(paths: list[str], order_root: list[str]) -> list[str]:
    """Paths whose first part is in ``order_root`` come first, in its order; then by name."""
    place = {name: i for i, name in enumerate(order_root)}
    return sorted(paths, key=lambda p: (place.get(p.split("/", 1)[0], len(place)), p.split("/")))


def _listing(repo: str, commit: str) -> pa.Table:
    """``kind, oid, path`` of ``list_tree`` as a table, read piece by piece: a large tree makes no Python rows."""
    parts = [pa.table({"kind": pa.array([], pa.string()), "oid": pa.array([], pa.string()), "path": pa.array([], pa.large_string())})]
    with tempfile.TemporaryFile() as errors:
        ls = subprocess.Popen(["git", "-C", repo, "ls-tree", "-r", "-z", "--full-tree", commit], stdout=subprocess.PIPE, stderr=errors)
        left = b""
        while piece := ls.stdout.read(1 << 24):
            whole, _, left = (left + piece).rpartition(b"\0")
            if whole:
                rows = pc.list_flatten(pc.split_pattern(pa.array([whole.decode("utf-8", "replace")], pa.large_string()), "\0"))
                got = pc.extract_regex(rows, r"(?s)^\S+ (?P<kind>\S+) (?P<oid>\S+)\t(?P<path>.*)$")
                parts.append(pa.table({"kind": pc.struct_field(got, "kind").cast(pa.string()), "oid": pc.struct_field(got, "oid").cast(pa.string()), "path": pc.struct_field(got, "path")}))
        if ls.wait():
            errors.seek(0)
            raise subprocess.CalledProcessError(ls.returncode, ls.args, stderr=errors.read())
    return pa.concat_tables(parts)


def _ordered(blobs: pa.Table, order_root: list[str]) -> pa.Table:
    """The rows as ``in_order`` sorts their paths, with their ``rank``."""
    first = pc.replace_substring_regex(blobs["path"], "(?s)/.*", "")
    place = pc.fill_null(pc.index_in(first, pa.array(order_root, pa.large_string())), len(order_root))
    parts = pc.replace_substring(blobs["path"], "/", "\0")  # less than all that a name may hold, so names are compared part by part
    order = pc.sort_indices(pa.table({"place": place, "parts": parts}), [("place", "ascending"), ("parts", "ascending")])
    return blobs.take(order).append_column("rank", pa.array(range(len(blobs)), pa.int64()))


def write_repository(files: DataFrame, root: str, branch: str = "main", message: str = "files") -> str:
    """A bare repository of one commit in ``root``, with the text ``raw`` of each file at ``path``; the commit.

    Tasks write the blobs, a pack each, as they are: to deflate them takes longer than all
    else.  The driver sees names and ids alone, and enters them sorted, which git takes
    without looking back.
    """
    spark = files.sparkSession
    _git(root, "init", "-q", "--bare", "-b", branch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        command = ["git", "-C", root, "-c", "fastimport.unpackLimit=0", "-c", "pack.compression=0", "fast-import", "--quiet", "--depth=0"]
        with tempfile.TemporaryFile() as errors, subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, stderr=errors) as packer:
            for batch in batches:
                ids = []
                for text in batch.column(1).to_pylist():
                    data = text.encode("utf-8", "surrogatepass")
                    ids.append(hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest())
                    packer.stdin.write(b"blob\ndata %d\n" % len(data) + data + b"\n")
                yield pa.RecordBatch.from_pydict({"path": batch.column(0), "oid": pa.array(ids, pa.string())})
            packer.stdin.close()
            if packer.wait():
                errors.seek(0)
                raise RuntimeError(errors.read().decode("utf-8", "replace"))

    names = own_folder(spark, "names")
    files.select("path", "raw").mapInArrow(run, "path string, oid string").write.parquet(names)
    listed = ds.dataset(names.removeprefix("file://").removeprefix("file:"), format="parquet").to_table()
    listed = listed.take(pc.sort_indices(listed, [("path", "ascending")]))
    enter = subprocess.Popen(["git", "-C", root, "update-index", "-z", "--index-info"], stdin=subprocess.PIPE)
    for batch in listed.to_batches(65_536):
        enter.stdin.write("".join(f"100644 {oid}\t{path}\0" for path, oid in zip(batch["path"].to_pylist(), batch["oid"].to_pylist())).encode())
    enter.stdin.close()
    if enter.wait():
        raise subprocess.CalledProcessError(enter.returncode, enter.args)
    if listed.num_rows:
        _git(root, "multi-pack-index", "write")
    commit = _git(root, "-c", "user.name=n", "-c", "user.email=e@example.org", "commit-tree", "-m", message, _git(root, "write-tree").decode().strip()).decode().strip()
    _git(root, "update-ref", f"refs/heads/{branch}", commit)
    return commit


def read_git(spark: SparkSession, repo: str, revision: str = "HEAD", *, tree: str, order_root: list[str] | None = None, use_hash: bool = False, submodules: bool = False, blobs_per_task: int = 500) -> DataFrame:
    """``tree, version, path, content, rank``; nothing for an unknown revision.

    The driver lists names; tasks read the blobs.  ``version`` is the revision as
    given, or with ``use_hash`` the commit.  Submodules that are checked out below
    the working tree are read with their path as prefix and as tree of their own.
    The repository must be where the executors can read it.
    """
    return read_named(_name(spark, repo, revision, tree, order_root, use_hash, submodules, blobs_per_task))


def name_git(spark: SparkSession, repo: str, revision: str = "HEAD", *, tree: str, order_root: list[str] | None = None, use_hash: bool = False, submodules: bool = False, blobs_per_task: int = 10_000) -> DataFrame:
    """The blobs of ``read_git`` that the repository has, as ``NAMED``; none is read."""
    named = _name(spark, repo, revision, tree, order_root, use_hash, submodules, blobs_per_task)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = batch.column(1)
            for root in pc.unique(roots).to_pylist():
                part = batch.filter(pc.equal(roots, root))
                ids = "\n".join(part.column(2).to_pylist()).encode() + b"\n"
                out = subprocess.run(["git", "-C", root, "cat-file", "--batch-check=%(objectname)"], input=ids, capture_output=True, check=True).stdout
                yield part.filter(pa.array([not row.endswith(b" missing") for row in out.splitlines()]))

    return named.mapInArrow(present, NAMED)


def _name(spark: SparkSession, repo: str, revision: str, tree: str, order_root: list[str] | None, use_hash: bool, submodules: bool, blobs_per_task: int) -> DataFrame:
    commit = resolve(repo, revision)
    if commit is None:
        return spark.createDataFrame([], NAMED)
    entries = _listing(repo, commit)
    ordered = _ordered(entries.filter(pc.equal(entries["kind"], "blob")).select(["path", "oid"]), order_root or [])
    if not len(ordered):
        listed = spark.createDataFrame([], "path string, oid string, rank long")
    else:
        listed = spark.createDataFrame(ordered.cast(pa.schema({"path": pa.string(), "oid": pa.string(), "rank": pa.int64()})))
    version = commit if use_hash else revision
    listed = listed.repartition(max(1, -(-len(ordered) // blobs_per_task)))
    found = listed.select(F.lit("blob").alias("kind"), F.lit(repo).alias("root"), F.col("oid").alias("at"), F.lit(tree).alias("tree"), F.lit(version).alias("version"), "path", "rank")
    if submodules:
        links = entries.filter(pc.equal(entries["kind"], "commit"))
        for oid, path in zip(links["oid"].to_pylist(), links["path"].to_pylist()):
            inner = f"{repo}/{path}"
            if resolve(inner, oid):
                sub = _name(spark, inner, oid, path, None, use_hash, True, blobs_per_task)
                found = found.unionByName(sub.withColumns({"path": F.concat(F.lit(f"{path}/"), "path"), "rank": F.col("rank") + len(ordered)}))
    return found


def _authorised(password_env: str, username: str) -> list[str]:
    """Options that let git ask this process's environment for the password, which no argument shows."""
    if not password_env:
        return []
    return ["-c", "credential.helper=", "-c", f'credential.helper=!f() {{ test "$1" = get && echo "username={username}" && echo "password=${password_env}"; }}; f']


def mirror(remote: str, path: str, *, depth: int = 0, password_env: str = "", username: str = "git", tries: int = 3, wait: float = 1.0) -> str:
    """Make ``path`` a bare mirror of ``remote``, or bring it up to date; its HEAD's branch.

    A folder that is bare already gets the remote's address and a pruning fetch.
    HEAD then follows the remote's.  Failures are tried again, ``tries`` times in all.
    """

    def git(*args: str, at: str | None = path) -> str:
        command = ["git", *_authorised(password_env, username), *(["-C", at] if at else []), *args]
        return subprocess.run(command, check=True, capture_output=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"}).stdout.decode()

    def once() -> str:
        bare = os.path.isdir(path) and subprocess.run(["git", "-C", path, "rev-parse", "--is-bare-repository"], capture_output=True).stdout.strip() == b"true"
        less = [f"--depth={depth}"] if depth else []
        if bare:
            git("remote", "set-url", "origin", remote)
            git("fetch", "-p", *less, "origin")
        else:
            os.makedirs(path, exist_ok=True)
            git("clone", "--mirror", *less, remote, path, at=None)
        head = next((r.split()[1] for r in git("ls-remote", "--symref", "origin", "HEAD").splitlines() if r.startswith("ref:")), "")
        if head:
            git("symbolic-ref", "HEAD", head)
        return head

    for left in reversed(range(tries)):
        try:
            return once()
        except subprocess.CalledProcessError:
            if not left:
                raise
            time.sleep(wait)
    raise ValueError("tries must be positive")


def mirror_all(specs: list[dict], workers: int = 8) -> list[str]:
    """Mirror all of ``remote``, ``path`` (and other arguments of ``mirror``), some at a time; the first failure ends it."""
    with ThreadPoolExecutor(workers) as pool:
        futures = [pool.submit(mirror, **s) for s in specs]
        try:
            return [f.result() for f in futures]
        except Exception:
            for f in futures:
                f.cancel()
            raise
