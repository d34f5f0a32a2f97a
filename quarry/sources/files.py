"""File trees and ordered lists as raw files: tree, version, path, content."""

from __future__ import annotations

import os
import subprocess
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

MAX_DEPTH = 100


def walk(root: str, ignore_symlinks: bool = False) -> list[str]:
    """Paths of all files under a local ``root`` (or ``root`` itself), relative to
    it; unreadable folders are skipped, and what lies deeper than 100 folders.

    Links to folders are followed unless ``ignore_symlinks``."""
    if os.path.isfile(root):
        return [os.path.basename(root)]
    out: list[str] = []
    stack = [("", 0)]
    while stack:
        folder, depth = stack.pop()
        folders, files = _entries(root, folder, ignore_symlinks)
        out += files
        if depth < MAX_DEPTH:
            stack += [(f, depth + 1) for f in folders]
    return sorted(out)


def read_tree(spark: SparkSession, root: str, *, tree: str, version: str = "", paths: list[str] | None = None) -> DataFrame:
    """``tree, version, path, content, rank`` of all files under ``root``, listed and read by Spark.

    ``paths`` (relative, in order) restricts the read and sets the rank."""
    if paths is not None and not paths:
        return spark.createDataFrame([], "tree string, version string, path string, content binary, rank long")
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile")
    raw = reader.load([f"{base}/{p}" for p in paths]) if paths is not None else reader.option("recursiveFileLookup", "true").load(base)
    plain = F.regexp_replace("path", "^file:/+", "/")
    prefix = base if base.startswith("/") else os.path.abspath(base) if "://" not in base else base
    rel = F.when(F.startswith(plain, F.lit(prefix + "/")), F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(prefix) + 2})")).otherwise(F.substring_index(plain, "/", -1))
    out = raw.select(F.lit(tree).alias("tree"), F.lit(version).alias("version"), rel.alias("path"), "content")
    if paths is None:
        return out.withColumn("rank", F.lit(0).cast("long"))
    order = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, rank long")
    return out.join(order, "path").select("tree", "version", "path", "content", "rank")


#: A file that a task can open, by where it lies and by what it is called: a ``file`` of
#: the folder ``root``, one of a listing (``listed``), or a git ``blob`` of the repository there.
NAMED = "kind string, root string, at string, tree string, version string, path string, rank long"

#: Folders that the driver opens before tasks take over; files that a task asks for at a time, and bytes of them it holds.
_SPREAD, _ASKED, _HELD = 256, 256, 4 << 20


def read_fs(spark: SparkSession, root: str, *, tree: str, ignore_symlinks: bool = False) -> DataFrame:
    """``tree, version, path, content, rank`` of a tree that all executors can read; nothing if ``root`` does not exist.

    The driver opens the uppermost folders only, until there are enough to go
    round; tasks walk the rest and read the files.  Rules are those of ``walk``.
    """
    return read_named(name_fs(spark, root, tree=tree, ignore_symlinks=ignore_symlinks))


def name_fs(spark: SparkSession, root: str, *, tree: str, ignore_symlinks: bool = False) -> DataFrame:
    """The files of ``read_fs`` that can be opened, as ``NAMED``."""
    if not os.path.exists(root):
        return spark.createDataFrame([], NAMED)
    files: list[str] = []
    level = [""]
    if os.path.isfile(root):
        root, base = os.path.split(root)
        files, level = [base], []
    depth = 0
    while level and len(level) < _SPREAD and depth < MAX_DEPTH:
        inner: list[str] = []
        for folder in level:
            more, own = _entries(root, folder, ignore_symlinks)
            inner += more
            files += own
        level, depth = inner, depth + 1
    at = pa.array(level + files, pa.string())
    if not len(at):
        return spark.createDataFrame([], NAMED)
    jobs = pa.table({"at": at, "depth": pa.array([depth] * len(level) + [-1] * len(files), pa.int32())})
    listed = spark.createDataFrame(jobs).repartition(max(1, min(len(at), 8 * spark.sparkContext.defaultParallelism)))
    entries = _entries  # by value, so that workers need not have this package

    def walked(at, depth):
        if depth < 0:
            yield [at]
            return
        stack = [(at, depth)]
        while stack:
            here, d = stack.pop()
            more, found = entries(root, here, ignore_symlinks)
            yield found
            if d < MAX_DEPTH:
                stack += [(x, d + 1) for x in more]

    def name(batches):
        for batch in batches:
            names = []
            for at, depth in zip(*(c.to_pylist() for c in batch.columns)):
                for found in walked(at, depth):
                    for rel in found:
                        try:
                            os.close(os.open(os.path.join(root, rel), os.O_RDONLY))
                        except OSError:
                            continue
                        names.append(rel)
                    while len(names) >= 4096:
                        yield pa.RecordBatch.from_pydict({"at": pa.array(names[:4096], pa.string())})
                        names = names[4096:]
            yield pa.RecordBatch.from_pydict({"at": pa.array(names, pa.string())})

    return _named(listed.mapInArrow(name, "at string"), "file", root, tree, "", F.col("at"), F.lit(0))


def _named(df: DataFrame, kind: str, root: str, tree: str, version: str, path: Column, rank: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit(root).alias("root"), "at", F.lit(tree).alias("tree"), F.lit(version).alias("version"), path.alias("path"), rank.cast("long").alias("rank"))


def read_named(named: DataFrame) -> DataFrame:
    """``named`` with the ``content`` of each file before its ``rank``, for where it lies.

    What cannot be read is left out, but for a file of a listing, which is an error.
    Tasks hold a few files at a time; each keeps one git for each repository.
    """
    asked, held = _ASKED, _HELD
    columns = [f for f in named.schema.fields if f.name not in ("kind", "root", "at")]
    kept = [f.name for f in columns]

    def read(batches):
        gits = {}

        def blobs(root):
            if root not in gits:
                errors = tempfile.TemporaryFile()
                gits[root] = subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=errors), errors
            return gits[root][0]

        def blob(root):
            git, errors = gits[root]
            head = git.stdout.readline().split()
            if len(head) == 2:  # a missing object
                return None
            if len(head) == 3 and len(data := git.stdout.read(int(head[2]))) == int(head[2]) and git.stdout.read(1):
                return data
            git.wait()
            errors.seek(0)
            raise RuntimeError(errors.read().decode("utf-8", "replace"))

        def file(root, at, strict):
            try:
                with open(os.path.join(root, at), "rb") as f:
                    return f.read()
            except OSError:
                if strict:
                    raise
                return None

        def made(piece, data):
            out = pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(data, pa.binary())], [*kept, "content"])
            return out.filter(out.column("content").is_valid())

        try:
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "root", "at"))))
                for a in range(0, len(rows), asked):
                    part = rows[a : a + asked]
                    for root in {r for kind, r, _ in part if kind == "blob"}:  # so few that a pipe holds their names
                        git = blobs(root)
                        git.stdin.write(b"".join(at.encode() + b"\n" for kind, r, at in part if kind == "blob" and r == root))
                        git.stdin.flush()
                    data, size, first = [], 0, a
                    for kind, root, at in part:
                        data.append(blob(root) if kind == "blob" else file(root, at, kind == "listed"))
                        size += len(data[-1] or b"")
                        if size > held:
                            yield made(batch.slice(first, len(data)), data)
                            data, size, first = [], 0, first + len(data)
                    yield made(batch.slice(first, len(data)), data)
        finally:
            for git, errors in gits.values():
                git.stdin.close()
                git.stdout.close()
                git.wait()
                errors.close()

    raw = named.mapInArrow(read, StructType([*columns, StructField("content", BinaryType())]))
    place = kept.index("rank")
    return raw.select(*kept[:place], "content", *kept[place:])


def _entries(root: str, folder: str, ignore_symlinks: bool) -> tuple[list[str], list[str]]:
    """Folders and files in a folder, by name; nothing if it cannot be opened."""
    folders, files = [], []
    try:
        found = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError:
        return [], []
    for e in found:
        if ignore_symlinks and e.is_symlink():
            continue
        try:
            (folders if e.is_dir() else files if e.is_file() else []).append(os.path.join(folder, e.name))
        except OSError:
            continue
    return folders, files


def read_ordered(spark: SparkSession, root: str, listing: str, *, tree: str, base: str = "") -> DataFrame:
    """Files named in a listing, in its order; blank rows are skipped.  A listing
    that is not absolute lies in ``base``, the folder of the configuration.

    Tasks open the files by their names as they stand: a name is no pattern, one
    that is listed twice has two ranks, and one that is missing is an error."""
    return read_named(name_ordered(spark, root, listing, tree=tree, base=base))


def name_ordered(spark: SparkSession, root: str, listing: str, *, tree: str, base: str = "") -> DataFrame:
    """The files of ``read_ordered`` as ``NAMED``."""
    with open(listing if os.path.isabs(listing) else os.path.join(base, listing)) as f:
        paths = [p for p in f.read().split("\n") if p]
    if not paths:
        return spark.createDataFrame([], NAMED)
    jobs = spark.createDataFrame(pa.table({"at": pa.array(paths), "path": pa.array(map(os.path.normpath, paths), pa.string()), "rank": pa.array(range(len(paths)), pa.int64())}))
    spread = jobs.repartition(max(1, min(len(paths) // 64, 8 * spark.sparkContext.defaultParallelism)))
    return _named(spread, "listed", root, tree, "", F.col("path"), F.col("rank"))
