"""Index specifications and server configuration, as JSON."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import binary_files, number_files
from .files import name_fs, name_ordered, read_named
from .git import name_git

#: Files that a task reads, where there are many.
FILES_PER_TASK = 20_000


@dataclass
class Metadata:
    url_pattern: str = ""
    remote: str = ""
    github: str = ""
    labels: list[str] = field(default_factory=list)


@dataclass
class PathSpec:
    path: str = ""
    name: str = ""
    ordered_contents: str = ""
    metadata: Metadata = field(default_factory=Metadata)
    ignore_symlinks: bool = False


@dataclass
class RepoSpec:
    path: str = ""
    name: str = ""
    revisions: list[str] = field(default_factory=list)
    metadata: Metadata = field(default_factory=Metadata)
    walk_submodules: bool = False
    clone_options: dict = field(default_factory=dict)


@dataclass
class IndexSpec:
    name: str = ""
    fs_paths: list[PathSpec] = field(default_factory=list)
    repositories: list[RepoSpec] = field(default_factory=list)


@dataclass
class ServerConfig:
    """Keys of the front end that bear on results; others are kept in ``other``."""

    default_max_matches: int = 0
    default_search_repos: list[str] = field(default_factory=list)
    file_links: list[dict] = field(default_factory=list)
    file_ext_to_lang: dict[str, str] = field(default_factory=dict)
    file_first_line_regex_to_lang: dict[str, str] = field(default_factory=dict)
    index_config: dict = field(default_factory=dict)
    other: dict = field(default_factory=dict)


def _make(cls, data: dict):
    known = {f.name for f in fields(cls)}
    values = {k: v for k, v in data.items() if k in known}
    if isinstance(values.get("metadata"), dict):
        values["metadata"] = _make(Metadata, values["metadata"])
    return cls(**values)


def parse_spec(text: str) -> IndexSpec:
    data = json.loads(text)
    spec = IndexSpec(data.get("name", ""), [_make(PathSpec, p) for p in data.get("fs_paths", [])], [_make(RepoSpec, r) for r in data.get("repositories", [])])
    if not spec.fs_paths and not spec.repositories:
        raise ValueError("the specification names neither paths nor repositories")
    return spec


def load_spec(path: str) -> IndexSpec:
    with open(path) as f:
        return parse_spec(f.read())


def spec_json(spec: IndexSpec) -> str:
    return json.dumps(asdict(spec), indent=2)


def load_config(path: str | None = None, **defaults) -> ServerConfig:
    """Defaults from flags, overridden by the file."""
    data = dict(defaults)
    if path:
        with open(path) as f:
            data.update(json.load(f))
    known = {f.name for f in fields(ServerConfig)} - {"other"}
    return ServerConfig(**{k: v for k, v in data.items() if k in known}, other={k: v for k, v in data.items() if k not in known})


def ingest(spark: SparkSession, spec: IndexSpec, *, base: str = "", order_root: list[str] | None = None, use_hash: bool = False, line_limit: int = 1024) -> tuple[DataFrame, DataFrame]:
    """``files`` and ``trees`` of a specification: paths first, then repositories by revision.

    Names are numbered, and files are read by their names only then, so that no content
    is exchanged, sorted or stored.  A file that has gone meanwhile leaves its number unused.
    """
    named, trees = [], []
    for p in spec.fs_paths:
        root = p.path if os.path.isabs(p.path) else os.path.join(base, p.path)
        part = name_ordered(spark, root, p.ordered_contents, tree=p.name, base=base) if p.ordered_contents else name_fs(spark, root, tree=p.name, ignore_symlinks=p.ignore_symlinks)
        named.append(part)
        trees.append((p.name, "", p.metadata))
    for r in spec.repositories:
        for revision in r.revisions:
            root = r.path if os.path.isabs(r.path) else os.path.join(base, r.path)
            named.append(name_git(spark, root, revision, tree=r.name, order_root=order_root, use_hash=use_hash, submodules=r.walk_submodules))
            trees.append((r.name, revision, r.metadata))
    every = None
    for i, part in enumerate(named):
        part = part.withColumn("source_no", F.lit(i))
        every = part if every is None else every.unionByName(part)
    numbered = number_files(every, "source_no", "rank", "path")
    count, tasks = numbered.count(), 8 * spark.sparkContext.defaultParallelism
    spread = numbered.repartition(max(1, min(-(-count // 64), max(tasks, count // FILES_PER_TASK))), F.floor(F.col("file_no") / 64))
    files = binary_files(read_named(spread), line_limit)
    table = spark.createDataFrame([(n, v, m.url_pattern, m.remote, m.github, m.labels) for n, v, m in trees], "name string, version string, url_pattern string, remote string, github string, labels array<string>")
    return files, table


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """A repository listing as JSON rows."""
    return spark.read.schema("full_name string, fork boolean, archived boolean, html_url string, clone_url string, ssh_url string").json(path)


def read_ignorelist(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.trim("value").alias("full_name"))
    return rows.where("full_name <> ''").distinct()
