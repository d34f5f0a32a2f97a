"""Command line: ``build`` an index, ``search`` it, ``explain``, ``inspect``, ``dump-file``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .operators import index as ix
from .operators.ingest import chunk_files, documents_as_files, ingest_metrics, span_table
from .operators.results import cli_lines, count_label
from .plans import planner
from .plans.engine import Config, Engine
from .plans.query import parse
from .sources.spec import ingest, load_spec


def _spark() -> SparkSession:
    return SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    b = sub.add_parser("build")
    b.add_argument("root")
    b.add_argument("--spec", help="index specification (JSON)")
    b.add_argument("--documents", help="Parquet table of documents")
    b.add_argument("--line-limit", type=int, default=1024)
    b.add_argument("--order-root", default="")
    b.add_argument("--revparse", action="store_true")
    b.add_argument("--ngrams", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("root")
    s.add_argument("query", nargs="+")
    s.add_argument("--literal", action="store_true")
    s.add_argument("--show-version", action="store_true")
    s.add_argument("--json", action="store_true")
    s.add_argument("--max-matches", type=int, default=50)
    s.add_argument("--context-lines", type=int, default=3)
    s.add_argument("--timeout", type=int, default=0, help="milliseconds; 0 for none")
    e = sub.add_parser("explain")
    e.add_argument("pattern")
    e.add_argument("--casefold", action="store_true")
    e.add_argument("--dot", action="store_true")
    i = sub.add_parser("inspect")
    i.add_argument("root")
    i.add_argument("--trees", action="store_true")
    i.add_argument("--source", action="store_true")
    i.add_argument("--metrics", action="store_true")
    i.add_argument("--spans", action="store_true", help="bytes of each file in its chunk")
    d = sub.add_parser("dump-file")
    d.add_argument("root")
    d.add_argument("path")
    a = p.parse_args(argv)
    if a.verb == "explain":
        from .functions.regex import parse as parse_regex

        print(planner.to_dot(planner.need_of(parse_regex(a.pattern, a.casefold))) if a.dot else json.dumps(planner.explain(a.pattern, a.casefold), indent=2))
        return 0
    spark = _spark()
    if a.verb == "build":
        if a.spec:
            spec = load_spec(a.spec)
            files, trees = ingest(spark, spec, base=os.path.dirname(os.path.abspath(a.spec)), order_root=a.order_root.split(), use_hash=a.revparse, line_limit=a.line_limit)
            print(ix.build_index(files, a.root, name=spec.name, trees=trees, ngrams=a.ngrams))
        else:
            print(ix.build_index(documents_as_files(spark.read.parquet(a.documents), a.line_limit), a.root, ngrams=a.ngrams))
        return 0
    engine = Engine.open(spark, a.root, Config(max_matches=getattr(a, "max_matches", 50), context_lines=getattr(a, "context_lines", 3), timeout_ms=getattr(a, "timeout", 0)))
    if a.verb == "search":
        reply = engine.search(parse(" ".join(a.query), not a.literal))
        if a.json:
            print(json.dumps(reply.as_dict(), ensure_ascii=False))
        else:
            if reply.results:
                frame = spark.createDataFrame(reply.results)
                for r in cli_lines(frame, a.show_version).orderBy("file_no", "lno").collect():
                    print(r.text)
            for r in reply.file_results:
                print(":".join(x for x in (r.tree, r.version if a.show_version else "", r.path) if x))
            print(count_label(len(reply.results), reply.info["why"]), "matches", file=sys.stderr)
        return 0
    if a.verb == "dump-file":
        rows = ix.dump_file(engine.files, a.path).collect()
        print(rows[0].text if rows else "", end="\n" if rows else "")
        return 0 if rows else 1
    frame = span_table(chunk_files(engine.files, 1 << 27)) if a.spans else ix.dump_trees(engine.files) if a.trees else ix.dump_source(engine.files) if a.source else ingest_metrics(engine.files) if a.metrics else ix.inspect(engine.files)
    for r in frame.toLocalIterator():
        print("\t".join(str(x) for x in r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
