"""Continuous ingest: new documents are matched as they arrive, and indexes reopened.

An extension: the corpus of an index stays immutable; a stream appends lines
that match saved queries, and publishes nothing half done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..operators.ingest import documents_as_files
from ..operators.search import Pattern, file_condition, search_lines
from ..plans.query import Query, effective_context


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long", max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def standing_query(documents: DataFrame, q: Query) -> DataFrame:
    """Matches of a query in a stream of documents: a plan without state."""
    files = documents_as_files(documents)
    return search_lines(files, Pattern.compile(q.line, q.fold_case), file_condition(q), effective_context(q))


def append_matches(matches: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append matches as Parquet, each exactly once."""
    writer = matches.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def arrivals(documents: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Documents and lines by window of arrival and source, with a bound on lateness."""
    lines = F.size(F.split("text", "\n"))
    return documents.withWatermark(time, late).groupBy(F.window(time, window), "source").agg(F.count("*").alias("documents"), F.sum(lines).alias("lines")).select("window.start", "window.end", "source", "documents", "lines")


def on_change(spark: SparkSession, root: str, reopen: Callable[[], bool]) -> Callable[[], bool]:
    """A poll for a new snapshot: calls ``reopen`` (``Engine.reload``) and says whether there was one."""
    from ..operators.index import current

    seen = [current(spark, root)]

    def poll() -> bool:
        now = current(spark, root)
        if now == seen[0]:
            return False
        seen[0] = now
        return reopen()

    return poll
