"""Shared plumbing: lineage cuts, size-checked broadcasts, private columns."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides up to this many bytes are broadcast; above it the join shuffles.
BROADCAST_LIMIT = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quarry-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    if _marked.get("checkpoints") != sc.getCheckpointDir():
        _marked["checkpoints"] = sc.getCheckpointDir()
        until_exit(spark, sc.getCheckpointDir())
    return named


_marked: dict[str, str] = {}


def until_exit(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the driver's JVM ends: for what this application alone reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the application in the shared one; it goes when the driver ends."""
    return until_exit(spark, os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of steps that are over: its
    cleaner goes by the garbage collection of the driver, which may be hours away."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, for wide rows."""
    path = own_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, once all that was made of it is stored or checkpointed itself."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is under ``limit``.

    ``df`` should be cheap to count (already checkpointed or a small table);
    beyond the limit it is returned as it is, for a shuffled join.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case setting."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, column: int, limit: int = 256 << 10) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about ``limit`` text bytes each, so that work arrays stay small."""
    start, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def arrow_map(df: DataFrame, fn: Callable, schema: str, column: int | None = None) -> DataFrame:
    """``mapInArrow`` with ``fn(batch) -> dict of arrays``, over slices if ``column`` holds texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column) if column is not None else [batch]:
                out = fn(piece)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def tokenizer_dir() -> str:
    """Folder of public tokenizer files; ``QUARRY_TOKENIZERS`` overrides the default."""
    return os.environ.get("QUARRY_TOKENIZERS", "/opt/tokenizers")
