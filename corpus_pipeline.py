"""From raw documents to packed batches, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``docs``, of which ``doc_id``, ``text``, ``source`` and ``lang``
must be there; others are passed on, whatever their names.  An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fresh, own_folder, release, table
from quarry.llm.decontaminate import drop_leaks
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.near_dedup import drop_near_duplicates
from quarry.llm.packing import pack
from quarry.llm.quality import classify


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; those without words (null and empty texts too) go.

    Null ids and repeated rows are judged like any others; null sources and
    languages are groups of their own.
    """
    verdict = fresh(docs, "quality_keep")
    return classify(docs, table(spark, sf_dir, "labels"), narrow=False).where(verdict).select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages are cut out.  A text of which less than half is left goes:
    it was an edited copy of earlier ones, and what remains are scraps around the edits,
    which the next stage could not know again.  ``n_chars`` follows the text.

    Rows with a null id or text, and texts that were blank before, stay as they are.
    Rows that agree in id and text are one document: they change, stay or go alike.
    """
    removed, before = fresh(docs, "lines_removed"), fresh(docs, "chars_before")
    text = F.col("text")
    marked = docs.withColumn(before, F.when(text.rlike(r"\S"), F.length(text)))  # null for blank texts
    left = F.col(before).isNull() | (text.rlike(r"\S") & (F.length(text) >= LEAST_LEFT * F.col(before)))
    out = dedup_lines(marked, removed_col=removed, inside_lines=True).where(left)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.

    Rows with a null id and texts without words stay; of rows that share an id
    one stays for each text.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leaked benchmark item go.

    Each row is judged by its own text, so null and repeated ids do not matter;
    null and empty texts stay.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left, with its tokens.

    Every row has its place, also with a null or repeated id; texts without tokens
    have no batch.
    """
    return pack(docs)


#: Share of a text that must be left for it to stay in ``line_dedup``.
LEAST_LEFT = 0.5

STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL can express neither the classifier nor the latent search; tests hold each operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written to the shared folder
    for the next, and goes when the driver ends or two stages on."""
    docs = table(spark, sf_dir, "documents")
    done: list[str] = []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = own_folder(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
        for old in done:  # nothing reads the one before last any more
            where = spark._jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        done = [path]
    return docs
