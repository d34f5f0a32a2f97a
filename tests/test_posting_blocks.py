"""Stored trigrams: blocks of postings."""

from pyspark.sql import functions as F

from quarry.operators import index as ix, ingest, ngram
from quarry.plans.engine import Engine

SF = "/root/testdata/sf0.001"


def test_blocks_hold_the_trigrams_of_all_files(spark):
    """in blocks of any size, each sorted, with a row a trigram."""
    files = ingest.documents_as_files(spark.read.parquet(f"{SF}/documents.parquet"))
    want = sorted(map(tuple, ngram.trigrams(files).collect()))
    for room in (1, 5_000, 10**9):
        blocks = ngram.posting_blocks(files.coalesce(1), room)
        assert sorted(map(tuple, ngram.pairs_of(blocks).collect())) == want
    names = [r.tri for r in blocks.collect()]
    assert names == sorted(set(names)) and len(names) == len({t for t, _ in want})


def test_lines_that_are_not_utf8_have_no_trigrams(spark):
    files = ingest.binary_files(spark.createDataFrame([(0, "t", "", "p", b"abcd\nx\xe9yz\nef"), (1, "t", "", "q", b"")], "file_no long, tree string, version string, path string, content binary"))
    assert sorted(map(tuple, ngram.pairs_of(ngram.posting_blocks(files)).collect())) == [("abc", 0), ("bcd", 0)] == sorted(map(tuple, ngram.trigrams(files).collect()))


def test_an_index_sorts_no_pairs(spark, tmp_path):
    """trigrams are stored without an exchange, and a look-up reaches the scan."""
    files = ingest.documents_as_files(spark.read.parquet(f"{SF}/documents.parquet"))
    assert "Exchange" not in ngram.posting_blocks(files)._jdf.queryExecution().executedPlan().toString()
    ix.build_index(files, str(tmp_path / "i"), ngrams=True)
    e = Engine.open(spark, str(tmp_path / "i"))
    assert e.ngrams.count() == ngram.trigrams(files).count()
    assert "PushedFilters: [In(tri" in e.ngrams.where(F.col("tri").isin("idi", "iot"))._jdf.queryExecution().executedPlan().toString()
