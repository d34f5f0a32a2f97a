"""A stream of files made of a table."""

import glob

from quarry.plans.catalogue_io import write_arrivals


def test_files_of_a_stream_have_so_many_rows(spark, tmp_path):
    """no task gets a share of the table that grows with it."""
    table = spark.range(0, 1000, 1, 2)
    write_arrivals(table, str(tmp_path / "in"), 100)
    files = glob.glob(f"{tmp_path}/in/*.parquet")
    assert len(files) == 10 and all(spark.read.parquet(f).count() == 100 for f in files)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "in")).collect()) == list(range(1000))
