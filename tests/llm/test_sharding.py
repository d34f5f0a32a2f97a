import numpy as np
from pyspark.sql import functions as F

from quarry.llm.sharding import _is_scan, hypergeometric, labels_of, matrix_row, shard_sizes, shuffle_to_shards, split_counts

from .helpers import SF


def test_matrix_has_exact_sums():
    starts = np.array([0, 7, 7, 40, 41, 100])
    sizes = shard_sizes(100, 7)
    m = np.array([matrix_row(starts, sizes, p, 9) for p in range(5)])
    assert (m >= 0).all() and m.sum(1).tolist() == [7, 0, 33, 1, 59] and (m.sum(0) == sizes).all()
    assert np.bincount(labels_of(starts, sizes, 2, 9), minlength=7).tolist() == m[2].tolist()


def test_counts_follow_the_hypergeometric_law():
    starts, sizes = np.array([0, 30, 60, 100]), shard_sizes(100, 4)
    draws = np.array([matrix_row(starts, sizes, 1, s)[0] for s in range(4000)])
    mean, var = 30 * 0.25, 30 * 0.25 * 0.75 * 70 / 99
    assert abs(draws.mean() - mean) < 0.12 and abs(draws.var() - var) < 0.4


def test_large_draws():
    rng = np.random.default_rng(1)
    x = np.array([hypergeometric(rng, 3_000_000_000, 7_000_000_000, 1_000_000) for _ in range(400)])
    assert abs(x.mean() - 300_000) < 100 and 350 < x.std() < 570
    assert split_counts(rng, np.array([2 * 10**9, 3 * 10**9]), 5 * 10**9).tolist() == [2 * 10**9, 3 * 10**9]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert _is_scan(docs) and _is_scan(docs.select("doc_id")) and not _is_scan(docs.where("doc_id > 3"))
    out = shuffle_to_shards(docs, 16).toPandas()
    n = docs.count()
    assert len(out) == n and out.doc_id.is_unique
    assert sorted(out.groupby("shard").size()) == sorted(shard_sizes(n, 16).tolist())
    assert all(sorted(g.position) == list(range(len(g))) for _, g in out.groupby("shard"))
    again = shuffle_to_shards(docs, 16).toPandas().sort_values("doc_id")
    assert (again[["shard", "position"]].values == out.sort_values("doc_id")[["shard", "position"]].values).all()
    other = shuffle_to_shards(docs, 16, seed=1).toPandas().sort_values("doc_id")
    assert (other.shard.values != again.shard.values).mean() > 0.8


def test_uniform_over_shards_and_places(spark, tmp_path):
    spark.range(60).repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    seen = np.zeros((60, 4))
    for s in range(12):
        for r in shuffle_to_shards(df, 4, seed=s).collect():
            seen[r.id, r.shard] += 1
    assert seen.sum(0).tolist() == [180] * 4
    assert ((seen - 3) ** 2 / 3).sum() < 260  # chi-square with about 180 degrees of freedom


def test_cases(spark):
    rows = [(1, "a", 1), (1, "a", 1), (None, None, 2), (2, "", None), (3, "long " * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = shuffle_to_shards(df, 3)
    assert out.columns == ["doc_id", "text", "shard", "_shard", "position"]
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.text or ""), r.shard or 0) for r in got) == sorted((d is None, d or 0, len(t or ""), s or 0) for d, t, s in rows)
    assert sorted(out.groupBy("_shard").agg(F.count("*").alias("n")).toPandas().n) == [1, 2, 2]
    assert shuffle_to_shards(df.limit(0), 3).count() == 0 and shuffle_to_shards(df, 50).count() == 5


def test_one_file_is_many_partitions(spark, tmp_path):
    """Each row range draws its own row of the matrix, from a single file and whatever the splits."""
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    out = shuffle_to_shards(df, shard_rows=50, part_rows=64).toPandas()
    assert sorted(out.groupby("shard").size()) == [50] * 20 and sorted(out.id) == list(range(1000))
    starts, sizes = np.append(np.arange(0, 1000, 64), 1000), shard_sizes(1000, 20)
    for p in range(16):
        rows = out[(out.id >= 64 * p) & (out.id < 64 * p + 64)].sort_values("id")
        assert rows.shard.tolist() == labels_of(starts, sizes, p, 42).tolist()
        assert np.bincount(rows.shard, minlength=20).tolist() == matrix_row(starts, sizes, p, 42).tolist()
    again = shuffle_to_shards(df, shard_rows=50, part_rows=64).toPandas().sort_values("id")
    assert (again[["shard", "position"]].values == out.sort_values("id")[["shard", "position"]].values).all()


def test_the_query_against_a_plain_shuffle(spark):
    from quarry.llm.queries import op8_sharding

    out = op8_sharding(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    n = len(docs)
    labels = labels_of(np.array([0, n]), shard_sizes(n, 16), 0, 42)
    assert out.set_index("doc_id").text.to_dict() == docs.set_index("doc_id").text.to_dict()
    assert (out.set_index("doc_id").shard.loc[docs.doc_id].to_numpy() == labels).all() and all(sorted(g.position) == list(range(len(g))) for _, g in out.groupby("shard"))
