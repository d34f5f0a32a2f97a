"""Operator 8: a uniform shuffle into shards of exact sizes, in one exchange.

The input's partitions are fixed ranges of its files' rows: file path and row
index name a row whatever the splits, the executors or the retries.  How many rows of each partition go to
each shard is a draw from the multivariate hypergeometric distribution, the law
of these counts under a uniform shuffle: the sums by partition and by shard are
exact.  The matrix is never built in one place: a partition draws its own row by
halving the partitions, with the counts of each half seeded by the half.  A local
permutation of the partition then decides which rows go where, without moving
anything; one exchange brings the shards together; and a second permutation
orders each shard.  Shards grow in number with the table, so that a task holds a
bounded part of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, small_side, stored

#: Shards (at least), rows of a shard (at most, beyond that number) and of a partition (at most).
SHARDS, SHARD_ROWS, PART_ROWS, SEED = 16, 8_000, 50_000, 42


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw; beyond the library's range by inversion around the mode."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if good and draws else 0
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    sd = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    a, b = max(low, mode - int(14 * sd) - 20), min(high, mode + int(14 * sd) + 20)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    logp = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(logp - logp.max())
    c = np.cumsum(p)
    return int(a + min(len(c) - 1, np.searchsorted(c, rng.random() * c[-1], side="right")))


def split_counts(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``draws`` from ``counts``."""
    if counts.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, draws, method="marginals")
    out = np.zeros(len(counts), dtype=np.int64)
    left = int(counts.sum())
    for s, c in enumerate(counts.tolist()):
        left -= c
        out[s] = x = hypergeometric(rng, c, left, draws) if draws else 0
        draws -= x
    return out


def matrix_row(starts: np.ndarray, shard_sizes: np.ndarray, p: int, seed: int, known: dict | None = None) -> np.ndarray:
    """Row ``p`` of the communication matrix; ``starts`` are the partitions' offsets, with the total.
    ``known`` keeps the counts of the halves on the way, which other rows share."""
    lo, hi, counts = 0, len(starts) - 1, shard_sizes
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = known.get((lo, hi)) if known is not None else None
        if left is None:
            left = split_counts(np.random.default_rng([seed, lo, hi]), counts, int(starts[mid] - starts[lo]))
            if known is not None:
                if len(known) >= 64:
                    known.clear()
                known[(lo, hi)] = left
        lo, hi, counts = (lo, mid, left) if p < mid else (mid, hi, counts - left)
    return counts


def shard_sizes(total: int, shards: int) -> np.ndarray:
    return np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)


def labels_of(starts: np.ndarray, sizes: np.ndarray, p: int, seed: int, known: dict | None = None) -> np.ndarray:
    """The shard of each row of partition ``p``: its matrix row, permuted locally."""
    labels = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(starts, sizes, p, seed, known))
    np.random.default_rng([seed, 1 << 40, p]).shuffle(labels)
    return labels


def shuffle_to_shards(df: DataFrame, shards: int | None = None, seed: int = SEED, *, shard_rows: int = SHARD_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``shard`` and ``position`` (from 0 in each shard): a uniform shuffle.

    There are ``shards`` shards, or else one for each ``shard_rows`` rows, and 16
    at least.  Their sizes differ by one at most.  Rows are taken as they are: nulls, empty
    and long texts and repeated rows are rows like any others.  If ``df`` has
    columns of these names the new ones get leading underscores.  With fewer rows
    than shards some shards are empty; an empty table gives an empty table.  The
    same files and seed give the same result.  ``df`` should be a plain read of
    files; anything else is first written to the shared folder.
    """
    c_shard, c_pos = fresh(df, "shard"), fresh(df, "position")
    path, at = fresh(df, "from_path"), fresh(df, "from_row")
    source = df if _is_scan(df) else stored(df, "unsharded")
    named = source.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
    files = sorted(((r["f"], r["n"]) for r in named.groupBy(F.col(path).alias("f")).agg(F.count("*").alias("n")).collect()))
    if not files:
        return df.select("*", F.lit(None).cast("int").alias(c_shard), F.lit(None).cast("long").alias(c_pos))
    # partitions: ranges of at most part_rows rows of a file
    ranges = [-(-n // part_rows) for _, n in files]
    first = np.concatenate([[0], np.cumsum(ranges)])
    counts = np.concatenate([np.minimum(part_rows, n - part_rows * np.arange(k)) for (_, n), k in zip(files, ranges)])
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    sizes = shard_sizes(int(starts[-1]), shards or max(SHARDS, -(-int(starts[-1]) // shard_rows)))
    num = fresh(df, "from_part")
    parts = df.sparkSession.createDataFrame([(f, int(i)) for (f, _), i in zip(files, first)], f"`{path}` string, `{num}` long")
    law = df.sparkSession.sparkContext.broadcast((starts, sizes))  # two numbers a partition and a shard
    cache: dict[int, np.ndarray] = {}
    known: dict = {}

    @F.arrow_udf("int")
    def shard_of(p: pa.Array, row: pa.Array) -> pa.Array:
        rows = row.to_numpy(zero_copy_only=False)
        ps, rows = p.to_numpy(zero_copy_only=False) + rows // part_rows, rows % part_rows
        out = np.empty(len(ps), dtype=np.int32)
        for q in np.unique(ps).tolist():
            if q not in cache:
                cache.clear()
                cache[q] = labels_of(*law.value, q, seed, known)
            out[ps == q] = cache[q][rows[ps == q]]
        return pa.array(out)

    sent = named.join(small_side(cut(parts), 200), path).withColumn(c_shard, shard_of(F.col(num), F.col(at)))
    order = Window.partitionBy(c_shard).orderBy(F.xxhash64(F.lit(seed), F.col(num), F.col(at)), num, at)
    return sent.withColumn(c_pos, (F.row_number().over(order) - 1).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns], c_shard, c_pos)


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a read of files, perhaps with columns chosen, so that every row of a file is there once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        if plan.nodeName() == "Project":
            chosen = plan.expressions()
            if any(chosen.apply(i).nodeName() != "AttributeReference" for i in range(chosen.size())):
                return False
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "HadoopFsRelation" in plan.relation().getClass().getName()
