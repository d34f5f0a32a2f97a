"""Operator 3: optimal length buckets and token-budget batches.

Whole texts are tokenised once and stored; their lengths give a global
histogram.  Dynamic programming over the distinct lengths chooses the bucket
boundaries that minimise total padding (exact: the cost is linear in the
boundary, so a lower envelope of lines finds each optimum in one sweep).  Inside
a bucket, rows are ranked without a global sort: by slots of a hash, whose counts
give each slot's offset; a batch holds as many rows of the bucket's length as the
token budget allows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side, stored
from .tokens import TOKENIZER, tokenize

BUCKETS, BUDGET, SLOT_TOKENS = 16, 65_536, 2_000_000


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` boundaries (the last is the greatest length) with the least total padding."""
    order = sorted(zip(lengths, counts))
    ls, cs = [x for x, _ in order], [c for _, c in order]
    n = len(ls)
    if n == 0:
        return []
    rows, total = [0], [0]
    for length, c in zip(ls, cs):
        rows.append(rows[-1] + c)
        total.append(total[-1] + length * c)
    best = [0] + [None] * n
    cuts: list[list[int]] = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, j: slopes fall, queries rise
        head, now, came = 0, [None] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            j = i - 1
            if best[j] is not None:
                m, b = -rows[j], best[j] + total[j]
                while len(hull) - head >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (b - b1) * (m1 - m2) <= (b2 - b1) * (m1 - m):
                        hull.pop()
                    else:
                        break
                hull.append((m, b, j))
            x = ls[i - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, b, j = hull[head]
                now[i], came[i] = m * x + b + x * rows[i] - total[i], j
        best = now
        cuts.append(came)
    # the last layer allows as many buckets as there are; fewer are never better
    out, i = [], n
    for came in reversed(cuts):
        out.append(ls[i - 1])
        i = came[i]
    return out[::-1]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, tokenizer: str = TOKENIZER, slot_tokens: int = SLOT_TOKENS) -> DataFrame:
    """``doc_id, n_tokens, tokens, bucket, bucket_length, padding, batch_id, batch_row``, a row for each row of ``docs``.

    ``bucket_length`` is the padded length, ``padding`` what lacks to it,
    ``batch_id`` numbers batches over all buckets, ``batch_row`` the rows in a
    batch from 0; the two name a row, whatever its id.  Every batch but the last
    of a bucket has floor(budget / bucket_length) rows, or one row if the length
    exceeds the budget.  Rows of a batch lie together (``as_batches`` joins them).
    Texts without tokens (null or empty) have nulls from ``bucket`` on.  Rows with
    a null id and repeated rows are packed like any others, wherever their places
    in the table put them; other columns are ignored; an empty table gives an
    empty table.
    """
    tokens = stored(tokenize(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer), "packing")
    # the place in the stored table tells equal rows apart
    place = [F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("part"), F.col("_metadata.row_index").alias("at")]
    counted = tokens.select("doc_id", "n_tokens", "tokens", *place)
    hist = sorted((r["n_tokens"], r["c"]) for r in tokens.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("c")).collect())
    bounds = optimal_boundaries([n for n, _ in hist], [c for _, c in hist], buckets)
    edges = np.searchsorted(bounds, [n for n, _ in hist]) if hist else []
    per = [max(1, budget // b) for b in bounds]
    sizes = np.bincount(edges, weights=[c for _, c in hist], minlength=len(bounds)).astype(int) if hist else []
    base = np.concatenate([[0], np.cumsum([-(-s // k) for s, k in zip(sizes, per)])]).astype(int)
    pick = lambda values, i: F.element_at(F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>"), i + 1)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_length", "int"), ("padding", "int"), ("batch_id", "long"), ("batch_row", "int"))]
    if not bounds:
        return tokens.select("doc_id", "n_tokens", "tokens", *nothing)
    slots = [math.ceil(s * b / slot_tokens) for s, b in zip(sizes, bounds)]  # a task ranks about that many tokens
    bucket = F.aggregate(F.array(*[F.lit(b) for b in bounds]), F.lit(0), lambda acc, b: acc + (b < F.col("n_tokens")).cast("int"))
    h = F.xxhash64("part", "at", "doc_id")
    full = counted.where("n_tokens > 0").select("*", bucket.alias("bucket"), h.alias("h")).withColumn("slot", F.pmod("h", pick(slots, F.col("bucket"))).cast("int"))
    if max(slots) > 1:
        offsets = full.groupBy("bucket", "slot").count()
        before = F.sum("count").over(Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
        offsets = cut(offsets.select("bucket", "slot", F.coalesce(before, F.lit(0)).alias("before")))
        full = full.join(small_side(offsets, 24), ["bucket", "slot"])
    else:
        full = full.withColumn("before", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("h", "part", "at")) + F.col("before") - 1
    ranked = full.withColumn("rank", rank).withColumn("per", pick(per, F.col("bucket"))).withColumn("long", pick(bounds, F.col("bucket")).cast("int"))
    done = ranked.select(
        "doc_id", "n_tokens", "tokens", "bucket",
        F.col("long").alias("bucket_length"),
        (F.col("long") - F.col("n_tokens")).alias("padding"),
        (pick(base, F.col("bucket")) + F.floor(F.col("rank") / F.col("per"))).cast("long").alias("batch_id"),
        F.pmod("rank", "per").cast("int").alias("batch_row"),
    )
    return done.unionByName(tokens.where("n_tokens = 0").select("doc_id", "n_tokens", "tokens", *nothing))


def as_batches(packed: DataFrame, pad: int = 0) -> DataFrame:
    """``batch_id, bucket, bucket_length, doc_ids, lengths, input_ids, mask``, a row a batch of ``pack``.

    ``input_ids`` holds the rows one after the other, each padded to the bucket's
    length; ``mask`` is true for real tokens.  A batch is as large as the budget,
    or one row, so a group is bounded.  Rows without a batch are left out.
    """
    item = F.struct("batch_row", "doc_id", "n_tokens", "tokens", "padding")
    one = packed.where("batch_id is not null").groupBy("batch_id", "bucket", "bucket_length").agg(F.sort_array(F.collect_list(item)).alias("r"))
    filled = lambda x: F.concat(x["tokens"], F.array_repeat(F.lit(pad), x["padding"]))
    real = lambda x: F.concat(F.array_repeat(F.lit(True), x["n_tokens"]), F.array_repeat(F.lit(False), x["padding"]))
    return one.select("batch_id", "bucket", "bucket_length", F.col("r.doc_id").alias("doc_ids"), F.col("r.n_tokens").alias("lengths"), F.flatten(F.transform("r", filled)).alias("input_ids"), F.flatten(F.transform("r", real)).alias("mask"))
