import itertools
import random

import pytest

from quarry.llm.packing import as_batches, optimal_boundaries, pack

from .helpers import SF


def padding(bounds, lengths, counts):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_boundaries_against_all_choices():
    rng = random.Random(2)
    for _ in range(60):
        lengths = rng.sample(range(1, 60), rng.randint(1, 9))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 5)
        got = optimal_boundaries(lengths, counts, k)
        best = min(padding([*c, max(lengths)], lengths, counts) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths, r))
        assert len(got) <= k and padding(got, lengths, counts) == best
    assert optimal_boundaries([], [], 4) == []


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pack(docs, slot_tokens=3_000).toPandas()
    assert sorted(out.doc_id) == sorted(r.doc_id for r in docs.collect())
    full = out[out.n_tokens > 0]
    assert (full.n_tokens <= full.bucket_length).all()
    want = optimal_boundaries(*zip(*full.n_tokens.value_counts().sort_index().items()), 16)
    assert sorted(full.bucket_length.unique()) == want
    for (b, n), g in full.groupby(["bucket", "bucket_length"]):
        per = max(1, 65_536 // int(n))
        sizes = g.groupby("batch_id").size().sort_index().tolist()
        assert sizes[:-1] == [per] * (len(sizes) - 1) and 0 < sizes[-1] <= per
        assert all(sorted(x.batch_row) == list(range(len(x))) for _, x in g.groupby("batch_id"))
    assert sorted(full.batch_id.unique()) == list(range(full.batch_id.nunique()))


def test_cases(spark):
    rows = [(None, "a b c", 1), (1, None, 2), (2, "", 3), (3, "same words", 4), (3, "same words", 4), (4, "long " * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    out = pack(df, buckets=2, budget=10).toPandas()
    assert len(out) == 6 and out[out.doc_id.isin([1, 2])].batch_id.isna().all() and (out[out.doc_id.isin([1, 2])].n_tokens == 0).all()
    (long,) = out[out.doc_id == 4].to_dict("records")
    assert long["n_tokens"] >= 100_000 and (out.batch_id == long["batch_id"]).sum() == 1
    assert pack(df.limit(0)).count() == 0 and pack(df.where("doc_id = 2")).collect()[0].bucket is None


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken"])
def test_other_tokenizer(spark, name):
    assert pack(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), tokenizer=name).collect()[0].n_tokens >= 2


def test_batches_hold_every_token(spark):
    from quarry.llm.tokens import encoding

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.unionAll(docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars"))  # null and repeated rows
    packed = pack(twice, budget=4_000)
    batches = as_batches(packed).collect()
    assert sum(len(b.doc_ids) for b in batches) == packed.where("batch_id is not null").count() and len({b.batch_id for b in batches}) == len(batches)
    enc, got = encoding("/opt/tokenizers/byte_bpe_multi_50k.tiktoken"), []
    for b in batches:
        assert len(b.input_ids) == len(b.mask) == b.bucket_length * len(b.doc_ids) and (len(b.input_ids) <= 4_000 or len(b.doc_ids) == 1)
        for i, (d, n) in enumerate(zip(b.doc_ids, b.lengths)):
            row = slice(i * b.bucket_length, (i + 1) * b.bucket_length)
            assert b.mask[row] == [True] * n + [False] * (b.bucket_length - n)
            got.append((d is None, enc.decode(b.input_ids[row][:n])))
    assert sorted(got) == sorted((null, r.text) for null in (False, True) for r in docs.collect() if r.text)
