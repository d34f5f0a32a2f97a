import random

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm.decontaminate import Items, check, drop_leaks, find_leaks, is_leak, lcs, masks_of
from quarry.llm.textkit import Words

from .helpers import SF


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randint(1, 70))], [rng.randrange(6) for _ in range(rng.randint(0, 90))]
        assert lcs(masks_of(a), b) == plain_lcs(a, b)


def brute(docs, bench):
    """All (doc, item) pairs with a leak, by LCS at every place of every text."""
    import numpy as np

    items = Items(bench, np.ones((1 << 14) + 1)[:, None].astype("float32"), np.ones(1 << 14))
    found = set()
    for d, text in docs:
        h = Words(pa.array([text])).hashes.tolist()
        for j, i in enumerate(items.ids):
            m = int(items.size[j])
            for a in range(0, max(1, len(h)), max(1, m // 2)):
                if is_leak(*check(items, j, h[max(0, a - m) : a + 2 * m])):
                    found.add((d, i))
                    break
    return found


def test_planted_paraphrases_against_brute_force(spark):
    rng = random.Random(3)
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = list(base)
    for k in range(60):
        item = rng.choice(bench)[1].split()
        kept = [w for w in item if rng.random() > 0.15]
        host = rng.choice(base)[1].split()
        at = rng.randrange(len(host) + 1)
        docs.append((10_000 + k, " ".join(host[:at] + kept + host[at:])))
    want = brute(docs, bench)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(want) >= 55
    assert len(got & want) >= 0.9 * len(want)
    assert all(d >= 10_000 or (d, i) in want for d, i in got)


def test_cases(spark):
    item = "what is the tallest mountain of the whole wide world today. it is surely everest in nepal"
    bench = spark.createDataFrame([(1, item), (2, item), (None, item), (3, None), (4, ""), (5, "too short")], "item_id long, text string")
    filler = " ".join(f"word{i % 97}x{i % 89}" for i in range(5000))
    rows = [(1, item, "a"), (1, item, "a"), (None, item, "b"), (2, None, "c"), (3, "", "d"), (4, filler + " " + item + " " + filler, "e"), (5, filler, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    assert got == {(d, i) for d in (1, None, 4) for i in (1, 2)}
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0
    assert drop_leaks(docs, bench.limit(0)).count() == len(rows)


def test_items_in_slices_give_the_same(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = lambda df: sorted((r.doc_id, r.item_id) for r in df.collect())
    assert pairs(find_leaks(docs, bench)) == pairs(find_leaks(docs, bench, items_at_once=7))


def test_singular_vectors_match_a_full_decomposition(spark):
    import numpy as np

    from quarry.llm import decontaminate as D

    texts = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("text").alias("t")).repartition(3)
    df, n = D.document_frequencies(texts)
    idf = np.log((n + 1) / (df + 1)) + 1
    words = Words(pa.array([r.t for r in texts.collect()]))
    grid, _ = D._padded(D._slots(words.hashes), words.off, D.PASSAGE)
    a = np.zeros((len(grid), (1 << D.BITS) + 1))
    np.add.at(a, (np.arange(len(grid))[:, None], grid), 1)
    a = a[:, :-1]
    assert n == len(grid) and (df == (a > 0).sum(0)).all()
    a *= idf
    a /= np.sqrt((np.append(idf, 0)[grid] ** 2).sum(1))[:, None]
    true = np.linalg.svd(a, compute_uv=False)
    vectors, values = D.singular_vectors(texts, idf)
    assert np.allclose(vectors.T @ vectors, np.eye(D.RANK), atol=1e-3)
    assert abs(values[0] - true[0]) < 0.02 * true[0]
    assert np.linalg.norm(a @ vectors) > 0.7 * np.sqrt((true[: D.RANK] ** 2).sum())


def test_long_items_are_found_verbatim_and_paraphrased(spark):
    rng = random.Random(11)
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    bench, docs, want = [], list(base), set()
    for k, size in enumerate([100, 200, 300, 400, 600, 1000] * 4):
        item = [rng.choice(vocabulary) for _ in range(size)]
        bench.append((k, " ".join(item)))
        for copy, kept in enumerate((1.0, 0.75)):
            host = rng.choice(base)[1].split()
            at = rng.randrange(len(host) + 1)
            docs.append((10_000 + 2 * k + copy, " ".join(host[:at] + [w for w in item if rng.random() < kept] + host[at:])))
            want.add((10_000 + 2 * k + copy, k))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, spark.createDataFrame(bench, "item_id long, text string"), items_at_once=50).collect()}
    assert got == want
