import random
from collections import defaultdict

import pyarrow as pa

from quarry.llm.near_dedup import K, THRESHOLD, bounds_of, drop_near_duplicates, least_jaccard, near_duplicates, partition_of, tune
from quarry.llm.textkit import Words, shingles

from .helpers import SF

SCHEMA = "doc_id long, text string"


def brute(rows):
    """ids that a superior contains, and all wanted pairs, by comparing all sets."""
    sh, off = shingles(Words(pa.array([t for _, t in rows])), K)
    sets = {i: set(sh[a:b].tolist()) for (i, _), a, b in zip(rows, off[:-1], off[1:])}
    post = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            post[x].append(i)
    common = defaultdict(int)
    for ids in post.values():
        for a in range(len(ids)):
            for b in range(a):
                common[(ids[a], ids[b])] += 1
    pairs = set()
    for (a, b), c in common.items():
        x, y = sorted((a, b), key=lambda i: (len(sets[i]), -i))
        if c >= THRESHOLD * len(sets[x]):
            pairs.add((x, y))
    return {x for x, _ in pairs}, pairs


def edited(rng, words, rate):
    return " ".join(rng.choice("abcdefgh") * 5 if rng.random() < rate else w for w in words)


def test_tuning():
    s = least_jaccard(0.6, 10, 15, 1.5)
    bands, rows = tune(s, 0.92, 72)
    assert 1 - (1 - s**rows) ** bands >= 0.92 and bands * rows <= 72
    import numpy as np

    for n in range(1, 3000):
        low, high = bounds_of(int(partition_of(np.array([n]), 1.5)[0]), 1.5)
        assert low <= n <= high


def check(spark, rows, recall=0.99):
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).toPandas()
    gone, pairs = brute(rows)
    dropped = set(out.doc_id[~out.keep])
    assert sorted(out.doc_id) == sorted({i for i, _ in rows})
    assert dropped <= gone and len(dropped) >= recall * len(gone)
    group = dict(zip(out.doc_id, out.group_id))
    linked_pairs = sum(group[x] == group[y] for x, y in pairs)
    assert linked_pairs >= 0.8 * len(pairs)  # a document joins the group of one superior
    assert (out[out.keep].doc_id == out[out.keep].group_id).all() and out[out.keep].group_id.nunique() == out.group_id.nunique()
    linked = out[out.container_id.notna()]
    assert all((x, int(y)) in pairs or c == 1.0 for x, y, c in zip(linked.doc_id, linked.container_id, linked.containment))
    return out


def test_whole_table_against_brute_force(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_edited_copies_and_shared_boilerplate_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    boiler = " ".join(word() for _ in range(12))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([6, 12, 40, 150, 600]))]
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), edited(rng, base, rng.choice([0, 0.02, 0.05, 0.1])) + ("\n" + boiler if rng.random() < 0.5 else "")))
    rng.shuffle(rows)
    check(spark, rows)


def test_a_large_group_keeps_one(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, edited(rng, base, 0.02) if i % 3 else " ".join(base)) for i in range(900)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert out.keep.sum() == 1 and out.group_id.nunique() == 1


def test_cases(spark):
    t = "one two three four five six seven eight"
    rows = [(1, t, "x"), (1, t, "x"), (2, t.upper() + "!", "y"), (None, t, "n"), (None, t, "n"), (3, None, "z"), (4, "", "z"), (5, "...", "z"), (6, "lone", "z"), (7, "lone", "z"), (8, t + " nine " + "ten " * 100_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id string").selectExpr("*", "1 as id", "2 as keep")
    out = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert set(out) == set(range(1, 9))
    assert out[8].keep and not out[1].keep and out[1].container_id == 8 and not out[2].keep and out[2].container_id == 1 and out[2].group_id == 8 and out[2].containment == 1.0
    assert all(out[i].keep and out[i].n_shingles == 0 for i in (3, 4, 5)) and out[6].keep and not out[7].keep
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 0, 3, 4, 5, 6, 8]
    assert near_duplicates(df.limit(0)).count() == 0 and drop_near_duplicates(df.limit(0)).count() == 0


def test_any_size_finds_what_far_larger_documents_contain(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, parts = [], set()
    for i in range(60):
        whole = [word() for _ in range(rng.choice([100, 400, 2000]))]
        size = int(len(whole) / rng.choice([1.6, 3, 8])) if i % 2 else rng.choice([8, 12, 30])
        at = rng.randint(0, len(whole) - size)
        copy = whole[at : at + size]
        if size >= 30:  # an edited copy: two words of 30, each in up to five shingles
            for p in range(7, size, 15):
                copy[p] = word()
        rows += [(2 * i, " ".join(whole)), (2 * i + 1, " ".join(copy))]
        parts.add(2 * i + 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = near_duplicates(df).toPandas()
    assert set(out.doc_id[~out.keep]) == parts
    assert all(g == x - x % 2 for x, g in zip(out.doc_id, out.group_id))
    assert near_duplicates(df.limit(0)).count() == 0


def test_hot_buckets_are_split_and_lose_nothing(spark, monkeypatch):
    from quarry.llm import near_dedup as N

    monkeypatch.setattr(N, "_SAMPLE", 4)
    whole = N._bucket_pairs
    monkeypatch.setattr(N, "_bucket_pairs", lambda keyed, t, r: whole(keyed, t, r, bucket_rows=20))
    rng = random.Random(8)
    rows = []
    for group in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows += [(1000 * group + i, edited(rng, base, 0.02)) for i in range(400)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).toPandas()
    assert out.keep.sum() == 3 and out.group_id.nunique() == 3


def test_packed_ranges_keep_every_hash(spark):
    import numpy as np

    from quarry.llm.near_dedup import _packed, _ranges_of, _unpack

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    df = spark.createDataFrame([(int(k.view(np.int64)), i) for i, k in enumerate(keys)], "key long, id long").repartition(3)
    rows = _packed(df, lambda b: (b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()), 50, 1, None).collect()
    got = {}
    for r in rows:
        got |= {int(i): (r["range"], int(k)) for k, i in zip(*_unpack(r["keys"], r["ids"], r["runs"]))}
    assert got == {i: (int(_ranges_of(keys[i : i + 1], 50)[0]), int(k) & (2**32 - 1)) for i, k in enumerate(keys)}
