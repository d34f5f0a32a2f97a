import random

from quarry.llm.line_dedup import dedup_lines
from quarry.llm.passages import byte_ranges, cut_passages, extend, fingerprints, without
from quarry.llm.textkit import Words

import numpy as np
import pyarrow as pa


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def grams(texts, k):
    """Every run of k words and the texts that hold it."""
    out = {}
    for i, t in texts.items():
        w = (t or "").split()
        for a in range(len(w) - k + 1):
            out.setdefault(tuple(w[a : a + k]), set()).add(i)
    return out


def test_every_window_shares_its_fingerprint():
    rng = random.Random(2)
    shared = words(rng, 50)
    for _ in range(20):
        texts = [" ".join(words(rng, rng.randint(0, 90)) + shared + words(rng, rng.randint(0, 90))) for _ in range(2)]
        g, doc, _ = fingerprints(Words(pa.array(texts)), 30, 50)
        assert set(g[doc == 0].tolist()) & set(g[doc == 1].tolist())


def test_extension_and_cut(spark):
    from pyspark.sql import functions as F

    def cut_words(text, runs):
        w = Words(pa.array(["x y", text]))
        at = [byte_ranges(w, np.array([1]), np.array([lo]), hi - lo) for lo, hi in runs]
        df = spark.createDataFrame([(text, [(int(a[0]), int(z[0])) for a, z in at])], "t string, r array<struct<a:int,z:int>>")
        return df.select(without(F.col("t"), F.col("r")).alias("t")).first().t

    a, b = np.array([[1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]]), np.array([[9, 2, 3, 4, 7, 6], [1, 2, 3, 4, 5, 6]])
    left, right = extend(a, b, 2)
    assert left.tolist() == [1, 2] and right.tolist() == [2, 4]
    assert cut_words("Ein, zwei drei.\nvier (fünf)", [(1, 3)]) == "Ein, \nvier (fünf)"
    assert cut_words("a b c d", [(0, 1), (2, 4)]) == "b "


def test_planted_passages_against_brute_force(spark):
    rng = random.Random(5)
    passages = [words(rng, rng.randint(51, 120)) for _ in range(6)]
    texts = {}
    for i in range(120):
        t = words(rng, rng.randint(0, 300))
        if i % 2:
            at = rng.randint(0, len(t))
            t[at:at] = rng.choice(passages)
        texts[i] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in cut_passages(df, "doc_id", "text", 30, 50).collect()}
    before, after = grams(texts, 50), grams(got, 50)
    assert any(len(v) > 1 for v in before.values()) and all(len(v) == 1 for v in after.values())
    for gram, where in before.items():
        if len(where) > 1:
            assert min(where) in after[gram]  # the earliest copy is the one that stays
    for i in range(0, 120, 2):
        assert got[i] == texts[i]


def test_cases(spark):
    rng = random.Random(8)
    p = " ".join(words(rng, 60))
    short = " ".join(words(rng, 49))
    rows = [(1, f"one {p} two", "x"), (2, f"three {p} four", "y"), (2, f"three {p} four", "y"), (2, f"five {p}", None), (None, p, "n"), (3, None, "n"), (4, "", "n"), (5, f"a {short} b", "s"), (6, f"c {short} d", "s"), (7, "tail " * 30_000 + p, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, passage_id string").selectExpr("*", "1 as id", "2 as runs")
    out = dedup_lines(df, inside_lines=True)
    assert out.columns == [*df.columns, "lines_removed"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert len(got) == len(rows)
    kept = {d: [t for i, t in got if i == d] for d in (1, 2, 3, 4, 5, 6, None, 7)}
    assert kept[1] == [f"one {p} two"] and kept[None] == [p] and kept[3] == [None] and kept[4] == [""]
    assert sorted(kept[2]) == ["five ", "three four", "three four"]
    assert kept[5] == [f"a {short} b"] and kept[6] == [f"c {short} d"]
    assert p not in kept[7][0] and len(kept[7][0].split()) < 60  # repeats within a text go as well
    assert dedup_lines(df.limit(0), inside_lines=True).count() == 0


def test_an_earlier_fragment_shields_no_copies(spark):
    rng = random.Random(12)
    texts, copies = {}, []
    for k, (held, size) in enumerate([(45, 50), (45, 55), (49, 50), (49, 60), (40, 80)] * 4):
        p = words(rng, size)
        pad = lambda: words(rng, 20)
        texts[3 * k] = " ".join(pad() + p[:held] + pad())
        texts[3 * k + 1] = " ".join(pad() + p + pad())
        texts[3 * k + 2] = " ".join(pad() + p + pad())
        copies.append((3 * k + 2, size))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in cut_passages(df, "doc_id", "text", 30, 50).collect()}
    assert all(len(got[i].split()) == 40 for i, _ in copies)
    assert all(got[i] == t for i, t in texts.items() if i % 3 < 2)


def test_the_query_on_its_whole_table_against_brute_force(spark):
    """Every word that an earlier equal window of 50 words covers is cut, and no other."""
    from quarry.llm.queries import op5_line_dedup

    from .helpers import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lines = {r.doc_id: r.text for r in dedup_lines(docs).collect()}  # has a brute force of its own
    got = {r.doc_id: r.text for r in op5_line_dedup(spark, SF).collect()}
    assert set(got) == set(lines)
    seen, cut = set(), 0
    for i in sorted(lines):
        w = Words(pa.array([lines[i]])).hashes.tolist()
        dead = set()
        for a in range(len(w) - 49):
            window = tuple(w[a : a + 50])
            if window in seen:
                dead |= set(range(a, a + 50))
            seen.add(window)
        assert Words(pa.array([got[i]])).hashes.tolist() == [x for k, x in enumerate(w) if k not in dead]
        cut += len(dead)
    assert cut > 0
