import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm.line_dedup import GUARANTEE, NOISE, dedup_lines

SCHEMA = "doc_id long, text string"


def brute(rows):
    """For each (id, text): lines that must go (in a run of GUARANTEE words that
    occurs earlier) and lines that may go (in such a run of NOISE words)."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    lines = {d: [x.strip(" ") for x in d[1].split("\n")] for d in docs}
    place = defaultdict(list)
    for d in docs:
        for p, x in enumerate(lines[d]):
            place[x].append((d, p))
    must, may = defaultdict(set), defaultdict(set)
    for d in docs:
        b = lines[d]
        for p, x in enumerate(b):
            for e, q in place[x]:
                if (e, q) >= (d, p):
                    continue
                a, lo, hi = lines[e], 0, 0
                while p - lo > 0 and q - lo > 0 and b[p - lo - 1] == a[q - lo - 1]:
                    lo += 1
                while p + hi + 1 < len(b) and q + hi + 1 < len(a) and b[p + hi + 1] == a[q + hi + 1]:
                    hi += 1
                n = sum(len(b[k].split()) for k in range(p - lo, p + hi + 1))
                if n >= GUARANTEE and x:
                    must[d].add(p)
                if n >= NOISE:
                    may[d].add(p)
    return must, may


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return dedup_lines(df).collect()


def check(spark, rows):
    out = run(spark, rows)
    assert len(out) == len(rows)
    must, may = brute(rows)
    gone = 0
    for r, (i, t) in zip(sorted(out, key=lambda r: (r.doc_id, r.lines_removed)), sorted(rows)):
        kept = r.text.split("\n") if r.text or r.lines_removed == 0 else []
        n = len(t.split("\n"))
        assert n - r.lines_removed == len(kept)
        assert len(must[(i, t)]) <= r.lines_removed <= len(may[(i, t)])
        gone += r.lines_removed
    return gone


def test_random_repeats_against_brute_force(spark):
    rng = random.Random(5)
    pool = [[" ".join(rng.choices(["ab", "cd", "ef", "gh", "ij", "kl"], k=rng.randint(1, 25))) for _ in range(rng.randint(1, 9))] for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += p[a : a + rng.randint(1, 9)] if rng.random() < 0.8 else [f"own {i} {rng.random()}", ""]
        rows.append((i, "\n".join(parts)))
    assert check(spark, rows) > 20


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert check(spark, [tuple(r) for r in df.collect()]) > 0


def test_long_single_line_and_thousand_copies(spark):
    passage = " ".join(f"w{k}" for k in range(55))
    rows = [(i, f"start {i}\n{passage}\nend {i}") for i in range(1000)]
    out = {r.doc_id: r for r in run(spark, rows)}
    assert out[0].lines_removed == 0 and passage in out[0].text
    assert all(out[i].lines_removed == 1 and out[i].text == f"start {i}\nend {i}" for i in range(1, 1000))


def test_repeats_inside_one_text_leave_a_copy(spark):
    line = " ".join(["x"] * 40)
    (r,) = run(spark, [(1, "\n".join([line] * 50))])
    assert r.lines_removed == 49 and r.text == line


def test_nulls_empties_repeated_rows_and_extra_columns(spark):
    p = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, p, "a", 1), (1, p, "a", 1), (None, p, "b", 2), (3, None, "c", 3), (4, "", "d", 4), (5, p, None, None), (6, "short", "e", 9)], "doc_id long, text string, dead_id string, id long")
    out = dedup_lines(df).collect()
    assert len(out) == 7 and dedup_lines(df).columns == ["doc_id", "text", "dead_id", "id", "lines_removed"]
    by = {(r.doc_id, r.dead_id): r for r in out}
    assert by[(1, "a")].text == p and by[(None, "b")].text == p and by[(3, "c")].text is None
    assert by[(4, "d")].text == "" and by[(5, None)].text == "" and by[(5, None)].lines_removed == 1


def test_empty_table_and_very_long_text(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "\n".join(f"line {k} " + "z " * 20 for k in range(20000))
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(1, long), (2, long)], SCHEMA)).select("doc_id", "lines_removed", F.length("text").alias("n")).collect()}
    assert out[1].lines_removed == 0 and out[2].lines_removed == 20000 and out[2].n == 0
