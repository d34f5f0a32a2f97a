import corpus_pipeline
from quarry.llm.near_dedup import near_duplicates

from .helpers import SF


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    n = docs.count()
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs, columns = docs, spark.read.parquet(path), docs.columns
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == columns and docs.schema == before.schema
        if name == "quality":
            ids = {r.doc_id for r in docs.collect()}
            good = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
            assert sum(i in ids for i in good) > 0.95 * len(good) and sum(i in ids for i, r in labels.items() if r.quality == 0) <= 2
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "near_dedup":
            want = {r.doc_id for r in near_duplicates(before).where("keep").collect()}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert n > seen[0] >= seen[1] >= seen[2] > 0 and seen[3] == seen[4] > 0.5 * n


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and out.columns == ["doc_id", "n_tokens", "tokens", "bucket", "bucket_length", "padding", "batch_id", "batch_row"]


def test_empty_and_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "calm words in a short text", "en", "s", 26), (2, "calm words in a short text", "en", "s", 26), (3, "word " * 50_000, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF)
            out.count()
            if name != "packing":
                d = out


def test_edited_copies_leave_no_stumps(spark, tmp_path):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(20):
        base = [word() for _ in range(400)]
        copy = list(base)
        for p in sorted(rng.sample(range(400), 6)):
            copy[p] = word()
        shared = " ".join(copy[:60]) if i % 4 else ""  # a third document quotes part of it
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(copy)), (3 * i + 2, " ".join(word() for _ in range(100)) + " " + shared)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    out = {r.doc_id: r.text for r in docs.collect()}
    texts = dict(rows)
    assert sorted(out) == sorted(i for i in texts if i % 3 != 1)
    assert all(out[i] == texts[i] for i in out if i % 3 == 0)
    assert all(out[i].split()[:100] == texts[i].split()[:100] and len(out[i].split()) < 160 for i in out if i % 3 == 2)


def test_extra_columns_with_clashing_names_pass_every_stage(spark):
    names = ["id", "keep", "h", "quality_keep", "lines_removed", "chars_before", "gone_id", "leak_free", "shard", "bucket", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").selectExpr("*", *[f"cast(doc_id as string) as {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and all(r.id == str(r.doc_id) == r.tokens for r in out.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
