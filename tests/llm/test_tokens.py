import glob

import pyarrow.parquet as pq
import pytest

from quarry.llm.tokens import encoding, read_tokens, token_table, tokenize, write_tokens

from .helpers import SF

ENC = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def test_exact_round_trip_of_the_query(spark):
    from quarry.llm.queries import op7_tokens

    enc = encoding(ENC)
    out = {r.doc_id: r for r in op7_tokens(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        assert enc.decode(out[d.doc_id].tokens) == d.text and out[d.doc_id].n_tokens == len(out[d.doc_id].tokens)


@pytest.mark.parametrize("coding, expected", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_layout(spark, tmp_path, coding, expected):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionAll(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars"))
    path = str(tmp_path / coding)
    write_tokens(tokenize(docs.coalesce(1)), path, coding=coding, row_group_bytes=200_000, page_bytes=8_000, page_rows=50)
    (file,) = glob.glob(f"{path}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 1
    col = meta.row_group(0).column(2)
    assert col.path_in_schema.startswith("tokens") and any(expected in e or e == "PLAIN_DICTIONARY" and coding == "dictionary" for e in col.encodings)
    assert col.has_offset_index and col.has_column_index
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    some = read_tokens(spark, path, [3, 1005])
    assert sorted(r.doc_id for r in some.collect()) == [3, 1005]
    pushed = lambda df: df._jdf.queryExecution().toString().split("PushedFilters: [")[1]
    assert "(doc_id,3)" in pushed(some) and "(doc_id,1005)" in pushed(some)
    many = read_tokens(spark, path, list(range(0, 60, 3)) + [1100])
    assert sorted(r.doc_id for r in many.collect()) == [*range(0, 60, 3), 1100] and read_tokens(spark, path, []).count() == 0
    assert all(f"(doc_id,{i})" in pushed(many) for i in (0, 30, 57, 1100))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    light = read_tokens(spark, path, metadata_only=True)
    assert "tokens:" not in light._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].replace("n_tokens:", "") and light.count() == docs.count()


def test_cases(spark):
    rows = [(1, "same", 1), (1, "same", 1), (None, "no id", 2), (2, None, 3), (3, "", 4), (4, "very long " * 100_000, 5), (5, "<|endoftext|> 😀", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    out = token_table(df).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 7 and by[2].tokens == [] and by[3].n_tokens == 0 and encoding(ENC).decode(by[5].tokens) == rows[6][1] and encoding(ENC).decode(by[4].tokens) == rows[5][1]
    assert token_table(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        write_tokens(tokenize(df), "/nowhere", coding="other")


def test_long_runs_of_white_space_give_the_same_ids(spark, monkeypatch):
    import random
    import re

    from quarry.llm import packing, tokens

    enc = encoding(ENC)
    blanks = " " * 1_000_000 + "a"
    texts = [blanks, "x" + "\n" * 2_000_000, "a" * 500_000 + "\t 　" * 400_000 + "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in token_table(df).collect()}
    assert all(enc.decode(out[i].tokens) == t for i, t in enumerate(texts))
    assert {r.doc_id: r.n_tokens for r in packing.pack(df).collect()} == {i: r.n_tokens for i, r in out.items()}
    # with a short limit the cuts can be held against the tokenizer itself
    monkeypatch.setattr(tokens, "_BLANKS", re.compile(tokens._BLANKS.pattern.replace("1024", "2")))
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice([" ", "\n", "\t", "\x1c", "　", "a", "the", ".", "1", "'s"]) * rng.choice([1, 1, 2, 5]) for _ in range(rng.randint(0, 12)))
        assert tokens.encode_text(enc, t).tolist() == enc.encode(t, disallowed_special=())
