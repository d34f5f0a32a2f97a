import pandas as pd

from quarry.llm.host_rules import host_rules, oracle

from .helpers import SF, same_as_duckdb


def test_whole_table_against_sql(spark):
    same_as_duckdb(host_rules(spark.read.parquet(f"{SF}/documents.parquet")), oracle(), documents=f"{SF}/documents.parquet")


CASES = [
    (1, "fine words in a fine text", "good"), (1, "fine words in a fine text", "good"), (2, None, "good"), (3, "", None), (4, "WHAT!! IS!! THIS!!", None),
    (None, "another fine text here", "good"), (5, "x " * 100_000, "bad"), (6, "a | b | c | d", "bad"), (7, "###a $$$b", "bad"), (8, "BUY NOW ALL OF IT", "bad"), (9, "ok words here\nok words\nok words\nok words\nok words", "bad"), (10, "plain text in a bad place", "bad"),
]


def test_cases_against_sql(spark):
    pdf = pd.DataFrame(CASES, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    df = spark.createDataFrame(CASES, "doc_id long, text string, source string").selectExpr("*", "1 as host", "2 as host_rate")
    same_as_duckdb(host_rules(df), oracle(), documents=pdf)
    by = {(r.doc_id, r.host): r for r in host_rules(df).collect()}
    assert by[(1, "good")].keep and by[(None, "good")].keep and not by[(2, "good")].keep and not by[(4, None)].keep
    assert not any(by[(i, "bad")].keep for i in range(5, 10)) and by[(5, "bad")].host_failed >= 4
    assert host_rules(df.limit(0)).count() == 0


def test_a_host_of_bad_texts_takes_its_good_ones_along(spark):
    rows = [(i, "ok fine words" if i % 40 == 0 else "NO!! WAY!!", "spam") for i in range(400)] + [(1000 + h * 50 + i, "fine words all along", f"h{h}") for h in range(20) for i in range(50)] + [(5000, "ok fine words", "tiny"), (5001, "NO!! WAY!!", "tiny")]
    out = {r.doc_id: r for r in host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].host_verdict == "rejected" and not out[0].keep
    assert out[1000].keep and out[5000].host_rate < 0.45
