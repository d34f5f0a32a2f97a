import numpy as np

from quarry.llm.quality import classify, train

from .helpers import SF


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.where("pmod(xxhash64(doc_id), 2) = 0"), labels.where("pmod(xxhash64(doc_id), 2) = 1").toPandas()
    out = classify(docs, fit).toPandas().merge(held, on="doc_id")
    assert ((out.p_quality >= 0.5) == (out.quality == 1)).mean() > 0.95
    assert ((out.p_toxic >= 0.5) == (out.toxic == 1)).mean() > 0.9


def test_host_and_path_posteriors(spark):
    good, bad = "some calm words about things and people in the town", "BUY!! NOW!! CHEAP!! $$$ WIN!!"
    rows = [(i, good if i % 2 else bad, "mixed", "en") for i in range(60)] + [(100 + i, bad, "spam", "en") for i in range(60)] + [(200 + i, good, "fine", "de") for i in range(60)] + [(300, good, "tiny", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = docs.where("doc_id < 60").selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "0 as toxic")
    out = classify(docs, labels).toPandas().set_index("doc_id")
    assert out.host_rate[100] < out.host_rate[300] < out.host_rate[200]
    assert out.keep[[1, 200, 300]].all() and not out.keep[[0, 100]].any()
    mean = out.p_document.mean()
    assert abs(out.host_rate[300] - mean) < abs(out.p_document[300] - mean)
    want = 1 / (1 + np.exp(-(np.log(out.p_document / (1 - out.p_document)) + 0.5 * (np.log(out.path_rate / (1 - out.path_rate)) - np.log(mean / (1 - mean))))))
    assert np.allclose(want, out.p_quality, atol=1e-6)


def test_cases(spark):
    text = "some calm words about things and people in the town"
    rows = [(1, text, None, None), (1, text, None, None), (None, text, "a", "x"), (2, None, "a", "x"), (3, "", "a", None), (4, text * 10_000, "b", "y"), (5, "!!! ??", "b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as host", "2 as keep", "3 as quality_keep")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    out = classify(docs, labels).collect()
    assert len(out) == 7 and all(not r.keep for r in out if r.doc_id in (2, 3, 5)) and all(r.keep for r in out if r.doc_id in (1, None, 4))
    wide = classify(docs, labels, narrow=False)
    assert wide.columns == [*docs.columns, "_quality_keep"] and wide.count() == 7
    assert classify(docs.limit(0), labels).count() == 0 and classify(docs, labels.limit(0)).where("keep").count() == 4


def test_the_sample_is_bounded_and_stable(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = train(docs, labels, sample_rows=40), train(docs.repartition(3), labels.repartition(2), sample_rows=40)
    assert all(np.array_equal(a[k]["slots"], b[k]["slots"]) and np.allclose(a[k]["head"]["w"], b[k]["head"]["w"]) for k in a)


def by_hand(out, weight=0.5):
    """Rates and posteriors of all documents from their own probabilities, in plain Python."""
    from collections import defaultdict
    from math import exp, log

    def prior(groups, center):
        n = sum(g[1] for g in groups)
        mu = sum(g[0] for g in groups) / n
        spread = sum(m * (s / m - (mu if center is None else c)) ** 2 for (s, m), c in zip(groups, center or [None] * len(groups))) / n
        between = spread - mu * (1 - mu) * len(groups) / n
        return mu, 1000.0 if between <= 0 else min(1000.0, max(2.0, mu * (1 - mu) / between - 1))

    hosts, paths = defaultdict(lambda: [0.0, 0]), defaultdict(lambda: [0.0, 0])
    for r in out:
        for g in (hosts[r.host], paths[(r.host, r.path)]):
            g[0] += r.p_document
            g[1] += 1
    mu, k = prior(list(hosts.values()), None)
    host_rate = {h: (mu * k + s) / (k + n) for h, (s, n) in hosts.items()}
    _, inner = prior(list(paths.values()), [host_rate[h] for h, _ in paths])
    path_rate = {(h, p): (inner * host_rate[h] + s) / (inner + n) for (h, p), (s, n) in paths.items()}
    clip = lambda x: min(max(x, 1e-9), 1 - 1e-9)
    odds = lambda x: log(clip(x) / (1 - clip(x)))
    post = [1 / (1 + exp(-(odds(r.p_document) + weight * (odds(path_rate[(r.host, r.path)]) - odds(mu))))) if r.p_document > 0 else 0.0 for r in out]
    return host_rate, path_rate, post


def test_the_query_on_its_whole_table_against_brute_force(spark):
    from quarry.llm.queries import op9_quality

    out = op9_quality(spark, SF).collect()
    host_rate, path_rate, post = by_hand(out)
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count() and len(path_rate) > len(host_rate) > 1
    for r, p in zip(out, post):
        assert np.isclose(r.host_rate, host_rate[r.host], atol=1e-6) and np.isclose(r.path_rate, path_rate[(r.host, r.path)], atol=1e-6)
        assert np.isclose(r.p_quality, p, atol=1e-6) and (abs(p - 0.5) < 1e-6 or r.keep == (p >= 0.5 and r.p_toxic < 0.5))


def test_hosts_and_paths_of_urls(spark):
    from pyspark.sql import functions as F

    from quarry.llm.host_rules import host_rules
    from quarry.llm.urls import host_of, path_of

    cases = {
        "https://www.Example.com:8080/News/2024/a.html?q=/x": ("example.com", "/News"), "http://u:p@sub.example.org.": ("sub.example.org", "/"), "ftp://[::1]:21/a/b": ("[::1]", "/a"),
        "https://example.com/page": ("example.com", "/"), "https://www.com/": ("www.com", "/"), "no url": (None, None), "": (None, None), None: (None, None),
    }
    got = {r.u: (r.h, r.p) for r in spark.createDataFrame([(u,) for u in cases], "u string").select("u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p")).collect()}
    assert got == cases
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    hosts = {r.host for r in host_rules(pages, id_col="page_id", text_col="html", url_col="url").collect()}
    assert len(hosts) > 1 and all("/" not in (h or "") for h in hosts)
    labels = pages.selectExpr("page_id as doc_id", "cast(page_id % 2 as int) as quality", "0 as toxic")
    out = classify(pages, labels, id_col="page_id", text_col="html", url_col="url").collect()
    assert {r.host for r in out} == hosts and all(r.path is None or r.path.startswith("/") for r in out)
    _, _, post = by_hand(out)
    assert np.allclose([r.p_quality for r in out], post, atol=1e-6)
