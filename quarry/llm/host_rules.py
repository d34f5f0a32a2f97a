"""Operator 4: quality rules aggregated by host.

Each text is held against simple rules, hard and (nearer limits) soft.  A
host's rate of failing texts is shrunk by an empirical beta prior (method of
moments over the hosts), and its verdict joined back: texts of a *normal* host
go if they break a hard rule, those of a *strict* host also for a soft one, and
those of a *rejected* host all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side
from .shrink import moments_prior
from .urls import host_of

STRICT, REJECT = 0.4, 0.7
#: Limits: share of words, distinct words, distinct lines.
HARD, SOFT = (0.3, 0.1, 0.4), (0.15, 0.15, 0.5)
_SYMBOLS = "#$%&*"


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def measures(text: Column) -> dict[str, Column]:
    """What the rules look at, all counted over the whole text."""
    lines = F.split(text, "\n")
    words = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    symbols = sum((_count(text, c) for c in _SYMBOLS[1:]), _count(text, _SYMBOLS[0]))
    return {
        "words": F.size(words),
        "distinct": F.size(F.array_distinct(words)),
        "caps": F.regexp_count(text, F.lit("[A-Z]{3,}")),
        "marks": _count(text, "!"),
        "symbols": symbols,
        "bars": _count(text, "|"),
        "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)),
    }


def failures(m: dict[str, Column], part: float, distinct: float, distinct_lines: float) -> Column:
    """Number of broken rules: too few words; capitals, marks, symbols or bars in
    more than ``part`` of the words; too few distinct words or lines."""
    w = m["words"]
    rules = [w < 2, *(m[k] > F.lit(part) * w for k in ("caps", "marks", "symbols", "bars")), (w >= 20) & (m["distinct"] < F.lit(distinct) * w), (m["lines"] >= 4) & (m["distinct_lines"] < F.lit(distinct_lines) * m["lines"])]
    return sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))


def host_verdicts(flagged: DataFrame, host: str, hard: str, strict: float = STRICT, reject: float = REJECT) -> DataFrame:
    """host, host_docs, host_failed, host_rate (posterior mean), host_verdict; checkpointed."""
    hosts = cut(flagged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"), F.sum((F.col(hard) > 0).cast("long")).alias("host_failed")))
    mu, strength = moments_prior(hosts, "host_failed", "host_docs")
    rate = (F.lit(mu * strength) + F.col("host_failed")) / (F.lit(strength) + F.col("host_docs"))
    verdict = F.when(F.col("host_rate") >= reject, "rejected").when(F.col("host_rate") >= strict, "strict").otherwise("normal")
    return cut(hosts.withColumn("host_rate", rate).withColumn("host_verdict", verdict))


def host_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", url_col: str | None = None, strict: float = STRICT, reject: float = REJECT) -> DataFrame:
    """``doc_id, host, hard_failures, soft_failures, host_docs, host_failed, host_rate, host_verdict, keep``, a row for each row of ``docs``.

    The host is ``host_col``, or that of the URL in ``url_col``.  A null text counts as empty; an empty text breaks the first rule (fewer than
    two words).  A null host is a host of its own.  Rows with a null id and
    repeated rows are judged like any others and count in their host.  Other
    columns are ignored; an empty table gives an empty table.
    """
    m = measures(F.col("t"))
    host = F.col(f"`{host_col}`").cast("string") if url_col is None else host_of(F.col(f"`{url_col}`"))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), host.alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    measured = base.select("doc_id", "host", *[c.alias(k) for k, c in m.items()])
    named = {k: F.col(k) for k in m}
    flagged = cut(measured.select("doc_id", "host", failures(named, *HARD).alias("hard_failures"), failures(named, *SOFT).alias("soft_failures")))
    verdicts = host_verdicts(flagged, "host", "hard_failures", strict, reject)
    side = small_side(verdicts.withColumnRenamed("host", "host2"), 96)
    keep = (F.col("host_verdict") == "normal") & (F.col("hard_failures") == 0) | (F.col("host_verdict") == "strict") & (F.col("hard_failures") == 0) & (F.col("soft_failures") == 0)
    return flagged.join(side, F.col("host").eqNullSafe(F.col("host2"))).select(
        "doc_id", "host", "hard_failures", "soft_failures", "host_docs", "host_failed", F.round("host_rate", 6).alias("host_rate"), "host_verdict", keep.alias("keep")
    )


def oracle(strict: float = STRICT, reject: float = REJECT) -> str:
    """The same in DuckDB SQL over ``documents``."""
    count = lambda c: f"(length(t) - length(replace(t, '{c}', '')))"
    symbols = " + ".join(count(c) for c in _SYMBOLS)

    def fails(part: float, distinct: float, lines: float) -> str:
        return (
            f"(w < 2)::INT + (caps > {part} * w)::INT + (marks > {part} * w)::INT + (symbols > {part} * w)::INT + (bars > {part} * w)::INT"
            f" + (w >= 20 AND dw < {distinct} * w)::INT + (l >= 4 AND dl < {lines} * l)::INT"
        )

    return f"""
WITH b AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, host, string_split(replace(t, chr(10), ' '), ' ') AS ws, string_split(t, chr(10)) AS ls,
  len(regexp_extract_all(t, '[A-Z]{{3,}}')) AS caps, {count('!')} AS marks, {symbols} AS symbols, {count('|')} AS bars FROM b),
m AS (SELECT doc_id, host, caps, marks, symbols, bars, len(ws) AS w, len(list_distinct(ws)) AS dw, len(ls) AS l, len(list_distinct(ls)) AS dl FROM c),
f AS (SELECT doc_id, host, {fails(*HARD)} AS hard_failures, {fails(*SOFT)} AS soft_failures FROM m),
h AS (SELECT host, count(*) AS host_docs, sum((hard_failures > 0)::INT)::BIGINT AS host_failed FROM f GROUP BY host),
g AS (SELECT sum(host_failed)::DOUBLE / sum(host_docs) AS mu, sum(host_docs)::DOUBLE AS n, count(*) AS g FROM h),
v AS (SELECT mu, sum(host_docs * pow(host_failed / host_docs::DOUBLE - mu, 2)) / any_value(n) - mu * (1 - mu) * any_value(g) / any_value(n) AS between_ FROM h, g GROUP BY mu),
s AS (SELECT mu, CASE WHEN between_ <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, mu * (1 - mu) / between_ - 1)) END AS strength FROM v),
r AS (SELECT host, host_docs, host_failed, (mu * strength + host_failed) / (strength + host_docs) AS rate FROM h, s),
x AS (SELECT *, CASE WHEN rate >= {reject} THEN 'rejected' WHEN rate >= {strict} THEN 'strict' ELSE 'normal' END AS host_verdict FROM r)
SELECT f.doc_id, f.host, hard_failures, soft_failures, host_docs, host_failed, round(rate, 6) AS host_rate, host_verdict,
  (host_verdict = 'normal' AND hard_failures = 0) OR (host_verdict = 'strict' AND hard_failures = 0 AND soft_failures = 0) AS keep
FROM f JOIN x ON f.host IS NOT DISTINCT FROM x.host"""
