"""Operator 9: a quality classifier with hierarchical empirical Bayes.

A document's own evidence comes from two logistic heads (good text, toxic text)
over surface features and lexicons, trained here on a bounded sample of the
labelled rows (``sample_rows``).  The probabilities of good text of all
documents are then summed by host and by path within the host; host rates
shrink towards the global beta prior, path rates towards their host's rate, and
a document's posterior moves its own log odds by ``weight`` times those of its
path against the global rate.  A document is kept if its posterior is at least
``threshold`` and it is not toxic; toxicity is the document's own matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, fresh, small_side, stored
from .shrink import moments_prior
from .textkit import Words
from .urls import host_of, path_of

SAMPLE_ROWS, WEIGHT, THRESHOLD, TOXIC = 20_000, 0.5, 0.5, 0.5
_BITS = 20
_SYMBOLS = [ord(c) for c in "#$%&*@^~<>{}[]\\"]


def _surface(words: Words) -> np.ndarray:
    """Surface features by text: shares of capitals, marks, symbols, bars and
    digits, repeated neighbours, distinct words, log length, word length, lines."""
    d = len(words.off) - 1
    n = words.counts().astype(float)
    hist = np.zeros((d, 256))
    for i in range(d):
        hist[i] = np.bincount(words.data[words.doc_off[i] : words.doc_off[i + 1]], minlength=256)
    per_word = 1 / np.maximum(n, 1)
    letters = hist[:, 65:91].sum(1) + hist[:, 97:123].sum(1)
    same = np.zeros(len(words.hashes) + 1)
    same[1:-1] = words.hashes[1:] == words.hashes[:-1] if len(words.hashes) else 0
    same[words.off] = 0
    acc = np.concatenate([[0], np.cumsum(same[:-1])])
    distinct = np.array([len(np.unique(words.hashes[a:b])) for a, b in zip(words.off[:-1], words.off[1:])], dtype=float)
    size = np.maximum(hist.sum(1), 1)
    return np.column_stack(
        [
            hist[:, 65:91].sum(1) / np.maximum(letters, 1),
            np.minimum(hist[:, 33] * per_word, 2),
            np.minimum(hist[:, _SYMBOLS].sum(1) * per_word, 3),
            np.minimum(hist[:, 124] * per_word, 2),
            hist[:, 48:58].sum(1) / size,
            (acc[words.off[1:]] - acc[words.off[:-1]]) * per_word,
            np.log1p(distinct) / np.log1p(np.maximum(n, 1)),
            np.log1p(n),
            np.minimum(np.where(n > 0, (size - hist[:, 32]) * per_word, 0), 40),
            np.minimum(hist[:, 10] * per_word, 1),
        ]
    ).astype(np.float64)


def _slots(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - _BITS)).astype(np.int64)


def _lexicon(docs: list[np.ndarray], y: np.ndarray, z: float = 4.0, effect: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Slots whose document frequency differs between the classes by ``z``
    standard deviations (signed root of the likelihood ratio, which also holds
    for words that one class never has) and whose log odds differ by ``effect``:
    words that lean less add up to noise in long texts.  Also their log odds."""
    if not len(docs) or y.min() == y.max():
        return np.empty(0, np.int64), np.empty(0)
    df = [np.bincount(np.concatenate([d for d, k in zip(docs, y) if k == c] or [np.empty(0, np.int64)]), minlength=1 << _BITS) for c in (0, 1)]
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    p0, p1 = (df[0] + 0.5) / (n0 + 1), (df[1] + 0.5) / (n1 + 1)
    odds = np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))
    rate = (df[0] + df[1]) / (n0 + n1)
    ratio = np.zeros(len(rate))
    for d, n in ((df[0], n0), (df[1], n1)):
        for seen, expected in ((d, n * rate), (n - d, n * (1 - rate))):
            ratio += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1) / np.where(seen > 0, expected, 1)), 0)
    pick = np.flatnonzero((ratio >= z * z) & (np.abs(odds) >= effect) & (df[0] + df[1] >= 4))
    return pick, np.clip(odds[pick], -5, 5)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> dict:
    """Ridge logistic regression by Newton steps on standardised features."""
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 1.0
        rate = min(max(rate, 0.001), 0.999)
        k = x.shape[1] if x.ndim == 2 else 0
        return {"mean": np.zeros(k), "scale": np.ones(k), "w": np.zeros(k), "b": float(np.log(rate / (1 - rate)))}
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    pen = np.full(len(w), ridge)
    pen[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + pen * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pen)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "w": w[:-1], "b": float(w[-1])}


def _apply(head: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(((x - head["mean"]) / head["scale"]) @ head["w"] + head["b"], -30, 30)))


def _lexical(hits: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positive and negative lexicon weight by text, as damped sums and a density."""
    n = np.diff(off)
    acc = np.concatenate([[0], np.cumsum(np.maximum(hits, 0))])
    neg = np.concatenate([[0], np.cumsum(np.minimum(hits, 0))])
    pos, low = acc[off[1:]] - acc[off[:-1]], neg[off[1:]] - neg[off[:-1]]
    return np.column_stack([np.log1p(pos), np.minimum(pos / np.maximum(n, 1), 3), np.log1p(-low) / np.log1p(np.maximum(n, 1))])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    """Features of at most ``sample_rows`` labelled ids (those with the least hash)."""
    picked = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        .select(F.col("doc_id").alias("label_id"), "q", "t")
    )
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(picked), F.col("id") == F.col("label_id")).select("id", "text", "q", "t")

    def run(batch: pa.RecordBatch) -> dict:
        words = Words(batch.column(1))
        x, slots = _surface(words), _slots(words)
        sets, counts = zip(*[np.unique(slots[a:b], return_counts=True) for a, b in zip(words.off[:-1], words.off[1:])])
        return {
            "id": batch.column(0), "q": batch.column(2), "t": batch.column(3), "x": pa.array(list(x), pa.list_(pa.float64())),
            "slots": pa.array([s.astype(np.int32).tobytes() for s in sets], pa.binary()), "counts": pa.array([c.astype(np.int32).tobytes() for c in counts], pa.binary()),
        }

    return arrow_map(rows, run, "id long, q int, t int, x array<double>, slots binary, counts binary", 1)


def heads(got: pd.DataFrame) -> dict:
    """The two heads from a sample of features and labels."""
    sets = [np.frombuffer(b, np.int32).astype(np.int64) for b in got.slots]
    counts = [np.frombuffer(b, np.int32) for b in got.counts]
    x = np.array([list(r) for r in got.x]) if len(got) else np.empty((0, 10))
    out: dict = {}
    for name, y in (("quality", got.q.to_numpy(dtype=np.int64)), ("toxic", got.t.to_numpy(dtype=np.int64))):
        lex = np.zeros((len(sets), 3))
        for part in (0, 1):  # lexicon features come from the other half, or they would look too good
            mine = np.arange(len(sets)) % 2 == part
            slots, odds = _lexicon([s for s, m in zip(sets, mine) if not m], y[~mine])
            w = np.zeros(1 << _BITS)
            w[slots] = odds
            idx = np.flatnonzero(mine)
            if len(idx):
                hits = np.concatenate([np.repeat(w[sets[i]], counts[i]) for i in idx])
                lex[idx] = _lexical(hits, np.concatenate([[0], np.cumsum([counts[i].sum() for i in idx])]))
        slots, odds = _lexicon(sets, y)
        out[name] = {"slots": slots, "odds": odds, "head": _fit(np.column_stack([x, lex]), y)}
    return out


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict:
    """The two heads, from at most ``sample_rows`` labelled ids (those with the
    least hash).  Labels with a null id or class are left out; of several labels
    of an id the largest counts.  A head without both classes is constant.  One
    task fits them, from the features of the sample in a fixed order; the driver
    gets the model alone."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.to_pandas() for b in batches]
        got = pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("id", "q", "t", "x", "slots", "counts")})
        got = got.assign(size=got.slots.map(len)).sort_values(["id", "size", "slots"], kind="stable").reset_index(drop=True)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(heads(got))], pa.binary())})

    sample = _sample(docs, labels, id_col, text_col, sample_rows)
    (row,) = sample.repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(row["model"])


def probabilities(model: dict, texts: pa.Array, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of good and toxic text, and the word counts."""
    words = Words(texts)
    x, slots = _surface(words), _slots(words)
    out = []
    for name in ("quality", "toxic"):
        if name not in cache:
            cache[name] = np.zeros(1 << _BITS)
            cache[name][model[name]["slots"]] = model[name]["odds"]
        out.append(_apply(model[name]["head"], np.column_stack([x, _lexical(cache[name][slots], words.off)])))
    n = words.counts()
    return np.where(n > 0, out[0], 0.0), np.where(n > 0, out[1], 0.0), n


def _scores(model: dict):
    cache: dict = {}

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        from .common import slices

        parts = []
        for piece in slices(pa.RecordBatch.from_arrays([texts], ["t"]), 0):
            q, t, _ = probabilities(model, piece.column(0), cache)
            flat = np.column_stack([q, t]).ravel()
            parts.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2), pa.int32()), pa.array(flat)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return score


def posteriors(scored: DataFrame, host: str, path: str, p: str) -> tuple[DataFrame, float]:
    """Posterior rates by (host, path), checkpointed, and the global rate."""
    paths = cut(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum(F.col(p).cast("decimal(30,12)")).cast("double").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    mu, strength = moments_prior(hosts, "hs", "hn")
    hosts = cut(hosts.withColumn("host_rate", (F.lit(mu * strength) + F.col("hs")) / (F.lit(strength) + F.col("hn"))))
    joined = paths.join(small_side(hosts.withColumnRenamed("host", "host2"), 64), F.col("host").eqNullSafe(F.col("host2")))
    _, inner = moments_prior(joined, "s", "n", center=F.col("host_rate"))
    rates = joined.withColumn("path_rate", (F.lit(inner) * F.col("host_rate") + F.col("s")) / (F.lit(inner) + F.col("n")))
    return cut(rates.select("host", "path", "n", "host_rate", "path_rate")), mu


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", url_col: str | None = None, sample_rows: int = SAMPLE_ROWS, weight: float = WEIGHT, threshold: float = THRESHOLD, toxic: float = TOXIC, narrow: bool = True
) -> DataFrame:
    """``doc_id, host, path, p_document, host_rate, path_rate, p_quality, p_toxic, keep``, a row for
    each row of ``docs``; with ``narrow=False`` the columns of ``docs`` and a boolean in ``quality_keep``.

    Host and path are ``host_col`` and ``path_col``, or the host and first folder
    of the URL in ``url_col``.  The strengths of the priors are held in 2 to 1000
    (``shrink.moments_prior``).

    Null and empty texts, and texts without words, have probability 0 and are
    rejected.  Null hosts and paths are a host and a path of their own.  Rows
    with a null id and repeated rows are classified like any others.  Columns
    of ``docs`` with clashing names are passed on untouched.  Without labels of
    both classes a head gives the rate of the class it has, or without any
    labels keeps what has words.  An empty table gives an empty table.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    if not len(model["toxic"]["slots"]) and model["toxic"]["head"]["b"] > 6:
        model["toxic"]["head"]["b"] = -6.9
    p, h, q = fresh(docs, "quality_scores"), fresh(docs, "quality_host"), fresh(docs, "quality_path")
    host, path = (F.col(f"`{host_col}`").cast("string"), F.col(f"`{path_col}`").cast("string")) if url_col is None else (host_of(F.col(f"`{url_col}`")), path_of(F.col(f"`{url_col}`")))
    scored = docs.withColumn(p, _scores(model)(F.col(f"`{text_col}`"))).withColumn(h, host).withColumn(q, path)
    # the model runs once over each text
    scored = cut(scored.select(F.col(f"`{id_col}`").alias("doc_id"), h, q, p)) if narrow else stored(scored, "scored")
    rates, mu = posteriors(scored.select(h, q, F.col(p)[0].alias("p")), h, q, "p")
    r = [fresh(docs, c) for c in ("rate_host", "rate_path", "rate_of_host", "rate_of_path")]
    table = small_side(rates.select(*[F.col(c).alias(a) for c, a in zip(("host", "path", "host_rate", "path_rate"), r)]), 96)
    joined = scored.join(table, F.col(h).eqNullSafe(F.col(r[0])) & F.col(q).eqNullSafe(F.col(r[1])), "left")
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = lambda c: F.log(clip(c) / (1 - clip(c)))
    own, bad = F.col(p)[0], F.col(p)[1]
    post = F.when(own > 0, 1 / (1 + F.exp(-(odds(own) + weight * (odds(F.col(r[3])) - odds(F.lit(mu))))))).otherwise(F.lit(0.0))
    keep = (post >= threshold) & (bad < toxic)
    if not narrow:
        return joined.select(*[F.col(f"`{c}`") for c in docs.columns], keep.alias(fresh(docs, "quality_keep")))
    return joined.select("doc_id", F.col(h).alias("host"), F.col(q).alias("path"), own.alias("p_document"), F.col(r[2]).alias("host_rate"), F.col(r[3]).alias("path_rate"), post.alias("p_quality"), bad.alias("p_toxic"), keep.alias("keep"))
