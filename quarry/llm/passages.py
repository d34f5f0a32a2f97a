"""Repeated passages inside lines: the part of operator 5 that line hashes cannot see.

A passage may begin and end in the middle of lines, where no line equals another.
So words are winnowed too: of the ``noise``-word grams in each window of
``guarantee`` words the one with the least hash is a fingerprint, and only around
grams that occur twice the windows themselves are compared: equal windows choose
equal grams at equal places, so a window that occurs twice is found at both.  A
window that has an equal one at an earlier place, whichever text holds it, is
cut; runs of ``guarantee`` words or more are the unions of their windows.

What is exchanged is a narrow row for each fingerprint (about one in eleven
words), and one for each window around those that repeat, whatever the lengths
of the texts or the number of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, discard, fresh, release, stored
from .textkit import Words, _tables, mix

_NEWLINE = 10


def run_hashes(words: Words, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each on, by prefix sums: what a run costs does not depend on its length."""
    n = len(words.hashes)
    if n < size:
        return np.empty(0, np.uint64)
    p, inv = _tables(n + 1)
    acc = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(words.hashes) * p[:n], out=acc[1:])
        return mix((acc[size:] - acc[:-size]) * inv[: n - size + 1])


def _sliding(best: np.ufunc, x: np.ndarray, span: int) -> np.ndarray:
    """``best`` of the ``span`` values from each on, by runs of doubled length."""
    size, out = 1, x
    while 2 * size <= span:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(out) - (span - size)], out[span - size :])


def fingerprints(words: Words, noise: int, guarantee: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, text and first word of each window's least gram, the first of those that are equal."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    span = guarantee - noise + 1
    grams = run_hashes(words, noise)
    if len(grams) < span:
        return none
    least = _sliding(np.minimum, grams, span)
    whole = np.zeros(len(least) + 1, np.int8)  # windows that lie within one text
    first, stop = words.off[:-1], words.off[1:] - guarantee + 1
    long = stop > first
    whole[first[long]] += 1
    whole[stop[long]] -= 1
    least[np.cumsum(whole[:-1], dtype=np.int8) == 0] = 0
    edge = np.zeros(span - 1, np.uint64)
    # no gram is less than the least of a window around it, so it is one's least if it is the greatest of these
    pick = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), span) == grams)
    order = np.argsort(grams[pick], kind="stable")
    here, back = pick[order[1:]], pick[order[:-1]]
    tie = np.flatnonzero((grams[here] == grams[back]) & (here - back < span))  # such a one needs a window that begins after the one before it
    window = here[tie][:, None] - np.arange(span)
    needed = ((window > back[tie][:, None]) & (least[np.clip(window, 0, len(least) - 1)] == grams[here[tie]][:, None]) & (window < len(least))).any(axis=1)
    keep = np.ones(len(pick), dtype=bool)
    keep[order[1:][tie[~needed]]] = False
    pick = pick[keep]
    doc = np.searchsorted(words.off, pick, side="right") - 1
    return grams[pick], doc, pick - words.off[doc]


def window_keys(words: Words, doc: np.ndarray, at: np.ndarray, noise: int, guarantee: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content key, text and first word of each window that holds one of the grams (text, first word)."""
    start = at[:, None] + np.arange(noise - guarantee, 1)
    inside = (start >= 0) & (start + guarantee <= words.counts()[doc][:, None])
    wanted = np.zeros(len(words.hashes) + 1, dtype=bool)
    wanted[(words.off[:-1][doc][:, None] + start)[inside]] = True
    place = np.flatnonzero(wanted)
    key = run_hashes(words, guarantee)[place] if len(place) else np.empty(0, np.uint64)
    of = np.searchsorted(words.off, place, side="right") - 1
    return key, of, place - words.off[of]


def extend(a: np.ndarray, b: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of equal length: words that agree before place ``at``, and from it on."""
    differ = np.ones((len(a), a.shape[1] + 2), dtype=bool)  # a border on either side ends every match
    differ[:, 1:-1] = a != b
    return differ[:, at::-1].argmax(axis=1), differ[:, at + 1 :].argmax(axis=1)


def byte_ranges(words: Words, doc: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte and the byte to go on from, in its text, of each run of ``size`` words:
    the marks that follow the last word go with it, but for those from the line's end on."""
    first = words.off[:-1][doc] + at
    after = first + size
    stop = words.doc_off[1:][doc].copy()
    more = after < words.off[1:][doc]
    stop[more] = words.start[after[more]]
    feeds = np.append(np.flatnonzero(words.data == _NEWLINE), len(words.data) + 1)
    feed = feeds[np.searchsorted(feeds, words.end[after - 1])]
    base = words.doc_off[:-1][doc]
    return words.start[first] - base, np.minimum(stop, feed) - base


def without(text: Column, runs: Column) -> Column:
    """``text`` without the byte ranges ``runs`` (a, z), which are in order and apart."""
    data = text.cast("binary")
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["z"]))
    ends = F.concat(F.transform(runs, lambda r: r["a"]), F.array(F.octet_length(text)))
    parts = F.zip_with(starts, ends, lambda s, e: F.substring(data, s + 1, e - s))
    return F.aggregate(parts, F.lit(b""), lambda out, part: F.concat(out, part)).cast("string")


def repeated_passages(docs: DataFrame, id_col: str, text_col: str, noise: int, guarantee: int) -> DataFrame:
    """id, th (xxhash64 of the text), runs (array of a, z in bytes) to cut; checkpointed."""
    text = F.col(f"`{text_col}`")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).where("id is not null and t is not null")

    def prints(batch: pa.RecordBatch) -> dict:
        g, doc, at = fingerprints(Words(batch.column(2)), noise, guarantee)
        of = pa.array(doc)
        return {"g": pa.array(g.view(np.int64)), "id": batch.column(0).take(of), "th": batch.column(1).take(of), "at": pa.array(at, pa.int32())}

    found = stored(arrow_map(base, prints, "g long, id long, th long, at int", 2), "grams")
    twice = found.groupBy("g").count().where("count > 1").select("g")
    wanted = cut(found.join(twice, "g").groupBy("id", "th").agg(F.collect_set("at").alias("hits")))
    del twice
    discard(found)
    release(docs.sparkSession)

    def windows(batch: pa.RecordBatch) -> dict:
        hits = batch.column(3)
        n = np.diff(np.asarray(hits.offsets))
        words = Words(batch.column(2))
        key, doc, at = window_keys(words, np.repeat(np.arange(len(n)), n), hits.flatten().to_numpy().astype(np.int64), noise, guarantee)
        first, go_on = byte_ranges(words, doc, at, guarantee)
        of = pa.array(doc)
        return {"w": pa.array(key.view(np.int64)), "id": batch.column(0).take(of), "th": batch.column(1).take(of), "at": pa.array(at, pa.int32()), "a": pa.array(first, pa.int32()), "z": pa.array(go_on, pa.int32())}

    holders = base.join(wanted, ["id", "th"]).select("id", "th", "t", "hits").dropDuplicates(["id", "th"])
    spots = stored(arrow_map(holders, windows, "w long, id long, th long, at int, a int, z int", 2), "windows")
    del holders
    release(docs.sparkSession)
    place = F.struct("id", "th", "at")
    firsts = spots.groupBy("w").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").select("w", "f")
    later = spots.join(firsts, "w").where(place > F.col("f")).groupBy("id", "th").agg(F.collect_list(F.struct("at", "a", "z")).alias("found"))

    def merge(batch: pa.RecordBatch) -> dict:
        runs = []
        for found in batch.column(2):
            at, first, go_on = (found.values.field(c).to_numpy() for c in range(3))
            order = np.argsort(at, kind="stable")
            new = np.flatnonzero(np.diff(at[order]) > guarantee)  # windows that meet or overlap are one run
            lo, hi = order[np.append(0, new + 1)], order[np.append(new, len(at) - 1)]
            runs.append([{"a": x, "z": y} for x, y in zip(first[lo].tolist(), go_on[hi].tolist())])
        return {"id": batch.column(0), "th": batch.column(1), "runs": pa.array(runs, pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))}

    dead = cut(arrow_map(later, merge, "id long, th long, runs array<struct<a:int,z:int>>"))
    discard(spots)
    return dead


def cut_passages(docs: DataFrame, id_col: str, text_col: str, noise: int, guarantee: int) -> DataFrame:
    """``docs`` without later repeats of passages of at least ``guarantee`` words.

    Later means a greater (id, text hash, word), so a cut word always has an equal
    one at an earlier place and one copy of it stays.  Words are compared without
    case and marks.  Rows with a null id or text, empty texts and texts of fewer than
    ``guarantee`` words are left as they are; rows that agree in id and text
    change alike; other columns are passed on; an empty table gives an empty one.
    """
    dead = repeated_passages(docs, id_col, text_col, noise, guarantee)
    release(docs.sparkSession)
    i, t, r = fresh(docs, "passage_id"), fresh(docs, "passage_text"), fresh(docs, "passage_runs")
    text = F.col(f"`{text_col}`")
    named = dead.select(F.col("id").alias(i), F.col("th").alias(t), F.col("runs").alias(r))
    same = (F.col(f"`{id_col}`") == F.col(i)) & (F.xxhash64(text) == F.col(t))
    joined = docs.join(named, same, "left")
    return joined.select(*[F.when(F.col(r).isNotNull(), without(text, F.col(r))).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
