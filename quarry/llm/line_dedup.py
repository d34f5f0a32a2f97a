"""Operator 5: delete repeated runs of lines, found by winnowing over line hashes.

Lines are compared trimmed.  A *gram* is the shortest run of lines from a given
one with at least ``noise`` words, a *window* the shortest with at least
``guarantee`` words.  Of the grams inside each window the one with the least
hash is a fingerprint.  Equal windows choose equal fingerprints, so every run
of ``guarantee`` words that occurs twice shares one, and no match has fewer than
``noise`` words.  Fingerprints, extended line by line both ways to where the next
ones take over, are joined with the earliest position of the same content, and
the later runs are deleted.

Earlier means a smaller (doc_id, text hash, line).  A deleted line always has
an equal line at an earlier place, so by induction one copy of it stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, discard, fresh, release, stored
from .passages import cut_passages
from .textkit import _tables, mix

NOISE, GUARANTEE = 30, 50


def _line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th, h (line hashes), w (words by line), a row for each distinct (id, text)."""
    text = F.col(f"`{text_col}`")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" ")))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), lines.alias("l"), text.alias("t")).where("id is not null and t is not null")
    return base.select("id", "th", F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", lambda x: F.when(x == "", 0).otherwise(blanks(x) + 1)).alias("w")).dropDuplicates(["id", "th"])


def _run_keys(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the line hashes of each run ``start:stop``."""
    p, inv = _tables(len(h) + 1)
    with np.errstate(over="ignore"):
        acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h.view(np.uint64)) * p[: len(h)])])
        return mix((acc[stop] - acc[start]) * inv[start] + (stop - start).astype(np.uint64)).view(np.int64)


def fingerprints(h: np.ndarray, w: np.ndarray, off: np.ndarray, noise: int, guarantee: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram key, text, first and last line (within the text) of each fingerprint."""
    n = len(h)
    if n == 0:
        return (np.empty(0, np.int64),) * 4
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    last = off[1:][doc] - 1
    words = np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
    gram = np.searchsorted(words[1:], words[:-1] + noise)  # its last line
    window = np.searchsorted(words[1:], words[:-1] + guarantee)
    key = _run_keys(h, np.arange(n), np.minimum(gram, n - 1) + 1).view(np.uint64)
    ok = (window <= last) & (w > 0)
    start = np.flatnonzero(ok)
    high = np.searchsorted(gram, window[start], side="right") - 1  # the last gram inside the window
    best = start.copy()
    live = np.arange(len(start))
    step = 1
    while len(live):
        live = live[start[live] + step <= high[live]]
        at = start[live] + step
        better = (key[at] <= key[best[live]]) & (w[at] > 0)
        best[live[better]] = at[better]
        step += 1
    pick = np.unique(best)
    base = off[:-1][doc[pick]]
    return key[pick].view(np.int64), doc[pick], pick - base, gram[pick] - base


def ranges(h: np.ndarray, w: np.ndarray, off: np.ndarray, noise: int, guarantee: int) -> tuple[np.ndarray, ...]:
    """Content key, text, first and last line of each fingerprint and of its
    extensions: line by line to either side, for less than ``guarantee`` words.

    That far suffices.  If a repeated run holds a line that its fingerprints do
    not cover, less than a window lies between the line and the nearest of them,
    or another would have been chosen in between.
    """
    _, doc, s, e = fingerprints(h, w, off, noise, guarantee)
    base = off[:-1][doc]
    first, last = base + s, base + e
    words = np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
    lo, hi = [first], [last]
    for way in (1, -1):
        a, b, end = first, last, np.where(way > 0, off[1:][doc] - 1, base)
        step = 1
        while len(a):
            at = b + step if way > 0 else a - step
            inside = at <= end if way > 0 else at >= end
            a, b, end, at = a[inside], b[inside], end[inside], at[inside]
            near = (words[at + 1] - words[b + 1] if way > 0 else words[a] - words[at]) < guarantee
            a, b, end, at = a[near], b[near], end[near], at[near]
            full = w[at] > 0
            lo.append(a[full] if way > 0 else at[full])
            hi.append(at[full] if way > 0 else b[full])
            step += 1
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    pairs = np.unique(np.stack([lo, hi], axis=1), axis=0) if len(lo) else np.empty((0, 2), np.int64)
    lo, hi = pairs[:, 0], pairs[:, 1]
    doc = np.searchsorted(off, lo, side="right") - 1
    return _run_keys(h, lo, hi + 1), doc, lo - off[doc], hi - off[doc]


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """id, th (xxhash64 of the text) and the merged runs of lines to delete; checkpointed.

    Every fingerprint and each of its extensions is joined with the earliest place
    of its content, so a passage in any number of texts costs a row a text.
    """

    def run(batch: pa.RecordBatch) -> dict:
        h, w = batch.column(2), batch.column(3)
        off = np.asarray(h.offsets).astype(np.int64)
        hv = np.asarray(h.values)[off[0] : off[-1]]
        wv = np.asarray(w.values)[w.offsets[0].as_py() : w.offsets[-1].as_py()]
        key, doc, s, e = ranges(hv, wv, off - off[0], noise, guarantee)
        at = pa.array(doc)
        return {"g": pa.array(key), "id": batch.column(0).take(at), "th": batch.column(1).take(at), "s": pa.array(s, pa.int32()), "e": pa.array(e, pa.int32())}

    prints = stored(arrow_map(_line_hashes(docs, id_col, text_col), run, "g long, id long, th long, s int, e int"), "prints", "lz4")
    firsts = prints.groupBy("g").agg(F.min(F.struct("id", "th", "s")).alias("f"), F.count("*").alias("c")).where("c > 1").select("g", "f")
    later = prints.join(firsts, "g").where(F.struct("id", "th", "s") > F.col("f"))
    merged = F.aggregate(
        F.sort_array(F.collect_set(F.struct("s", "e"))),
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, r: F.when((F.size(acc) > 0) & (r["s"] <= F.element_at(acc, -1)["e"] + 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], r["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(r))),
    )
    dead = cut(later.groupBy("id", "th").agg(merged.alias("runs")))
    discard(prints)
    return dead


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, noise: int = NOISE, guarantee: int = GUARANTEE, removed_col: str = "lines_removed", inside_lines: bool = False) -> DataFrame:
    """``docs`` with later repeated runs deleted from its text, and ``removed_col``.

    With ``inside_lines`` what remains is then searched for passages of at least
    ``guarantee`` words that begin or end within lines (see ``passages``); they
    do not count in ``removed_col``.

    Rows with a null id or text are left as they are (0 removed) and are no
    source of repeats: they have no place in the order.  Rows that share an id
    but not the text are documents of their own; rows that agree in both are one
    and change alike.  Empty texts, runs under ``guarantee`` words and blank lines at the ends of
    a run may stay.
    A text may become empty.  Other columns are passed on, whatever their names;
    an existing ``removed_col`` is replaced.  An empty table gives an empty table.
    """
    if not inside_lines:
        return _without_lines(docs, id_col, text_col, noise, guarantee, removed_col)
    # the text without repeated lines is stored, as passages are searched in it more than once
    whole = stored(_without_lines(docs, id_col, text_col, noise, guarantee, removed_col), "lines")
    release(docs.sparkSession)
    return cut_passages(whole, id_col, text_col, noise, guarantee)


def _without_lines(docs: DataFrame, id_col: str, text_col: str, noise: int, guarantee: int, removed_col: str) -> DataFrame:
    dead = repeated_runs(docs, id_col, text_col, noise=noise, guarantee=guarantee)
    release(docs.sparkSession)
    i, t, r = fresh(docs, "dead_id"), fresh(docs, "dead_text"), fresh(docs, "dead_runs")
    text = F.col(f"`{text_col}`")
    joined = docs.join(dead.select(F.col("id").alias(i), F.col("th").alias(t), F.col("runs").alias(r)), (F.col(f"`{id_col}`") == F.col(i)) & (F.xxhash64(text) == F.col(t)), "left")
    kept = F.filter(F.split(text, "\n"), lambda _, k: ~F.exists(F.col(r), lambda x: (k >= x["s"]) & (k <= x["e"])))
    gone = F.aggregate(F.col(r), F.lit(0), lambda n, x: n + x["e"] - x["s"] + 1)
    named = {text_col: F.when(F.col(r).isNotNull(), F.array_join(kept, "\n")).otherwise(text), removed_col: F.coalesce(gone, F.lit(0))}
    others = [c for c in docs.columns if c.lower() != removed_col.lower()]
    return joined.select(*[named[c].alias(c) if c == text_col else F.col(f"`{c}`") for c in others], named[removed_col].alias(removed_col))
