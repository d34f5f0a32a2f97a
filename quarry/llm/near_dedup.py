"""Operator 10: MinHash near-duplicate detection by a containment ensemble.

A document is a near duplicate of a *superior* one (more shingles, or as many
and a smaller id) of any size if at least ``threshold`` of its k-word shingles
occur there.

* Documents with equal sets collapse first, so copies cost one row each.
* Documents are partitioned by the size of their shingle set, at powers of
  ``ratio``; a document looks in the tables of its own partition and the next.
  For each partition, containment at its size bounds converts to the least
  Jaccard similarity that a wanted pair can have, and bands and rows are tuned
  for that similarity (``recall`` at the least, far more for closer pairs).
* Inside a bucket a 128-bit sketch drops what is unlike and each document meets
  its likeliest superior, so a group of thousands of copies costs a pair a
  member, and no bucket is capped.  A sketch of 64 bytes then spares most of the
  pairs that bands alone brought together the exact check.
* Whoever is still alone looks among the whole sets of all others.  In far larger
  sets the Jaccard similarity of a wanted pair falls towards 0 and no banding
  finds it, but each shingle of the smaller set is still in the larger with the
  containment's probability.  So the ``PROBES`` least shingles of the smaller set
  are looked up in an inverted index.  A wanted pair shares so many of them
  (``least_hits``) that it shares some of the rarest; only those are joined, so a
  passage that all documents share costs nothing.  This also finds what the bands
  or the sketches missed.

The index is exchanged as packed arrays by ranges of the shingles' hashes, four
to five bytes a shingle, so this step has one scan and no broadcast at any size.
Containment is always computed from the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, discard, fresh, release, slices, small_side, stored
from .textkit import Words, mix, reduce_by, shingles

K, THRESHOLD, RATIO, RECALL, HASHES = 5, 0.6, 1.5, 0.92, 72
_BITS, _BYTES = 128, 64
PROBES, MISS, COMMON = 32, 0.001, 3
#: Shingles of a range of the index, and those that a task packs at a time.
RANGE_ITEMS, _FLUSH = 4_000_000, 1_000_000
#: Rows of a bucket that one task walks through; larger buckets are split, and their leaders meet afterwards.
BUCKET_ROWS, _SAMPLE = 100_000, 64


def least_jaccard(threshold: float, low: int, high: int, ratio: float) -> float:
    """Jaccard similarity of a pair at the containment threshold, sizes ``low..high``."""
    r = max(1.0, min(ratio, high / max(1, low)))
    return threshold / (r + 1 - threshold)


def tune(s: float, recall: float, hashes: int) -> tuple[int, int]:
    """Bands and rows with the most rows that still find ``s`` with ``recall``."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - s**rows))
        if bands * rows <= hashes:
            return bands, rows
    return hashes, 1


def partition_of(n: np.ndarray, ratio: float) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(ratio) + 1e-9).astype(np.int64)


def bounds_of(p: int, ratio: float) -> tuple[int, int]:
    """Set sizes of partition ``p`` (inclusive)."""
    return math.ceil(ratio**p - 1e-6), max(math.ceil(ratio ** (p + 1) - 1e-6) - 1, math.ceil(ratio**p - 1e-6))


def plan_of(p: int, threshold: float, ratio: float, recall: float, hashes: int) -> tuple[int, int]:
    """Bands and rows of the table of partition ``p``: its own pairs and those
    with the next smaller partition."""
    low = bounds_of(max(p - 1, 0), ratio)[0]
    return tune(least_jaccard(threshold, low, bounds_of(p, ratio)[1], ratio), recall, hashes)


def _unique_sets(sh: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles by document."""
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.argsort(sh)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(n) < 65536 else doc[order], kind="stable")]
    s = sh[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    counts = np.bincount(doc[new], minlength=len(n))
    return s[new], np.concatenate([[0], np.cumsum(counts)])


def _least_by_bin(sh: np.ndarray, off: np.ndarray, bins: int, salt: int) -> np.ndarray:
    """The least hash in each of ``bins`` classes of a document's shingles, empty classes borrowing from the next."""
    d = len(off) - 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    bits = bins.bit_length() - 1
    out = np.full(d * bins, full)
    h = mix(sh ^ np.uint64(salt))
    doc = np.repeat(np.arange(d), np.diff(off))
    np.minimum.at(out, doc * bins + (h >> np.uint64(64 - bits)).astype(np.int64), h & np.uint64((1 << (64 - bits)) - 1))
    out = out.reshape(d, bins)
    for _ in range(2):
        for j in range(bins - 1, -1, -1):
            col, nxt = out[:, j], out[:, (j + 1) % bins]
            np.copyto(col, nxt, where=col == full)
    return mix(out + np.arange(bins, dtype=np.uint64))


def _sketch(sh: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words by document: one-bit min-hashes of 128 bins."""
    bit = (_least_by_bin(sh, off, _BITS, 0x5851F42D4C957F2D) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bit, axis=1).view(np.int64)
    return packed[:, 0], packed[:, 1]


def _long_sketch(sh: np.ndarray, off: np.ndarray) -> pa.Array:
    """One-byte min-hashes of 64 bins by document."""
    rows = (_least_by_bin(sh, off, _BYTES, 0x14057B7EF767814F) & np.uint64(255)).astype(np.uint8)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _signatures(docs: DataFrame, k: int, threshold: float, ratio: float, recall: float, hashes: int) -> DataFrame:
    """One narrow row a document: id, set size, hash of the set, sketches, band keys, the least shingles."""
    rng = np.random.default_rng(20)
    mult = rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plans = {p: plan_of(p, threshold, ratio, recall, hashes) for p in range(0, 120)}
    rows_used = sorted({r for _, r in plans.values()})

    def run(batch: pa.RecordBatch) -> dict:
        sh, off = shingles(Words(batch.column(1)), k)
        sh, off = _unique_sets(sh, off)
        n = np.diff(off)
        with np.errstate(over="ignore"):
            set_hash = reduce_by(np.add, mix(sh + np.uint64(11)), off, np.uint64(0))
        a, b = _sketch(sh, off)
        part = partition_of(n, ratio)
        need = max([plans[int(x)][0] * plans[int(x)][1] for q in np.unique(part[n > 0]) for x in (q, q + 1)], default=0)
        sig = np.empty((len(n), need), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(need):
                v = sh * mult[j]
                sig[:, j] = reduce_by(np.minimum, v ^ (v >> np.uint64(29)), off, np.uint64(0))
        keys: list = [None] * len(n)
        banded = {}
        with np.errstate(over="ignore"):
            for r in rows_used:
                if need >= r:
                    c = need // r
                    acc = np.zeros((len(n), c), dtype=np.uint64)
                    for i in range(r):
                        acc = mix(acc * np.uint64(31) + sig[:, i : c * r : r])
                    banded[r] = acc + np.arange(c, dtype=np.uint64)
            for d in np.flatnonzero(n > 0):
                p = int(part[d])
                both = []
                for table in (p, p + 1):
                    bands, r = plans[table]
                    both.append(mix(banded[r][d, :bands] + np.uint64(table * 1_000_003)))
                keys[d] = np.concatenate(both).view(np.int64)
        least = sh[np.arange(len(sh)) - np.repeat(off[:-1], n) < PROBES].view(np.int64)
        probes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(n, PROBES))]), pa.int32()), pa.array(least))
        return {"id": batch.column(0), "n": pa.array(n, pa.int32()), "sh": pa.array(set_hash.view(np.int64)), "a": pa.array(a), "b": pa.array(b), "long": _long_sketch(sh, off), "keys": pa.array(keys, pa.list_(pa.int64())), "probes": probes}

    return arrow_map(docs, run, "id long, n int, sh long, a long, b long, long binary, keys array<long>, probes array<long>", 1)


def _agree(a: np.ndarray, b: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    differ = np.bitwise_count((a[i] ^ a[js]).view(np.uint64)).astype(np.int64)  # signed words would count their magnitude
    return _BITS - differ - np.bitwise_count((b[i] ^ b[js]).view(np.uint64))


def _possible(n: np.ndarray, i: int, js: np.ndarray, agree: np.ndarray, threshold: float, ratio: float) -> np.ndarray:
    """Superiors within the ratio whose sketch does not rule the threshold out (2.6 deviations)."""
    r = n[js] / n[i]
    p = (1 + threshold / (r + 1 - threshold)) / 2
    return (r <= ratio) & (agree >= _BITS * p - 2.6 * np.sqrt(_BITS * p * (1 - p)))


def _bucket_pairs(keyed: DataFrame, threshold: float, ratio: float, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Candidate (x, superior y) pairs.  Rows: key, id, n, a, b.  A document meets
    the likeliest of its bucket's leaders, which are those that met none.

    Keys that a sample shows in far more than ``bucket_rows`` rows are split by
    id; the leaders of the splits, which are few, then meet in turn.
    """
    seen = keyed.where(F.pmod(F.xxhash64("id"), F.lit(_SAMPLE)) == 0).groupBy("key").count()
    hot = cut(seen.where(F.col("count") * _SAMPLE > 2 * bucket_rows).select("key", F.ceil(F.col("count") * _SAMPLE / bucket_rows).cast("int").alias("splits")))
    if not hot.take(1):
        return _leaders(keyed.withColumn("splits", F.lit(None).cast("int")), threshold, ratio).select("x", "y").distinct()
    split = keyed.join(small_side(hot, 24), "key", "left").withColumn("old", F.col("key")).withColumn("key", F.when(F.col("splits").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("id", F.lit(1)), F.col("splits")))))
    met = cut(_leaders(split, threshold, ratio))
    again = met.where("y is null").select(F.col("old").alias("key"), F.col("x").alias("id")).join(keyed, ["key", "id"]).withColumn("splits", F.lit(None).cast("int"))
    return met.where("y is not null").select("x", "y").unionByName(_leaders(again, threshold, ratio).select("x", "y")).distinct()


def _leaders(keyed: DataFrame, threshold: float, ratio: float) -> DataFrame:
    """x, superior y in each bucket; and for splits (not null) the leaders with a null y and the key of old.
    Sorted by key in each partition, so that a bucket is a run of rows."""
    if "old" not in keyed.columns:
        keyed = keyed.withColumn("old", F.lit(None).cast("long"))

    def pairs(t: dict[str, np.ndarray], lo: int, hi: int, xs: list, ys: list) -> np.ndarray:
        ids, n, a, b = (t[c][lo:hi] for c in ("id", "n", "a", "b"))
        leaders = np.zeros(hi - lo, dtype=np.int64)
        m = 0
        for i in range(hi - lo):
            js = leaders[:m]
            if m:
                agree = _agree(a, b, i, js)
                ok = _possible(n, i, js, agree, threshold, ratio)
                if ok.any():
                    xs.append(ids[i])
                    ys.append(ids[js[int(np.argmax(np.where(ok, agree, -1)))]])
                    continue
            leaders[m] = i
            m += 1
        return ids[leaders[:m]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(tab: pa.Table) -> pa.RecordBatch:
            t = {c: tab.column(c).to_numpy() for c in ("key", "id", "n", "a", "b")}
            parts, old = tab.column("splits").is_valid().to_numpy(), tab.column("old")
            edge = np.flatnonzero(np.concatenate([[True], t["key"][1:] != t["key"][:-1], [True]]))
            xs: list = []
            ys: list = []
            lead: list = []
            keys: list = []
            for g in np.flatnonzero((np.diff(edge) > 1) | parts[edge[:-1]]):
                first = pairs(t, edge[g], edge[g + 1], xs, ys)
                if parts[edge[g]]:
                    lead += first.tolist()
                    keys += [old[int(edge[g])].as_py()] * len(first)
            return pa.RecordBatch.from_pydict({"x": pa.array([*xs, *lead], pa.int64()), "y": pa.array([*ys, *[None] * len(lead)], pa.int64()), "old": pa.array([*[None] * len(xs), *keys], pa.int64())})

        for batch in batches:
            tab = pa.Table.from_batches([batch])
            if held is not None and held.num_rows:
                tab = pa.concat_tables([held, tab])
            if tab.num_rows == 0:
                continue
            key = tab.column("key").to_numpy()
            cut_at = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            held = tab.slice(cut_at)
            if cut_at:
                yield emit(tab.slice(0, cut_at))
        if held is not None and held.num_rows:
            yield emit(held)

    ordered = keyed.select("key", "id", "n", "a", "b", "splits", "old").repartition("key").sortWithinPartitions("key", F.desc("n"), "id")
    return ordered.mapInArrow(run, "x long, y long, old long")


def _verify(texts: DataFrame, pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs whose exact containment reaches the threshold, with it.

    Texts go to the superior's partition, its own first, so that each partition
    holds one superior's set at a time.
    """
    sent = pairs.select(F.col("x").alias("id"), F.col("y").alias("to"), F.lit(1).alias("part")).union(pairs.select(F.col("y").alias("id"), F.col("y").alias("to"), F.lit(0).alias("part")).distinct())
    routed = texts.join(sent, "id").select("to", "part", "id", "text").repartition("to").sortWithinPartitions("to", "part", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, sets = None, []
        for batch in batches:
            for piece in slices(batch, 3):
                sh, off = shingles(Words(piece.column(3)), k)
                out: dict[str, list] = {"x": [], "y": [], "containment": []}
                for r, (to, part, x) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist())):
                    if to != leader:
                        leader, sets = to, []
                    own = np.unique(sh[off[r] : off[r + 1]])
                    if part == 0:
                        sets.append(own)
                    elif len(own):
                        c = 0.0
                        for s in sets:
                            if len(s):
                                c = max(c, float((s[np.minimum(np.searchsorted(s, own), len(s) - 1)] == own).sum()) / len(own))
                        if c >= threshold:
                            out["x"].append(x)
                            out["y"].append(to)
                            out["containment"].append(c)
                yield pa.RecordBatch.from_pydict({"x": pa.array(out["x"], pa.int64()), "y": pa.array(out["y"], pa.int64()), "containment": pa.array(out["containment"], pa.float64())})

    return routed.mapInArrow(run, "x long, y long, containment double")


def least_hits(n: int, threshold: float) -> int:
    """Probes of a set of ``n`` that a superior holds at least, but for ``MISS`` of the pairs at the threshold."""
    if n <= PROBES:
        return max(1, math.ceil(threshold * n - 1e-9))
    below = 0.0
    for k in range(PROBES + 1):
        below += math.comb(PROBES, k) * threshold**k * (1 - threshold) ** (PROBES - k)
        if below > MISS:
            return max(1, k)
    return PROBES


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float, ratio: float) -> DataFrame:
    """Pairs whose long sketches do not rule the threshold out (3.3 deviations); short sets always pass."""

    @F.arrow_udf("boolean")
    def possible(x: pa.Array, y: pa.Array, nx: pa.Array, ny: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, _BYTES) for v in (x, y))
        n, m = nx.to_numpy(zero_copy_only=False), ny.to_numpy(zero_copy_only=False)
        j = threshold / (np.minimum(ratio, m / n) + 1 - threshold)
        return pa.array((n < _BYTES) | ((a == b).sum(axis=1) >= _BYTES * j - 3.3 * np.sqrt(_BYTES * j * (1 - j))))

    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("long").alias(f"l{c}"))
    return pairs.join(side("x"), "x").join(side("y"), "y").where(possible("lx", "ly", "nx", "ny")).select("x", "y")


def _ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, by its leading 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _packed(df: DataFrame, items, ranges: int, kind: int, column: int | None) -> DataFrame:
    """range, kind, keys, ids, runs: ``items(batch) -> (keys, ids)`` packed by range, many rows of ``df`` at a time.

    Within a range 32 bits of a hash tell shingles apart: with ``RANGE_ITEMS`` in
    it one in 1,000 meets another by chance, which is one hit of the many that a
    pair needs, and pairs are checked from their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, ids = (np.concatenate(v) for v in zip(*held))
            held.clear()
            at = _ranges_of(keys, ranges)
            order = np.argsort(at.astype(np.uint16) if ranges < 65536 else at, kind="stable")
            keys, ids, at = keys[order].astype(np.uint32), ids[order], at[order]
            edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            out: dict[str, list] = {"keys": [], "ids": [], "runs": []}
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own = ids[a:b]  # a document's shingles follow each other
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                for name, v in (("keys", keys[a:b]), ("ids", own[first]), ("runs", np.diff(np.append(first, b - a)).astype(np.uint32))):
                    out[name].append(v.tobytes())
            return pa.RecordBatch.from_pydict({"range": pa.array(at[edge[:-1]], pa.int32()), "kind": pa.array([kind] * (len(edge) - 1), pa.int32()), **{c: pa.array(v, pa.binary()) for c, v in out.items()}})

        size = 0
        for batch in batches:
            for piece in slices(batch, column) if column is not None else [batch]:
                got = items(piece)
                if len(got[0]):
                    held.append(got)
                    size += len(got[0])
                if size >= _FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return df.mapInArrow(run, "range int, kind int, keys binary, ids binary, runs binary")


def _unpack(keys, ids, runs) -> tuple[np.ndarray, np.ndarray]:
    k, i, r = (np.frombuffer(v, t) for v, t in ((keys, np.uint32), (ids, np.int64), (runs, np.uint32)))
    return k, np.repeat(i, r)


def _met(texts: DataFrame, probes: DataFrame, ranges: int, k: int) -> DataFrame:
    """key, id, df: for ``probes`` (id, probes) each probe that several texts hold and
    their number; and, with a null df, each text (id) that holds such a key."""

    def of_texts(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        sh, off = _unique_sets(*shingles(Words(piece.column(1)), k))
        return sh, np.repeat(piece.column(0).to_numpy(), np.diff(off))

    def of_probes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(1)
        return lists.flatten().to_numpy().view(np.uint64), np.repeat(batch.column(0).to_numpy(), np.diff(np.asarray(lists.offsets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, keys, hits = -1, [], None, []

        def ended() -> Iterator[pa.RecordBatch]:
            if not hits:
                return
            at, ids = (np.concatenate(v) for v in zip(*hits))
            df = np.bincount(at, minlength=len(keys))
            own, who = (np.concatenate(v) for v in zip(*asked))
            place = np.searchsorted(keys, own)
            asks, holds = df[place] > 1, df[at] > 1
            high = np.uint64(now) << np.uint64(32)  # with the range a key is one of the whole index
            out = [(own[asks], who[asks], df[place[asks]]), (keys[at[holds]], ids[holds], None)]
            for key, who, n in out:
                for a in range(0, len(key), 1 << 17):
                    b = a + (1 << 17)
                    yield pa.RecordBatch.from_pydict({"key": pa.array((key[a:b].astype(np.uint64) | high).view(np.int64)), "id": pa.array(who[a:b]), "df": pa.array(n[a:b], pa.int64()) if n is not None else pa.nulls(len(key[a:b]), pa.int64())})

        for batch in batches:
            for i, (r, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if r != now:
                    yield from ended()
                    now, asked, keys, hits = r, [], None, []
                own, ids = _unpack(*(batch.column(c)[i].as_buffer() for c in (2, 3, 4)))
                if kind == 0:
                    asked.append((own, ids))
                elif asked:
                    if keys is None:
                        keys = np.unique(np.concatenate([a for a, _ in asked]))
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    live = keys[at] == own
                    hits.append((at[live].astype(np.int32), ids[live]))
        yield from ended()

    both = _packed(probes, of_probes, ranges, 0, None).unionByName(_packed(texts, of_texts, ranges, 1, 1))
    return both.repartition("range").sortWithinPartitions("range", "kind").mapInArrow(run, "key long, id long, df long")


def _larger_pairs(texts: DataFrame, sets: DataFrame, alone: DataFrame, k: int, threshold: float) -> DataFrame:
    """(x, superior y) of any sizes, for the sets ``alone`` (rep, n, probes; a part of ``sets``)."""
    total = texts.sparkSession.sparkContext.defaultParallelism, sets.agg(F.sum(F.col("n").cast("long") * F.col("copies"))).first()[0] or 0
    ranges = max(total[0], math.ceil(total[1] / RANGE_ITEMS))
    met = cut(_met(texts, alone.select(F.col("rep").alias("id"), "probes"), ranges, k))
    m = F.least(F.col("nx"), F.lit(PROBES))
    need = F.element_at(F.array(*[F.lit(least_hits(i, threshold)) for i in range(1, PROBES + 2)]), F.least(F.col("nx"), F.lit(PROBES + 1)))
    asked = met.where("df is not null").join(alone.select(F.col("rep").alias("id"), F.col("n").alias("nx")), "id")
    by_set = asked.groupBy(F.col("id").alias("x"), "nx").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("p")).withColumn("common", F.least(F.lit(COMMON), need))
    # of a wanted pair's hits all but need - common can be among the probes left out; those that one text holds come first
    ask = by_set.select("x", "nx", "common", F.explode(F.slice("p", 1, F.greatest(F.lit(0), F.size("p") - need + F.col("common")))["key"]).alias("key"))
    held = met.where("df is null").select("key", F.col("id").alias("y")).distinct()
    shared = ask.join(held, "key").where("x <> y").groupBy("x", "nx", "common", "y").agg(F.count("*").alias("hits")).where("hits >= common")
    sized = shared.join(sets.select(F.col("rep").alias("y"), F.col("n").alias("ny")), "y")
    superior = (F.col("ny") > F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    return cut(sized.where(superior).select("x", "y"))


def _alone(rows: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` has no superior yet."""
    return rows.join(edges.select(F.col("x").alias(column)).distinct(), column, "left_anti")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, threshold: float = THRESHOLD, ratio: float = RATIO, recall: float = RECALL, hashes: int = HASHES
) -> DataFrame:
    """Near-duplicate groups: ``doc_id, group_id, container_id, containment, n_shingles, keep``, a row an id.

    ``container_id`` is a superior document that contains this one (null if none
    does), ``group_id`` the kept document at the end of that chain, ``keep``
    whether it is the document itself; so one document of each group is kept.
    Exact copies have containment 1 in the smallest id of the copies.

    Null and empty texts, and texts without words, have no shingles: they are
    kept, alone in their group.  Rows with a null id cannot be named and are
    left out.  Rows that share an id share its verdict: the largest of their
    sets stands for the id.  Other columns, whatever their names, are ignored.
    An empty table gives an empty table.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")
    raw = stored(_signatures(texts, k, threshold, ratio, recall, hashes), "signatures", "lz4")
    sig = cut(raw.where("n > 0").groupBy("id").agg(F.max(F.struct("n", "sh")).alias("s")).select("id", "s.*"))
    sets = cut(sig.groupBy("n", "sh").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))

    def of_sets(*columns: str) -> DataFrame:
        """Columns of the signatures, a row a set."""
        named = sets.select(F.col("rep").alias("id"), "n", "sh")
        return raw.select("id", "n", "sh", *columns).join(named, ["id", "n", "sh"]).dropDuplicates(["id", "n", "sh"]).drop("sh")

    keyed = of_sets("keys", "a", "b").select(F.explode("keys").alias("key"), "id", "n", "a", "b")
    likely = cut(_alike(_bucket_pairs(keyed, threshold, ratio), of_sets("long"), threshold, ratio))
    del keyed
    release(docs.sparkSession)
    edges = cut(_verify(texts, likely, k, threshold))
    release(docs.sparkSession)
    # those that are still alone look among all larger sets
    alone = cut(_alone(of_sets("probes").select(F.col("id").alias("rep"), "n", "probes"), edges, "rep"))
    discard(raw)
    larger = _larger_pairs(texts, sets, alone, k, threshold)
    release(docs.sparkSession)
    edges = cut(edges.unionByName(_verify(texts, larger, k, threshold)))
    release(docs.sparkSession)
    up = edges.groupBy("x").agg(F.max(F.struct("containment", (-F.col("y")).alias("o"))).alias("m")).select(F.col("x").alias("id"), (-F.col("m.o")).alias("up"), F.col("m.containment").alias("containment"))
    link = cut(up)
    root = link.select("id", F.col("up").alias("root"))
    while True:  # pointer jumping: as many rounds as the logarithm of the longest chain
        hop = root.select(F.col("id").alias("root"), F.col("root").alias("next"))
        stepped = cut(root.join(hop, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        root = stepped.select("id", "root")
        if not stepped.where("moved").take(1):
            break
    reps = sets.select(F.col("rep").alias("id"), "n", "sh").join(link, "id", "left").join(root, "id", "left").select(F.col("id").alias("rep"), "n", "sh", "up", "containment", F.coalesce("root", "id").alias("root"))
    named = sig.select("id", "n", "sh").join(reps, ["n", "sh"]).select(
        F.col("id").alias("doc_id"),
        F.col("root").alias("group_id"),
        F.when(F.col("id") == F.col("rep"), F.col("up")).otherwise(F.col("rep")).alias("container_id"),
        F.when(F.col("id") == F.col("rep"), F.col("containment")).otherwise(F.lit(1.0)).alias("containment"),
        F.col("n").alias("n_shingles"),
        (F.col("id") == F.col("root")).alias("keep"),
    )
    alone = texts.select("id").distinct().join(sig.select("id"), "id", "left_anti").select(
        F.col("id").alias("doc_id"), F.col("id").alias("group_id"), F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("double").alias("containment"), F.lit(0).alias("n_shingles"), F.lit(True).alias("keep")
    )
    return named.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is kept, in the columns of ``docs``.

    Rows with a null id stay.  Of rows that share an id, one stays for each
    distinct text.
    """
    verdict = near_duplicates(docs, id_col, text_col, **options).where(~F.col("keep"))
    c = fresh(docs, "gone_id")
    out = docs.join(small_side(cut(verdict.select(F.col("doc_id").alias(c))), 16), F.col(f"`{id_col}`") == F.col(c), "left_anti")
    repeated = cut(docs.groupBy(F.col(f"`{id_col}`").alias(c)).count().where("count > 1").where(F.col(c).isNotNull()).select(c))
    if not repeated.take(1):
        return out
    once = out.join(repeated, F.col(f"`{id_col}`") == F.col(c), "left_anti")
    return once.unionByName(out.join(repeated, F.col(f"`{id_col}`") == F.col(c), "left_semi").dropDuplicates([id_col, text_col]))
