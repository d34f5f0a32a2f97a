"""Operator 2: benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all passages of all texts give the
   inverse document frequencies.
2. A randomised singular value decomposition of the TF-IDF matrix of all
   passages, with one power iteration: tasks multiply their rows by a test matrix
   and back, the sums are added up in a tree of partitions, and a small
   factorisation on the driver yields the leading right singular vectors.  The
   matrix is never stored.
3. Texts are cut into overlapping passages, projected, and compared by cosine
   with the projected benchmark items, long ones cut into parts no longer than a
   passage (parts of up to 30 words are held against passages of 24 words, others
   against passages of 48): that finds candidates.  Those that hold too little of the part's
   squared idf to be a paraphrase go at once.
4. A candidate is a leak if the longest common subsequence of the item's words
   and the passage's surroundings covers enough of the item and of its answer
   (its last sentence).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices
from .textkit import Words

BITS, RANK, OVER, SEED = 14, 64, 8, 7
PASSAGE, BLOCK = 48, 12
COSINE, MASS, LCS, ANSWER, MIN_WORDS = 0.45, 0.3, 0.6, 0.5, 6
_CHUNKS, _FAN_IN = 16, 16


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.uint16)


def _grid(off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive passages of ``size`` words: index of each word in a padded
    grid (words of a text start a new row), and the first row of each text."""
    n = np.diff(off)
    rows = -(-n // size)
    first = np.concatenate([[0], np.cumsum(rows)])
    shift = np.repeat(first[:-1] * size - off[:-1], n)
    return np.arange(int(off[-1]) - int(off[0])) + int(off[0]) + shift, first


def _padded(slots: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at, first = _grid(off, size)
    out = np.full(int(first[-1]) * size, 1 << BITS, dtype=np.int32)
    out[at] = slots
    return out.reshape(-1, size), first


def _row_sums(table: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each row of the grid, place by place."""
    out = np.zeros((len(grid), table.shape[1]), dtype=np.float32)
    for a in range(0, len(grid), 1024):
        columns = np.ascontiguousarray(grid[a : a + 1024].T)
        part = out[a : a + 1024]
        buf = np.empty_like(part)
        for c in columns:
            np.take(table, c, axis=0, out=buf, mode="clip")
            part += buf
    return out


def _scatter_rows(z: np.ndarray, s: np.ndarray, y: np.ndarray, rows: np.ndarray, often: int = 24) -> None:
    """``z[s] += y[rows]`` for sorted ``s``: frequent slots by sums, others rank by rank."""
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    count = np.diff(np.append(edge, len(s)))
    for a, c in zip(edge[count > often], count[count > often]):
        z[s[a]] += y[rows[a : a + c]].sum(axis=0)
    edge, count = edge[count <= often], count[count <= often]
    for rank in range(int(count.max()) if len(count) else 0):
        at = edge[count > rank] + rank
        z[s[at]] += y[rows[at]]


def _sum_tables(parts: DataFrame, tasks: int, dtype: str) -> dict[int, np.ndarray]:
    """Add up binary arrays by ``chunk`` in a tree where a task reads at most
    ``_FAN_IN`` arrays of one chunk; one array a chunk comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for c, t, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(b.as_buffer(), dtype=dtype).astype(np.float64)
                at = (c, t // _FAN_IN)
                total[at] = total[at] + x if at in total else x
        if total:
            chunk, task = zip(*total)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk, pa.int32()), "task": pa.array(task, pa.int32()), "data": pa.array([v.astype(dtype).tobytes() for v in total.values()], pa.binary())})

    level = parts
    while True:
        groups = max(1, -(-tasks // _FAN_IN))
        level = level.repartition(_CHUNKS * groups, "chunk", F.floor(F.col("task") / _FAN_IN)).mapInArrow(add, "chunk int, task int, data binary")
        if groups <= 1:
            break
        tasks = groups
    out: dict[int, np.ndarray] = {}
    for r in level.collect():
        x = np.frombuffer(r["data"], dtype=dtype).astype(np.float64)
        out[r["chunk"]] = out[r["chunk"]] + x if r["chunk"] in out else x
    return out


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column, 512 << 10)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold each slot's words, and the number of passages, over all texts."""
    v = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(v + 1, dtype=np.int64)
        for piece in _pieces(batches, 0):
            words = Words(piece.column(0))
            slots = _slots(words.hashes)
            at, first = _grid(words.off, PASSAGE)
            order = np.argsort(slots, kind="stable")
            s, p = slots[order], (at // PASSAGE)[order]
            new = np.ones(len(s), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1])
            df[:v] += np.bincount(s[new], minlength=v)
            df[v] += first[-1]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([0], pa.int32()), "task": pa.array([TaskContext.get().partitionId()], pa.int32()), "data": pa.array([df.tobytes()], pa.binary())})

    total = _sum_tables(texts.mapInArrow(run, "chunk int, task int, data binary"), texts.rdd.getNumPartitions(), "int64").get(0)
    return (total[:v], int(total[v])) if total is not None else (np.zeros(v), 0)


def random_matrix(size: int = RANK + OVER, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((1 << BITS, size)).astype(np.float32)


def _normal_product(texts: DataFrame, idf: np.ndarray, matrix: np.ndarray | None) -> np.ndarray | None:
    """A'(A W) of the TF-IDF matrix A of all passages, for ``matrix`` or the random
    one; None without passages."""
    v, k = 1 << BITS, RANK + OVER
    sent = None if matrix is None else texts.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = random_matrix(k) if sent is None else sent.value
        w = np.vstack([w * idf[:, None].astype(np.float32), np.zeros((1, k), np.float32)])
        weight = np.append(idf, 0.0).astype(np.float32) ** 2
        z = np.zeros((v, k), dtype=np.float32)
        for piece in _pieces(batches, 0):
            words = Words(piece.column(0))
            grid, _ = _padded(_slots(words.hashes), words.off, PASSAGE)
            if not len(grid):
                continue
            y = _row_sums(w, grid)
            y /= np.maximum(weight[grid].sum(axis=1), 1e-6)[:, None]  # both norms: of the row here and in the product back
            flat = grid.ravel()
            real = np.flatnonzero(flat < v)
            s = flat[real].astype(np.uint16)
            order = np.argsort(s, kind="stable")
            s, rows = s[order], real[order] // PASSAGE
            _scatter_rows(z, s, y, rows)
        step = v // _CHUNKS
        yield pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array(range(_CHUNKS), pa.int32()),
                "task": pa.array([TaskContext.get().partitionId()] * _CHUNKS, pa.int32()),
                "data": pa.array([z[c * step : (c + 1) * step].tobytes() for c in range(_CHUNKS)], pa.binary()),
            }
        )

    got = _sum_tables(texts.mapInArrow(run, "chunk int, task int, data binary"), texts.rdd.getNumPartitions(), "float32")
    return np.vstack([got[c].reshape(-1, k) for c in range(_CHUNKS)]) * idf[:, None] if got else None


def singular_vectors(texts: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (slots x rank) and values of the TF-IDF matrix of all passages.

    A random W, one power iteration Q R = A'(A W), and the Nystroem factorisation
    of A'A from A'(A Q): two passes over the texts.
    """
    v = 1 << BITS
    z = _normal_product(texts, idf, None)
    if z is None or not np.linalg.norm(z):
        return np.zeros((v, RANK), np.float32), np.zeros(RANK)
    omega = np.linalg.qr(z)[0]
    z = _normal_product(texts, idf, omega)
    omega = omega.astype(np.float32).astype(np.float64)  # as the tasks had it
    shift = 1e-6 * np.linalg.norm(z) + 1e-12
    zs = z + shift * omega
    c = omega.T @ zs
    u, lam, _ = np.linalg.svd((c + c.T) / 2)
    b = zs @ (u / np.sqrt(np.maximum(lam, 1e-12 * lam.max())))
    left, sv, _ = np.linalg.svd(b, full_matrices=False)
    return left[:, :RANK].astype(np.float32), np.sqrt(np.maximum(sv[:RANK] ** 2 - shift, 0))


def lcs(masks: dict[int, int], words: list[int]) -> int:
    """Longest common subsequence of an item (bit masks of its words' places) and ``words``."""
    row = -1
    size = 0
    for m in masks.values():
        size |= m
    for x in words:
        m = masks.get(x)
        if m:
            u = row & m
            row = (row + u) | (row - u)
    return (~row & size).bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(words):
        out[x] = out.get(x, 0) | 1 << i
    return out


def answer_of(text: str) -> str:
    """The item's answer: its last sentence of at least three words, or all of it."""
    for part in reversed(re.split(r"[.!?\n]+", text)):
        if len(part.split()) >= 3:
            return part
    return text


def parts_of(m: int) -> np.ndarray:
    """Bounds of the equal parts, of a passage's words at most, of an item of ``m`` words.
    A text that holds some share of the item's words holds that share of one part at least."""
    return np.linspace(0, m, -(-m // PASSAGE) + 1).round().astype(np.int64)


class Items:
    """Benchmark items ready for the search: words and masks, and the latent vectors of their parts."""

    def __init__(self, rows: list[tuple[int, str]], table: np.ndarray, weight: np.ndarray):
        self.ids, self.masks, self.answers, self.size, vectors, slots, of, size = [], [], [], [], [], [], [], []
        for i, text in rows:
            w = Words(pa.array([text])).hashes
            if len(w) < MIN_WORDS:
                continue
            self.ids.append(i)
            self.size.append(len(w))
            self.masks.append(masks_of(w.tolist()))
            self.answers.append(masks_of(Words(pa.array([answer_of(text)])).hashes.tolist()))
            cuts = parts_of(len(w))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                vectors.append(table[_slots(w[lo:hi])].sum(axis=0))
                slots.append(np.unique(_slots(w[lo:hi])))
                of.append(len(self.ids) - 1)
                size.append(hi - lo)
        self.size = np.array(self.size, dtype=np.int64)
        #: item and words of each part
        self.of, self.part_size = (np.array(v, dtype=np.int64) for v in (of, size))
        x = np.array(vectors, dtype=np.float32).reshape(len(of), table.shape[1])
        self.vectors = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        #: shares of the part's squared idf by slot, in 255ths rounded up
        self.mass = np.zeros((len(of), len(table)), dtype=np.uint8)
        for j, own in enumerate(slots):
            share = weight[own] ** 2 / (weight[own] ** 2).sum()
            self.mass[j, own] = np.minimum(255, np.ceil(share * 255))
        self.answer_size = np.array([sum(m.bit_count() for m in a.values()) for a in self.answers], dtype=np.int64)


def check(items: Items, j: int, region: list[int]) -> tuple[float, float]:
    return lcs(items.masks[j], region) / int(items.size[j]), lcs(items.answers[j], region) / int(items.answer_size[j])


def is_leak(ratio: float, answer: float) -> bool:
    return ratio >= LCS and answer >= ANSWER


def search(words: Words, table: np.ndarray, items: Items, cosine: float = COSINE) -> tuple[list, list, list, list, list]:
    """Leaks in a batch: text, item, cosine, LCS ratio, answer ratio."""
    grid, first = _padded(_slots(words.hashes), words.off, BLOCK)
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    if not len(grid) or not items.ids:
        return out
    blocks = np.vstack([_row_sums(table, grid), np.zeros((PASSAGE // BLOCK, table.shape[1]), np.float32)])
    cells = np.vstack([grid, np.full((PASSAGE // BLOCK, BLOCK), 1 << BITS, dtype=grid.dtype)])
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    for size, mine in ((2, items.part_size <= 30), (PASSAGE // BLOCK, items.part_size > 30)):
        which = np.flatnonzero(mine)
        if not len(which):
            continue
        count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        begin = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        vectors = items.vectors[which].T
        for a in range(0, len(begin), 2048):
            at = begin[a : a + 2048]
            end = first[1:][doc[at]]  # a text shorter than a passage ends it
            x = blocks[at]
            for k in range(1, size):
                x += np.where((at + k < end)[:, None], blocks[at + k], np.float32(0))
            x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
            sim = x @ vectors
            rows, cols = np.divmod(np.flatnonzero(sim >= cosine), sim.shape[1])
            if not len(rows):
                continue
            mass = np.zeros(len(rows), dtype=np.int32)
            for k in range(size):
                live = at[rows] + k < end[rows]
                got = items.mass.take(which[cols][:, None] * items.mass.shape[1] + cells[at[rows] + k]).sum(axis=1, dtype=np.int32)
                mass += np.where(live, got, 0)
            near = np.flatnonzero(mass >= MASS * 255)
            for r, c in zip(rows[near].tolist(), cols[near].tolist()):
                part = int(which[c])
                j = int(items.of[part])
                d = int(doc[begin[a + r]])
                lo, hi = words.off[d], words.off[d + 1]
                place = lo + (begin[a + r] - first[d]) * BLOCK
                m = int(items.size[j])
                region = words.hashes[max(lo, place - m) : min(hi, place + size * BLOCK + m)].tolist()
                ratio = lcs(items.masks[j], region) / m
                if ratio < LCS:
                    continue
                ans = lcs(items.answers[j], region) / int(items.answer_size[j])
                if is_leak(ratio, ans):
                    for o, value in zip(out, (d, j, float(sim[r, c]), ratio, ans)):
                        o.append(value)
    return out


def latent_table(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights from slots to the latent space, with a zero row for padding, and the idf.

    A passage x goes to x V / S, its row of the left singular vectors, so that a
    few strong directions do not make all passages alike.
    """
    df, n = document_frequencies(texts)
    idf = np.log((n + 1) / (df + 1)) + 1
    vectors, values = singular_vectors(texts, idf)
    scale = np.where(values > 1e-6 * max(values.max(), 1e-9), 1 / np.maximum(values, 1e-9), 0.0)
    table = (vectors * idf[:, None] * scale).astype(np.float32)
    return np.vstack([table, np.zeros((1, table.shape[1]), np.float32)]), idf


def _ready_items(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> list[tuple[int, str]]:
    rows = benchmark.select(F.col(f"`{item_id_col}`").cast("long"), F.col(f"`{item_text_col}`")).dropna().distinct().collect()
    return sorted((r[0], r[1]) for r in rows)


def _portions(items: list[tuple[int, str]], at_once: int) -> list[list[tuple[int, str]]]:
    """Items in runs of at most ``at_once`` parts, or of one item."""
    out: list[list[tuple[int, str]]] = [[]]
    room = at_once
    for item in items:
        parts = max(1, -(-len(Words(pa.array([item[1]])).hashes) // PASSAGE))
        if out[-1] and parts > room:
            out.append([])
            room = at_once
        out[-1].append(item)
        room -= parts
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE, items_at_once: int = 2_000) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_ratio, answer_ratio``: each leaked pair, with its best passage.

    Items with fewer than six words, a null text or a null id are not searched;
    null and empty texts hold no leaks.  Rows with a null doc_id are reported
    under null, and rows that share an id together.  Items of equal text are
    reported each.  Other columns are ignored.  Empty tables give an empty table.
    Benchmarks of more than ``items_at_once`` items, or parts of long items, are
    searched in that many at a time, so what tasks are sent has a fixed size.
    """
    texts = docs.select(F.col(f"`{text_col}`").alias("t"))
    table, idf = latent_table(texts)
    items = _ready_items(benchmark, item_id_col, item_text_col)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    found = None
    for some in _portions(items, items_at_once):
        part = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            ready = Items(part.value, shared.value, idf)
            for piece in _pieces(batches, 1):
                d, j, cos, ratio, ans = search(Words(piece.column(1)), shared.value, ready, cosine)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": piece.column(0).take(pa.array(d, pa.int64())), "item_id": pa.array([ready.ids[x] for x in j], pa.int64()), "cosine": pa.array(cos, pa.float64()), "lcs_ratio": pa.array(ratio, pa.float64()), "answer_ratio": pa.array(ans, pa.float64())}
                )

        hits = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "doc_id long, item_id long, cosine double, lcs_ratio double, answer_ratio double")
        found = hits if found is None else found.union(hits)
    best = F.max(F.struct("lcs_ratio", "answer_ratio", "cosine")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.lcs_ratio", "b.answer_ratio")


def _clean(part, shared, idf: np.ndarray, cosine: float):
    """A column function: whether a text has no leak of the broadcast items."""
    ready: list[Items] = []

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Items(part.value, shared.value, idf))
        kept = []
        for piece in slices(pa.RecordBatch.from_arrays([texts], ["t"]), 0, 512 << 10):
            good = np.ones(piece.num_rows, dtype=bool)
            good[np.array(search(Words(piece.column(0)), shared.value, ready[0], cosine)[0], dtype=np.int64)] = False
            kept.append(good)
        return pa.array(np.concatenate(kept) if kept else np.empty(0, bool))

    return clean


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE, items_at_once: int = 2_000) -> DataFrame:
    """The rows of ``docs`` without a leak of any item, in the columns of ``docs``.

    Each row is judged by its own text, whatever its id; nothing is joined or
    moved.  The cases of ``find_leaks`` hold.
    """
    table, idf = latent_table(docs.select(F.col(f"`{text_col}`").alias("t")))
    items = _ready_items(benchmark, item_id_col, item_text_col)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(table)
    out, flag = docs, fresh(docs, "leak_free")
    for some in _portions(items, items_at_once) if items else []:
        clean = _clean(sc.broadcast(some), shared, idf, cosine).asNondeterministic()  # or the plan would push it into other filters and run it twice
        out = out.withColumn(flag, clean(F.col(f"`{text_col}`"))).where(F.col(flag)).drop(flag)
    return out
