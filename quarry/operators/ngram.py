"""A trigram table over lines, and candidate files for literals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import Need

N = 3


def trigrams(files: DataFrame) -> DataFrame:
    """``tri, file_no``: each distinct trigram of each file's lines.

    Made in Arrow batches: code points as numbers, three of which are a key, so a
    file's distinct trigrams are one sort of numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _keys(text)
                if len(own):
                    yield pa.RecordBatch.from_pydict({"tri": pa.array(_names(own), pa.string()), "file_no": pa.array(np.full(len(own), no, np.int64))})

    return _texts(files).mapInArrow(run, "tri string, file_no long")


def _texts(files: DataFrame) -> DataFrame:
    """``file_no, text``: the lines that are UTF-8, as one text."""
    valid = F.array_join(F.filter("lines", lambda x: F.is_valid_utf8(x)), "\n")
    return files.select("file_no", (F.when(F.is_valid_utf8("content"), F.col("content")).otherwise(valid) if "content" in files.columns else valid).alias("text"))


def _keys(text: str | None) -> np.ndarray:
    """The distinct trigrams of a text's lines, as sorted numbers."""
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(code) < N:
        return np.empty(0, np.uint64)
    key = code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:]
    feed = code == 10
    return np.unique(key[~(feed[:-2] | feed[1:-1] | feed[2:])])


def _names(keys: np.ndarray) -> list[str]:
    chars = np.stack([keys >> np.uint64(42), keys >> np.uint64(21) & np.uint64(0x1FFFFF), keys & np.uint64(0x1FFFFF)], axis=1).astype(np.uint32)
    whole = chars.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + N] for i in range(0, len(whole), N)]


#: Pairs of a trigram and a file in a block of postings.
BLOCK_PAIRS = 2_000_000


def posting_blocks(files: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``tri, files``: the pairs of ``trigrams``, the files of a trigram in one row for each block.

    A block is what a task has read until it holds enough pairs; its rows are
    sorted by trigram, so that a stored block is searched by pages.  Nothing is
    exchanged, and a task's memory does not grow with the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        numbers: list[int] = []
        pairs = 0

        def block() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(keys)
            order = np.argsort(every, kind="stable")
            every = every[order]
            owner = np.repeat(np.array(numbers, np.int64), [len(k) for k in keys])[order]
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            tri, ends = _names(every[starts]), np.append(starts[1:], len(every))
            at = 0
            while at < len(tri):  # pieces of at most so many pairs, or of one trigram
                low = int(starts[at])
                to = max(at + 1, int(np.searchsorted(ends, low + 200_000, side="right")))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts[at:to], ends[to - 1]) - low, pa.int32()), pa.array(owner[low : int(ends[to - 1])]))
                yield pa.RecordBatch.from_arrays([pa.array(tri[at:to], pa.string()), lists], ["tri", "files"])
                at = to

        for batch in batches:
            for no, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _keys(text)
                if len(own):
                    keys.append(own)
                    numbers.append(no)
                    pairs += len(own)
                if pairs >= block_pairs:
                    yield from block()
                    keys, numbers, pairs = [], [], 0
        if pairs:
            yield from block()

    return _texts(files).mapInArrow(run, "tri string, files array<long>")


def pairs_of(blocks: DataFrame) -> DataFrame:
    """``tri, file_no`` of stored blocks; a condition on ``tri`` reaches their scan."""
    return blocks.select("tri", F.explode("files").alias("file_no"))


def grams_of(text: str) -> list[str]:
    return sorted({text[i : i + N] for i in range(len(text) - N + 1)})


def candidates(table: DataFrame, need: Need) -> DataFrame | None:
    """``file_no`` of the files that may fulfil the need; None if trigrams cannot tell."""
    if need.kind == "lit":
        grams = grams_of(need.text)
        if need.fold or not grams:
            return None
        hits = table.where(F.col("tri").isin(grams))
        return hits.groupBy("file_no").count().where(F.col("count") == len(grams)).select("file_no")
    parts = [candidates(table, p) for p in need.parts]
    if need.kind == "or":
        if not parts or any(p is None for p in parts):
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()
    known = [p for p in parts if p is not None]
    if not known:
        return None
    out = known[0]
    for p in known[1:]:
        out = out.join(p, "file_no", "left_semi")
    return out


def with_candidates(files: DataFrame, table: DataFrame, need: Need) -> DataFrame:
    got = candidates(table, need)
    return files if got is None else files.join(got, "file_no", "left_semi")
