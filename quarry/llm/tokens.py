"""Operator 7: token ids as Parquet list columns for selective reads.

Texts are encoded whole by a public tokenizer and written by Spark's committing
Parquet writer, so lost tasks leave nothing behind.  Token lists are dictionary-
or delta-encoded as asked, row groups are small enough to be units of work, and
small pages with page indexes let a reader fetch the tokens of a few documents,
or metadata alone, without the rest.  Rows are clustered by id inside each file,
so that the page index of ``doc_id`` is selective.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir, tokenizer_dir

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space (the tokenizer's, which is Unicode's) that its pattern would walk back through one by one.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1024,}")
_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file; loaded once a process."""
    import tiktoken

    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("quarry", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def encode_text(enc, text: str) -> np.ndarray:
    """The ids of a text, whatever its length.

    The pattern makes one piece of a run of white space, but for its last character
    if a word follows.  Its engine gives up on very long runs, so these are cut
    here at the same places, and encoded as the pieces they are.
    """
    parts, at = [], 0
    for m in _BLANKS.finditer(text):
        low, high = m.span()
        high -= high < len(text)
        if low > at:
            parts.append(enc.encode_to_numpy(text[at:low], disallowed_special=()))
        parts.append(np.array(enc._encode_single_piece(text[low:high]), dtype=np.uint32))
        at = high
    if at == 0:
        return enc.encode_to_numpy(text, disallowed_special=())
    if at < len(text):
        parts.append(enc.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(parts)


def encoder(name: str = TOKENIZER) -> Callable[[str], np.ndarray]:
    """``text -> ids``, with the file read where it runs."""
    path = name if os.path.isabs(name) else os.path.join(tokenizer_dir(), name)

    def encode(text: str) -> np.ndarray:
        from quarry.llm import tokens as here

        return here.encode_text(here.encoding(path), text)

    return encode


def tokenize(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, tokens``: whole texts; null and empty texts have no tokens."""
    encode = encoder(tokenizer)

    def run(batch: pa.RecordBatch) -> dict:
        ids = [encode(t) if t else np.empty(0, np.uint32) for t in batch.column(1).to_pylist()]
        n = np.array([len(x) for x in ids], dtype=np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat))
        return {"doc_id": batch.column(0), "n_tokens": pa.array(n), "tokens": tokens}

    return arrow_map(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t")), run, "doc_id long, n_tokens int, tokens array<int>", 1)


def write_tokens(tokens: DataFrame, path: str, *, coding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, page_rows: int = 1_000, mode: str = "errorifexists") -> None:
    """Write ``tokens`` with ``coding`` 'dictionary' (few distinct ids, best for
    vocabularies) or 'delta' (delta binary packed, best for sorted or smooth lists)."""
    if coding not in ("dictionary", "delta"):
        raise ValueError("coding is 'dictionary' or 'delta'")
    (
        tokens.sortWithinPartitions("doc_id")
        .write.mode(mode)
        .option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.enable.dictionary", "false" if coding == "delta" else "true")
        .option("parquet.enable.dictionary#tokens.list.element", "true" if coding == "dictionary" else "false")
        .option("parquet.writer.version", "PARQUET_2_0" if coding == "delta" else "PARQUET_1_0")
        .option("parquet.column.index.access", "true")
        .parquet(path)
    )


def token_table(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, **layout) -> DataFrame:
    """Write the token table of ``docs`` and return it as read back: ``doc_id, n_tokens, tokens``.

    Without a ``path`` it goes to a new folder under the shared one.  Null and
    empty texts have an empty list; rows with a null id, and repeated rows, have
    rows of their own; other columns are ignored; an empty table gives an empty
    table.
    """
    spark = docs.sparkSession
    path = path or os.path.join(shared_dir(spark), f"tokens-{uuid.uuid4().hex}")
    write_tokens(tokenize(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer), path, **layout)
    return spark.read.parquet(path)


def read_tokens(spark, path: str, ids: list[int] | None = None, metadata_only: bool = False) -> DataFrame:
    """Selective read: some ids (pushed down to row groups and pages), or metadata without tokens.

    Besides the exact list, the scan gets at most 200 ranges around the ids, cut at
    their widest gaps: a long list alone would be pushed down as one range.  Null
    ids are found by no list; an empty list gives no rows.
    """
    df = spark.read.parquet(path)
    if ids is not None:
        order = np.unique(np.array(list(ids), dtype=np.int64))
        wide = np.sort(np.argsort(np.diff(order), kind="stable")[::-1][:199]) + 1
        near = F.lit(False)
        for part in np.split(order, wide) if len(order) else []:
            near = near | F.col("doc_id").between(int(part[0]), int(part[-1]))
        df = df.where(near & F.col("doc_id").isin(order.tolist()))
    return df.select("doc_id", "n_tokens") if metadata_only else df
