"""Queries of the training-data operators over whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, host_rules
from .common import table
from .decontaminate import find_leaks
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack
from .pii import pseudonymise
from .quality import classify
from .sharding import shuffle_to_shards
from .tokens import token_table


#: The key of the registered query where none is set: its tables are invented, so nothing needs hiding.
PUBLIC_KEY = "key for tests"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=os.environ.get("QUARRY_PII_KEY", PUBLIC_KEY))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), inside_lines=True)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_to_shards(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_decontamination, op3_packing, op4_host_rules, op5_line_dedup, op6_chat, op7_tokens, op8_sharding, op9_quality, op10_near_dedup)
}

ORACLE_SQL: dict[str, str] = {"op4_host_rules": host_rules.oracle(), "op6_chat": chat.ORACLE}
