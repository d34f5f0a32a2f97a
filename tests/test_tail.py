"""Patterns that end where a line does look at its last characters alone."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import regex as rx
from quarry.operators.search import Pattern

TEXTS = ["", "a", "ab", "a.b", "xx a.b", "a.b xx a.b", "ß!ß", "\U0001f600.\U0001f600", "long " * 300 + "a-b", "abab", "zab", " ab", "ababab" * 50, "a.", ".b "]


@pytest.mark.parametrize("pattern", [r"\S\W\S$", r"(ab){1,3}$", r"\bab$", r"[a-z]?.b$", r"a|.b$", "ab$|x", "^ab$", "(?:a|ab|b)+$", r"x{0,3}.\z", "$"])
def test_same_as_over_the_whole_text(spark, pattern):
    """matches and bounds are those of Python's engine."""
    p = Pattern.compile(pattern, False)
    python = re.compile(pattern.replace("\\z", "\\Z"), re.ASCII)
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = {r.text: list(r.b) if r.m else None for r in rows.select("text", p.matches(F.col("text")).alias("m"), p.bounds(F.col("text")).alias("b")).collect()}
    want = {t: list(m.span()) if (m := python.search(t)) else None for t in TEXTS}
    assert got == want


def test_which_patterns_have_a_tail():
    tail = lambda p: rx.tail(rx.parse(p))
    assert tail(r"\S\W\S$") == 5 and tail("(ab){2,3}$") == 8
    assert [tail(p) for p in ("^ab$", "a+$", "ab", "ab$|x", ".*b$")] == [None] * 5
