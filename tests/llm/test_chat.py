import pandas as pd

from quarry.llm.chat import ORACLE, Template, format_chats

from .helpers import SF, same_as_duckdb

COLS = ["conv_id", "turn", "role", "text"]


def test_whole_table_against_sql(spark):
    same_as_duckdb(format_chats(spark.read.parquet(f"{SF}/conversations.parquet")), ORACLE, conversations=f"{SF}/conversations.parquet")


CASES = [
    (1, 0, "system", "s"), (1, 1, "user", "u <|end|> trick"), (1, 5, "assistant", None),
    (2, 0, "user", "u"), (2, 1, "user", "again"), (2, 2, "assistant", "a"),
    (3, 0, "user", "u"), (3, 0, "user", "u"), (3, 1, "assistant", "a"),
    (4, 0, "user", "u"), (5, 0, None, "u"), (5, 1, "assistant", "a"), (6, 0, "assistant", "a"),
    (7, 0, "user", ""), (7, 1, "assistant", "long " * 100_000), (8, 0, "user", "u"), (8, 1, "assistant", "a"), (8, 2, "system", "s"),
    (9, 0, "user", "x"), (9, 1, "robot", "y"),
]


def test_cases_against_sql(spark):
    pdf = pd.DataFrame(CASES, columns=COLS)
    df = spark.createDataFrame(CASES, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as status", "2 as segment")
    same_as_duckdb(format_chats(df), ORACLE, conversations=pdf)
    status = {r.conv_id: r.status for r in format_chats(df).collect()}
    assert status == {1: "ok", 2: "bad_order", 3: "bad_turns", 4: "open_end", 5: "bad_order", 6: "bad_order", 7: "ok", 8: "bad_order", 9: "bad_order"}
    one = format_chats(df).where("conv_id = 1").orderBy("segment").collect()
    assert "".join(r.text for r in one) == "<|system|>\ns<|end|>\n<|user|>\nu < |end|> trick<|end|>\n<|assistant|>\n<|end|>\n"
    assert [r.loss for r in one] == [False] * 5 + [True]
    assert format_chats(df.limit(0)).count() == 0


def test_nulls(spark):
    df = spark.createDataFrame([(None, 0, "user", "u"), (None, 1, "assistant", "a"), (1, None, "user", "u"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.status for r in format_chats(df).collect()} == {None: "no_id", 1: "bad_turns"}


def test_own_template(spark):
    t = Template(moves={"start": {"user": "asked"}, "asked": {"tool": "asked", "assistant": "done"}}, final=("done",), segments={"user": (("Q {text}", False),), "tool": (("T {text}", False),), "assistant": (("A ", False), ("{text}", True))})
    df = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "tool", "t"), (1, 2, "tool", "t"), (1, 3, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert [(r.text, r.loss) for r in format_chats(df, t).orderBy("segment").collect()] == [("Q u", False), ("T t", False), ("T t", False), ("A ", False), ("a", True)]


def test_conversations_in_stretches_against_sql(spark):
    """With a low limit every conversation is cut, and the states are folded over the stretches."""
    pdf = pd.DataFrame(CASES, columns=COLS)
    df = spark.createDataFrame(CASES, "conv_id long, turn long, role string, text string")
    same_as_duckdb(format_chats(df, long_turns=1), ORACLE, conversations=pdf)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    hot = turns.unionByName(spark.range(0, 900).selectExpr("-1 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text"))
    same_as_duckdb(format_chats(hot, long_turns=100), ORACLE, conversations=hot.toPandas())
