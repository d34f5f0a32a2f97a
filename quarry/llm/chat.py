"""Operator 6: chat formatting by a finite-state machine over roles.

A template declares the states, which role leads where, the states a
conversation may end in, and for each role the segments to emit with their loss
flags.  The machine runs as a fold over each conversation's ordered turns.  Very
long conversations are cut into stretches: each stretch gives, for every state,
the state that it leads to, and these are folded in order, so no task holds more
than a stretch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side

TEXT = "{text}"
#: Turns from which on a conversation is cut into stretches, of about as many.
LONG_TURNS = 10_000


@dataclass(frozen=True)
class Template:
    start: str = "start"
    moves: dict = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple = ("assistant",)
    #: by role: (text with ``{text}`` for the turn's text, whether it counts in the loss)
    segments: dict = field(
        default_factory=lambda: {
            "system": (("<|system|>\n", False), ("{text}<|end|>\n", False)),
            "user": (("<|user|>\n", False), ("{text}<|end|>\n", False)),
            "assistant": (("<|assistant|>\n", False), ("{text}<|end|>\n", True)),
        }
    )
    #: markers that a turn's text must not contain, and what replaces them
    escape: tuple = ("<|", "< |")


DEFAULT = Template()


def _next_state(t: Template, state: Column, role: Column) -> Column:
    out = F.lit("bad")
    for s, moves in t.moves.items():
        for r, to in moves.items():
            out = F.when((state == s) & (role == r), to).otherwise(out)
    return out


def _segments(t: Template, turn: Column) -> Column:
    body = F.replace(F.coalesce(turn["text"], F.lit("")), F.lit(t.escape[0]), F.lit(t.escape[1]))
    out = F.array().cast("array<struct<turn:bigint,role:string,text:string,loss:boolean>>")
    for role, parts in t.segments.items():
        made = F.array(
            *[
                F.struct(turn["turn"].cast("bigint").alias("turn"), turn["role"].alias("role"), (F.concat(F.lit(p.split(TEXT)[0]), body, F.lit(p.split(TEXT)[1])) if TEXT in p else F.lit(p)).alias("text"), F.lit(loss).alias("loss"))
                for p, loss in parts
            ]
        )
        out = F.when(turn["role"] == role, made).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: Template = DEFAULT, *, long_turns: int = LONG_TURNS) -> DataFrame:
    """``conv_id, status, n_turns, segment, turn, role, text, loss``: a row for each segment of each sound
    conversation, and a single row with nulls from ``segment`` on for each rejected one.

    ``status`` is ``ok``; ``bad_turns`` if a turn number is null or repeated (so
    repeated rows reject their conversation: their order is undefined);
    ``bad_order`` if the machine has no move for a role (a null role too); or
    ``open_end`` if it stops in a state that is not final.  Turns follow their
    numbers, which may have gaps.  A null text counts as empty.  Rows with a null
    conv_id are one rejected conversation, ``no_id``, and only counted.  Other
    columns are ignored; an empty table gives an empty table.
    """
    known = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    lost = turns.where("conv_id is null").agg(F.count("*").alias("n")).where("n > 0")
    lost = _rejected(lost.select(F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.lit("no_id").alias("status"), F.col("n").cast("int").alias("n_turns")))
    long = cut(known.groupBy("conv_id").count().where(F.col("count") > long_turns))
    rows = long.agg(F.sum("count")).first()[0]
    if not rows:
        return _short(known, template).unionByName(lost)
    names = small_side(long.select("conv_id"), 16)
    return _short(known.join(names, "conv_id", "left_anti"), template).unionByName(_long(known.join(names, "conv_id", "left_semi"), template, -(-rows // long_turns))).unionByName(lost)


def _rejected(judged: DataFrame) -> DataFrame:
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("segment", "int"), ("turn", "long"), ("role", "string"), ("text", "string"), ("loss", "boolean"))]
    return judged.select("conv_id", "status", "n_turns", *empty)


def _step(t: Template, state: Column, turn: Column) -> Column:
    return _next_state(t, state, F.coalesce(turn["role"], F.lit("")))


def _odd(turns: str) -> Column:
    numbers = F.transform(turns, lambda x: x["turn"])
    return F.exists(numbers, lambda n: n.isNull()) | (F.size(F.array_distinct(numbers)) != F.size(numbers))


def _status(t: Template, odd: Column, state: Column) -> Column:
    return F.when(odd, "bad_turns").when(state == "bad", "bad_order").when(~state.isin(list(t.final)), "open_end").otherwise("ok")


def _short(turns: DataFrame, t: Template) -> DataFrame:
    """Conversations whose turns fit one array."""
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    state = F.aggregate("t", F.lit(t.start), lambda s, x: _step(t, s, x))
    judged = chats.withColumn("state", state).select("conv_id", "t", _status(t, _odd("t"), F.col("state")).alias("status"), F.size("t").alias("n_turns"))
    pieces = F.when(F.col("status") == "ok", F.flatten(F.transform("t", lambda x: _segments(t, x))))
    return judged.select("conv_id", "status", "n_turns", F.posexplode_outer(pieces).alias("segment", "s")).select("conv_id", "status", "n_turns", "segment", "s.turn", "s.role", "s.text", "s.loss")


def _long(turns: DataFrame, t: Template, parts: int) -> DataFrame:
    """Conversations in stretches: a range of turns in each of ``parts`` partitions."""
    placed = turns.repartitionByRange(parts, "conv_id", "turn").withColumn("part", F.spark_partition_id())
    runs = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    states = sorted({t.start, "bad", *t.moves, *(to for m in t.moves.values() for to in m.values())})
    ends = F.create_map(*[c for s in states for c in (F.lit(s), F.aggregate("t", F.lit(s), lambda at, x: _step(t, at, x)))])
    sizes = F.aggregate("t", F.lit(0), lambda n, x: n + F.size(_segments(t, x)))
    runs = cut(runs.select("conv_id", "part", "t", ends.alias("ends"), sizes.alias("segments"), _odd("t").alias("odd")))
    # a few numbers a stretch
    narrow = runs.select("conv_id", "part", F.transform(F.array(*[F.lit(s) for s in states]), lambda s: F.struct(s.alias("a"), F.col("ends")[s].alias("b"))).alias("moves"), "odd", F.size("t").alias("n"), "segments")
    folded = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "moves"))).alias("m"), F.max("odd").alias("odd"), F.sum("n").cast("int").alias("n_turns"))
    state = F.aggregate("m", F.lit(t.start), lambda s, x: F.element_at(F.filter(x["moves"], lambda p: p["a"] == s), 1)["b"])
    judged = cut(folded.withColumn("state", state).select("conv_id", _status(t, F.col("odd"), F.col("state")).alias("status"), "n_turns"))
    before = F.coalesce(F.sum("segments").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    place = narrow.select("conv_id", "part", before.alias("before")).join(judged.where("status = 'ok'"), "conv_id")
    sound = runs.select("conv_id", "part", "t").join(place, ["conv_id", "part"]).select("conv_id", "status", "n_turns", "before", F.posexplode(F.flatten(F.transform("t", lambda x: _segments(t, x)))).alias("at", "s"))
    return sound.select("conv_id", "status", "n_turns", (F.col("before") + F.col("at")).alias("segment"), "s.turn", "s.role", "s.text", "s.loss").unionByName(_rejected(judged.where("status <> 'ok'")))


ORACLE = """
WITH t AS (SELECT *, lag(role) OVER w AS prev, count(*) OVER (PARTITION BY conv_id) AS n_turns,
             count(DISTINCT turn) OVER (PARTITION BY conv_id) AS d, row_number() OVER w AS rn
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
ok AS (SELECT *, CASE WHEN prev IS NULL AND rn = 1 THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant' ELSE false END AS fine FROM t),
c AS (SELECT conv_id, any_value(n_turns) AS n_turns,
        CASE WHEN conv_id IS NULL THEN 'no_id' WHEN any_value(n_turns) <> any_value(d) THEN 'bad_turns' WHEN NOT bool_and(coalesce(fine, false)) THEN 'bad_order'
             WHEN arg_max(role, rn) <> 'assistant' THEN 'open_end' ELSE 'ok' END AS status FROM ok GROUP BY conv_id),
s AS (SELECT o.conv_id, c.status, c.n_turns, 2 * (rn - 1) + k AS segment, turn, role,
        CASE WHEN k = 0 THEN '<|' || role || '|>' || chr(10) ELSE replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) END AS text,
        k = 1 AND role = 'assistant' AS loss
      FROM ok o JOIN c USING (conv_id), (SELECT unnest([0, 1]) AS k) WHERE c.status = 'ok')
SELECT * FROM s UNION ALL SELECT conv_id, status, n_turns, NULL, NULL, NULL, NULL, NULL FROM c WHERE status <> 'ok'"""
