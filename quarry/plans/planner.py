"""Necessary conditions of a pattern, as literals that a text must contain.

The planner never excludes a match: it only adds conjuncts that every matching
line fulfils.  They are cheap (``contains``), reach the Parquet scan, and spare
most files the split into lines.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import regex as rx

MOST_STRINGS, MOST_CHARS, SHORTEST = 16, 8, 2
#: A need that is fulfilled by more than one in so many positions is not worth a filter.
LEAST_WEIGHT = 16


@dataclass(frozen=True)
class Need:
    """``any`` | ``lit`` (text, fold) | ``and`` | ``or``."""

    kind: str
    text: str = ""
    fold: bool = False
    parts: tuple = ()


ANY = Need("any")


def _all(parts: list[Need]) -> Need:
    parts = list(dict.fromkeys(p for p in parts if p.kind != "any"))
    return ANY if not parts else parts[0] if len(parts) == 1 else Need("and", parts=tuple(parts))


def _some(parts: list[Need]) -> Need:
    parts = list(dict.fromkeys(parts))
    return ANY if not parts or any(p.kind == "any" for p in parts) else parts[0] if len(parts) == 1 else Need("or", parts=tuple(parts))


def _literals(strings: frozenset) -> Need:
    return _some([Need("lit", s, f) if len(s) >= SHORTEST else ANY for s, f in sorted(strings)])


def _char(c: str, fold: bool) -> frozenset | None:
    """The strings that stand for a character; with folding only letters without
    partners outside ASCII can be lower-cased safely."""
    if not fold or not c.isalpha():
        return frozenset([(c, False)])
    if not c.isascii() or c.lower() in "ks":
        return None
    return frozenset([(c.lower(), True)])


def _join(a: frozenset, b: frozenset) -> frozenset:
    return frozenset((x + y, f or g) for (x, f), (y, g) in itertools.product(a, b))


_NOTHING = frozenset([("", False)])


def _walk(node: rx.Node) -> tuple[frozenset | None, Need]:
    """The exact strings of a node if they are few, and otherwise its need."""
    k = node.kind
    if k == "lit":
        return _char(node.text, node.fold), ANY
    if k == "class":
        if node.negated or node.extra or sum(b - a + 1 for a, b in node.ranges) > MOST_CHARS:
            return None, ANY
        got = [_char(chr(x), node.fold) for a, b in node.ranges for x in range(a, b + 1)]
        return (None if None in got or not got else frozenset().union(*got)), ANY
    if k in ("bol", "eol", "begin", "end", "wordb", "nwordb", "empty"):
        return _NOTHING, ANY
    if k == "group":
        return _walk(node.items[0])
    if k == "alt":
        sides = [_walk(x) for x in node.items]
        if all(e is not None for e, _ in sides):
            union = frozenset().union(*(e for e, _ in sides))
            if len(union) <= MOST_STRINGS:
                return union, ANY
        return None, _some([_literals(e) if e is not None else n for e, n in sides])
    if k == "rep":
        exact, need = _walk(node.items[0])
        if node.low == 0:
            return None, ANY
        if exact is not None and len(exact) == 1 and node.low <= 64:
            run = _NOTHING
            for _ in range(node.low):
                run = _join(run, exact)
            return (run, ANY) if node.low == node.high else (None, _literals(run))
        return None, _literals(exact) if exact is not None else need
    if k == "cat":
        run, needs, whole = _NOTHING, [], True
        for x in node.items:
            exact, need = _walk(x)
            again = _walk(x.items[0])[0] if exact is None and x.kind == "rep" and x.low > 0 else None
            if again is not None and len(run) * len(again) <= MOST_STRINGS:  # what comes before meets the first of them, what follows the last
                needs += [_literals(_join(run, again)), need]
                run, whole = again, False
            elif exact is None:
                needs += [_literals(run), need]
                run, whole = _NOTHING, False
            elif len(run) * len(exact) > MOST_STRINGS:
                needs.append(_literals(run))
                run, whole = exact, False
            else:
                run = _join(run, exact)
        return (run, ANY) if whole else (None, _all([*needs, _literals(run)]))
    return None, ANY


def need_of(node: rx.Node) -> Need:
    """What every match needs, or ANY if that is too common to help."""
    exact, need = _walk(node)
    need = _literals(exact) if exact is not None else need
    return need if selectivity(need) * LEAST_WEIGHT <= 1 else ANY


def condition(need: Need, text: Column) -> Column | None:
    """The need as a predicate on ``text``; None if there is none."""
    if need.kind == "any":
        return None
    if need.kind == "lit":
        return (F.lower(text) if need.fold else text).contains(F.lit(need.text.lower() if need.fold else need.text))
    parts = [condition(p, text) for p in need.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if need.kind == "and" else out | p
    return out


def selectivity(need: Need) -> float:
    """Share of positions that a need lets pass, if all of a hundred printable characters were alike."""
    if need.kind == "any":
        return 1.0
    if need.kind == "lit":
        return (0.02 if need.fold else 0.01) ** len(need.text)
    shares = [selectivity(p) for p in need.parts]
    return min(shares) if need.kind == "and" else min(1.0, sum(shares))


def size(need: Need) -> tuple[int, int]:
    """Nodes and depth."""
    if need.kind in ("any", "lit"):
        return 1, 1
    sizes = [size(p) for p in need.parts]
    return 1 + sum(n for n, _ in sizes), 1 + max(d for _, d in sizes)


def show(need: Need) -> str:
    if need.kind == "any":
        return "anything"
    if need.kind == "lit":
        return repr(need.text) + ("/i" if need.fold else "")
    return "(" + f" {need.kind} ".join(show(p) for p in need.parts) + ")"


def to_dot(need: Need) -> str:
    """The need as a graph in DOT."""
    lines, count = ["digraph need {"], itertools.count()

    def visit(n: Need) -> int:
        me = next(count)
        label = (show(n) if n.kind in ("any", "lit") else n.kind).replace("\\", "\\\\").replace('"', '\\"')
        lines.append(f'  n{me} [label="{label}"];')
        for p in n.parts:
            lines.append(f"  n{me} -> n{visit(p)};")
        return me

    visit(need)
    return "\n".join([*lines, "}"])


def explain(pattern: str, fold: bool = False) -> dict:
    """What the planner makes of a pattern."""
    node = rx.parse(pattern, fold)
    need = need_of(node)
    nodes, depth = size(need)
    share = selectivity(need)
    return {
        "pattern": pattern,
        "java": rx.prefix(fold) + rx.to_java(node, fold),
        "width": rx.width(node),
        "program_size": rx.program_size(node),
        "need": show(need),
        "selectivity": share,
        "weight": 1 / share if share else float("inf"),
        "nodes": nodes,
        "depth": depth,
        "chain": rx.chain(node) is not None,
    }
