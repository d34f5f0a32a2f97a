"""The search dialect: a parser for linear-time regular expressions, and what is
derived from the syntax tree: the equivalent ``java.util.regex`` pattern, the
greatest match width, a program size, and chains that need a safe rewriting.

The dialect has no back references, look-around, possessive or atomic groups.
``.`` is any character but a line feed, ``^`` and ``$`` hold at the ends of a
line, ``\\s`` has no vertical tab, ``\\w``, ``\\d`` and ``\\b`` are ASCII.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

MAX_PROGRAM, MAX_WIDTH, MAX_REPEAT = 4000, 200, 1000
_TOP = 0x10FFFF
_META = set("\\.+*?()|[]{}^$")


class QueryError(ValueError):
    """A query that cannot be run; ``label`` names the field at fault."""

    def __init__(self, message: str, label: str = "query"):
        super().__init__(f"{label}: {message}")
        self.label = label


def quote(text: str) -> str:
    """The pattern that matches ``text`` itself."""
    return "".join("\\" + c if c in _META else c for c in text)


@dataclass(frozen=True)
class Node:
    kind: str  # empty lit class any bol eol wordb nwordb cat alt rep group begin end
    items: tuple = ()
    text: str = ""
    ranges: tuple = ()
    negated: bool = False
    low: int = 0
    high: int | None = None
    lazy: bool = False
    name: str | None = None
    extra: tuple = ()  # Unicode properties inside a class, as Java writes them
    fold: bool = False


_PERL = {"d": ((48, 57),), "w": ((48, 57), (65, 90), (95, 95), (97, 122)), "s": ((9, 10), (12, 13), (32, 32))}
_POSIX = {
    "alnum": ((48, 57), (65, 90), (97, 122)), "alpha": ((65, 90), (97, 122)), "ascii": ((0, 127),), "blank": ((9, 9), (32, 32)), "cntrl": ((0, 31), (127, 127)),
    "digit": ((48, 57),), "graph": ((33, 126),), "lower": ((97, 122),), "print": ((32, 126),), "punct": ((33, 47), (58, 64), (91, 96), (123, 126)),
    "space": ((9, 13), (32, 32)), "upper": ((65, 90),), "word": _PERL["w"], "xdigit": ((48, 57), (65, 70), (97, 102)),
}
_ESCAPES = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}


def _complement(ranges: tuple) -> tuple:
    out, at = [], 0
    for lo, hi in sorted(ranges):
        if lo > at:
            out.append((at, lo - 1))
        at = max(at, hi + 1)
    if at <= _TOP:
        out.append((at, _TOP))
    return tuple(out)


def _folded(ranges: tuple) -> tuple:
    """The ranges with both cases of their ASCII letters, and what else folds to them (U+212A, U+017F)."""
    out = list(ranges)
    for lo, hi in ranges:
        for first, shift in ((65, 32), (97, -32)):
            a, b = max(lo, first), min(hi, first + 25)
            if a <= b:
                out.append((a + shift, b + shift))
            for letter, other in (("k", 0x212A), ("s", 0x17F)):
                if a <= ord(letter) - (32 if first == 65 else 0) <= b:
                    out.append((other, other))
    return tuple(out)


@dataclass
class _Parser:
    src: str
    fold: bool = False
    i: int = 0
    depth: int = 0
    flags: list = field(default_factory=list)

    def more(self) -> bool:
        return self.i < len(self.src)

    def peek(self) -> str:
        return self.src[self.i] if self.more() else ""

    def take(self) -> str:
        if not self.more():
            raise QueryError("the pattern ends too early")
        c = self.src[self.i]
        self.i += 1
        return c

    def parse(self) -> Node:
        node = self.alternation()
        if self.more():
            raise QueryError("unexpected )")
        return node

    def alternation(self) -> Node:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else Node("alt", tuple(branches))

    def sequence(self) -> Node:
        out: list[Node] = []
        while self.more() and self.peek() not in "|)":
            at = self.i
            node = self.atom()
            if node is None:
                continue
            node = self.repeats(node, at)
            out.append(node)
        if not out:
            return Node("empty")
        return out[0] if len(out) == 1 else Node("cat", tuple(out))

    def bounds(self) -> tuple[int, int | None] | None:
        """``{n}``, ``{n,}`` or ``{n,m}`` at the cursor; anything else is literal."""
        end = self.src.find("}", self.i)
        if self.peek() != "{" or end < 0:
            return None
        parts = self.src[self.i + 1 : end].split(",")
        if len(parts) > 2 or not parts[0].isascii() or not parts[0].isdigit() or (len(parts) == 2 and parts[1] and not (parts[1].isascii() and parts[1].isdigit())):
            return None
        low = int(parts[0])
        high = low if len(parts) == 1 else int(parts[1]) if parts[1] else None
        if low > MAX_REPEAT or (high or 0) > MAX_REPEAT or (high is not None and high < low):
            raise QueryError("bad repetition " + self.src[self.i : end + 1])
        self.i = end + 1
        return low, high

    def repeats(self, node: Node, at: int) -> Node:
        while self.more():
            c = self.peek()
            if c in "*+?":
                self.take()
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            else:
                got = self.bounds()
                if got is None:
                    return node
                low, high = got
            lazy = self.peek() == "?"
            if lazy:
                self.take()
            if node.kind == "rep" and (node.high is None or high is None) and node.low in (0, 1) and low in (0, 1):
                # a repeat of a star or plus is one of them again
                node = Node("rep", node.items, low=min(node.low, low), high=None, lazy=node.lazy)
            else:
                node = Node("rep", (node,), low=low, high=high, lazy=lazy)
        return node

    def atom(self) -> Node | None:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.char_class()
        if c == ".":
            return Node("any")
        if c == "^":
            return Node("bol")
        if c == "$":
            return Node("eol")
        if c in "*+?":
            raise QueryError(f"nothing to repeat before {c}")
        if c == "{":
            self.i -= 1
            if self.bounds() is not None:
                raise QueryError("nothing to repeat before {")
            self.take()
            return Node("lit", text="{", fold=self.fold)
        if c == "\\":
            return self.escape()
        return Node("lit", text=c, fold=self.fold)

    def group(self) -> Node | None:
        name, capture, saved = None, True, self.fold
        if self.peek() == "?":
            self.take()
            if self.src[self.i : self.i + 2] == "P<" or (self.peek() == "<" and self.src[self.i + 1 : self.i + 2] not in ("=", "!")):
                end = self.src.find(">", self.i)
                name = self.src[self.src.find("<", self.i) + 1 : end]
                if end < 0 or not name.isidentifier():
                    raise QueryError("bad group name")
                self.i = end + 1
            else:
                on = True
                while True:
                    c = self.take()
                    if c == "-":
                        on = False
                    elif c == "i":
                        self.fold = on
                    elif c in "msU" and c != "U":
                        pass  # lines hold no line feeds, so these change nothing
                    elif c == ":":
                        capture = False
                        break
                    elif c == ")":
                        return None  # flags hold up to the end of the enclosing group
                    else:
                        raise QueryError("unsupported group (?" + c)
        self.depth += 1
        if self.depth > 250:
            raise QueryError("groups are nested too deeply")
        inner = self.alternation()
        self.depth -= 1
        if self.peek() != ")":
            raise QueryError("missing )")
        self.take()
        self.fold = saved
        return Node("group", (inner,), name=name, lazy=not capture)

    def code_point(self) -> int:
        """The code of a hexadecimal or octal escape after ``\\x`` or ``\\0``."""
        if self.peek() == "{":
            end = self.src.find("}", self.i)
            digits, self.i = self.src[self.i + 1 : end], end + 1
        else:
            digits = self.src[self.i : self.i + 2]
            self.i += 2
        try:
            code = int(digits, 16)
        except ValueError:
            raise QueryError("bad hexadecimal escape") from None
        if code > _TOP:
            raise QueryError("bad hexadecimal escape")
        return code

    def property(self, c: str) -> tuple[str, bool]:
        negated = c == "P"
        if self.peek() == "{":
            end = self.src.find("}", self.i)
            name, self.i = self.src[self.i + 1 : end], end + 1
        else:
            name = self.take()
        if name.startswith("^"):
            negated, name = not negated, name[1:]
        if not name.isalpha() and "_" not in name:
            raise QueryError("bad character property")
        return ("\\P{" if negated else "\\p{") + (name if len(name) <= 2 else "Is" + name) + "}", negated

    def escape(self) -> Node:
        c = self.take()
        if c in _PERL:
            return Node("class", ranges=_PERL[c], fold=self.fold)
        if c.lower() in _PERL:
            return Node("class", ranges=_PERL[c.lower()], negated=True, fold=self.fold)
        if c in "pP":
            return Node("class", extra=(self.property(c)[0],), fold=self.fold)
        if c == "b":
            return Node("wordb")
        if c == "B":
            return Node("nwordb")
        if c == "A":
            return Node("begin")
        if c == "z":
            return Node("end")
        if c == "Q":
            end = self.src.find("\\E", self.i)
            text, self.i = (self.src[self.i :], len(self.src)) if end < 0 else (self.src[self.i : end], end + 2)
            return Node("group", (Node("cat", tuple(Node("lit", text=x, fold=self.fold) for x in text)) if text else Node("empty"),), lazy=True)
        return Node("lit", text=chr(self.single(c)), fold=self.fold)

    def single(self, c: str) -> int:
        if c in _ESCAPES:
            return _ESCAPES[c]
        if c == "x":
            return self.code_point()
        if c == "0":
            digits = "0"
            while len(digits) < 3 and self.peek() and self.peek() in "01234567":
                digits += self.take()
            return int(digits, 8)
        if c.isalnum() and c.isascii():
            raise QueryError(f"unsupported escape \\{c}")
        return ord(c)

    def all_but(self, ranges: tuple) -> tuple:
        """What a negated class inside a class stands for: folding comes before negation."""
        return _complement(_folded(ranges) if self.fold else ranges)

    def char_class(self) -> Node:
        negated = self.peek() == "^"
        if negated:
            self.take()
        ranges: list[tuple[int, int]] = []
        extra: list[str] = []
        first = True
        while True:
            if not self.more():
                raise QueryError("missing ]")
            c = self.take()
            if c == "]" and not first:
                break
            first = False
            if c == "[" and self.peek() == ":":
                end = self.src.find(":]", self.i)
                if end > 0:
                    name = self.src[self.i + 1 : end]
                    if name.lstrip("^") not in _POSIX:
                        raise QueryError(f"unknown class [:{name}:]")
                    got = _POSIX[name.lstrip("^")]
                    ranges += self.all_but(got) if name.startswith("^") else got
                    self.i = end + 2
                    continue
            if c == "\\":
                e = self.take()
                if e.lower() in _PERL:
                    ranges += self.all_but(_PERL[e.lower()]) if e.isupper() else _PERL[e]
                    continue
                if e in "pP":
                    extra.append(self.property(e)[0])
                    continue
                low = self.single(e)
            else:
                low = ord(c)
            high = low
            if self.peek() == "-" and self.src[self.i + 1 : self.i + 2] not in ("]", ""):
                self.take()
                d = self.take()
                high = self.single(self.take()) if d == "\\" else ord(d)
                if high < low:
                    raise QueryError("bad character range")
            ranges.append((low, high))
        return Node("class", ranges=tuple(ranges), negated=negated, extra=tuple(extra), fold=self.fold)


def parse(pattern: str, fold: bool = False, label: str = "query") -> Node:
    try:
        return _Parser(pattern, fold).parse()
    except QueryError as e:
        raise QueryError(str(e).removeprefix("query: "), label) from None
    except RecursionError:
        raise QueryError("groups are nested too deeply", label) from None


# -- Java ------------------------------------------------------------------

_WORDB = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_NWORDB = "(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"


def _char(code: int, in_class: bool = False) -> str:
    c = chr(code)
    if c.isalnum() and c.isascii():
        return c
    if 32 <= code < 127:
        return "\\" + c if in_class or c in _META or c == "#" else c
    return f"\\x{{{code:x}}}"


def _wrap(node: Node, fold: bool) -> str:
    """The Java text of a node, grouped so that it stands as one item; ``fold`` is what holds outside."""
    text = _java(node, fold)
    return text if node.kind in ("lit", "class", "any", "group", "bol", "eol", "begin", "end", "wordb", "nwordb") and not text.startswith("(?i") else f"(?:{text})"


def _java(node: Node, fold: bool) -> str:
    k = node.kind
    if k in ("lit", "class"):
        if k == "lit":
            text = _char(ord(node.text))
        else:
            inner = "".join(_char(a, True) if a == b else f"{_char(a, True)}-{_char(b, True)}" for a, b in node.ranges) + "".join(node.extra)
            text = f"[^{inner}]" if node.negated and inner else f"[{inner}]" if inner else "(?!)"
        if node.fold != fold:
            return f"(?iu:{text})" if node.fold else f"(?-iu:{text})"
        return text
    if k == "any":
        return "."
    if k == "bol":
        return "^"
    if k == "eol":
        return "$"
    if k == "begin":
        return "\\A"
    if k == "end":
        return "\\z"
    if k in ("wordb", "nwordb"):
        text = _WORDB if k == "wordb" else _NWORDB
        return f"(?-iu:{text})" if fold else text  # folding must not widen the ASCII class
    if k == "empty":
        return ""
    if k == "cat":
        return "".join(f"(?:{_java(x, fold)})" if x.kind == "alt" else _java(x, fold) for x in node.items)
    if k == "alt":
        return "|".join(_java(x, fold) for x in node.items)
    if k == "group":
        return f"(?:{_java(node.items[0], fold)})"
    low, high = node.low, node.high
    mark = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((low, high)) or ("{%d}" % low if low == high else "{%d,%s}" % (low, "" if high is None else high))
    return _wrap(node.items[0], fold) + mark + ("?" if node.lazy else "")


def to_java(node: Node, fold: bool = False) -> str:
    """The body of the Java pattern; use it after ``prefix(fold)``.  Groups do not capture."""
    return _java(node, fold)


def prefix(fold: bool, lines: bool = False) -> str:
    """Flags: line feeds alone end lines; ``lines`` lets anchors hold inside a text of many lines."""
    return "(?d" + ("iu" if fold else "") + ("m" if lines else "") + ")"


def to_re2(node: Node, fold: bool = False) -> str:
    """The node in the syntax of the linear engine, without captures; ``fold`` is what holds outside."""
    k = node.kind
    if k in ("lit", "class"):
        if k == "lit":
            text = _char(ord(node.text))
        else:
            inner = "".join(_char(a, True) if a == b else f"{_char(a, True)}-{_char(b, True)}" for a, b in node.ranges) + "".join(x.replace("{Is", "{") for x in node.extra)
            text = f"[^{inner}]" if node.negated and inner else f"[{inner}]" if inner else "[^\\x00-\\x{10FFFF}]"
        return text if node.fold == fold else f"(?i:{text})" if node.fold else f"(?-i:{text})"
    simple = {"any": ".", "bol": "^", "eol": "$", "begin": "\\A", "end": "\\z", "wordb": "\\b", "nwordb": "\\B", "empty": ""}
    if k in simple:
        return simple[k]
    if k == "cat":
        return "".join(f"(?:{to_re2(x, fold)})" if x.kind == "alt" else to_re2(x, fold) for x in node.items)
    if k == "alt":
        return "|".join(to_re2(x, fold) for x in node.items)
    if k == "group":
        return f"(?:{to_re2(node.items[0], fold)})"
    low, high = node.low, node.high
    mark = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((low, high)) or ("{%d}" % low if low == high else "{%d,%s}" % (low, "" if high is None else high))
    return f"(?:{to_re2(node.items[0], fold)}){mark}" + ("?" if node.lazy else "")


_ONE_CHAR = ("lit", "class", "any")


def needs_linear(node: Node) -> bool:
    """Whether a backtracking engine may recurse or retry too much: a group that
    is repeated often, or three repeats without end that are no chain."""
    return _repeats_groups(node) or (unbounded(node) > 2 and chain(node) is None)


def _repeats_groups(node: Node) -> bool:
    if node.kind == "rep" and node.items[0].kind not in _ONE_CHAR and (node.high is None or node.high > 16):
        return True
    return any(_repeats_groups(x) for x in node.items)


def stays_in_line(node: Node) -> bool:
    """Whether no repeat without end can run over a line feed, so that each try over a text of many lines is short."""
    if node.kind == "rep" and node.high is None:
        item = node.items[0]
        if item.kind == "class" and (item.extra or any(a <= 10 <= b for a, b in item.ranges) != item.negated):
            return False
        if item.kind not in _ONE_CHAR:
            return False
    return all(stays_in_line(x) for x in node.items)


# -- measures --------------------------------------------------------------


def width(node: Node) -> int:
    """Characters in the longest match, counting an unbounded repeat once."""
    k = node.kind
    if k in ("lit", "class", "any"):
        return 1
    if k == "cat":
        return sum(width(x) for x in node.items)
    if k == "alt":
        return max(width(x) for x in node.items)
    if k == "group":
        return width(node.items[0])
    if k == "rep":
        return width(node.items[0]) * (max(node.low, 1) if node.high is None else node.high)
    return 0


def program_size(node: Node) -> int:
    """About how many instructions an automaton for the pattern has."""
    k = node.kind
    if k in ("cat", "alt"):
        return sum(program_size(x) for x in node.items) + (len(node.items) - 1 if k == "alt" else 0)
    if k == "group":
        return program_size(node.items[0]) + (0 if node.lazy else 2)
    if k == "rep":
        copies = max(node.low, 1) if node.high is None else max(node.high, 0)
        return program_size(node.items[0]) * copies + max(1, (node.high or node.low) - node.low + 1)
    if k == "class":
        return max(1, math.ceil((len(node.ranges) + 4 * len(node.extra)) / 1))
    return 1


def guard(nodes: list[Node], label: str, widest: int | None = MAX_WIDTH) -> None:
    if sum(program_size(n) for n in nodes) > MAX_PROGRAM or (widest is not None and any(width(n) > widest for n in nodes)):
        raise QueryError("the pattern is too large", label)


def can_be_empty(node: Node) -> bool:
    k = node.kind
    if k in ("lit", "class", "any"):
        return False
    if k == "cat":
        return all(can_be_empty(x) for x in node.items)
    if k == "alt":
        return any(can_be_empty(x) for x in node.items)
    if k == "group":
        return can_be_empty(node.items[0])
    if k == "rep":
        return node.low == 0 or can_be_empty(node.items[0])
    return True


def kinds(node: Node) -> set[str]:
    return {node.kind}.union(*(kinds(x) for x in node.items)) if node.items else {node.kind}


def unbounded(node: Node) -> int:
    own = 1 if node.kind == "rep" and node.high is None else 0
    return own + sum(unbounded(x) for x in node.items)


def chain(node: Node) -> list[Node] | None:
    """The pieces of ``p.*q.*r...`` where each has one fixed length and no choice
    of length, so that taking each piece at its earliest place decides whether
    the pattern matches at all; None for any other pattern."""
    items = node.items if node.kind == "cat" else ()
    pieces: list[list[Node]] = [[]]
    for x in items:
        if x.kind == "rep" and x.items[0].kind == "any" and x.low == 0 and x.high is None and not x.lazy:
            pieces.append([])
        elif x.kind in ("lit", "class"):
            pieces[-1].append(x)
        else:
            return None
    if len(pieces) < 3 or any(not p for p in pieces):
        return None
    return [Node("cat", tuple(p)) for p in pieces]


def tail(node: Node) -> int | None:
    """How many of the last characters of a text tell whether the pattern matches, if
    it must end where the text does and has a greatest width: those, one that a word
    boundary looks back to, and a line feed that ends the text; None for any other pattern."""
    if node.kind != "cat" or node.items[-1].kind not in ("eol", "end") or unbounded(node) or {"bol", "begin"} & kinds(node):
        return None
    return width(node) + 2
