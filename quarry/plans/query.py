"""Search queries: the record, the mini-language, and request parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..functions.regex import QueryError, quote

DEFAULT_LIMIT, DEFAULT_CONTEXT = 50, 3


@dataclass(frozen=True)
class Query:
    line: str = ""
    file: tuple[str, ...] = ()
    repo: str = ""
    tags: str = ""
    fold_case: bool = False
    not_file: tuple[str, ...] = ()
    not_repo: str = ""
    not_tags: str = ""
    max_matches: int = 0
    filename_only: bool = False
    context_lines: int = 0
    #: names for ``repo[]``; they count only if ``repo`` is empty
    repos: tuple[str, ...] = field(default=())


OPERATORS = frozenset("file -file path -path repo -repo tags -tags case lit max_matches".split())
_NAME = re.compile(r"([A-Za-z0-9_-]+):")
_STOP = re.compile(r"[\[( ]|\\.", re.S)


def has_upper(*patterns: str) -> bool:
    return any("A" <= c <= "Z" for p in patterns for c in p)


def _balanced(text: str, at: int, opening: str) -> int:
    """Where the group that was opened just before ``at`` ends, or the end of the text."""
    closing, depth = {"(": ")", "[": "]"}[opening], 1
    while at < len(text):
        c = text[at]
        at += 1
        if c == "\\":
            at += 1
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if depth == 0:
                break
    return min(at, len(text))


def tokenize(text: str, regex: bool) -> dict[str, list[str]]:
    """Values by operator; the main term is under the empty name.

    An operator is a known name and a colon where the last token ended; a space
    ends its value.  Groups in parentheses or brackets are taken whole in regex
    mode, and in literal mode where they follow a space.
    """
    text = text.strip()
    found: dict[str, list[str]] = {}
    name, value, at, in_regex, after_space = "", "", 0, regex, True
    while True:
        head = _NAME.match(text, at)
        stop = _STOP.search(text, at)
        if head is not None and (stop is None or head.start() <= stop.start()):
            token, kind = head, "name"
        elif stop is not None:
            token, kind = stop, stop.group()
        else:
            found.setdefault(name, []).append(value + text[at:])
            return found
        value += text[at : token.start()]
        after_space = after_space and token.start() == at
        at = token.end()
        if kind == "name":
            if name == "" and token.group(1) in OPERATORS:
                if value.strip():
                    found.setdefault("", []).append(value)
                name, value = token.group(1), ""
            else:
                value += token.group()
            if name == "lit":
                in_regex = False
        elif kind == " ":
            if name:
                found.setdefault(name, []).append(value)
                name, value, in_regex = "", "", regex
            else:
                value += " "
        elif kind in "([" and (in_regex or after_space):
            end = _balanced(text, at, kind)
            value += kind + text[at:end]
            at = end
        else:
            value += kind
        after_space = kind == " "


def parse(text: str, regex: bool = True) -> Query:
    """The query that a line of the mini-language stands for."""
    ops = tokenize(text, regex)
    if len(ops.get("", ())) > 1:
        raise QueryError("the main search term must be in one piece")

    def only(name: str) -> str:
        values = ops.get(name, [])
        if len(values) > 1:
            raise QueryError(f"more than one value for {name}:")
        return values[0] if values else ""

    plain = (lambda s: s) if regex else quote
    terms = []
    for name in ("", "case", "lit"):
        if name in ops:
            term = ops[name][0].strip()
            terms.append(quote(term) if name == "lit" or not regex else term)
    terms = [t for t in terms if t]
    if len(terms) > 1:
        raise QueryError("case:, lit: and a bare pattern exclude each other")
    line = terms[0] if terms else ""
    files = tuple(plain(f) for f in ops.get("file", []) + ops.get("path", []))
    limit = ops.get("max_matches", [""])[0]
    if limit and not re.fullmatch(r"[+-]?\d+", limit, re.ASCII):
        raise QueryError("max_matches: must be an integer")
    names_only = not line and bool(files)
    if names_only:
        line = files[0]
    return Query(
        line=line,
        file=files,
        repo=plain(only("repo")),
        tags=only("tags"),
        not_file=tuple(plain(f) for f in ops.get("-file", []) + ops.get("-path", [])),
        not_repo=plain(only("-repo")),
        not_tags=only("-tags"),
        max_matches=int(limit) if limit else 0,
        filename_only=names_only,
        fold_case=not ("case" in ops or "lit" in ops) and not has_upper(line),
    )


def from_params(params: dict[str, list[str]], default_limit: int = 0) -> Query:
    """A query from request parameters: ``q``, or the separate fields ``line``,
    ``file`` (any number), ``repo``, ``repo[]``, ``fold_case``, with ``regex``."""
    regex = params.get("regex", ["true"])[0] != "false"
    plain = (lambda s: s) if regex else quote
    q = parse(params["q"][0], regex) if "q" in params else Query()
    if "line" in params:
        q = replace(q, line=plain(params["line"][0]))
    if "file" in params:
        q = replace(q, file=tuple(plain(f) for f in params["file"]))
    if "repo" in params:
        q = replace(q, repo=plain(params["repo"][0]))
    if not q.repo and "repo[]" in params:
        q = replace(q, repos=tuple(params["repo[]"]))
    if "fold_case" in params:
        fold = params["fold_case"][0]
        q = replace(q, fold_case={"true": True, "false": False}.get(fold, not has_upper(q.line)))
    if not q.line:
        raise QueryError("the query has no pattern")
    return replace(q, max_matches=q.max_matches or default_limit)


def effective_limit(q: Query, default: int = DEFAULT_LIMIT) -> int | None:
    """None: no limit."""
    return None if q.max_matches < 0 else q.max_matches or default


def effective_context(q: Query, default: int = DEFAULT_CONTEXT) -> int:
    return q.context_lines if q.context_lines > 0 else default
