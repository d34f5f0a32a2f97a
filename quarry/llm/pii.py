"""Operator 1: format-preserving pseudonyms by keyed Feistel permutations.

Numbers and dates that pass their validation (card numbers by Luhn, IBANs by
mod 97, octets of addresses, areas of social security numbers, real calendar
dates, phone lengths), addresses of mail and hexadecimal secrets are permuted
inside the set of values of the same format.  The permutation depends on the key
and the kind alone, so equal values stay equal across documents, distinct ones
stay distinct, and who has the key can invert it.  What fails validation stays.

A date has one pseudonym in all notations, and a phone number one in all
spacings, with or without its country's code.  So that each notation can be read
back, a date stays among those whose day is as it was under 10, up to 12 or over
12 and whose month is under 10 or not; padding with zeros stays as it is.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 10
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Permutations of range(n) for any n: alternating Feistel rounds on a pair
    of residues, walking cycles until the value lies in the range (and in the
    wanted subset)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, i: int, x: int) -> int:
        data = f"{kind}|{n}|{i}|{x}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def _once(self, x: int, n: int, kind: str, back: bool) -> int:
        a = math.isqrt(n - 1) + 1 if n > 1 else 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * self._round(kind, n, i, right)) % a
            else:
                right = (right + sign * self._round(kind, n, i, left)) % b
        return left * b + right

    def permute(self, x: int, n: int, kind: str, allowed: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        while True:
            x = self._once(x, n, kind, back)
            if x < n and allowed(x):
                return x


def luhn_digit(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _fill(shape: str, chars: str, is_slot: Callable[[str], bool]) -> str:
    it = iter(chars)
    return "".join(next(it) if is_slot(c) else c for c in shape)


def _card(f: Feistel, s: str, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or d[0] == "0" or luhn_digit(d[:-1]) != int(d[-1]):
        return None
    n = len(d) - 1
    body = str(f.permute(int(d[:-1]), 10**n, f"card{n}", lambda x: x >= 10 ** (n - 1), back)).zfill(n)
    return _fill(s, body + str(luhn_digit(body)), str.isdigit)


#: Country codes of two digits; 1 and 7 have one, all others three.
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _country(digits: str) -> str:
    return digits[:1] if digits[:1] in ("1", "7") else digits[:2] if digits[:2] in _TWO else digits[:3]


def _phone(f: Feistel, s: str, back: bool) -> str | None:
    """The digits after the country's code; ten digits in American notation have code 1."""
    d = re.sub(r"\D", "", s)
    head = 0
    if s[0] == "+" or s.startswith("00"):
        head = 2 * (s[0] != "+")
        code = _country(d[head:])
        head += len(code)
    else:
        code = "1"
    n = len(d) - head
    if not 7 <= n <= 13 or code[:1] == "0":
        return None
    first = d[head] == "0"
    x = f.permute(int(d[head:]), 10**n, f"phone{code}-{n}", lambda v: (v < 10 ** (n - 1)) == first, back)
    return _fill(s, d[:head] + str(x).zfill(n), str.isdigit)


def _ip(f: Feistel, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = 0
    for p in parts:
        x = x * 256 + int(p)
    y = f.permute(x, 1 << 32, "ip", back=back)
    return ".".join(str(y >> k & 255) for k in (24, 16, 8, 0))


def _ssn_ok(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(f: Feistel, s: str, back: bool) -> str | None:
    x = int(s.replace("-", ""))
    if not _ssn_ok(x):
        return None
    return _fill(s, str(f.permute(x, 10**9, "ssn", _ssn_ok, back)).zfill(9), str.isdigit)


def _day(y: int, m: int, d: int) -> int | None:
    try:
        n = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    return n - _FIRST if _FIRST <= n <= _LAST else None


def _cell(n: int) -> tuple[bool, bool, bool]:
    """What of a date its notations depend on: how many digits day and month have, and whether the day can be a month."""
    d = datetime.date.fromordinal(_FIRST + n)
    return d.day < 10, d.day > 12, d.month < 10


def _shift_day(f: Feistel, n: int, back: bool) -> datetime.date:
    cell = _cell(n)
    return datetime.date.fromordinal(_FIRST + f.permute(n, _LAST - _FIRST + 1, "date", lambda v: _cell(v) == cell, back))


def _iso_date(f: Feistel, s: str, back: bool) -> str | None:
    n = _day(int(s[:4]), int(s[5:7]), int(s[8:]))
    return None if n is None else _shift_day(f, n, back).isoformat()


def _other_date(f: Feistel, s: str, back: bool) -> str | None:
    """d.m.y for dots; m/d/y for slashes, or d/m/y where that alone is a date."""
    sep = "." if "." in s else "/"
    one, two, year = s.split(sep)
    month_first = sep == "/" and _day(int(year), int(one), int(two)) is not None
    n = _day(int(year), int(one), int(two)) if month_first else _day(int(year), int(two), int(one))
    if n is None:
        return None
    day = _shift_day(f, n, back)
    new = (day.month, day.day) if month_first else (day.day, day.month)
    return sep.join([*(str(x).zfill(len(old)) for x, old in zip(new, (one, two))), str(day.year)])


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _is_iban(s: str) -> bool:
    c = s.replace(" ", "")
    return 15 <= len(c) <= 34 and bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", c)) and _iban_check(c[:2], c[4:]) == int(c[2:4])


def _iban(f: Feistel, s: str, back: bool) -> str | None:
    c = s.replace(" ", "")
    if not _is_iban(s):
        return None
    body = _mixed(f, c[4:], f"iban{c[:2]}", back)
    return _fill(s, f"{c[:2]}{_iban_check(c[:2], body):02d}{body}", lambda x: x != " ")


def _mixed(f: Feistel, s: str, kind: str, back: bool) -> str:
    """Permute digits, small and capital letters in place; other characters stay."""
    sets = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    slots = [(i, a) for i, ch in enumerate(s) for a in sets if ch in a]
    if not slots:
        return s
    n, x = 1, 0
    for i, a in slots:
        x, n = x * len(a) + a.index(s[i]), n * len(a)
    shape = "".join("01A"[sets.index(a)] for _, a in slots)
    y = f.permute(x, n, f"{kind}{shape}", back=back)
    out = list(s)
    for i, a in reversed(slots):
        y, r = divmod(y, len(a))
        out[i] = a[r]
    return "".join(out)


def _email(f: Feistel, s: str, back: bool) -> str | None:
    local, _, domain = s.rpartition("@")
    return f"{_mixed(f, local, 'mail', back)}@{domain}"


def _secret(f: Feistel, s: str, back: bool) -> str | None:
    if s.isdigit() or s.isalpha():
        return None
    alphabet = "0123456789ABCDEF" if re.search("[A-F]", s) else "0123456789abcdef"

    def mixed(x: int) -> bool:  # what would be read as another kind is left out
        h = format(x, f"0{len(s)}x")
        return not (h.isdigit() or h.isalpha() or _is_iban(h.upper()))

    if _is_iban(s.upper()):
        return None
    y = format(f.permute(int(s, 16), 16 ** len(s), f"hex{len(s)}", mixed, back), f"0{len(s)}x")
    return y.upper() if "A" in alphabet else y


_KINDS = {
    "iso": (r"\d{4}-\d{2}-\d{2}", _iso_date),
    "date": (r"\d{1,2}(?:/\d{1,2}/|\.\d{1,2}\.)(?:19|20)\d{2}", _other_date),
    "ip": (r"\d{1,3}(?:\.\d{1,3}){3}", _ip),
    "ssn": (r"\d{3}-\d{2}-\d{4}", _ssn),
    "phone": (r"(?:\+|00(?=[1-9]))\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ -]?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}", _phone),
    "card": (r"\d(?:[ -]?\d){12,18}", _card),
    "iban": (r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _iban),
    "hex": (r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})", _secret),
}
_END = r"(?![\w@]|[.-]\d|/\d)"
_NUMBER = re.compile(r"(?<![\w.@/-])(?=[+(\dA-Fa-f]|[A-Z]{2}\d)(?:" + "|".join(f"(?P<{k}>{p})" for k, (p, _) in _KINDS.items()) + ")" + _END, re.ASCII)
_EACH = {k: re.compile(p + _END, re.ASCII) for k, (p, _) in _KINDS.items()}
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])")
_DIGIT = re.compile(r"\d", re.ASCII)


def rewrite(text: str, f: Feistel, back: bool = False) -> tuple[str, int]:
    """The text with pseudonyms (or, ``back``, the originals), and how many there are."""
    count = 0

    def numbers() -> Iterator[str]:
        nonlocal count
        at = 0
        for m in iter(lambda: _NUMBER.search(text, at), None):
            yield text[at : m.start()]
            at, kinds, shown = m.end(), list(_KINDS), m.group()
            for kind in kinds[kinds.index(m.lastgroup) :]:  # what is no value of the first kind may be one of a later
                own = m if kind == m.lastgroup else _EACH[kind].match(text, m.start())
                y = own and _KINDS[kind][1](f, own.group(), back)
                if y:
                    count += 1
                    at, shown = own.end(), y
                    break
            yield shown
        yield text[at:]

    def mail(m: re.Match) -> str:
        nonlocal count
        count += 1
        return _email(f, m.group(), back)

    if "@" in text:
        text = _MAIL.sub(mail, text)
    if _DIGIT.search(text):
        text = "".join(numbers())
    return text, count


def pseudonymise(docs: DataFrame, *, text_col: str = "text", key: str | None = None, count_col: str = "pseudonyms") -> DataFrame:
    """``docs`` with pseudonyms in its text and their number in ``count_col``.

    ``key`` defaults to the environment's QUARRY_PII_KEY; without either it raises
    ValueError, as a known key would let anyone invert the result.  A null text stays null with a count of 0, an empty one empty.  Ids
    are not looked at, so null ids and repeated rows change like any others (and
    repeated rows alike).  Other columns pass through; an existing ``count_col``
    is replaced.  An empty table gives an empty table.
    """
    secret = (key or os.environ.get("QUARRY_PII_KEY", "")).encode()
    if not secret:
        raise ValueError("give a key, or set QUARRY_PII_KEY")
    keep = [c for c in docs.columns if c.lower() != count_col.lower()]
    at = keep.index(text_col)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(count_col, T.IntegerType())])
    schema.fields[at] = T.StructField(text_col, T.StringType(), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(secret)
        for batch in batches:
            done = [(None, 0) if t is None else rewrite(t, f) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int32())], names=[*keep, count_col])

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)
