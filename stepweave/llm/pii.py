"""Format-preserving pseudonyms for personal data.

A value that passes its check (Luhn, mod 97, octets, calendar, numbering plan)
is mapped to a number below the count of valid values of its format, permuted
there by a keyed Feistel network, and written back in the same format.  Equal
values of a kind get equal pseudonyms in every document and every written form
(dates, cards, addresses), different values different ones, and who has the key
can undo it.  A date keeps its shape: a day below 10, up to 12 or beyond, a
month below 10 or not, and May.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROUNDS = 10
#: Stands in where the session names no key, for demonstrations and tests: who reads it can undo the pseudonyms.
DEMO_KEY = b"stepweave pseudonyms, demonstration key"
KEY_SETTING = "spark.stepweave.pseudonymKey"


class Feistel:
    """A keyed permutation of 0..n-1 for any n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, r: int, x: int, w: int) -> int:
        size = (w.bit_length() + 7) // 8 + 8
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(f"{tweak}|{r}|{x}|{w}|{block}".encode(), key=self.key).digest()
            block += 1
        return int.from_bytes(out[:size], "big") % w

    def permute(self, x: int, n: int, tweak: str, undo: bool = False) -> int:
        """The image of x; outside 0..n-1 the network, which permutes a square of at least n, is walked on."""
        if n < 2:
            return x
        w = math.isqrt(n - 1) + 1
        while True:
            a, b = divmod(x, w)
            if undo:
                for r in reversed(range(ROUNDS)):
                    a, b = (b - self._round(tweak, r, a, w)) % w, a
            else:
                for r in range(ROUNDS):
                    a, b = b, (a + self._round(tweak, r, b, w)) % w
            x = a * w + b
            if x < n:
                return x


def luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        if i % 2 == 0:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return -total % 10


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _fill(shape: str, digits: str) -> str:
    """The digits of ``shape`` replaced in order, all else kept."""
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), shape)


# Each kind: value -> replaced value, or None where the value isn't valid. ``p`` permutes (x, n).
Permute = Callable[[int, int], int]


def _card(s: str, p: Permute) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]):
        return None
    n = len(d) - 2  # the first digit tells the scheme, the last checks
    body = d[0] + str(p(int(d[1:-1]), 10**n)).zfill(n)
    return _fill(s, body + str(luhn(body)))


def _walk(x: int, n: int, ok: Callable[[int], bool], p: Permute) -> int:
    x = p(x, n)
    while not ok(x):
        x = p(x, n)
    return x


def _phone(s: str, p: Permute) -> str | None:
    """A plus or brackets mark a number even outside the numbering plan; such numbers stay among themselves."""
    d, plus = _digits(s), s.lstrip().startswith("+")
    if plus and not d.startswith("1"):  # the country's digits stay
        return _fill(s, d[:2] + str(p(int(d[2:]), 10 ** (len(d) - 2))).zfill(len(d) - 2)) if 8 <= len(d) <= 15 else None
    lead, d = ("1", d[1:]) if len(d) == 11 and d[0] == "1" else ("", d)

    def ok(x: int) -> bool:
        t = str(x).zfill(10)
        return t[0] > "1" and t[3] > "1"

    if len(d) != 10 or not (ok(int(d)) or plus or "(" in s):
        return None
    planned = ok(int(d))
    return _fill(s, lead + str(_walk(int(d), 10**10, lambda x: ok(x) == planned, p)).zfill(10))


def _ip(s: str, p: Permute) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    x = p(int.from_bytes(bytes(parts), "big"), 2**32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(s: str, p: Permute) -> str | None:
    def ok(x: int) -> bool:
        t = str(x).zfill(9)
        return t[:3] not in ("000", "666") and t[0] != "9" and t[3:5] != "00" and t[5:] != "0000"

    x = int(_digits(s))
    return _fill(s, str(_walk(x, 10**9, ok, p)).zfill(9)) if ok(x) else None


_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


# English names of months.
MONTHS = "January February March April May June July August September October November December".split()


def _shape(n: int) -> tuple[bool, ...]:
    """What a date's written forms tell of it: a day below 10 or above 12, a month below 10, or May, which is short and long at once."""
    t = datetime.date.fromordinal(n + _DAY0)
    return t.day < 10, t.day > 12, t.month < 10, t.month == 5


def _date(s: str, p: Permute) -> str | None:
    """year-month-day, day.month.year, month/day/year where that is a date, else day/month/year, and days with the month's name.

    All forms of a day share one permutation, so they stay linked.  It keeps the
    shape of a date, hence every form its length, with zeros or without.
    """
    named = re.search("[A-Za-z]+", s)
    numbers = re.findall("[0-9]+", s)
    if named:
        day, year = (int(x) for x in numbers)
        ymd = [(year, [m[:3] for m in MONTHS].index(named[0][:3].title()) + 1, day)]
    else:
        a, b, c = (int(x) for x in numbers)
        ymd = [(a, b, c)] if len(numbers[0]) == 4 else [(c, b, a)] if "." in s else [(c, a, b), (c, b, a)]
    for late, (y, m, d) in enumerate(ymd):
        try:
            x = datetime.date(y, m, d).toordinal() - _DAY0
        except ValueError:
            continue
        if not 0 <= x < _DAYS:
            continue
        t = datetime.date.fromordinal(_walk(x, _DAYS, lambda n: _shape(n) == _shape(x), p) + _DAY0)
        if named:
            name = MONTHS[t.month - 1]
            name = name if len(named[0]) > 3 else name[:3]
            out = iter([t.day, t.year])
            parts = re.split("([0-9]+|[A-Za-z]+)", s)
            return "".join(name if x.isalpha() else str(next(out)).zfill(len(x)) if x.isdigit() else x for x in parts)
        order = (t.year, t.month, t.day) if len(numbers[0]) == 4 else (t.day, t.month, t.year) if "." in s or late else (t.month, t.day, t.year)
        out = iter(order)
        return re.sub("[0-9]+", lambda m: str(next(out)).zfill(len(m[0])), s)
    return None


def _ip6(s: str, p: Permute) -> str | None:
    """Written in full where it was, else in the short form; so an address stays linked however it is written."""
    try:
        x = int(ipaddress.IPv6Address(s))
    except ValueError:
        return None
    if "::" in s and (len(re.findall("[0-9A-Fa-f]+", s)) < 3 or not re.search("[0-9]", s)):
        return None  # rather a name in a program
    new = ipaddress.IPv6Address(p(x, 2**128))
    full = all(len(g) == 4 for g in s.split(":"))
    return new.exploded if full else new.compressed


def _key(s: str, p: Permute) -> str:
    """The issuer's prefix stays."""
    lead = re.match("AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-", s)[0]
    return lead + _classes(s[len(lead) :], p)


def _classes(s: str, p: Permute) -> str:
    """Letters stay letters of their case, digits digits, all else as it is."""
    n, x, kinds = 1, 0, []
    for c in s:
        base, size = ("0", 10) if "0" <= c <= "9" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("", 1)
        kinds.append((base, size))
        if size > 1:
            x, n = x * size + ord(c) - ord(base), n * size
    x, out = p(x, n), []
    for c, (base, size) in zip(reversed(s), reversed(kinds), strict=True):
        if size > 1:
            x, v = divmod(x, size)
            c = chr(ord(base) + v)
        out.append(c)
    return "".join(reversed(out))


def _hex(s: str, p: Permute) -> str:
    if re.fullmatch("[0-9a-f]+", s) and not s.isdigit():
        return format(p(int(s, 16), 16 ** len(s)), f"0{len(s)}x")
    return _classes(s, p)


def _email(s: str, p: Permute) -> str:
    name, _, host = s.rpartition("@")
    return f"{_classes(name, p)}@{host}"


def _iban(s: str, p: Permute) -> str | None:
    flat = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _classes(flat[4:], p)
    out = iter(flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(out) for c in s)


# The usual forms go before looser ones, so that a number beside a card or phone isn't taken as a part of it
# (but for four digits right before a card in groups of four).
_USUAL_CARD = r"(?:[0-9]{13,19}|[0-9]{4}(?:(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})|[0-9]{4}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{5})(?![0-9])"
_USUAL_PHONE = r"(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
_NOT_BESIDE = rf"(?!{_USUAL_PHONE}|[0-9]{{1,6}}[ -](?:{_USUAL_CARD}|{_USUAL_PHONE}))"
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + ")"
#: Kind, pattern, function. Earlier kinds go first where several begin at one place.
KINDS = (
    ("key", r"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z_-]{20,})(?![0-9A-Za-z])", _key),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", _iban),
    ("ip6", r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}:){1,7}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])", _ip6),
    ("ip", r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])", _ip),
    ("card", rf"(?<![0-9A-Za-z.-])(?:{_USUAL_CARD}|{_NOT_BESIDE}[0-9](?:[ -]?[0-9]){{12,18}})(?![0-9A-Za-z]|[.-][0-9])", _card),
    ("ssn", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])", _ssn),
    ("date", r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|%MONTH% [0-9]{1,2},? [0-9]{4}|[0-9]{1,2} %MONTH%,? [0-9]{4})(?![0-9A-Za-z]|[./-][0-9])".replace("%MONTH%", _MONTH), _date),
    ("phone", rf"(?<![0-9A-Za-z.])(?:(?:\+?1[ .-]?)?{_USUAL_PHONE}|{_NOT_BESIDE}(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})(?:[ .-]?[0-9]{{2,4}}){{2,4}})(?![0-9A-Za-z]|[.-][0-9])", _phone),
)
_SECRET = re.compile(r"(?i)(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\s?[=:]\s?[\"']?([A-Za-z0-9_+/-]{8,})")
_WORTH = re.compile(r"[0-9@=]")


class Pseudonyms:
    def __init__(self, key: bytes = DEMO_KEY):
        self.feistel = Feistel(key)
        self.pattern = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in KINDS))
        self.of = {name: function for name, _, function in KINDS}
        self.one = functools.lru_cache(1 << 16)(self._one)

    def _one(self, kind: str, value: str, undo: bool) -> str | None:
        return self.of.get(kind, _hex)(value, lambda x, n: self.feistel.permute(x, n, kind, undo))

    def text(self, text: str | None, undo: bool = False) -> tuple[str | None, list[str]]:
        """The text with pseudonyms, and the kind of each value found, sorted."""
        if not text or not _WORTH.search(text):
            return text, []
        kinds: list[str] = []

        def put(m: re.Match) -> str:
            new = self.one(m.lastgroup, m[0], undo)
            if new is None:
                return m[0]
            kinds.append(m.lastgroup)
            return new

        def hide(m: re.Match) -> str:
            kinds.append("secret")
            a, b = m.span(1)
            return text[m.start() : a] + self.one("secret", m[1], undo) + text[b : m.end()]

        if "=" in text or ":" in text:
            out, at = [], 0
            for m in _SECRET.finditer(text):  # kept apart, so that no other kind is sought inside
                out += [self.pattern.sub(put, text[at : m.start()]), hide(m)]
                at = m.end()
            out.append(self.pattern.sub(put, text[at:]))
            return "".join(out), sorted(kinds)
        return self.pattern.sub(put, text), sorted(kinds)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's settings name, else the one for demonstrations."""
    found = spark.conf.get(KEY_SETTING, None)
    return found.encode() if found else DEMO_KEY


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``, and n_pii (long) and pii_kinds (distinct, sorted, comma-joined).

    One row for each input row, all columns kept; input columns named n_pii or
    pii_kinds are replaced.  Null and empty texts stay as they are, with n_pii
    0.  Texts are handled whole, each by itself, so nothing is shuffled and
    equal values agree across tasks by the key alone.
    """
    names = [c for c in docs.columns if c not in ("n_pii", "pii_kinds")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = StructType([*docs.schema.fields, StructField("n_pii", LongType()), StructField("pii_kinds", StringType())])
    at = names.index(text_col)

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for batch in batches:
            done = [p.text(t, undo) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(k) for _, k in done], pa.int64()), pa.array([",".join(sorted(set(k))) for _, k in done], pa.string())], names=[*names, "n_pii", "pii_kinds"])

    return docs.mapInArrow(hide, schema)
