"""Personal data replaced by format-preserving Feistel pseudonyms.

Candidates are found by one pattern and validated: Luhn for card numbers, octet ranges for addresses, calendar for dates, area
rules for social security numbers, remainder 97 for IBANs. If a card or IBAN candidate fails, the runs of its tokens are tried, the longest
first, and then the search goes on one token later. A valid value is numbered within all values of its
format, the number is permuted by a keyed Feistel network with cycle walking, and the result is written in the same format. So
equal values have equal pseudonyms in every document, whatever separators or order of parts they are written with, different values
have different ones, and a text keeps its length: days of a calendar are permuted among those whose day and month have as
many digits, and phone numbers without their country code. With the key the permutation can be undone. The key is the session's setting
``spark.tessella.pseudonymKey``; KEY serves tests and sessions that name none.

Everything happens inside the row; texts without a digit or ``@`` are passed on after one scan of their bytes.

Defined cases: null text stays null and empty text empty, with no values found; values that fail their check are left alone; repeated
rows are treated one by one; texts of any length are treated whole; an empty table gives an empty result; columns named n_<kind> are
replaced if counts are asked for, others carried along.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from calendar import monthrange
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = b"tessella pseudonyms 1"
ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date", "secret", "token", "ip6")

#: One alternative per kind; the first that matches at a place is validated.
_PATTERN = re.compile(
    r"(?P<email>[^\s@<>\"'(),;:|*#$%&]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?<![0-9A-Za-z])[0-9a-fA-F]{24,}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{2}\6[0-9]{2}|[0-9]{1,2}([-/.])[0-9]{1,2}\7[0-9]{4})(?![0-9]))"
    r"|(?P<ssn>(?<![0-9-])(?<![0-9] )[0-9]{3}([- ])[0-9]{2}\9[0-9]{4}(?![0-9-])(?! [0-9]))"
    r"|(?P<phone>(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9]))"
    r"|(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
    r"|(?P<token>(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}|xox[abprs]-[0-9A-Za-z-]{10,})(?![0-9A-Za-z]))"
    r"|(?P<ip6>(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]))"
)
#: Kinds whose candidates run over spaces or hyphens into what stands beside a value: a token, and the characters a value may have.
_TOKENS = {"card": (re.compile("[0-9]+"), " -", 13, 19), "iban": (re.compile("[0-9A-Z]+"), " ", 15, 34)}
#: Country calling codes of one and of two digits; all others have three.
_CODES = {"1", "7"} | set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_MORE = re.compile("[ -][0-9]")
_IBAN_START = re.compile("[A-Z]{2}[0-9]{2}")
_DIGITS = b"0123456789@"


def feistel(x: int, size: int, tweak: bytes, key: bytes = KEY, undo: bool = False) -> int:
    """A keyed permutation of range(size): balanced Feistel rounds on the next even number of bits, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def mix(r: int, v: int) -> int:
        return int.from_bytes(blake2b(v.to_bytes(width, "big"), key=key, person=bytes([r]), salt=blake2b(tweak, digest_size=16).digest(), digest_size=width).digest(), "big") & mask

    while True:
        a, b = x >> half, x & mask
        for r in range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS):
            a, b = (b ^ mix(r, a), a) if undo else (b, a ^ mix(r, b))
        x = a << half | b
        if x < size:
            return x


def luhn_digit(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _refill(shape: str, symbols: str, part: Callable[[str], bool]) -> str:
    """``shape`` with the characters that ``part`` accepts replaced by ``symbols`` in turn."""
    it = iter(symbols)
    return "".join(next(it) if part(c) else c for c in shape)


@lru_cache(1)
def _calendar() -> dict[tuple[int, int], list[date]]:
    """All days by how their day and month are written: of one digit, of two up to twelve, or (days only) beyond, which no month can be."""
    out: dict[tuple[int, int], list[date]] = {}
    for x in range((LAST_DAY - FIRST_DAY).days + 1):
        day = FIRST_DAY + timedelta(days=x)
        out.setdefault(_written(day), []).append(day)
    return out


def _written(day: date) -> tuple[int, int]:
    return (day.day > 9) + (day.day > 12), day.month > 9


class Pseudonyms:
    """One method per kind: the pseudonym of a value, or None if the value is not valid."""

    def __init__(self, key: bytes = KEY, undo: bool = False):
        self.key, self.undo = key, undo
        self.of = lru_cache(65_536)(self._of)

    def _of(self, kind: str, value: str) -> str | None:
        return getattr(self, kind)(value)

    def _walk(self, x: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        while True:
            x = feistel(x, size, tweak.encode(), self.key, self.undo)
            if valid(x):
                return x

    def card(self, value: str) -> str | None:
        digits = re.sub("[^0-9]", "", value)
        if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        n = len(digits) - 1
        new = str(self._walk(int(digits[:-1]), 10**n, f"card{n}", lambda x: len(set(str(x).zfill(n))) > 1)).zfill(n)
        return _refill(value, new + str(luhn_digit(new)), str.isdigit)

    def phone(self, value: str) -> str | None:
        """The number without its country code, which is told from the digits alone, so that all ways to write it agree."""
        digits = re.sub("[^0-9]", "", value)
        code = next((n for n in (1, 2) if digits[:n] in _CODES), 3) if value[0] == "+" else 0
        own = digits[code:]
        if not 7 <= len(own) <= 15:
            return None
        new = digits[:code] + str(self._walk(int(own), 10 ** len(own), f"phone{len(own)}")).zfill(len(own))
        return _refill(value, new, str.isdigit)

    def ip(self, value: str) -> str | None:
        """Within the addresses whose octets have as many digits each, so that the text keeps its length."""
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        first = {1: 0, 2: 10, 3: 100}
        count = {1: 10, 2: 90, 3: 156}
        x, size = 0, 1
        for p in parts:
            x, size = x * count[len(p)] + int(p) - first[len(p)], size * count[len(p)]
        x = self._walk(x, size, "ip" + "".join(str(len(p)) for p in parts))
        out = []
        for p in reversed(parts):
            x, r = divmod(x, count[len(p)])
            out.append(str(first[len(p)] + r))
        return ".".join(reversed(out))

    def ssn(self, value: str) -> str | None:
        def valid(x: int) -> bool:
            return 0 < x // 1_000_000 < 900 and x // 1_000_000 != 666 and x // 10_000 % 100 > 0 and x % 10_000 > 0

        x = int(re.sub("[- ]", "", value))
        return _refill(value, str(self._walk(x, 10**9, "ssn", valid)).zfill(9), str.isdigit) if valid(x) else None

    def date(self, value: str) -> str | None:
        """Day, month and year are put back in the order read; days that only a month-first reading allows stay such days."""
        parts = re.split("[-/.]", value)
        year_first = len(parts[0]) == 4
        orders = [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]  # day first unless only the month can come first
        for order in orders:
            y, m, d = (int(parts[i]) for i in order)
            if FIRST_DAY.year <= y <= LAST_DAY.year and 1 <= m <= 12 and 1 <= d <= monthrange(y, m)[1]:
                break
        else:
            return None
        kind = _written(date(y, m, d))
        days = _calendar()[kind]
        new = days[self._walk(bisect_left(days, date(y, m, d)), len(days), f"date{kind}")]
        at = {order[0]: str(new.year), order[1]: str(new.month), order[2]: str(new.day)}
        return _refill(value, "".join(at[i].zfill(len(parts[i])) for i in range(3)), str.isdigit)

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._mixed(plain[4:], "iban" + plain[:2])
        check = 98 - number(body + plain[:2] + "00") % 97
        return _refill(value, plain[:2] + f"{check:02d}" + body, lambda c: c != " ")

    def _mixed(self, value: str, tweak: str) -> str:
        """Permute within the words of one shape: digits, small and capital letters stay what they are."""
        sets = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        kind = lambda c: "0" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else ""
        shape = "".join(kind(c) for c in value)
        x, size = 0, 1
        for c in value:
            if k := kind(c):
                x, size = x * len(sets[k]) + sets[k].index(c), size * len(sets[k])
        if size == 1:
            return value
        x = self._walk(x, size, tweak + shape)
        out = []
        for k in reversed(shape):
            x, r = divmod(x, len(sets[k]))
            out.append(sets[k][r])
        return _refill(value, "".join(reversed(out)), lambda c: bool(kind(c)))

    def email(self, value: str) -> str | None:
        local, _, domain = value.rpartition("@")
        return f"{self._mixed(local, 'email')}@{domain}"

    def token(self, value: str) -> str | None:
        """Access keys with a known beginning, which stays."""
        head = re.match("AKIA|gh[pousr]_|sk-|xox[abprs]-", value).group()
        return head + self._mixed(value[len(head) :], "token" + head)

    def ip6(self, value: str) -> str | None:
        """Addresses written in full, in small or capital letters."""
        plain, sizes = value.replace(":", ""), "".join(str(len(x)) for x in value.split(":"))
        if not (value == value.lower() or value == value.upper()):
            return None
        new = f"{self._walk(int(plain, 16), 16 ** len(plain), 'ip6' + sizes):0{len(plain)}x}"
        return _refill(value, new.upper() if value != value.lower() else new, lambda c: c != ":")

    def secret(self, value: str) -> str | None:
        """Hexadecimal keys with digits and letters of one case."""
        if value.isdigit() or value.isalpha() or not (value == value.lower() or value == value.upper()):
            return None
        new = f"{self._walk(int(value, 16), 16 ** len(value), f'hex{len(value)}'):0{len(value)}x}"
        return new.upper() if value == value.upper() else new

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds of the values found in order."""
        kinds: list[str] = []
        out: list[str] = []
        at = look = 0
        while m := _PATTERN.search(text, look):
            kind, start, end = m.lastgroup, m.start(), m.end()
            got = self.of(kind, m.group())
            # A card with two kinds of separators, or with more digits behind it, may hold the value rather than be it.
            if kind in _TOKENS and (got is None or kind == "card" and (len(set(m.group()) & set(" -")) > 1 or _MORE.match(text, end))):
                start, end, got, look = self._within(kind, text, start, end)
            if got is None:
                look = look if kind in _TOKENS else end
                continue
            out += [text[at:start], got]
            kinds.append(kind)
            at = look = end
        return "".join(out) + text[at:], kinds

    def _within(self, kind: str, text: str, start: int, end: int) -> tuple[int, int, str | None, int]:
        """The likeliest and longest valid run of whole tokens that begins in a failed candidate, and where to look on if there is none."""
        token, between, least, most = _TOKENS[kind]
        spans: list[tuple[int, int]] = []
        for m in token.finditer(text, start):
            if spans and not (m.start() == spans[-1][1] + 1 and text[spans[-1][1]] in between) or m.start() >= end + most:
                break
            spans.append(m.span())
        found: list[tuple[bool, bool, int, int, int]] = []
        for i, (s, _) in enumerate(spans):
            if s >= end or (kind == "iban" and not _IBAN_START.match(text, s)):
                continue
            size = 0
            for b, e in spans[i:]:
                size += e - b
                if size > most:
                    break
                if size >= least and not text[e : e + 1].isalnum():
                    # Runs with one separator, and cards that begin as issuers number them, come first.
                    found.append((len(set(text[s:e]) & set(between)) > 1, kind == "card" and text[s] not in "23456", -size, s, e))
        for *_, s, e in sorted(found):
            if (got := self.of(kind, text[s:e])) is not None:
                return s, e, got, e
        return start, end, None, spans[1][0] if len(spans) > 1 and spans[1][0] < end else end


def pseudonymise(docs: DataFrame, text: str = "text", key: bytes | None = None, counts: bool = True) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and, with counts, one column n_<kind> per kind."""
    key = key or (docs.sparkSession.conf.get("spark.tessella.pseudonymKey", None) or KEY.decode()).encode()
    kept = docs.drop(*[f"n_{k}" for k in KINDS]) if counts else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for batch in batches:
            texts: list[bytes | str | None] = []
            found: list[list[str]] = []
            for t in batch.column(text).cast(pa.binary()).to_pylist():
                kinds: list[str] = []
                if t and len(t.translate(None, _DIGITS)) < len(t):
                    new, kinds = p.replace(t.decode())
                    t = new.encode()
                texts.append(t)
                found.append(kinds)
            at = batch.schema.get_field_index(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            names = list(batch.schema.names)
            if counts:
                columns += [pa.array([f.count(k) for f in found], pa.int64()) for k in KINDS]
                names += [f"n_{k}" for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] if counts else []
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *extra]))
