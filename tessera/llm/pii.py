"""Personal data to format-preserving pseudonyms by a keyed Feistel permutation.

Card numbers (Luhn), telephone numbers, IPv4 addresses, social security numbers, IBANs (mod 97), calendar dates,
e-mail addresses and quoted secrets are found by pattern and validated. A value is a number in the domain of its
format (letters stay letters, digits digits, separators stay); ROUNDS keyed rounds on its two halves permute the
domain, check digits are worked out anew, and the pseudonym is written in the same format. The same key gives
equal values equal pseudonyms in all documents, different values different ones, and undo() gives values back.

A card number that fails the Luhn check is still one of 16 digits standing alone, so it is permuted among such
numbers. Null texts stay null and have no findings, empty tables give empty results, equal texts equal ones.
Only the text changes; other columns stay as they are, also those named like a kind. The key is a parameter.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, plain_names, schema_of

ROUNDS = 8
DEFAULT_KEY = "replace-me-by-a-secret"

PATTERN = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    |(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b\s{0,3}[=:]\s{0,3}(?:["'](?=[^"'\s]{6,}["'])|(?=[A-Za-z0-9+/_.-]{0,64}[0-9])))(?P<secret>[A-Za-z0-9+/_.-]{6,})
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<ipv4>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))
    |(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}(?P<sep>[./])[0-9]{2}(?P=sep)[0-9]{4})(?![0-9]))
    |(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))
    |(?P<phone>(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]))
    |(?P<card>(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}(?P<gap2>[ -])[0-9]{6}(?P=gap2)[0-9]{5})(?![0-9A-Za-z]))""",
    re.X,
)
LIKELY = re.compile(r"[@0-9]|[=:]\s{0,3}[\"']")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
MONTH_FIRST = [n for n in range(FIRST_DAY, LAST_DAY + 1) if datetime.date.fromordinal(n).day > 12]


class Feistel:
    """Keyed permutations of the numbers below a size, and their inverses."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()
        self._round = lru_cache(100_000)(self._digest)

    def _digest(self, tweak: str, n: int, value: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}/{n}/{value}".encode(), key=self.key, digest_size=32).digest(), "big")

    def permute(self, value: int, left: int, right: int, tweak: str, back: bool = False) -> int:
        """value below left * right: its place in the permutation named by the tweak (or the place's value)."""
        a, b = divmod(value, right)
        for n in range(ROUNDS) if not back else reversed(range(ROUNDS)):
            sign = -1 if back else 1
            if n % 2 == 0:
                a = (a + sign * self._round(tweak, n, b)) % left
            else:
                b = (b + sign * self._round(tweak, n, a)) % right
        return a * right + b

    def symbols(self, text: str, tweak: str, back: bool = False) -> str:
        """Digits, small and capital letters each within their kind; other characters stay."""
        sets = ["0123456789" if "0" <= c <= "9" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else c for c in text]
        return self.within(text, sets, tweak, back)

    def within(self, text: str, sets: list[str], tweak: str, back: bool = False) -> str:
        """Each character among those of its set, all of the text together as one number."""
        sizes = [len(s) for s in sets]
        half = len(sizes) // 2
        left, right = prod(sizes[:half]), prod(sizes[half:])
        value = 0
        for c, s in zip(text, sets):
            value = value * len(s) + s.index(c)
        shape = "".join(s[0] if len(s) > 1 else "-" for s in sets)
        value = self.permute(value, left, right, f"{tweak}:{shape}", back)
        out = []
        for s in reversed(sets):
            value, digit = divmod(value, len(s))
            out.append(s[digit])
        return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The digit that completes a number by the Luhn rule."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _refilled(shape: str, chars: str) -> str:
    """The separators of shape with new characters in the places of its letters and digits."""
    new = iter(chars)
    return "".join(next(new) if c.isalnum() else c for c in shape)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Pseudonyms:
    """Finds, validates and permutes the values of texts."""

    def __init__(self, key: str):
        self.feistel = Feistel(key)

    def value(self, kind: str, found: str, back: bool = False) -> str | None:
        """The pseudonym of a value (or the value of a pseudonym), None if it isn't valid."""
        return getattr(self, f"_{kind}")(found, back)

    def _email(self, x: str, back: bool) -> str:
        name, _, top = x.rpartition(".")
        local, _, host = name.partition("@")
        return self.feistel.symbols(f"{local}@{host}", "email", back) + f".{top}"

    def _secret(self, x: str, back: bool) -> str:
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", x):
            letters = "0123456789abcdef" if x == x.lower() else "0123456789ABCDEF"
            return self.feistel.within(x, [letters] * len(x), "hex", back)
        return self.feistel.symbols(x, "secret", back)

    def _iban(self, x: str, back: bool) -> str | None:
        plain = x.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self.feistel.symbols(plain[4:], f"iban{plain[:2]}", back)
        check = 98 - _mod97(body + plain[:2] + "00")
        return _refilled(x, f"{plain[:2]}{check:02d}{body}")

    def _ipv4(self, x: str, back: bool) -> str | None:
        parts = list(map(int, x.split(".")))
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in x.split(".")):
            return None
        n = self.feistel.permute(int.from_bytes(bytes(parts), "big"), 1 << 16, 1 << 16, "ipv4", back)
        return ".".join(map(str, n.to_bytes(4, "big")))

    def _date(self, x: str, back: bool) -> str | None:
        form = "%Y-%m-%d" if x[4] == "-" else f"%d{x[2]}%m{x[2]}%Y"
        try:
            day = datetime.datetime.strptime(x, form).date()
        except ValueError:
            try:
                form = f"%m{x[2]}%d{x[2]}%Y"  # month first, where the day can't be first
                day = datetime.datetime.strptime(x, form).date()
            except ValueError:
                return None
        n = day.toordinal()
        if not FIRST_DAY <= n <= LAST_DAY:
            return None
        if form[1] == "m":  # among the dates that can't be read day first
            return datetime.date.fromordinal(MONTH_FIRST[self._cycle(bisect_left(MONTH_FIRST, n), len(MONTH_FIRST), back)]).strftime(form)
        return datetime.date.fromordinal(FIRST_DAY + self._cycle(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, back)).strftime(form)

    def _cycle(self, n: int, size: int, back: bool) -> int:
        """A permutation of any size: steps through that of the next square until it falls inside."""
        side = int(size**0.5) + 1
        while True:
            n = self.feistel.permute(n, side, side, f"cycle{size}", back)
            if n < size:
                return n

    def _ssn(self, x: str, back: bool) -> str | None:
        area, group, serial = map(int, x.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = area - 1 - (area > 666)
        n = self.feistel.permute((areas * 99 + group - 1) * 9_999 + serial - 1, 898 * 99, 9_999, "ssn", back)
        n, serial = divmod(n, 9_999)
        areas, group = divmod(n, 99)
        area = areas + 1 + (areas + 1 >= 666)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, x: str, back: bool) -> str:
        digits = re.sub(r"\D", "", x)
        country, own = digits[:-10], digits[-10:]
        return _refilled(x, country + self.feistel.symbols(own, f"phone{country}", back))

    def _card(self, x: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", x)
        if luhn_digit(digits[:-1]) == digits[-1]:
            body = self.feistel.symbols(digits[:-1], "card", back)
            return _refilled(x, body + luhn_digit(body))
        if len(digits) != 16:
            return None
        # not valid: permuted among the numbers that aren't, by the distance of the last digit from the right one
        body, off = digits[:-1], (int(digits[-1]) - int(luhn_digit(digits[:-1]))) % 10 - 1
        n = self.feistel.permute(int(body) * 9 + off, 10**8 * 3, 10**7 * 3, "number16", back)
        body, off = divmod(n, 9)
        text = f"{body:015d}"
        return _refilled(x, f"{text}{(int(luhn_digit(text)) + off + 1) % 10}")

    def replaced(self, text: str, back: bool = False) -> tuple[str, Counter]:
        """The text with pseudonyms, and how many of each kind."""
        counts: Counter = Counter()
        if not LIKELY.search(text):
            return text, counts

        def new(m: re.Match) -> str:
            kind = m.lastgroup
            x = m[kind]
            got = self.value(kind, x, back)
            if got is None:
                return m[0]
            counts[kind] += 1
            start = m.start(kind) - m.start()
            return m[0][:start] + got + m[0][start + len(x) :]

        return PATTERN.sub(new, text), counts


def pseudonymised(docs: DataFrame, key: str = DEFAULT_KEY, undo: bool = False, counts: bool = True) -> DataFrame:
    """The table with pseudonyms in text; with n_pii and pii_kinds (`kind:count`, comma-joined) if counts."""
    arrow_limits(docs.sparkSession)
    added = ["n_pii", "pii_kinds"] if counts else []
    docs = docs.drop(*added)
    names, docs = docs.columns, plain_names(docs, "text", "n_chars")
    others = [c for c in docs.columns if c != "text"]
    schema = schema_of(docs, ["text", *others]) + (", n_pii long, pii_kinds string" if counts else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for b in batches:
            got = [(None, Counter()) if t is None else pseudonyms.replaced(t, undo) for t in b.column(0).to_pylist()]
            cols = [pa.array([t for t, _ in got], pa.string()), *b.columns[1:]]
            if counts:
                cols.append(pa.array([sum(c.values()) for _, c in got], pa.int64()))
                cols.append(pa.array([",".join(f"{k}:{c[k]}" for k in sorted(c)) for _, c in got], pa.string()))
            yield pa.record_batch(cols, names=["text", *others, *added])

    out = docs.select("text", *others).mapInArrow(work, schema)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns, *added).toDF(*names, *added)
