"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Validated values are taken as numbers of their format's domain and permuted there by a keyed Feistel
network with cycle walking, so a pseudonym is again a valid value of the same format, equal values have
equal pseudonyms in every document, and the key's holder can go back. Separators stay as they are and
don't take part.

Kinds: card (Luhn), iban (mod 97), ssn, ipv4, phone, date (calendar) and e-mail local parts. Null texts
stay null, empty ones empty. Overlapping finds: the earlier kind in KINDS wins, then the leftmost.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import small_batches

ROUNDS = 8
KINDS = ("email", "iban", "ipv4", "card", "ssn", "date", "phone")
#: Dates are permuted within these years, which keep four digits.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: How many characters an IBAN has.
IBAN_LENGTH = {
    country: n for n, countries in {
        15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for country in countries.split()
}
#: Groups that a card's digits stand in behind other numbers.
CARD_GROUPS = re.compile(r"1[3-9]|4 4 4 4(?: [1-3])?|4 6 [45]")
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """A keyed permutation of 0 .. size - 1 for any size; tweak keeps formats apart."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hashlib.blake2b(tweak.encode() + b"/" + str(size).encode(), key=key[:64], digest_size=32).digest()

    def _round(self, i: int, x: int) -> int:
        data = bytes([i]) + x.to_bytes(self.half // 8 + 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key).digest(), "big") & self.mask

    def _once(self, x: int, rounds: range) -> int:
        left, right = x >> self.half, x & self.mask
        if rounds.step > 0:
            for i in rounds:
                left, right = right, left ^ self._round(i, right)
        else:
            for i in rounds:
                left, right = right ^ self._round(i, left), left
        return left << self.half | right

    def _walk(self, x: int, rounds: range) -> int:
        while True:
            x = self._once(x, rounds)
            if x < self.size:
                return x

    def permute(self, x: int) -> int:
        return self._walk(x, range(ROUNDS))

    def invert(self, x: int) -> int:
        return self._walk(x, range(ROUNDS - 1, -1, -1))


def luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return -total % 10


def mod97(text: str) -> int:
    return int("".join(str(int(x, 36)) for x in text)) % 97


class Pseudonyms:
    """Finds values in texts and replaces them; invert=True goes back."""

    def __init__(self, key: bytes, invert: bool = False):
        self.key, self.invert = key, invert
        self.number = lru_cache(200_000)(self._number)
        self.replace: dict[str, Callable[[str], str | None]] = {
            "email": self.email, "iban": self.iban, "ipv4": self.ipv4, "card": self.card, "ssn": self.ssn, "date": self.date, "phone": self.phone,
        }

    PATTERNS = {
        "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.A),
        "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*(?![A-Za-z0-9])(?: [A-Z0-9]+(?![A-Za-z0-9]))*"),
        "ipv4": re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
        "card": re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9])*"),
        "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        "date": re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./-][0-9])"),
        "phone": re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9]|[.-][0-9])"),
    }

    def _number(self, tweak: str, size: int, x: int) -> int:
        f = Feistel(self.key, tweak, size)
        return f.invert(x) if self.invert else f.permute(x)

    def characters(self, tweak: str, text: str) -> str:
        """Digits stay digits, letters letters of their case; anything else stays and separates nothing."""
        places = [(i, DIGITS if ch.isdigit() else LETTERS) for i, ch in enumerate(text) if ch.isascii() and ch.isalnum()]
        x, size = 0, 1
        for i, alphabet in places:
            x, size = x * len(alphabet) + alphabet.index(text[i].lower()), size * len(alphabet)
        if size == 1:
            return text
        x = self.number(tweak + "/" + "".join("d" if a is DIGITS else "a" for _, a in places), size, x)
        out = list(text)
        for i, alphabet in reversed(places):
            x, k = divmod(x, len(alphabet))
            out[i] = alphabet[k].upper() if text[i].isupper() else alphabet[k]
        return "".join(out)

    @staticmethod
    def _refill(text: str, digits: str, member: Callable[[str], bool] = str.isdigit) -> str:
        left = iter(digits)
        return "".join(next(left) if member(ch) else ch for ch in text)

    def email(self, text: str) -> str:
        local, _, domain = text.partition("@")
        return self.characters("email", local) + "@" + domain

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self.characters("iban/" + plain[:2], plain[4:])
        check = 98 - mod97(body + plain[:2] + "00")
        return self._refill(text, f"{plain[:2]}{check:02d}{body}", str.isalnum)

    @staticmethod
    def _ibans(run: str) -> list[tuple[int, int]]:
        """Valid values in groups of capitals and digits: of the country's length, else as long as can be."""
        groups, out, at = [m.span() for m in re.finditer("[A-Z0-9]+", run)], [], 0
        for i, (a, _) in enumerate(groups):
            if a < at or not re.match("[A-Z]{2}[0-9]{2}", run[a : a + 4]):
                continue
            size, ends = 0, {}
            for x, b in groups[i:]:
                size += b - x
                if size > 34:
                    break
                ends[size] = b
            for n in (IBAN_LENGTH.get(run[a : a + 2]), max(ends, default=0)):
                plain = run[a : ends[n]].replace(" ", "") if n in ends and n >= 15 else ""
                if plain and mod97(plain[4:] + plain[:4]) == 1:
                    at = ends[n]
                    out.append((a, at))
                    break
        return out

    @staticmethod
    def _cards(run: str) -> list[tuple[int, int]]:
        """Valid values in groups of digits: from a run's start or behind a value as long as can be, elsewhere in a card's groups."""
        groups, out, at, fresh = [m.span() for m in re.finditer("[0-9]+", run)], [], 0, True
        for i, (a, _) in enumerate(groups):
            if a < at:
                continue
            size, sizes, ends = 0, [], []
            for x, b in groups[i:]:
                size += b - x
                if size > 19:
                    break
                sizes.append(str(b - x))
                if size >= 13 and (fresh or CARD_GROUPS.fullmatch(" ".join(sizes))):
                    ends.append(b)
            fresh = False
            for b in reversed(ends):
                digits = "".join(filter(str.isdigit, run[a:b]))
                if int(digits[-1]) == luhn(digits[:-1]) and len(set(digits)) > 1:
                    out.append((a, b))
                    at, fresh = b, True
                    break
        return out

    def _run(self, kind: str, run: str) -> list[tuple[int, int, str]]:
        """(start, end, pseudonym) of a run's values; pseudonyms walk on until the run is read as before, so that the way back finds them."""
        parse = self._ibans if kind == "iban" else self._cards
        spans = parse(run)
        for a, b in reversed(spans) if self.invert else spans:
            while True:
                run = run[:a] + (self.replace[kind](run[a:b]) or run[a:b]) + run[b:]
                if parse(run) == spans:
                    break
        return [(a, b, run[a:b]) for a, b in spans]

    def ipv4(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self.number("ipv4", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def card(self, text: str) -> str | None:
        digits = "".join(filter(str.isdigit, text))
        if int(digits[-1]) != luhn(digits[:-1]) or len(set(digits)) == 1:
            return None
        n = len(digits) - 1
        body = f"{self.number('card', 10**n, int(digits[:-1])):0{n}d}"
        return self._refill(text, body + str(luhn(body)))

    def ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))

        def valid(area: int, group: int, serial: int) -> bool:
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        if not valid(area, group, serial):
            return None
        x = area * 1_000_000 + group * 10_000 + serial
        while True:  # walk on within the valid numbers
            x = self.number("ssn", 10**9, x)
            area, rest = divmod(x, 1_000_000)
            if valid(area, *divmod(rest, 10_000)):
                return f"{area:03d}-{rest // 10_000:02d}-{rest % 10_000:04d}"

    def date(self, text: str) -> str | None:
        mark = next(ch for ch in text if not ch.isdigit())
        a, b, d = text.split(mark)
        year_first = len(a) == 4
        year, month, day = (int(a), int(b), int(d)) if year_first else (int(d), int(b), int(a))
        american = not year_first and mark == "/" and month > 12
        if american:
            month, day = day, month
        try:
            x = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= x <= LAST_DAY:
            return None
        size = LAST_DAY - FIRST_DAY + 1
        x -= FIRST_DAY
        while True:
            x = self.number("date", size, x)
            new = datetime.date.fromordinal(x + FIRST_DAY)
            # a written form that would be read another way round, or lengths that don't fit, walk on
            first, second = (new.month, new.day) if american else (new.day, new.month)
            if year_first:
                return f"{new.year:04d}{mark}{new.month:02d}{mark}{new.day:02d}"
            if len(a) == 1 and first > 9 or len(b) == 1 and second > 9 or american and second <= 12:
                continue
            return f"{first:0{len(a)}d}{mark}{second:0{len(b)}d}{mark}{new.year:04d}"

    def phone(self, text: str) -> str | None:
        digits = "".join(filter(str.isdigit, text))
        if not 10 <= len(digits) <= 15 or not (text[0] == "+" or "(" in text or re.search(r"[0-9][ .-][0-9]", text)):
            return None
        country = len(re.match(r"\+?([0-9]*)", text)[1]) if text[0] == "+" and not text[1 : len(digits) + 1].isdigit() else len(digits) - 10
        n = len(digits) - country
        return self._refill(text, digits[:country] + f"{self.number('phone', 10**n, int(digits[country:])):0{n}d}")

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of all values, in order and without overlap."""
        has_digit = any(d in text for d in DIGITS)
        out: list[tuple[int, int, str, str]] = []
        for kind in KINDS:
            if not ("@" in text if kind == "email" else has_digit):
                continue
            for m in self.PATTERNS[kind].finditer(text):
                if kind in ("iban", "card"):
                    if m.end() - m.start() < 13:
                        continue
                    run = m[0]
                    if kind == "card" and re.match("[./][0-9]", text[m.end() : m.end() + 2]):
                        run = re.sub("[ -][0-9]{1,2}$", "", run)  # a date's start or an expiry
                    found = [(m.start() + a, m.start() + b, kind, new) for a, b, new in self._run(kind, run)]
                    out += [x for x in found if not any(a < x[1] and x[0] < b for a, b, _, _ in out)]
                    continue
                if any(a < m.end() and m.start() < b for a, b, _, _ in out):
                    continue
                new = self.replace[kind](m[0])
                if new is not None:
                    out.append((m.start(), m.end(), kind, new))
        return sorted(out)

    def apply(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        found, at, parts = self.find(text), 0, []
        for a, b, _, new in found:
            parts += (text[at:a], new)
            at = b
        return ("".join([*parts, text[at:]]) if found else text), found


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", invert: bool = False) -> DataFrame:
    """doc_id, the text with pseudonyms, and how many values of each kind were replaced."""
    small_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Pseudonyms(key, invert)
        for batch in batches:
            texts, counts = batch.column(1).to_pylist(), [[0] * len(batch) for _ in KINDS]
            for i, x in enumerate(texts):
                if x:
                    texts[i], found = engine.apply(x)
                    for _, _, kind, _ in found:
                        counts[KINDS.index(kind)][i] += 1
            total = [sum(x) for x in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (total, *counts))], names=names)

    return docs.select("doc_id", text).mapInArrow(run, schema)
