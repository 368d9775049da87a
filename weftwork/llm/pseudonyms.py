"""Format-preserving pseudonyms for personal numbers, dates and accounts.

A found value is validated, ranked among all values of its format, and its rank is permuted by a
keyed Feistel network that is walked until it is inside the format again. The value with the new
rank takes the place of the old one. Equal values get equal pseudonyms in every document, whatever
task meets them; a pseudonym is valid like its original; and who has the key can undo it.

Formats: payment cards (13 to 19 digits with a check digit), telephone numbers, IPv4 addresses,
US social security numbers, IBANs, dates with a day in digits or with the month's English name, e-mail addresses, and secrets that are
recognised by a prefix or by a name before them. Separators and letter case stay where they are.

Digits and groups that aren't valid as a whole may hold a card or an IBAN beside other numbers or
words: every start at a separator is tried, for an IBAN with the length of its country, for a card
with every end at a separator, those of a usual grouping and then the longest first. A pseudonym beside other digits may be valid
with them by chance, and isn't undone then.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Values kept by a task.
_KEEP = 200_000
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()

_MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS)

_FIND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<secret>(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsru]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,})(?![A-Za-z0-9]))"
    r"|(?P<named>(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\b)[ \t]*[=:][ \t]*[\"']?(?=[A-Za-z_+/.-]*[0-9])(?P<value>[A-Za-z0-9_+/.-]{8,}))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<iso>(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}(?![0-9/]))"
    rf"|(?P<worded>(?<![A-Za-z0-9])(?i:{_MONTH}) [0-9]{{1,2}},? (?:19|20)[0-9]{{2}}(?![0-9])|(?<![A-Za-z0-9.-])[0-9]{{1,2}} (?i:{_MONTH}),? (?:19|20)[0-9]{{2}}(?![0-9]))"
    r"|(?P<day>(?<![0-9./-])[0-9]{1,2}(?P<sep>[./-])[0-9]{1,2}(?P=sep)(?:19|20)[0-9]{2}(?![0-9]|[./-][0-9]))"
    r"|(?P<ip>(?<![0-9.])(?<![vV])(?<!ersion )(?<!elease )(?<!uild )(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<phone>(?<![0-9+])\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9]))"
    r"|(?P<card>(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
)
_GROUP = re.compile(r"[0-9]+")
#: Groups of digits that cards are usually written in.
_USUAL = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20))}
#: Calling codes of one and of two digits; all others have three.
_COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: The code of numbers that are written without one.
_HOME = "+1"
#: The lengths of IBANs by country.
_LENGTHS = {
    country: int(size)
    for size, countries in (
        x.split(":")
        for x in (
            "15:NO", "16:BE BI", "18:DK FK FI FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV", "22:BG BH CR DE GB GE IE ME RS VA",
            "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST", "26:IS TR", "27:BF CF CM DJ FR GR IT MC MG MR SM",
            "28:AL AZ BJ BY CI CY DO DZ GT GW HN HU LB ML NE NI PL SN SV TD TG", "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "33:RU", "32:LC",
        )
    )
    for country in countries.split()
}
#: A text without any of these has nothing to find.
_MAYBE = re.compile(r"[0-9@]")
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Feistel:
    """Keyed permutations of range(n) for any n, one for each tweak."""

    def __init__(self, key: bytes) -> None:
        if not key:
            raise ValueError("a key is needed")
        self.key = key

    def _round(self, tweak: str, i: int, x: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")
        block = b""
        while len(block) < size:
            block += hmac.digest(self.key, f"{tweak}|{i}|{len(block)}|".encode() + data, hashlib.sha256)
        return int.from_bytes(block[:size], "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """The place of x in the permutation; a walk stays below n, four steps on average at most."""
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        tweak = f"{tweak}|{n}"
        while True:
            a, b = x >> half, x & mask
            if back:
                for i in reversed(range(ROUNDS)):
                    a, b = b ^ self._round(tweak, i, a, half), a
            else:
                for i in range(ROUNDS):
                    a, b = b, a ^ self._round(tweak, i, b, half)
            x = a << half | b
            if x < n:
                return x


def luhn(digits: str) -> int:
    """What a check digit must add to the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


class Pseudonyms:
    """Replaces what it finds; ``back`` makes it put the originals in the place of pseudonyms."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.feistel, self.back = Feistel(key), back
        self.known: dict[tuple[str, str], str | None] = {}

    def _rank(self, value: str, sizes: list[int], digits: list[int], tweak: str) -> list[int]:
        """Permute mixed-radix digits."""
        x, n = 0, 1
        for d, s in zip(digits, sizes, strict=True):
            x, n = x * s + d, n * s
        x = self.feistel.permute(x, n, tweak, self.back)
        out = []
        for s in reversed(sizes):
            x, d = divmod(x, s)
            out.append(d)
        return out[::-1]

    def characters(self, text: str, tweak: str) -> str:
        """Letters and digits change within their class and case; other characters stay."""
        at = [(i, k, c.index(t)) for i, t in enumerate(text) for k, c in enumerate(_CLASSES) if t in c]
        new = self._rank(text, [len(_CLASSES[k]) for _, k, _ in at], [d for _, _, d in at], tweak + ":" + "".join(str(k) for _, k, _ in at))
        out = list(text)
        for (i, k, _), d in zip(at, new, strict=True):
            out[i] = _CLASSES[k][d]
        return "".join(out)

    def _digits(self, text: str, new: str) -> str:
        it = iter(new)
        return "".join(next(it) if c.isascii() and c.isdigit() else c for c in text)

    def _valid(self, x: str, tweak: str, ok, step) -> str | None:
        """Walk until a valid value; None if x itself isn't valid."""
        if not ok(x):
            return None
        while True:
            x = step(x)
            if ok(x):
                return x

    def card(self, x: str) -> str | None:
        d = re.sub(r"\D", "", x)
        if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        new = d[0] + f"{self.feistel.permute(int(d[1:-1]), 10 ** (len(d) - 2), f'card{d[0]}', self.back):0{len(d) - 2}d}"
        return self._digits(x, new + str(luhn(new)))

    def ssn(self, x: str) -> str | None:
        ok = lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"
        return self._valid(x, "ssn", ok, lambda v: self.characters(v, "ssn"))

    def ip(self, x: str) -> str | None:
        o = x.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in o):
            return None
        n = 0
        for p in o:
            n = n * 256 + int(p)
        n = self.feistel.permute(n, 1 << 32, "ip", self.back)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))

    def phone(self, x: str) -> str | None:
        if len(re.sub(r"\D", "", x)) > 15:
            return None
        # The country's code, however the number is grouped, so that one number has one pseudonym.
        start = x[: 1 + next(n for n in (1, 2, 3) if n == 3 or x[1 : n + 1] in _COUNTRIES)] if x[0] == "+" else ""
        if not start[1:].isdigit() and start:
            return None
        rest = re.sub(r"\D", "", x[len(start) :])
        # A national number is that of its country, which those without a code are of, and stays one; other numbers stay others.
        national = lambda v: len(v) == 10 and v[0] not in "01" and v[3] not in "01"
        if start in ("", _HOME) and national(rest):
            kind, ok = f"phone{_HOME}", national
        else:
            kind, ok = f"phone{start} other", lambda v: len(v) >= 6 and bool(start) and not (start == _HOME and national(v))
        new = self._valid(rest, kind, ok, lambda v: self.characters(v, kind))
        return None if new is None else start + self._digits(x[len(start) :], new)

    def iban(self, x: str) -> str | None:
        v = x.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(v) <= 34 or number(v[4:] + v[:4]) % 97 != 1:
            return None
        body = self.characters(v[4:], f"iban{v[:2]}")
        v = v[:2] + f"{98 - number(body + v[:2] + '00') % 97:02d}" + body
        it = iter(v)
        return "".join(next(it) if c != " " else c for c in x)

    def _date(self, year: int, month: int, day: int, like=lambda d: True) -> datetime.date | None:
        """Another date among those that are ``like`` it."""
        try:
            d = datetime.date(year, month, day)
        except ValueError:
            return None
        if not 0 <= d.toordinal() - _DAY0 < _DAYS or not like(d):
            return None
        while True:
            d = datetime.date.fromordinal(_DAY0 + self.feistel.permute(d.toordinal() - _DAY0, _DAYS, "date", self.back))
            if like(d):
                return d

    def iso(self, x: str) -> str | None:
        d = self._date(int(x[:4]), int(x[5:7]), int(x[8:]))
        return d and d.isoformat().replace("-", x[4])

    def day(self, x: str) -> str | None:
        """Day before month; with slashes month before day, unless the first number can't be a month."""
        a, b, year = re.split(r"[./-]", x)
        sep = x[len(a)]
        # What decides the order holds for the pseudonym too, so that it is read as it was made.
        us = sep == "/" and int(a) <= 12
        like = (lambda d: d.day > 12) if sep == "/" and not us else (lambda d: True)
        d = self._date(int(year), int(a if us else b), int(b if us else a), like)
        if not d:
            return None
        p, q = (d.month, d.day) if us else (d.day, d.month)
        return f"{p:02d}{sep}{q:02d}{sep}{d.year}"

    def worded(self, x: str) -> str | None:
        """A date with the month's name, whole or short, in the case it has. May, which tells neither, stays May."""
        word = re.search(r"[A-Za-z]+", x)[0]
        month = next(k for k, m in enumerate(_MONTHS, 1) if m[:3].lower() == word[:3].lower())
        numbers = re.findall(r"[0-9]+", x)
        d = self._date(int(numbers[1]), month, int(numbers[0]), lambda d: (d.month == 5) == (month == 5))
        if not d:
            return None
        name = _MONTHS[d.month - 1] if len(word) > 3 or month == 5 else _MONTHS[d.month - 1][:3]
        name = name.upper() if word.isupper() else name.lower() if word.islower() else name
        it = iter((f"{d.day:02d}" if len(numbers[0]) == 2 else str(d.day), str(d.year)))
        return re.sub(r"[A-Za-z]+|[0-9]+", lambda m: name if m[0][0].isalpha() else next(it), x)

    def email(self, x: str) -> str | None:
        """The domain stays. A mailbox is the same in any case of letters; each letter keeps its own."""
        name, _, domain = x.rpartition("@")
        new = self.characters(name.lower(), "email@" + domain.lower())
        return f"{''.join(c.upper() if o.isupper() else c for c, o in zip(new, name, strict=True))}@{domain}"

    def secret(self, x: str) -> str | None:
        m = re.match(r"AKIA|ASIA|gh._|sk_(?:live|test)_", x)
        return m[0] + self.characters(x[m.end() :], "secret" + m[0])

    def replace(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """(the text with pseudonyms, how many there are of each kind)."""
        counts: dict[str, int] = {}
        if not text or not _MAYBE.search(text):
            return text, counts
        if len(self.known) > _KEEP:
            self.known = {}

        out: list[str] = []
        at = done = 0
        while m := _FIND.search(text, at):
            kind = next(k for k in ("email", "secret", "named", "iban", "ssn", "iso", "worded", "day", "ip", "phone", "card") if m[k] is not None)
            start, at = m.start("value") if kind == "named" else m.start(), m.end()
            if kind == "card":
                start, end, new, at = self._cards(text, start)
            elif kind == "iban":
                ends = [start + x.start() for x in re.finditer(" ", m[0])]
                # An end inside a run isn't guessed: one of several would be valid by chance too often.
                ends = [e for e in ends if len(text[start:e].replace(" ", "")) == _LENGTHS.get(text[start : start + 2])] + [at, *ends[:1]]
                end, new = next(((e, x) for e in ends if (x := self._new(kind, text[start:e])) is not None), (ends[-1], None))
                at = end
            else:
                end, new = at, self._new(kind, text[start:at])
            if new is None:
                continue
            name = {"iso": "date", "day": "date", "worded": "date", "named": "secret"}.get(kind, kind)
            counts[name] = counts.get(name, 0) + 1
            out += text[done:start], new
            done = end
        return "".join(out) + text[done:], counts

    def _new(self, kind: str, found: str) -> str | None:
        if (kind, found) not in self.known:
            new = self.characters(found, "named") if kind == "named" else getattr(self, kind)(found)
            if new is None and kind == "phone" and len(re.sub(r"\D", "", found)) >= 13:
                new = self.card(found) if re.fullmatch(r"[0-9 -]+", found) else None
            self.known[kind, found] = new
        return self.known[kind, found]

    def _cards(self, text: str, start: int) -> tuple[int, int, str | None, int]:
        """(start, end, pseudonym, where to go on) of the first card in the groups of digits from ``start``, or from the next ones if hyphens join them."""
        while True:
            sizes: list[int] = []
            tries: list[tuple[bool, int]] = []
            e = start
            while m := _GROUP.match(text, e):
                e = m.end()
                sizes.append(e - m.start())
                if sum(sizes) > 19:
                    break
                if sum(sizes) >= 13:
                    tries.append((tuple(sizes) in _USUAL, e))
                if text[e : e + 1] not in (" ", "-"):
                    break
                e += 1
            for _, e in sorted(tries, reverse=True):
                if (new := self._new("card", text[start:e])) is not None:
                    return start, e, new, e
            after = start + sizes[0]
            if not (text[after : after + 1] == "-" and _GROUP.match(text, after + 1)):
                return start, after, None, after
            start = after + 1
            if _FIND.match(text, start):
                return start, start, None, start


def _run(key: bytes, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            done = [names.replace(t) for t in batch.column("text").to_pylist()]
            kinds = pa.array([[(k, n) for k, n in sorted(c.items())] for _, c in done], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([sum(c.values()) for _, c in done], pa.int64()), kinds], ["doc_id", "text", "n_found", "kinds"])

    return run


def pseudonymize(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, text, n_found, kinds)``, one row for each row.

    ``text`` has a pseudonym in the place of each valid value, ``kinds`` the number of each kind.
    What isn't valid, such as digits without their check digit, stays. A null text stays null, an
    empty one empty. Repeated rows and equal values get equal pseudonyms. Dates without leading
    zeros get them. ``back`` undoes what was done with the key. Extra columns don't matter; an
    empty table gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_run(key, back), "doc_id long, text string, n_found long, kinds map<string,int>")
