"""Format-preserving pseudonyms by a keyed Feistel permutation.

Each value is a number below the size of its format's domain. A balanced
Feistel network over enough bits permutes it; results outside the domain, or
not valid in the format, are permuted again (cycle walking), which keeps the
map one-to-one. Long addresses are permuted in place, one half of their
characters after the other, without the large number. Equal values of a format
get equal pseudonyms in every document, and nothing has to be joined or stored.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
_ROUNDS = 10
_LONG = 3000  # characters beyond which a value is no number: arithmetic is quadratic, and Python prints 4,300 digits at most
_MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(_MONTHS)
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9/-])(?:(?P<iso>[0-9]{4}-[0-9]{2}-[0-9]{2})|(?P<slash>[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})|(?P<dot>[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})"
    rf"|(?P<dmy>[0-9]{{1,2}}\x20(?:{_MONTH})\x20[0-9]{{4}}))(?![0-9]|[-/.][0-9])|(?P<mdy>\b(?:{_MONTH})\x20[0-9]{{1,2}},\x20[0-9]{{4}}(?![0-9])))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    r"|(?P<phone>(?<![0-9A-Za-z+])(?:\+1[\x20.-]?)?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|-[0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,5}(?![0-9]))"
    r"|(?P<card>(?<![0-9A-Za-z.-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9]))"
)

#: First address and size of ranges with a meaning of their own: private, loopback, link-local, shared, multicast and reserved.
_RANGES = tuple((int.from_bytes(bytes(map(int, a.split("."))), "big"), 1 << (32 - n)) for a, n in (x.split("/") for x in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/4 240.0.0.0/4".split()) for n in (int(n),))
_ANY = re.compile("[0-9@]")  # every kind has one of these


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.memo: dict[tuple, str | None] = {}

    def permute(self, x: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        """A one-to-one map of the valid numbers below ``size`` to themselves."""
        half = max(1, -(-(size - 1).bit_length() // 2))
        mask = (1 << half) - 1
        salt = hashlib.blake2b(f"{tweak}|{size}".encode(), digest_size=16).digest()
        width = -(-half // 8)
        while True:
            left, right = x >> half, x & mask
            for r in range(_ROUNDS):
                f = hashlib.shake_256(self.key + salt + bytes([r]) + right.to_bytes(width, "big")).digest(width)
                left, right = right, left ^ (int.from_bytes(f, "big") & mask)
            x = left << half | right
            if x < size and valid(x):
                return x

    def permute_places(self, places: list[int], sizes: list[int], tweak: str) -> list[int]:
        """As ``permute``, for a number of any length, given by its digits to the bases ``sizes`` (two or more).

        Each round adds to the digits of one half what a hash makes of the other.
        """
        x, base = np.array(places, dtype=np.uint8), np.array(sizes, dtype=np.uint8)
        salt = hashlib.blake2b(f"{tweak}|places".encode(), digest_size=16).digest()
        one, other = slice(0, len(x) // 2), slice(len(x) // 2, len(x))
        for r in range(_ROUNDS):
            f = hashlib.shake_256(self.key + salt + bytes([r]) + x[other].tobytes()).digest(8 * len(x[one]))
            x[one] = (x[one] + (np.frombuffer(f, "<u8") % base[one]).astype(np.uint8)) % base[one]
            one, other = other, one
        return x.tolist()

    def digits(self, value: str, tweak: str, valid: Callable[[str], bool] = lambda _: True) -> str:
        n = len(value)
        return str(self.permute(int(value), 10**n, f"{tweak}{n}", lambda x: valid(str(x).zfill(n)))).zfill(n)

    def letters(self, value: str, tweak: str) -> str:
        """Letters as letters of their case, digits as digits, the rest as it is; equal but for case, equal pseudonyms."""
        sizes = [26 if c.isalpha() else 10 for c in value if c.isalnum()]
        if not sizes:
            return value
        places = [ord(c) - 97 if s == 26 else int(c) for c, s in zip((c for c in value.lower() if c.isalnum()), sizes)]
        shape = "".join("a" if c.isalpha() else "0" if c.isdigit() else c for c in value)
        if len(places) > _LONG:
            places = self.permute_places(places, sizes, tweak + shape)
        else:
            x, total = 0, 1
            for d, s in zip(places, sizes):
                x, total = x * s + d, total * s
            y = self.permute(x, total, tweak + shape)
            for i in reversed(range(len(sizes))):
                y, places[i] = divmod(y, sizes[i])
        new = (chr(97 + d) if s == 26 else str(d) for d, s in zip(places, sizes))
        return "".join((n.upper() if c.isupper() else n) if c.isalnum() and (n := next(new)) else c for c in value)

    def email(self, v: str) -> str:
        local, _, domain = v.rpartition("@")
        *labels, top = domain.split(".")
        return f"{self.letters(local, 'local')}@{'.'.join(self.letters(x, 'label') for x in labels)}.{top}"

    def iban(self, v: str) -> str | None:
        plain = v.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self.letters(plain[4:], "iban" + plain[:2])
        check = 98 - _mod97(body + plain[:2] + "00")
        return _refill(v, plain[:2] + f"{check:02d}" + body)

    def ip(self, v: str) -> str | None:
        parts = [int(x) for x in v.split(".")]
        if max(parts) > 255:
            return None
        x = int.from_bytes(bytes(parts), "big")
        for first, size in _RANGES:  # an address of a special range stays in it
            if first <= x < first + size:
                return ".".join(map(str, (first + self.permute(x - first, size, f"ip{first}")).to_bytes(4, "big")))
        y = self.permute(x, 1 << 32, "ip", lambda z: not any(first <= z < first + size for first, size in _RANGES))
        return ".".join(map(str, y.to_bytes(4, "big")))

    def date(self, v: str, form: str) -> str | None:
        """A date in the same form, with as many digits in each place."""
        try:
            if form == "iso":
                y, m, d = v.split("-")
            elif form in ("slash", "dot"):
                a, b, y = re.split(r"[/.]", v)
                m, d = (b, a) if form == "dot" or int(a) > 12 else (a, b)
                form = form if form == "dot" else "dmslash" if int(a) > 12 else "slash"
            elif form == "dmy":
                d, m, y = v.split(" ")
            else:
                m, d, y = v.replace(",", "").split(" ")
            named = m in _MONTHS
            day = datetime.date(int(y), _MONTHS.index(m) + 1 if named else int(m), int(d)).toordinal()
        except ValueError:
            return None
        if not _FIRST <= day <= _LAST:
            return None
        widths = (0 if named else len(m), len(d))
        padded = 1 not in widths and (d[0] == "0" or not named)  # all of two digits: 01 to 09 are among them

        def valid(x: int) -> bool:
            t = datetime.date.fromordinal(_FIRST + x)
            fits = lambda n, w: w == 0 or (n < 10 if w == 1 else padded or n >= 10)
            return fits(t.month, widths[0]) and fits(t.day, widths[1]) and (form != "dmslash" or t.day > 12)

        t = datetime.date.fromordinal(_FIRST + self.permute(day - _FIRST, _LAST - _FIRST + 1, f"date{form}{widths}{padded}", valid))
        mm = _MONTHS[t.month - 1] if named else str(t.month).zfill(widths[0])
        dd = str(t.day).zfill(widths[1])
        return {"iso": f"{t.year}-{mm}-{dd}", "slash": f"{mm}/{dd}/{t.year}", "dmslash": f"{dd}/{mm}/{t.year}", "dot": f"{dd}.{mm}.{t.year}", "dmy": f"{dd} {mm} {t.year}", "mdy": f"{mm} {dd}, {t.year}"}[form]

    def ssn(self, v: str) -> str | None:
        valid = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        plain = v.replace("-", "")
        return _refill(v, self.digits(plain, "ssn", valid)) if valid(plain) else None

    def phone(self, v: str) -> str | None:
        plain = "".join(c for c in v if c.isdigit())
        lead = "1" if v.startswith("+1") and len(plain) == 11 else ""
        if not lead and v.startswith("+"):
            lead, rest = plain[:2], plain[2:]
            return _refill(v, lead + self.digits(rest, "phone" + lead)) if 8 <= len(plain) <= 15 else None
        rest = plain[len(lead) :]
        good = lambda x: x[0] > "1" and x[3] > "1"
        return _refill(v, lead + self.digits(rest, "phone", good if good(rest) else lambda x: not good(x)))

    def card(self, v: str) -> str | None:
        plain = "".join(c for c in v if c.isdigit())
        if not _luhn(plain):
            return None
        body = self.digits(plain[:-1], "card")
        return _refill(v, body + next(c for c in "0123456789" if _luhn(body + c)))

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        counts: dict[str, int] = {}
        if not _ANY.search(text):
            return text, counts

        def one(m: re.Match) -> str:
            kind, v = m.lastgroup, m.group()
            form = next((f for f in ("iso", "slash", "dot", "dmy", "mdy") if m.group(f)), "") if m.group("date") else ""
            kind = "date" if form else next(k for k in KINDS if m.group(k))
            if (kind, v) not in self.memo:
                if len(self.memo) > 200_000 or len(v) > _LONG:  # one long value at a time
                    self.memo.clear()
                self.memo[kind, v] = self.date(v, form) if form else getattr(self, kind)(v)
            new = self.memo[kind, v]
            if new is None:
                return v
            counts[kind] = counts.get(kind, 0) + 1
            return new

        return PATTERN.sub(one, text), counts


def _mod97(x: str) -> int:
    return int("".join(str(int(c, 36)) for c in x)) % 97


def _luhn(x: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(x))) % 10 == 0


def _refill(form: str, plain: str) -> str:
    """The characters of ``plain`` in the places of the letters and digits of ``form``."""
    new = iter(plain)
    return "".join(next(new) if c.isalnum() else c for c in form)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns, rows and other text stay.

    Emails, IP addresses, phone numbers, dates, and numbers that pass their
    check (cards by Luhn, IBANs modulo 97, social security numbers) get a valid
    pseudonym of the same format and width; other numbers stay. n_chars, where
    there is one, keeps its value: it describes the source. Null and empty
    texts stay as they are, and bytes that are no UTF-8; long texts are read
    whole. Repeated rows give equal results; no rows give no rows. Other columns
    pass through whatever their names.
    """
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        p = Pseudonyms(key)
        for part in wordhash.slices(batches, at):
            texts = [p.replace(t)[0] if t else t for t in wordhash.strings(part.column(at))]
            yield part.set_column(at, part.schema.field(at), wordhash.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """Per document: doc_id, the count of each kind, their sum n_pii, and the pseudonymised text.

    A null text stays null and has no personal data; long texts are read whole,
    and bytes that are no UTF-8 stay.
    Repeated rows give equal results; no rows give no rows. Only doc_id and
    text are read, so other columns may have any names.
    """

    def run(batches):
        p = Pseudonyms(key)
        for part in wordhash.slices(batches, 1):
            ids, texts = part.column(0), []
            counts = {k: [] for k in KINDS}
            for t in wordhash.strings(part.column(1)):
                new, n = p.replace(t) if t else (t, {})
                texts.append(new)
                for k in KINDS:
                    counts[k].append(n.get(k, 0))
            yield pa.RecordBatch.from_arrays([ids, wordhash.array(texts, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS)], names=["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS))
    return made.withColumn("n_pii", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)).cast("long"))
