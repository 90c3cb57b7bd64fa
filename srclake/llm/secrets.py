"""Secret scanning: patterns, and a guess-cost estimate for credential values.

The estimate is a dynamic programme over a value: the cheapest way to write it
as words, dates, repeats, keyboard walks and brute-force characters, in log10
guesses. Values in a credential context that cost enough are reported too.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .words import WORDS

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Identifiers may go on after the keyword, as in secret_access_key.
CONTEXT = re.compile(r"(?:passphrase|password|passwd|pwd|secret|credential|token|(?:api|private|access)[_-]?key)[A-Za-z0-9_-]{0,32}[\"']?\x20*(?:=>|:=|[:=]|\x20is\x20)\x20*[\"']?([^\s\"'<>]+)", re.I | re.A)
KINDS = ("assign", "access", "hex", "guess")
LEAST_GUESSES = 8.0  # log10; a value that costs less is weak or a placeholder

_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("4@31!0$57+", "aaeiiosstt")
_DATE_SIZES, _DAYS = (4, 6, 7, 8, 9, 10), math.log10(365 * 120)
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)[0-9]{2}|[0-9]{2})|(?:19|20)[0-9]{2})")


def _neighbours() -> dict[str, str]:
    at = {c: (x + y * 0.5, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
    return {c: "".join(d for d, (u, v) in at.items() if d != c and abs(u - x) <= 1 and abs(v - y) <= 1) for c, (x, y) in at.items()}


_NEAR = _neighbours()
_AT = {c: (x + y * 0.5, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}


def _step(a: str, b: str) -> tuple[float, int]:
    """The direction from one key to the next."""
    return _AT[b][0] - _AT[a][0], _AT[b][1] - _AT[a][1]


_BRUTE = {"digit": 1.0, "lower": math.log10(26), "upper": math.log10(26), "other": math.log10(33)}


def _brute(c: str) -> float:
    return _BRUTE["digit"] if "0" <= c <= "9" else _BRUTE["lower"] if "a" <= c <= "z" else _BRUTE["upper"] if "A" <= c <= "Z" else _BRUTE["other"]


_SEGMENT = 0.3  # one more segment doubles the guesses
_TURN, _KEYS, _SIGNS = math.log10(4), math.log10(47), math.log10(36)


class _Starts:
    """Where a run's segment may begin: (start, cost so far), without those that another beats at every end to come.

    A start is added when its shortest segment ends.

    A segment costs log10 of its number of units more, which grows ever slower,
    so an earlier start that is not dearer by more than the widest gap stays
    ahead, and one that is dearer than a later one never is again. Few starts
    survive, whatever the length of the run; their costs rise.
    """

    __slots__ = ("kept", "least")

    def __init__(self, least: int):
        self.kept: list[tuple[int, float]] = []
        self.least = least  # units of the shortest segment

    def add(self, i: int, cost: float, unit: int = 1) -> None:
        while self.kept and self.kept[-1][1] >= cost:  # longer and dearer at every end
            self.kept.pop()
        if all(cost < c + math.log10((self.least + (i - k) // unit) / self.least) for k, c in self.kept):
            self.kept.append((i, cost))

    def best(self, j: int, unit: int = 1) -> tuple[float, int]:
        return min((c + math.log10((j - i) // unit), i) for i, c in self.kept)


class Guesser:
    def __init__(self, words=WORDS):
        self.rank = {}
        for i, w in enumerate(words, 1):
            self.rank.setdefault(w, math.log10(i + 1))
        self.longest = max(map(len, self.rank), default=0)
        self.tails = {w[-3:] for w in self.rank}

    def word(self, value: str, low: str, plain: str, i: int, j: int) -> float:
        """log10 guesses of value[i:j] as a word; infinite if it is none."""
        for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)):
            if form in self.rank:
                v = value[i:j]
                return self.rank[form] + extra + (0.0 if v.islower() or not v.isalpha() else 0.3 if v.istitle() or v.isupper() else 0.1 * (j - i))
        return math.inf

    def segments(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """The least log10 guesses, and the segmentation that has it.

        Every word, date, repeat (of one to four characters), keyboard walk and
        row of successive characters at every place is a candidate, parts of
        longer runs too; the time is linear in the length.
        """
        n = len(value)
        low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
        plain = low.translate(_LEET)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        brute = [_brute(c) for c in value]
        sums = [0.0]
        for x in brute:
            sums.append(sums[-1] + x)
        same = {s: [_Starts(2 if s > 1 else 3) for _ in range(s)] for s in (1, 2, 3, 4)}  # by start modulo s
        run_from = dict.fromkeys(same, 0)
        walk, row = _Starts(3), _Starts(3)
        walk_from = row_from = 0  # where the present runs begin
        turns = [0] * (n + 2)  # changes of direction before each place
        for j in range(1, n + 1):
            k = j - 1
            cost, how = best[k] + brute[k], (k, "brute")
            if j >= 3 and (low[j - 3 : j] in self.tails or plain[j - 3 : j] in self.tails):
                for i in range(max(0, j - self.longest), j - 2):
                    if (c := best[i] + self.word(value, low, plain, i, j) + _SEGMENT) < cost:
                        cost, how = c, (i, "word")
            if "0" <= value[k] <= "9":
                for size in _DATE_SIZES:
                    if size <= j and (c := best[j - size] + (_DAYS if size > 4 else 2.1) + _SEGMENT) < cost and _DATE.fullmatch(value, j - size, j):
                        cost, how = c, (j - size, "date")
            for s, starts in same.items():
                if k < s:
                    continue
                if value[k] != value[k - s]:  # a run begins after the place that differs from this one
                    run_from[s] = k - s + 1
                    for x in starts:
                        x.kept.clear()
                    continue
                x = starts[j % s]
                i = j - x.least * s
                if i >= run_from[s]:
                    x.add(i, best[i] + sums[i + s] - sums[i] + _SEGMENT, s)
                if x.kept:
                    c, i = x.best(j, s)
                    if c < cost:
                        cost, how = c, (i, "repeat")
            turns[j] = turns[k]
            if k and low[k] in _NEAR.get(low[k - 1], ""):
                if k - walk_from > 1:
                    turns[j] += _step(low[k - 2], low[k - 1]) != _step(low[k - 1], low[k])
                if j - walk_from >= 3:
                    walk.add(j - 3, best[j - 3] - _TURN * turns[j - 1] + _KEYS + _SEGMENT)  # the turns of a segment come after its second key
                    c, i = walk.best(j)
                    if c + _TURN * turns[j] < cost:
                        cost, how = c + _TURN * turns[j], (i, "walk")
            else:
                walk.kept.clear()
                walk_from = k
            if k and abs(d := ord(low[k]) - ord(low[k - 1])) == 1 and (k - 1 == row_from or d == ord(low[k - 1]) - ord(low[k - 2])):
                if j - row_from >= 3:
                    row.add(j - 3, best[j - 3] + _SIGNS + _SEGMENT)
                    c, i = row.best(j)
                    if c < cost:
                        cost, how = c, (i, "walk")
            else:
                row.kept.clear()
                row_from = k - 1 if k and abs(ord(low[k]) - ord(low[k - 1])) == 1 else k
            best[j], back[j] = cost, how
        out, j = [], n
        while j:
            i, kind = back[j]
            if kind == "brute" and out and out[-1][2] == "brute":
                out[-1] = (i, out[-1][1], "brute")
            else:
                out.append((i, j, kind))
            j = i
        return best[n], out[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the pattern matches, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, words=WORDS, least: float = LEAST_GUESSES) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans has the pattern matches and, as ``guess``, every value in a
    credential context whose guess cost reaches ``least``; ``words`` is the
    dictionary, most usual first. Positions count code points; ends are
    exclusive. A null or empty text has no spans. Texts and values may have any
    length: the work is linear in it. Repeated rows give equal results; no rows
    give no rows. Only doc_id and text are read, so other columns may have any
    names.
    """
    guesser = Guesser(words)

    def run(batches):
        for part in wordhash.slices(batches, 1):
            out = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                text = text or ""
                base = base_spans(text)
                more = []
                if "=" in text or ":" in text or " is " in text:
                    more = [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guesser.segments(m.group(1))[0] >= least]
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
