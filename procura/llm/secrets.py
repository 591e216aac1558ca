"""Secrets in texts: fixed patterns, and values whose guess cost is that of a secret.

Values that stand in a credential context are priced by a dynamic program: the cheapest
way to cut them into words, dates, repeats, keyboard walks and brute-force spans gives the
logarithm of the guesses an attacker needs. Weak values ("changeme", "qwerty123") and
ordinary words are left alone.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from procura.llm.common import release_memory

KINDS = ("assign", "access", "hex", "guess")
MASK = "[secret]"
# Guesses (a power of ten) from which a value in a credential context is a secret.
GUESSES = 10.0
# Letters of a word that is not in the list, at most, and characters of a unit that repeats.
LETTERS = 14
UNIT = 8

# The base patterns.
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

_CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|(?:api|access|private|signing|encryption)[_\x20-]?key|credentials?|auth)"""
    r"""["']?\x20*(?::=|=>|[:=])\x20*["'`]?([!-~]{6,})"""
)
_CONTEXT_HINTS = (b"pass", b"pwd", b"pin", b"secret", b"token", b"key", b"credential", b"auth")

# Frequent choices, most frequent first.
_WORDS = """password admin welcome login letmein qwerty monkey dragon master secret test user root guest
changeme default example sample demo hello sunshine princess football baseball superman batman shadow
michael jordan summer winter spring autumn monday friday access server public private system manager
company office internet computer google database oracle mysql postgres redis token apikey placeholder
your none null true false undefined todo here insert value string xxxx change this that the and for
money love freedom whatever trustno flower cheese cookie pepper ginger soccer hockey tigger charlie
andrew thomas robert daniel george jessica ashley amanda maggie hunter ranger harley yankees""".split()
_RANK = {w: k + 1 for k, w in enumerate(_WORDS)}
_LONGEST = max(map(len, _WORDS))
_LEET = str.maketrans("013457@$!", "oieastasi")
_ROWS = ("`1234567890-=", "\tqwertyuiop[]", "\0asdfghjkl;'", "\0zxcvbnm,./")
_KEYS = {c: (y, x) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", re.A)
_YEAR = re.compile(r"(?:19|20)\d\d", re.A)
_LETTERS, _VOWELS, _DIGITS = frozenset("abcdefghijklmnopqrstuvwxyz"), frozenset("aeiouy"), frozenset("0123456789")


def _near(a: str, b: str) -> bool:
    """Keys side by side, or characters one step apart."""
    p, q = _KEYS.get(a), _KEYS.get(b)
    return abs(ord(a) - ord(b)) == 1 or bool(p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


class _Starts:
    """The cheapest start of a run for every end, where length adds its logarithm.

    A start costs what leads to it; a segment from it adds log10 of its length. As lengths
    grow, an earlier start loses less by each step: once it is as cheap as a later one, it
    stays so. Starts wait on a stack, latest on top, until the one below overtakes them.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[float, int, float]] = []  # cost, start, end at which the one below overtakes

    @staticmethod
    def _overtaken(below: tuple[float, int, float], cost: float, start: int) -> float:
        ratio = 10.0 ** min(cost - below[0], 300.0)
        return (ratio * start - below[1]) / (ratio - 1.0) if ratio > 1.0 else math.inf

    def least(self, end: int) -> float:
        stack = self.stack
        while len(stack) > 1 and stack[-2][0] + math.log10(end - stack[-2][1]) <= stack[-1][0] + math.log10(end - stack[-1][1]):
            stack.pop()
        return stack[-1][0] + math.log10(end - stack[-1][1]) if stack else math.inf

    def add(self, cost: float, start: int, end: int) -> float:
        """Let a start in, later than those before; the least cost at ``end`` with it."""
        stack, own = self.stack, cost + math.log10(end - start)
        before = self.least(end)
        if before <= own:
            return before
        while stack and (at := self._overtaken(stack[-1], cost, start)) >= stack[-1][2]:
            stack.pop()
        stack.append((cost, start, at if stack else math.inf))
        return own


def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``; 0 when empty.

    Segments are single characters at their class's cost, and after the choice of a kind:
    words of the list by rank, also in capitals or with digits for letters; other words
    (4 to ``LETTERS`` letters that can be spoken: a vowel, at most three consonants in a
    row), as one of 100,000; dates and years; walks of 3 or more neighbouring keys or
    characters; repeats of a unit of 1 to ``UNIT`` characters. The minimum is over all
    segmentations, in time proportional to the value.
    """
    n = len(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    joint = math.log10(2)  # which kind of segment follows
    chars = [0.0, *itertools.accumulate(map(_char_cost, value))]
    best = [0.0] * (n + 1)
    walks = _Starts()
    walk_from = 0
    units = [_Starts() for _ in range(UNIT + 1)]
    period_from = [0] * (UNIT + 1)
    for end in range(1, n + 1):
        last = end - 1
        cost = math.inf
        if plain[last] in _LETTERS:
            cost = _words(value, low, plain, end, best, joint)
        if value[last] in _DIGITS:
            if end >= 4 and _YEAR.fullmatch(value, end - 4, end):
                cost = min(cost, best[end - 4] + math.log10(120))
            for start in range(max(0, end - 10), end - 5):
                if value[start] in _DIGITS and _DATE.fullmatch(value, start, end):
                    cost = min(cost, best[start] + math.log10(365 * 120))
        if last and _near(low[last - 1], low[last]):
            if end - 3 >= walk_from:
                cost = min(cost, walks.add(best[end - 3], end - 3, end) + math.log10(47 * 8))
        else:
            walk_from, walks.stack = last, []
        for unit in range(1, UNIT + 1):
            if last < unit:
                break
            if value[last] != value[last - unit]:
                period_from[unit] = last - unit + 1
                if units[unit].stack:
                    units[unit].stack = []
            elif (start := end - 2 * unit) >= period_from[unit]:
                whole = best[start] + chars[start + unit] - chars[start]
                cost = min(cost, units[unit].add(whole, start, end) - math.log10(unit))
        best[end] = min(best[last] + chars[end] - chars[last], cost + joint)
    return best[n]


def _words(value: str, low: str, plain: str, end: int, best: list[float], joint: float) -> float:
    """Least cost of a word that ends at ``end``, listed or spoken, and what leads to it."""
    cost, row, vowel, letters, spoken = math.inf, 0, False, True, True
    for start in range(end - 1, max(-1, end - max(LETTERS, _LONGEST) - 1), -1):
        if plain[start] not in _LETTERS:
            break
        size, letters = end - start, letters and low[start] in _LETTERS
        if (rank := _RANK.get(plain[start:end])) is not None:
            upper = joint if value[start:end] != low[start:end] else 0.0
            cost = min(cost, best[start] + math.log10(rank + 1) + (0.0 if letters else joint) + upper)
        voiced = low[start] in _VOWELS
        vowel, row = vowel or voiced, 0 if voiced else row + 1
        spoken = spoken and letters and row <= 3 and size <= LETTERS
        if spoken and vowel and size >= 4:
            piece = value[start:end]
            steady = piece in (low[start:end], piece.upper(), piece.capitalize())
            cost = min(cost, best[start] + (5.0 if steady else 5.0 + size * joint))
    return cost


def find(text: str | None) -> list[tuple[int, int, int, int]]:
    """Spans as (start, kind, end, start of the value), in order; places are code points.

    ``kind`` counts in ``KINDS``. Base patterns are matched leftmost and without overlap,
    each for itself. Other values in a credential context join where they cost ``GUESSES``
    or more and no base span covers them. They end before the next assignment of the base
    patterns; one that meets a base span ends with its quote, too.
    """
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    low = data.lower()
    out = []
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    place, at = 0, 0
    for m in _HEX.finditer(data):
        place += m.start() - at if len(data) == len(text) else len(data[at : m.start()].decode("utf-8", "surrogatepass"))
        at = m.start()
        out.append((place, 2, place + len(m[0]), place))
    if any(h in low for h in _CONTEXT_HINTS):
        taken = sorted((value, e) for _, _, e, value in out)
        starts, reach = [s for s, _ in taken], list(itertools.accumulate((e for _, e in taken), max))
        heads = sorted(s for s, kind, _, _ in out if kind == 0)
        m = _CONTEXT.search(text)
        while m:
            start, stop = m.start(1), m.end(1)
            after = bisect.bisect_right(heads, start)
            cut = after < len(heads) and heads[after] < stop
            stop = heads[after] if cut else stop
            value = text[start:stop]
            # An assignment that follows is joined by one of these signs.
            value = value.rstrip("\"'`,;.)]}>" + "&?|" * cut)
            end = start + len(value)
            # Back from the last span that starts before the end, while any reaches the start.
            met, k = [], bisect.bisect_left(starts, end)
            while k and reach[k - 1] > start:
                k -= 1
                met += [taken[k]] if taken[k][1] > start else []
            if met and (quote := text[start - 1]) in "\"'`" and quote in value:
                end = text.index(quote, start)
                value = text[start:end]
            covered = any(s <= start and end <= e for s, e in met)
            if len(value) >= 6 and not covered and guess_cost(value) >= GUESSES:
                out.append((start, 3, end, start))
            m = _CONTEXT.search(text, stop)
    return sorted(out)


def redacted(text: str | None) -> str | None:
    """The text with every found value replaced by ``MASK``, the union where values meet."""
    out, at = [], 0
    for start, end in sorted((value, end) for _, _, end, value in find(text)):
        if end > at:
            if start >= at:
                out += [text[at:start], MASK]
            at = end
    return "".join([*out, text[at:]]) if out else text


def _written(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def scan(text: Column) -> Column:
    """Struct of ``n_assign, n_access, n_hex, base_sha256, spans`` of a text column.

    Null texts count as empty. ``spans`` lists ``kind:start:end``, by start and kind;
    ``base_sha256`` is the digest of the same list without the spans of the method.
    """

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = find(t if isinstance(t, str) else None)
            base = [s for s in spans if s[1] < 3]
            rows.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype="int64" if k < 3 else object) for k, n in enumerate(names)})

    return run(text)


def redact(text: Column) -> Column:
    """A text column without its secrets; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        clean = [redacted(t if isinstance(t, str) else None) for t in texts]
        release_memory()
        return pd.Series(clean, dtype=object)

    return run(text)
