"""Chat formatting: roles of transcript lines by a hidden Markov model, then rendering.

States are roles, observations are features of lines: a speaker marker, the place in its
row, length, closing sign. Transitions differ between lines that start a row or name a
speaker and the lines after them. Roles are the Viterbi path of each conversation.

A conversation may be longer than a task should hold. Rows are range-partitioned by
conversation and turn, so a long one lies in several partitions in a row. Every partition
first reports, for its first and its last conversation, the best score from each state
before to each state at its end; these few rows are chained, which fixes the states at the
borders; then every partition finds its paths by itself. The result is the exact path.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.operators.joins import checkpointed

ROLES = ("system", "user", "assistant")
# Words before a colon that name a speaker.
_NAMES = {"system": ("system", "instructions", "context"), "user": ("user", "human", "customer", "question", "q", "me"), "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "a")}
_MARKER = re.compile(
    r"\s*+(?:[*_#>\[(<|]{0,4}+)\s*+(?:" + "|".join(f"(?P<{r}>{'|'.join(n)})" for r, n in _NAMES.items()) + r")\s*+[\])>|*_]{0,4}+\s*+[:：]\s*+[*_]{0,2}\s*", re.I | re.A
)
_SIZES = (0, 30, 80, 200, 500, 1500)
# Weight of the belief that a marker names its speaker, against counted lines.
_BELIEF = 200.0

Feature = tuple[str, str]


@dataclass
class Model:
    """Logarithms: of first states, of transitions (``new row``, from, to), of features given a state."""

    first: list[float]
    step: dict[bool, list[list[float]]]
    emit: dict[Feature, list[float]]
    unseen: dict[str, list[float]]


def marker(line: str) -> tuple[str, int]:
    """The role that a line's marker names ('' without one), and where its text begins."""
    found = _MARKER.match(line)
    return (found.lastgroup, found.end()) if found else ("", 0)


def features(line: str, place: str) -> list[Feature]:
    """What is seen of a line; ``place``: first of its conversation, of its row, or later."""
    size = sum(len(line) > s for s in _SIZES)
    end = line.rstrip()[-1:]
    return [("marker", marker(line)[0]), ("size", f"{place}{size}"), ("end", end if end in "?!.:," else "-"), ("place", place)]


def _lines(text: object) -> list[str]:
    return text.split("\n") if isinstance(text, str) else [""]


def placed(conversations: DataFrame, key: str, turn: str, text: str, role: str | None = None) -> DataFrame:
    """Rows by conversation and turn in range partitions, checkpointed so that both passes see the same.

    A conversation is named by its key as text; a row without one is a conversation of its own.
    """
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("n"), F.md5(F.concat_ws("\x1f", F.col(turn).cast("string"), F.col(text)))))
    rows = conversations.select(
        F.col(key).alias("_key"), F.col(turn).alias("_turn"), F.col(text).alias("_text"),
        (F.col(role) if role else F.lit(None)).cast("string").alias("_role"), name.alias("_conv"),
    )
    order = ["_conv", "_turn", "_text", "_role"]
    return checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch[c].tolist() for c in ("_conv", "_key", "_turn", "_text", "_role", "_part")], strict=True)


def fit(rows: DataFrame, learn: Column) -> Model:
    """Count features and transitions of placed rows where ``learn`` (over ``_key``) holds.

    Only rows with a role of ``ROLES`` count; all lines of a row have its role. Tasks count
    their own rows and the sums are a few hundred. Starts and transitions between two
    partitions are not counted.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, str, str], int] = {}

        def add(*what: str) -> None:
            found[what] = found.get(what, 0) + 1

        first = True
        for _, group in groupby(_rows(batches), key=lambda r: r[0]):
            before = None
            for k, (*_, text, role, _) in enumerate(group):
                if role not in ROLES:
                    before = None
                    continue
                if k == 0 and not first:
                    add("start", "", role)
                elif before:
                    add("turn", before, role)
                for n, line in enumerate(_lines(text)):
                    for kind, value in features(line, "later" if n else "row" if k else "start"):
                        add(f"f:{kind}", value, role)
                    if n and not marker(line)[0]:
                        add("line", role, role)
                before = role
            first = False
        keys = list(found)
        yield pd.DataFrame({n: pd.Series([k[i] for k in keys], dtype=object) for i, n in enumerate(("kind", "a", "b"))} | {"n": pd.Series([found[k] for k in keys], dtype="int64")})

    counted = rows.where(learn).mapInPandas(count, "kind string, a string, b string, n long")
    sums = {(r["kind"], r["a"], r["b"]): float(r["n"]) for r in counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()}
    for r in ROLES:
        sums["f:marker", r, r] = sums.get(("f:marker", r, r), 0.0) + _BELIEF

    def share(kind: str, a: str, b: str, total: float, values: int) -> float:
        return math.log((sums.get((kind, a, b), 0.0) + 0.5) / (total + 0.5 * values))

    total = lambda kind, a=None, b=None: sum(n for (k, x, y), n in sums.items() if k == kind and a in (None, x) and b in (None, y))
    first = [share("start", "", r, total("start"), len(ROLES)) for r in ROLES]
    step = {new: [[share("turn" if new else "line", a, b, total("turn" if new else "line", a), len(ROLES)) for b in ROLES] for a in ROLES] for new in (True, False)}
    values: dict[str, set[str]] = {}
    for k, a, _ in sums:
        if k.startswith("f:"):
            values.setdefault(k[2:], set()).add(a)
    emit = {(k, v): [share(f"f:{k}", v, r, total(f"f:{k}", None, r), len(vs) + 1) for r in ROLES] for k, vs in values.items() for v in vs}
    unseen = {k: [share(f"f:{k}", "\0", r, total(f"f:{k}", None, r), len(vs) + 1) for r in ROLES] for k, vs in values.items()}
    return Model(first, step, emit, unseen)


def _seen(model: Model, line: str, place: str) -> list[float]:
    zero = [0.0] * len(ROLES)
    parts = [model.emit.get(f) or model.unseen.get(f[0], zero) for f in features(line, place)]
    return [sum(p[s] for p in parts) for s in range(len(ROLES))]


def _observed(model: Model, texts: Iterator[object], begins: bool) -> Iterator[tuple[bool, list[float]]]:
    """Whether a line starts a row or names a speaker, and its emissions; ``begins``: the conversation starts here."""
    for k, text in enumerate(texts):
        for n, line in enumerate(_lines(text)):
            yield not n or bool(marker(line)[0]), _seen(model, line, "later" if n else "row" if k or not begins else "start")


def _forward(model: Model, before: list[float] | None, lines: Iterator[tuple[bool, list[float]]], path: list[tuple[int, ...]] | None) -> list[float]:
    """Best scores at the last line; ``before``: scores of the line before (None: a start). Fills ``path`` with the best previous states."""
    states, score = range(len(ROLES)), before
    for new, seen in lines:
        if score is None:
            back, score = tuple(states), [model.first[s] + seen[s] for s in states]
        else:
            step = model.step[new]
            back = tuple(max(states, key=lambda a, s=s: (score[a] + step[a][s], -a)) for s in states)
            score = [score[back[s]] + step[back[s]][s] + seen[s] for s in states]
        if path is not None:
            path.append(back)
    return score


def _borders(rows: DataFrame, model: Model) -> dict[tuple[int, str], tuple[bool, int | None, int | None]]:
    """For the conversations at the ends of partitions: does it begin here, the state before, the state at the end."""
    states = range(len(ROLES))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, at = [], 0
        for k, (conv, group) in enumerate(groupby(_rows(batches), key=lambda r: r[0])):
            if k > 1:
                out.pop()  # neither first nor last
            scores = [None] * (len(ROLES) + 1)
            starts: list[list[float] | None] = [None, *[[0.0 if s == t else -math.inf for t in states] for s in states]]
            for n, r in enumerate(group):
                at = r[5]
                for i in range(len(starts)):
                    # From a start, and from each state at the end of the partition before.
                    begin = starts[i] if n == 0 else scores[i]
                    scores[i] = _forward(model, begin, _observed(model, [r[3]], i == 0 and n == 0), None)
            out.append((at, conv, [x for s in scores for x in s]))
        yield pd.DataFrame({"part": pd.Series([o[0] for o in out], dtype="int64"), "conv": pd.Series([o[1] for o in out], dtype=object), "score": pd.Series([o[2] for o in out], dtype=object)})

    told = sorted(rows.mapInPandas(report, "part long, conv string, score array<double>").collect(), key=lambda r: (r["part"], r["conv"]))
    out = {}
    for conv, chain in groupby(told, key=lambda r: r["conv"]):
        parts = sorted(chain, key=lambda r: r["part"])
        if len(parts) < 2:
            continue
        k = len(ROLES)
        tables = [[p["score"][k * i : k * i + k] for i in range(k + 1)] for p in parts]
        score, backs = tables[0][0], []
        for t in tables[1:]:
            back = [max(states, key=lambda a, s=s: (score[a] + t[a + 1][s], -a)) for s in states]
            score = [score[back[s]] + t[back[s] + 1][s] for s in states]
            backs.append(back)
        last = max(states, key=lambda s: (score[s], -s))
        ends = [last]
        for back in reversed(backs):
            ends.append(back[ends[-1]])
        ends.reverse()
        for n, p in enumerate(parts):
            out[p["part"], conv] = (n == 0, ends[n - 1] if n else None, ends[n])
    return out


def render(role: str, text: str) -> str:
    """One turn in canonical form."""
    return f"<|{role}|>\n{text.strip()}\n<|end|>"


def recover(rows: DataFrame, model: Model) -> DataFrame:
    """``_key, _turn, part, role, text, rendered``: the turns found in placed rows.

    Lines of a row that follow each other in one role are one part; a line with a marker
    begins another, and the marker is left out of its text. A null text is an empty line.
    """
    borders = _borders(rows, model)  # two entries for each partition at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
            held = list(group)  # within one partition
            begins, before, last = borders.get((held[0][5], conv), (True, None, None))
            path: list[tuple[int, ...]] = []
            start = None if before is None else [0.0 if s == before else -math.inf for s in range(len(ROLES))]
            score = _forward(model, start, _observed(model, (r[3] for r in held), begins), path)
            state = max(range(len(ROLES)), key=lambda s: (score[s], -s)) if last is None else last
            states = []
            for back in reversed(path):
                states.append(state)
                state = back[state]
            states.reverse()
            at = 0
            for _, key, turn, text, *_ in held:
                parts: list[tuple[str, list[str]]] = []
                for line in _lines(text):
                    role, (named, begin) = ROLES[states[at]], marker(line)
                    at += 1
                    if parts and parts[-1][0] == role and not named:
                        parts[-1][1].append(line)
                    else:
                        parts.append((role, [line[begin:]]))
                out += [(key, turn, k, role, "\n".join(lines)) for k, (role, lines) in enumerate(parts)]
            if len(out) > 2000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        text = [None if x is None or x != x else str(int(x)) for x in (o[0] for o in out)], [None if x is None or x != x else str(int(x)) for x in (o[1] for o in out)]
        return pd.DataFrame(
            {"_key": pd.Series(text[0], dtype=object), "_turn": pd.Series(text[1], dtype=object), "part": pd.Series([o[2] for o in out], dtype="int64"), "role": pd.Series([o[3] for o in out], dtype=object), "text": pd.Series([o[4] for o in out], dtype=object), "rendered": pd.Series([render(o[3], o[4]) for o in out], dtype=object)}
        )

    return rows.mapInPandas(run, "_key string, _turn string, part long, role string, text string, rendered string")


def format_chats(conversations: DataFrame, learn: Column | None = None, key: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """``key, turn, part, role, text, rendered`` of transcripts whose roles are to be found.

    The model is counted from rows where ``learn`` (a column over ``_key``; all by
    default) holds and ``role`` is known; a recovered role never looks at its own row's
    ``role``. Rows with a null key are conversations of their own; null turns come first;
    rows that repeat key and turn follow each other by text. Keys and turns are integers;
    other columns are not read.
    """
    rows = placed(conversations, key, turn, text, role)
    model = fit(rows, F.lit(True) if learn is None else learn)
    found = recover(rows.withColumn("_role", F.lit(None).cast("string")), model)
    return found.select(F.col("_key").cast("long").alias(key), F.col("_turn").cast("long").alias(turn), "part", "role", "text", "rendered")
