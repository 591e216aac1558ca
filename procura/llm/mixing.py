"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Documents fall into cells of source, language and topic. The tokens to take from every
cell are raked until the mix has the target share of each source, language and topic; a
document stays with the probability of its cell.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.operators.joins import checkpointed

OTHER = "*"
Targets = Mapping[str, Mapping[str, float]]

# Signs of a topic, in order; the first that a text holds decides.
TOPICS = {
    "legal": ("license", "License", "LICENSE", "copyright", "Copyright"),
    "tabular": (" | ",),
    "contact": ("@", "+1-", "tel:"),
}
GENERAL = "general"

# A source with less than this share of all tokens is not weighted for itself.
LEAST = 0.005

# An example mix: fixed shares; ``*`` is every other value, null too.
DEFAULT: Targets = {
    "source": {"src0": 0.15, OTHER: 0.85},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.1, OTHER: 0.02},
    "topic": {"legal": 0.05, "tabular": 0.1, "contact": 0.1, GENERAL: 0.75},
}


def topic_of(text: Column) -> Column:
    """The topic of a text; null and empty texts are general."""
    out = F.lit(GENERAL)
    for name, signs in reversed(TOPICS.items()):
        found = F.lit(False)
        for sign in signs:
            found = found | text.contains(sign)
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(words, lambda w: w != "")).cast("long")


def group_of(column: Column, shares: Mapping[str, float]) -> Column:
    """The value where the targets name it, else ``*``."""
    named = [v for v in shares if v != OTHER]
    return F.when(column.isin(named), column).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def rake(tokens: np.ndarray, shares: list[np.ndarray], budget: float, rounds: int = 500) -> np.ndarray:
    """Tokens to take from each cell: marginals in proportion to ``shares``, no cell above its own.

    Targets of values without tokens are spread over the others. A sweep scales every
    margin in turn and then cuts cells to what they hold; where the targets cannot all be
    met, the last sweep is the compromise and at most ``budget`` is taken.
    """
    total = tokens.sum()
    if not total:
        return np.zeros_like(tokens)
    x, goal = tokens * min(1.0, budget / total), min(budget, total)
    axes = range(tokens.ndim)
    wanted = []
    for axis in axes:
        held = tokens.sum(axis=tuple(a for a in axes if a != axis)) > 0
        share = np.where(held, shares[axis], 0.0)
        share = share if share.sum() > 0 else held.astype(float)
        wanted.append(goal * share / share.sum())
    for _ in range(rounds):
        before = x.copy()
        for axis in axes:
            now = x.sum(axis=tuple(a for a in axes if a != axis))
            factor = np.divide(wanted[axis], now, out=np.ones_like(now), where=now > 0)
            x = x * factor.reshape([-1 if a == axis else 1 for a in axes])
        x = np.minimum(x, tokens)
        if np.abs(x - before).max() <= 1e-9 * goal:
            break
    return x


@dataclass
class Mix:
    """``probability`` and ``weight`` (relative to an even sample) of each cell."""

    targets: Targets
    probability: dict[tuple[str, ...], float]
    weight: dict[tuple[str, ...], float]

    def _value(self, cells: dict[tuple[str, ...], float], groups: list[Column]) -> Column:
        pairs = [F.lit(x) for cell, v in cells.items() for x in ("\x1f".join(cell), float(v))]
        return F.element_at(F.create_map(*pairs), F.concat_ws("\x1f", *groups))


def calibrate(docs: DataFrame, targets: Targets = DEFAULT, share: float = 0.5, tokens: str = "n_tokens") -> Mix:
    """Rake the cells of ``docs`` (a column of groups per target, and ``tokens``).

    ``share`` of all tokens is to be taken. The cells are as many as the targets have
    values, multiplied: a fixed number, whatever the data; their totals are one
    aggregate with map-side sums. A cell without tokens has the probability ``share``.
    """
    names = list(targets)
    values = [list(dict.fromkeys([*targets[n], OTHER])) for n in names]
    held = docs.groupBy(*names).agg(F.sum(tokens).alias("n")).collect()
    counted = np.zeros([len(v) for v in values])
    for row in held:
        counted[tuple(v.index(row[n]) for n, v in zip(names, values, strict=True))] += row["n"] or 0
    shares = [np.array([float(targets[n].get(v, 0.0)) for v in vs]) for n, vs in zip(names, values, strict=True)]
    taken = rake(counted, shares, share * counted.sum())
    chance = np.divide(taken, counted, out=np.full_like(counted, share), where=counted > 0)
    cells = list(product(*values))
    probability = dict(zip(cells, np.minimum(chance, 1.0).ravel(), strict=True))
    return Mix(targets, probability, {c: p / share if share else 0.0 for c, p in probability.items()})


def grouped(docs: DataFrame, targets: Targets, text: str = "text") -> DataFrame:
    """``docs`` with the group of every target in ``_mix.<name>`` and ``_mix.n_tokens``.

    A target named ``topic`` is read from the text, any other from the column of its name.
    """
    source = {n: topic_of(F.col(text)) if n == "topic" else F.col(n) for n in targets}
    groups = [group_of(F.coalesce(c.cast("string"), F.lit(OTHER)), targets[n]).alias(n) for n, c in source.items()]
    return docs.withColumn("_mix", F.struct(*groups, n_tokens(F.col(text)).alias("n_tokens")))


def balanced(docs: DataFrame, power: float = 0.5, share: float = 0.5, targets: Targets = DEFAULT, text: str = "text") -> Targets:
    """``targets`` with one for every source of ``docs``: in proportion to its tokens to a power.

    Sources with less than ``LEAST`` of all tokens, and null, stay together in ``*`` and keep
    the share of tokens that they have; so at most ``1 / LEAST`` sources are named. No source
    is to give more than it holds when ``share`` of all tokens is taken.
    """
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(n_tokens(F.col(text))).alias("n"))
    return _balanced(sizes, power, share, targets)


def _balanced(sizes: DataFrame, power: float, share: float, targets: Targets) -> Targets:
    total = sizes.agg(F.sum("n")).first()[0] or 0
    named = sizes.where((F.col("source") != OTHER) & (F.col("n") >= LEAST * total) & (F.col("n") > 0)).collect()
    held = {r["source"]: r["n"] / total for r in sorted(named, key=lambda r: r["source"])}
    rest = max(0.0, 1.0 - sum(held.values()))
    wanted, open_ones, left = {}, set(held), 1.0 - rest
    while open_ones:
        unit = left / sum(held[n] ** power for n in open_ones)
        full = [n for n in held if n in open_ones and unit * held[n] ** power * share > held[n]]
        # Such a source gives all it holds, and the others share the rest.
        for n in full or list(open_ones):
            wanted[n] = held[n] / share if full else unit * held[n] ** power
        left -= sum(wanted[n] for n in full)
        open_ones -= set(full or open_ones)
    return {**targets, "source": {**{n: wanted[n] for n in held}, OTHER: rest if held else 1.0}}


def draw(id_column: str, text: str, seed: int) -> Column:
    """A number in [0, 1) from the id, or from the text where the id is null."""
    key = F.coalesce(F.col(id_column).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / float(16**13)


def mix(docs: DataFrame, targets: Targets = DEFAULT, share: float = 0.5, seed: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_mix``: groups, ``n_tokens``, ``weight``, ``probability``, ``kept``.

    A row is kept when a number drawn from its id by a hash lies below its probability,
    so runs repeat and rows that repeat an id share its fate. Null values of a target
    belong to ``*``; null and empty texts have no tokens. Texts are read twice, once for
    the totals and once for the rows, and never shuffled.
    """
    rows = grouped(docs, targets, text)
    return _drawn(rows, calibrate(rows.select("_mix.*"), targets, share), seed, id_column, text)


def mix_balanced(
    docs: DataFrame, power: float = 0.5, share: float = 0.5, targets: Targets = DEFAULT, seed: int = 1, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``mix`` with the targets of ``balanced``, in the same two passes over the texts.

    The totals are kept by source as it is and by the groups of the other targets, a table
    without texts; the named sources, and then the cells, are taken from it.
    """
    others = {n: v for n, v in targets.items() if n != "source"}
    source = F.col("source").cast("string").alias("source")
    cells = grouped(docs, others, text).select(source, "_mix.*").groupBy("source", *others).agg(F.sum("n_tokens").alias("n_tokens"))
    cells = checkpointed(cells)
    chosen = _balanced(cells.groupBy("source").agg(F.sum("n_tokens").alias("n")), power, share, targets)
    named = group_of(F.coalesce("source", F.lit(OTHER)), chosen["source"])
    plan = calibrate(cells.withColumn("source", named), chosen, share)
    return _drawn(grouped(docs, chosen, text), plan, seed, id_column, text)


def _drawn(rows: DataFrame, plan: Mix, seed: int, id_column: str, text: str) -> DataFrame:
    groups = [F.col(f"_mix.{n}") for n in plan.targets]
    probability, weight = plan._value(plan.probability, groups), plan._value(plan.weight, groups)
    extra = F.struct(
        *groups, F.col("_mix.n_tokens"), weight.alias("weight"), probability.alias("probability"),
        (draw(id_column, text, seed) < probability).alias("kept"),
    )
    return rows.withColumn("_mix", extra)
