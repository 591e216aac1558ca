"""Quality score by Naive Bayes support vectors.

A document is a set of hashed n-gram indicators: words (one and two in a row) and word
shapes (one to three in a row). Each indicator is scaled by the log-ratio of its smoothed
class counts; a linear hinge-loss model over them is fitted by dual coordinate descent and
its margin turned into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.llm.common import mix, word_hashes
from procura.operators.joins import checkpointed

_SHAPE = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """``ratio``: log-count ratio of each bucket; ``weights``: of the scaled indicators."""

    ratio: np.ndarray
    weights: np.ndarray
    constant: float
    slope: float
    offset: float


def _shapes(text: str, known: dict[bytes, int]) -> np.ndarray:
    """A number per word: its letters, digits and signs with runs cut to one.

    ``known`` holds shapes met before; it is emptied when it has grown large.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_SHAPE).split()
    out = [known.get(w) for w in words]
    if None in out:
        if len(known) > 100_000:
            known.clear()
        for k, code in enumerate(out):
            if code is None:
                out[k] = known[words[k]] = xxhash.xxh3_64_intdigest(_RUN.sub(rb"\1", words[k]))
    return np.array(out, np.uint64)


def features(text: str | None, buckets: int, known: dict[bytes, int]) -> np.ndarray:
    """The buckets of a text's n-grams, each once, rising; one of its own for no words."""
    words = word_hashes(text)
    if not len(words):
        return np.array([0], np.int64)
    shapes = mix(_shapes(text, known))
    # The shape of a word that repeats the one before is another.
    shapes[1:] ^= np.where(words[1:] == words[:-1], np.uint64(1), np.uint64(0))
    grams = [mix(words), mix(words[:-1] * _STEP + words[1:])]
    run = np.zeros(len(shapes), np.uint64)
    for n in range(1, 4):
        if n <= len(shapes):
            run = mix(run[: len(shapes) - n + 1] * _STEP + shapes[n - 1 :] + np.uint64(n))
            grams.append(run)
    return np.unique(np.concatenate(grams) % np.uint64(buckets - 1)).astype(np.int64) + 1


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and constant; row k has the values ``scale[rows[k]]``, labels are +1 or -1."""
    w, constant, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norm = np.array([float(scale[r] @ scale[r]) + 1 for r in rows])
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            r, y = rows[k], labels[k]
            x = scale[r]
            new = min(max(alpha[k] - (y * (w[r] @ x + constant) - 1) / norm[k], 0.0), cost)
            if new != alpha[k]:
                step = (new - alpha[k]) * y
                w[r] += step * x
                constant += step
                alpha[k] = new
    return w, constant


def _platt(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with smoothed targets, by Newton steps."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([margin, np.ones(len(margin))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-6 * beta)
        beta += step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text", label: str = "quality",
    buckets: int = 1 << 17, sample: int = 16_000, fitted: int = 5_000, cost: float = 0.01, epochs: int = 10, smooth: float = 1.0,
) -> Model:
    """Learn from labelled rows whose id satisfies ``learn`` (a column over ``id_column``).

    At most ``sample`` of them are read, chosen by a hash of the id, so that no text is
    shuffled: their ids are broadcast. Class counts cover the sample; the margin is fitted
    to at most ``fitted`` ids of it, and a fifth of those sets the probability. Of rows that
    repeat an id the margin is fitted to the smallest text. An id with several labels has
    the one that at least half of them say; null labels and texts of
    unlabelled ids are not read. With labels of one class only, or none, every score is
    the share of label 1, or one half.
    """
    truth = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull() & learn)
        .groupBy(F.col(id_column).alias("_id")).agg((F.avg(label) >= 0.5).alias("_good"))
    )
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, total, known = np.zeros((2, buckets), np.int64), np.zeros(2, np.int64), {}
        for batch in batches:
            for t, good in zip(batch["_text"], batch["_good"], strict=True):
                found[int(good), features(t if isinstance(t, str) else None, buckets, known)] += 1
                total[int(good)] += 1
        at = np.flatnonzero(found.any(axis=0))
        yield pd.DataFrame({"bucket": np.append(at, -1), "bad": np.append(found[0, at], total[0]), "good": np.append(found[1, at], total[1])})

    place = F.row_number().over(Window.orderBy(F.xxhash64("_id"), "_id"))
    chosen = checkpointed(truth.orderBy(F.xxhash64("_id"), "_id").limit(sample).withColumn("_place", place))
    counted = rows.join(F.broadcast(chosen), "_id").select("_text", "_good").mapInPandas(count, "bucket long, bad long, good long")
    sums = counted.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    totals = sums[sums["bucket"] == -1]
    bad, good = int(totals["bad"].sum()), int(totals["good"].sum())
    share = good / (bad + good) if bad + good else 0.5
    flat = Model(np.zeros(buckets), np.zeros(buckets), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if not bad or not good:
        return flat
    sums = sums[sums["bucket"] >= 0]
    n = np.full((2, buckets), smooth)
    n[0, sums["bucket"]] += sums["bad"].to_numpy()
    n[1, sums["bucket"]] += sums["good"].to_numpy()
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for i, t, y in zip(batch["_id"], batch["_text"], batch["_good"], strict=True):
                at = features(t if isinstance(t, str) else None, buckets, known)
                yield pd.DataFrame({"_id": [i], "_good": [y], "_at": [at.astype(np.int32)]})

    # Copies of a chosen id are one example, so that they cannot push out others.
    kept = rows.join(F.broadcast(chosen.where(F.col("_place") <= fitted)), "_id").groupBy("_id", "_good").agg(F.min("_text").alias("_text"))
    data = kept.mapInPandas(sparse, "_id long, _good boolean, _at array<int>").toPandas()
    data = data.sort_values("_id", kind="stable")
    examples, positive = [np.asarray(a, np.int64) for a in data["_at"]], data["_good"].to_numpy(bool)
    if positive.all() or not positive.any():
        return flat
    # Every fifth of each class; with less than five of one, all rows serve both.
    place = np.where(positive, np.cumsum(positive), np.cumsum(~positive)) - 1
    held = place % 5 == 4
    few = len(set(positive[held])) < 2
    w, constant = dual_descent([e for e, h in zip(examples, held, strict=True) if few or not h], np.where(positive[~held | few], 1, -1), ratio, cost, epochs)
    held |= few
    margin = np.array([w[e] @ ratio[e] + constant for e, h in zip(examples, held, strict=True) if h])
    return Model(ratio, w, constant, *_platt(margin, positive[held]))


def score(model: Model, text: Column) -> Column:
    """The probability of label 1; null and empty texts count as texts without words."""
    weights, constant, slope, offset = model.weights * model.ratio, model.constant, model.slope, model.offset
    buckets = len(weights)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        known: dict[bytes, int] = {}
        margin = [weights[features(t if isinstance(t, str) else None, buckets, known)].sum() + constant for t in texts]
        z = slope * np.array(margin, float) + offset
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return scored(text)
