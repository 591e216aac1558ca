"""Language identification: multinomial logistic regression on character n-grams.

Features are hashed n-grams of the lower-cased text with sublinear counts, weighted by
inverse document frequency and scaled to length 1. The model is learned by
follow-the-regularised-leader with an elastic net, which leaves it sparse, and its
scores are calibrated by a temperature on documents that it was not fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.llm.common import mix, release_memory

UNKNOWN = "und"
# Characters worked off at once, so that memory does not follow the longest text.
SLICE = 200_000
# Parts in which the ids of one language are ranked before its first ones meet.
PARTS = 1024


@dataclass
class Model:
    """``weights``: one row per bucket and one for the constant, a column per language."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    longest: int


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str, buckets: int, longest: int) -> np.ndarray:
    """How often each bucket's n-grams (1 to ``longest`` characters) occur in a text."""
    out = np.zeros(buckets, np.int64)
    for lo in range(0, len(text), SLICE):
        # A slice repeats the end of the one before; n-grams within that are its own.
        back = min(lo, longest - 1)
        part = text[lo - back : lo + SLICE].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        gram = np.zeros(len(codes), np.uint64)
        for n in range(1, min(longest, len(codes)) + 1):
            gram = (gram[: len(codes) - n + 1] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            fresh = gram[max(0, back - n + 1) :]
            out += np.bincount((mix(fresh) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return out


def features(text: str, idf: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of a text, of length 1."""
    n = counts(text, len(idf), longest)
    at = np.flatnonzero(n)
    value = (1 + np.log(n[at])) * idf[at]
    return at, value / max(1e-12, float(np.sqrt(value @ value)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, epochs: int,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1,
) -> np.ndarray:
    """Weights (size x classes) by follow-the-regularised-leader, one row at a time."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, value, label = rows[k]
            w = weights(z[at], n[at])
            p = _softmax(value @ w)
            p[label] -= 1
            g = value[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(z, n)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log-loss, between 1/20 and 20."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(-3, 3, 121))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-300).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(
    docs: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text", lang: str = "lang",
    buckets: int = 1 << 15, longest: int = 3, sample: int = 2000, epochs: int = 4,
) -> Model:
    """Learn from the rows where ``learn`` holds and neither id, text nor language is null.

    Document frequencies count every such row. Weights are fitted to at most ``sample``
    of them, as many of each language as there are, chosen by a hash of the id; a tenth
    sets the temperature. Of rows that repeat an id and a language the smallest text
    counts. Without any such row the model knows no language.
    """
    rows = docs.where(learn & F.col(id_column).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(id_column).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, total = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for t in batch["_text"]:
                found += counts(t, buckets, longest) > 0
                total += 1
        at = np.flatnonzero(found)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(found[at], total)})
        release_memory()

    counted = rows.select("_text").mapInPandas(frequencies, "bucket long, n long")
    df = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # a row per bucket at most
    total = int(df.loc[df["bucket"] == -1, "n"].sum())
    if not total:
        return Model([], np.zeros(buckets), np.zeros((buckets + 1, 0)), 1.0, longest)
    seen = np.zeros(buckets)
    df = df[df["bucket"] >= 0]
    seen[df["bucket"].to_numpy()] = df["n"].to_numpy()
    idf = np.log((1 + total) / (1 + seen)) + 1

    # Ids first: texts are read for the chosen only. ``sample`` ids fit any executor.
    order = F.xxhash64("_id")
    ids = rows.groupBy("_id").agg(F.min("_lang").alias("_lang"))
    # One language may hold most ids: its first ones are found in parts, then meet.
    early = Window.partitionBy("_lang", F.pmod(order, F.lit(PARTS))).orderBy(order, "_id")
    few = ids.withColumn("_rank", F.row_number().over(early)).where(F.col("_rank") <= sample)
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(order, "_id")))
    chosen = ranked.where(F.col("_rank") <= sample).orderBy("_rank", order, "_lang").limit(sample).select("_id", "_lang")

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, name, t in zip(batch["_id"], batch["_lang"], batch["_text"], strict=True):
                at, value = features(t, idf, longest)
                yield pd.DataFrame({"_id": [i], "_lang": [name], "_at": [at.astype(np.int32)], "_value": [value.astype(np.float32)]})

    # Copies of a chosen id are one example, so that they cannot push out others.
    texts = rows.join(F.broadcast(chosen), ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))
    kept = texts.mapInPandas(sparse, "_id long, _lang string, _at array<int>, _value array<float>")
    data = kept.toPandas().sort_values("_id")
    languages = sorted(set(data["_lang"]))
    examples = [
        (np.append(np.asarray(at, np.int64), buckets), np.append(value, 1.0).astype(np.float64), languages.index(name))
        for at, value, name in zip(data["_at"], data["_value"], data["_lang"], strict=True)
    ]
    held = [k % 10 == 9 for k in range(len(examples))]
    weights = ftrl([e for e, h in zip(examples, held, strict=True) if not h], buckets + 1, len(languages), epochs)
    logits = np.array([value @ weights[at] for (at, value, _), h in zip(examples, held, strict=True) if h])
    labels = np.array([label for (*_, label), h in zip(examples, held, strict=True) if h], np.int64)
    return Model(languages, idf, weights, _temperature(logits, labels), longest)


def predict(model: Model, text: Column) -> Column:
    """Struct of ``lang_pred`` and ``score`` (0 to 1) of a text column.

    ``und`` with score 0 for a text that is null or has no letter, and for every text if
    the model knows no language.
    """
    spark_model = model

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        m, names, scores = spark_model, [], []
        for t in texts:
            if not m.languages or not isinstance(t, str) or not has_letter(t):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, value = features(t, m.idf, m.longest)
            p = _softmax((value @ m.weights[at] + m.weights[-1]) / m.temperature)
            names.append(m.languages[int(p.argmax())])
            scores.append(min(1.0, float(p.max())))
        release_memory()
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    return judged(text)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; see ``predict``. Columns of these names are replaced."""
    out = docs.withColumn("_found", predict(model, F.col(text)))
    return out.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")
