from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from procura.llm import mixing, queries


def test_rake_meets_feasible_margins():
    rng = np.random.default_rng(2)
    tokens = rng.integers(100, 1000, (3, 4, 2)).astype(float)
    shares = [np.array([0.3, 0.4, 0.3]), np.array([0.2, 0.3, 0.2, 0.3]), np.array([0.5, 0.5])]
    x = mixing.rake(tokens, shares, 0.2 * tokens.sum())
    assert (x <= tokens).all() and x.sum() == pytest.approx(0.2 * tokens.sum())
    for axis, share in enumerate(shares):
        got = x.sum(axis=tuple(a for a in range(3) if a != axis)) / x.sum()
        assert got == pytest.approx(share, abs=1e-6)
    # Fitting keeps the odds ratios of the table.
    odds = lambda t: t[0, 0, 0] * t[1, 1, 0] / t[0, 1, 0] / t[1, 0, 0]
    assert odds(x) == pytest.approx(odds(tokens))


def test_rake_without_room():
    x = mixing.rake(np.array([[10.0, 0.0], [0.0, 1000.0]]), [np.array([0.9, 0.1]), np.array([0.9, 0.1])], 500.0)
    assert x[0, 0] <= 10 and x.sum() <= 500 + 1e-6
    assert not mixing.rake(np.zeros((2, 2)), [np.ones(2)] * 2, 5.0).any()


def brute(rows, targets, share, seed):
    """Cells, plain dictionaries and the same draws."""
    topic = lambda t: next((n for n, s in mixing.TOPICS.items() if any(x in t for x in s)), mixing.GENERAL)
    of = lambda n, v: v if v in targets[n] else "*"
    cells = [(of("source", r[3]), of("lang", r[2]), of("topic", topic(r[1] or ""))) for r in rows]
    size = [len((r[1] or "").encode().split()) for r in rows]
    values = [[*dict.fromkeys([*targets[n], "*"])] for n in ("source", "lang", "topic")]
    held = {c: 0.0 for c in itertools.product(*values)}
    for c, n in zip(cells, size):
        held[c] += n
    total = sum(held.values())
    x, goal = {c: n * share for c, n in held.items()}, total * share
    for _ in range(500):
        before = dict(x)
        for axis, n in enumerate(("source", "lang", "topic")):
            live = [v for v in values[axis] if sum(h for c, h in held.items() if c[axis] == v) > 0]
            mass = sum(targets[n].get(v, 0) for v in live)
            for v in live:
                now = sum(y for c, y in x.items() if c[axis] == v)
                if now > 0:
                    f = goal * targets[n].get(v, 0) / mass / now
                    x = {c: y * f if c[axis] == v else y for c, y in x.items()}
        x = {c: min(y, held[c]) for c, y in x.items()}
        if max(abs(x[c] - before[c]) for c in x) <= 1e-9 * goal:
            break
    out = []
    for r, c, n in zip(rows, cells, size):
        p = min(1.0, x[c] / held[c]) if held[c] else share
        key = str(r[0]) if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 16**13
        out.append((str(r[0]), *c, n, round(p, 6), u < p))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), *r._mix[:3], r._mix.n_tokens, round(r._mix.probability, 6), r._mix.kept) for r in df.collect())


def test_hard_rows_against_brute_force(spark):
    rows = [(i, "a b\tc " * (i % 9) + ("license" if i % 5 == 0 else " | " if i % 5 == 1 else ""), ("en", "de", "fr", "xx", None)[i % 5], ("src0", "s", None)[i % 3]) for i in range(300)]
    rows += [(None, "x y", "en", "src0"), (None, None, None, None), (5, "", "en", "q"), (5, "", "en", "q"), (6, "w " * 50_000, "es", "src1")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_tokens int, topic string")
    got = mixing.mix(df, share=0.4, seed=3)
    assert set(df.columns) < set(got.columns)
    assert result(got) == brute(rows, mixing.DEFAULT, 0.4, 3)
    assert mixing.mix(df.limit(0)).collect() == []


@pytest.mark.parametrize("hot", ["zeta", "src0", "it's\\ ünï"])
def test_every_source_meets_its_target(spark, tmp_path, hot):
    rng = random.Random(6)
    langs, topics = ["en"] * 50 + ["de"] * 20 + ["fr"] * 18 + ["es"] * 10 + ["xx"] * 2, [" license"] * 5 + [" | "] * 10 + [" @"] * 10 + [""] * 75
    source = lambda i: hot if i % 3 == 0 else rng.choice(["a", "b", "b", "c", "d"]) if i % 100 != 1 else rng.choice(["rare1", "rare2", "rare3", None])
    rows = [(i, "w " * rng.randint(10, 50) + rng.choice(topics), rng.choice(langs), source(i)) for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    targets = mixing.balanced(docs)["source"]
    assert set(targets) == {hot, "a", "b", "c", "d", "*"} and sum(targets.values()) == pytest.approx(1)
    size = dict(docs.groupBy("source").agg(F.sum(mixing.n_tokens(F.col("text")))).collect())
    assert targets[hot] / targets["b"] == pytest.approx((size[hot] / size["b"]) ** 0.5)
    got = queries.op2_mixing(spark, str(tmp_path)).groupBy("source").agg(F.sum(F.col("probability") * F.col("n_tokens"))).collect()
    taken = sum(n for _, n in got)
    assert taken == pytest.approx(0.5 * sum(size.values()), rel=0.01)
    assert {s: n / taken for s, n in got} == pytest.approx(targets, abs=0.005)


def test_balanced_without_room(spark):
    rows = [("big", "w " * 900), ("small", "w " * 100), ("none", "")]
    df = spark.createDataFrame(rows, "source string, text string")
    # The small source would owe 125 of 500 words and has 100.
    assert mixing.balanced(df)["source"] == pytest.approx({"big": 0.8, "small": 0.2, "*": 0.0})
    assert mixing.balanced(df.limit(0))["source"] == {"*": 1.0}


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    assert result(mixing.mix(docs)) == brute(rows, mixing.DEFAULT, 0.5, 1)
    found = queries.op2_mixing(spark, folder)
    assert found.count() == len(rows)
    assert found.agg(F.min("probability"), F.max("probability")).first()[1] <= 1


def test_balanced_in_two_passes(spark, folder):
    """Totals by source serve both the targets and the cells."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.limit(5).withColumn("source", F.lit(None).cast("string")))
    docs = docs.unionByName(docs.limit(3).withColumn("source", F.lit("rare")).withColumn("text", F.lit("a b")))
    pick = lambda d: sorted(map(str, d.select("doc_id", "_mix.*").collect()))
    assert pick(mixing.mix_balanced(docs)) == pick(mixing.mix(docs, mixing.balanced(docs)))
