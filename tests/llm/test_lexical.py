"""Ranked lexical search against a plain ranking of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from procura.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall(text.translate(LOWER)) if text is not None else []


def plain(docs, items, k=10):
    bags = [(i, plain_terms(t)) for i, t in docs]
    bags = [(i, w, Counter(w)) for i, w in bags if w]
    n_docs, n_terms = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for _, _, bag in bags for t in bag)
    out = []
    for item, text in items:
        asked, scores = Counter(plain_terms(text)), []
        for doc, words, bag in bags:
            m, score = 100 - 75 + 75 * len(words) * n_docs // n_terms, 0
            for t, q in asked.items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += q * w * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    docs = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(5)
    items = spark.createDataFrame([(*i, 1.0) for i in items], "item_id long, text string, score double")
    rows = lexical.ranked_search(docs, items, **more).collect()
    return sorted([tuple(r) for r in rows], key=repr)


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_terms(text):
    assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_against_every_document(spark, monkeypatch, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "ñ", "中文", "X9"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(200)]
    docs += [(i + 1000, docs[7][1]) for i in range(40)]  # ties
    docs += [(5, "w1 w1"), (5, "w1 w1"), (None, "w1 w2"), (None, None), (9999, None), (9998, "..."), (2**60 + 1, "w3")]
    docs.append((7777, "w2 " * 30_000))
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(30)] + [(77, None), (78, ""), (79, "absent"), (80, "w1, W1; w1")]
    for name, value in (("DOCS", 16), ("ITEMS", 7), ("TERMS", 5)):
        monkeypatch.setattr(lexical, name, value)
    want = plain(docs, items, k)
    assert found(spark, docs, items, k=k) == want
    assert found(spark, docs, items, k=k, item_bytes=300) == want  # several passes


def test_repeated_items(spark):
    docs = [(1, "a b"), (2, "a")]
    assert found(spark, docs, [(1, "a"), (1, "a"), (None, "a")]) == plain(docs, [(1, "a")])
    assert found(spark, docs, [(1, "a"), (1, "b")]) == sorted(plain(docs, [(1, "a")]) + plain(docs, [(1, "b")]), key=repr)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []


def test_products_of_longs_where_doubles_are_not_exact(spark):
    known, tiles = lexical.item_tiles(["a " * 310_000 + "b", "a b"])
    weights = np.full(len(known), 30_000, np.int64)
    assert lexical._kind(tiles[0][2][0], weights) is np.int64
    assert lexical._kind(lexical.item_tiles(["a b"])[1][0][2][0], weights) is np.float64
    docs = [(1, "a b c"), (2, "b b"), (3, "c d"), (4, "d"), (5, "e")]
    items = [(1, "a " * 3_000_000 + "b"), (2, "a b")]
    assert found(spark, docs, items) == plain(docs, items)
