"""Collocations against plain counts of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from procura.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_pieces(text):
    found = (re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)))
    return [w for w in found if w]


def plain(docs, least, contained=80, top=2000, longest=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for words in plain_pieces(text):
            n[lang or "und" if lang is not None else "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        rows = []
        for p, a in candidates.items():
            if 100 * longer[p] >= contained * a:
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        total = sum(c for p, c in counts.items() if len(p) == 1)
        out += [(lang, r, p.decode(), -a, left, right, total, -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(spark, docs, **more):
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "text string, lang string, phrase int, n int").repartition(5)
    return sorted(tuple(r) for r in collocations.collocations(table, **more).collect())


@given(st.text(alphabet="aB é\t.\n\x0b\x1c,?中", max_size=60))
@settings(max_examples=200, deadline=None)
def test_pieces(text):
    assert [p.decode().split(" ")[:-1] for p in collocations.pieces(text)] == plain_pieces(text)


@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"dd", b"e", b"f"]), min_size=1, max_size=40), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_every_phrase_is_in_one_chunk(words, spacing):
    want = Counter(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    got = Counter()
    for own, chunk in collocations.chunks(b" ".join(words) + b" ", 4, spacing):
        held = chunk.split()
        got.update(tuple(held[i : i + k]) for k in range(1, 5) for i in range(own) if i + k <= len(held))
    assert got == want


def test_equal_passages_are_cut_alike():
    rng = random.Random(4)
    words = [f"w{i}".encode() for i in range(200)]
    passage = rng.choices(words, k=300)
    a, b = (set(collocations.chunks(b" ".join(rng.choices(words, k=n) + passage) + b" ", 4, 16)) for n in (50, 77))
    assert len(a & b) >= 0.8 * 300 / 16


@pytest.mark.parametrize("limits", [{}, {"WORDS": 40}, {"GATHERED": 100}, {"SPACING": 2}, {"BITS": 1 << 15}])
def test_against_plain_counts(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(5)
    words = ["the", "The", "red", "fox", "jumps", "über", "中文", "a'b", "x-y", " z"] + [f"r{i}" for i in range(30)]
    phrases = ["new york city", "machine learning", "in order to be", "to be or"]
    docs = []
    for i in range(150):
        parts = rng.choices(words + phrases, k=rng.randint(0, 40))
        docs.append((" ".join(p + rng.choice(["", "", "", ",", ".\n", "\t"]) for p in parts), rng.choice(["en", "de", None, "und"])))
    docs += [("same passage with many words that repeats in every copy of it", "en")] * 60
    docs += [("ha " * 3000, "en"), (None, "en"), ("", None), ("...", "xx"), ("one", "yy")]
    want = plain(docs, 6, top=25)
    assert len({r[0] for r in want}) == 3
    assert found(spark, docs, least=6, top=25) == want


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [("a b", "en")]) == []


def test_products_past_64_bits(spark):
    """Scores of counts that no table of a test can hold."""
    rows = spark.createDataFrame([(10**17, 3 * 10**17, 10**17 + 1)], "a long, l long, r long")
    score = rows.select(collocations.score().alias("s")).first()["s"]
    assert score == 2_000_000 * 10**17 // (4 * 10**17 + 1)
