from __future__ import annotations

import random
import re

import pytest

from procura.llm import minhash


def brute(rows, percent=75):
    """The definition, over all pairs that share a shingle."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    pairs = {(h[x], h[y]) for h in holders.values() for y in range(len(h)) for x in range(y)}
    for x, y in pairs:
        (i, a), (j, b) = sets[x], sets[y]
        if 100 * len(a & b) >= percent * len(a | b) and root(i) != root(j):
            up[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_hard_cases(spark):
    rows = [
        (1, None, "x"), (2, "", None), (3, " \t\n", "x"), (4, "One two", "x"), (5, "one\x0bTWO", "x"), (6, "Éa éa b c d", "x"),
        (7, "éa éa b c d", "x"), (8, "a b c d e", "x"), (9, "w " * 30_000, "x"), (10, "w " * 5, "x"), (11, "w w w w", "x"),
    ]
    docs = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, component_id string, kept int, n_shingles int, _doc int")
    assert result(minhash.near_duplicates(docs)) == brute([r[:2] for r in rows])


def test_null_id_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(str, minhash.near_duplicates(docs).collect()))
    assert len(got) == 4
    rows = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert rows == {(None, None, True), (1, 1, True), (2, 2, True), (2, 1, False)}


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("block", [512, 8])
def test_groups_chains_and_shared_passages(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, base, shared = [], [word() for _ in range(200)], [word() for _ in range(60)]
    for _ in range(60):  # spokes: each near the base, most not near each other
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(200)] = word()
        rows.append(t)
    t = list(base)
    for _ in range(40):  # a chain that drifts away
        t = list(t)
        for _ in range(3):
            t[rng.randrange(200)] = word()
        rows.append(t)
    for _ in range(60):  # a passage in different texts
        rows.append([word() for _ in range(rng.randint(5, 100))] + shared)
    rows += [rows[3]] * 50
    rng.shuffle(rows)
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(docs)) == brute(rows)


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert result(minhash.near_duplicates(docs)) == brute([tuple(r) for r in docs.collect()])
