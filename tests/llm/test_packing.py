"""Packing against every packing of small sets, and pieces against the tokenizers library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from procura.llm import bpe, packing
from procura.llm.queries import word_tokenizer

tokenizers = pytest.importorskip("tokenizers")


def fewest(sizes, capacity):
    """The least number of sequences, by trying every way to fill one around the largest."""

    @cache
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        fills = {()}
        for i in range(len(rest)):
            fills |= {(*f, i) for f in fills if first + sum(rest[j] for j in f) + rest[i] <= capacity}
        return 1 + min(best(tuple(s for i, s in enumerate(rest) if i not in f)) for f in fills)

    return best(tuple(sorted(sizes, reverse=True)))


def held(patterns):
    total = Counter()
    for copies, sizes in patterns:
        for s in sizes:
            total[s] += copies
    return total


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=300, deadline=None)
def test_least_on_small_sets(sizes):
    patterns = packing.pack(Counter(sizes), 20, nodes=100_000)
    assert held(patterns) == Counter(sizes)
    assert all(sum(p) <= 20 for _, p in patterns)
    assert sum(c for c, _ in patterns) == fewest(sizes, 20)


@given(st.lists(st.integers(1, 60), max_size=60))
@settings(max_examples=200, deadline=None)
def test_bounds(sizes):
    counts = np.bincount(sizes, minlength=61) if sizes else np.zeros(61, np.int64)
    fit, patterns = packing.best_fit(counts), packing.pack(Counter(sizes), 60, nodes=50)
    assert held(fit) == held(patterns) == Counter(sizes)
    assert all(sum(p) <= 60 for _, p in fit + patterns)
    assert -(-(sum(sizes) + packing.waste_bound(counts)) // 60) <= sum(c for c, _ in patterns) <= sum(c for c, _ in fit)


def test_search_beats_best_fit():
    rng = random.Random(1)
    better = 0
    for _ in range(60):
        counts = Counter(rng.randint(15, 70) for _ in range(24))
        fit = sum(c for c, _ in packing.best_fit(np.array([counts[i] for i in range(101)])))
        better += sum(c for c, _ in packing.pack(counts, 100)) < fit
    assert better > 0


def test_counts_of_any_size():
    """Work goes by kinds of length: a billion pieces are packed like a thousand."""
    rng = random.Random(2)
    counts = {s: rng.randint(1, 10**9) for s in range(1, 2049)}
    patterns = packing.pack(counts, nodes=3)
    assert held(patterns) == Counter(counts)
    table = np.array([counts.get(s, 0) for s in range(2049)])
    total = sum(s * n for s, n in counts.items()) + packing.waste_bound(table)
    assert sum(c for c, _ in patterns) <= 1.005 * total / 2048
    assert len(patterns) < 6 * 2048


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_tokenizer())


@given(st.text(max_size=80) | st.lists(st.sampled_from(["a", "J̌", "İ", "'s", " ", " ", "\x1c", "\x85", " ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>", "Ω", "12", "é", "́"])).map("".join))
@settings(max_examples=300, deadline=None)
def test_words_in_a_row(text):
    library = tokenizers.Tokenizer.from_file(word_tokenizer()) if not hasattr(test_words_in_a_row, "lib") else test_words_in_a_row.lib
    if not hasattr(test_words_in_a_row, "lib"):
        test_words_in_a_row.lib = library
        with open(word_tokenizer(), encoding="utf-8") as f:
            test_words_in_a_row.encode = packing.word_encoder(f.read())
    ids = np.frombuffer(test_words_in_a_row.encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_old_words_go(monkeypatch, library):
    monkeypatch.setattr(packing, "KEPT_BYTES", 50 * packing._ENTRY_BYTES)
    monkeypatch.setattr(packing, "RUN", 7)
    with open(word_tokenizer(), encoding="utf-8") as f:
        encode = packing.word_encoder(f.read() + " ")
    text = " ".join(f"word{i % 130} Other.{i}" for i in range(400))
    for _ in range(2):
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["İ.", "שׁ! שׁ", "word%%% Word.%%% a.!!! Mot.... É*** a#$#$#", "word... <|endoftext|>. 's!"])
def test_signs_behind_words(library, text):
    """Letters that fall apart when normalised are not cut from the signs behind them."""
    with open(word_tokenizer(), encoding="utf-8") as f:
        encode = packing.word_encoder(f.read())
    assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_library_is_read_once():
    """The next task of a worker does not parse the tokenizer again, and finds its words."""
    with open(word_tokenizer(), encoding="utf-8") as f:
        spec = f.read()
    packing.word_encoder(spec)("some words")
    first = packing._worker_store(spec)
    library, words = first.library, first.words
    again = packing._worker_store(spec)
    assert again.library is library and again.words is words and b"some" in words


def checked(spark, library, docs, capacity):
    """Pack and hold the result against the library and the rules of a packing."""
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int").repartition(4)
    rows = packing.pack_documents(table, bpe.vocabulary(spark, word_tokenizer()), capacity=capacity).collect()
    want = Counter()
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want[i, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_pieces_and_places(spark, library):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["alpha", "of", "Zebra-crossing", "ñandú", "x1"], k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(i + 1000, docs[3][1]) for i in range(200)] + [(1, None), (1, None), (None, "a b"), (None, ""), (2**60 + 1, "a " * 5000), (8, "b" * 3000)]
    n, tokens = checked(spark, library, docs, 64)
    assert n <= 1.02 * tokens / 64 + 1


def test_empty_table(spark, library):
    assert checked(spark, library, [], 64) == (0, 0)


def test_a_whole_table(spark, folder, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    n, tokens = checked(spark, library, rows, packing.CAPACITY)
    assert n <= 1.01 * tokens / packing.CAPACITY + 1
