from __future__ import annotations

import hashlib
import random
import struct
from array import array

import pytest
from pyspark.sql import functions as F

from procura.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = queries.tokenizer()
    with open(path, encoding="utf-8") as f:
        return bpe.Vocabulary.read(f.read()), tokenizers.Tokenizer.from_file(path)


LETTERS = [chr(c) for c in (*range(0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x180E, 0x4E00, 0x1F600, 0x661, 0x10FFFF)]
HARD = ["", " ", "  a", "a  ", "\n\n x", "don't 'S 've", "<|endoftext|>", "a <|endoftext|>  b<|endo", "ab" * 20_000, "\x85\x1c a\xa0 b", "é" * 999]


def test_equal_to_the_library(both):
    own, library = both
    rng = random.Random(1)
    texts = ["".join(rng.choice(LETTERS) if rng.random() < 0.5 else rng.choice(" \n\t'stre llvd a1<|endoftext|>.") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text in HARD + texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(array("I", own.encode(text))) == ids, text
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_a_full_store_of_chunks_changes_nothing(both, monkeypatch):
    own, _ = both
    want = own.encode("one two three four five two")
    monkeypatch.setattr(bpe, "KEPT", 2)
    assert own.encode("one two three four five two") == want


def test_columns_and_digests(spark, both):
    _, library = both
    rows = [*enumerate(HARD), (None, "x"), (7, None), (7, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    sent = bpe.vocabulary(spark, queries.tokenizer())
    out = df.select("text", bpe.encoded(F.col("text"), sent).alias("ids"), bpe.digests(F.col("text"), sent).alias("d"))
    for r in out.select("*", bpe.decoded(F.col("ids"), sent).alias("back")).collect():
        text = r.text or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.back == text and r.d.n_tokens == len(ids)
        assert r.d.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.d.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_whole_table(spark, folder, both):
    _, library = both
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = queries.op9_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
