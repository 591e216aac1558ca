from __future__ import annotations

import hashlib
import random
from array import array

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from procura.llm import bpe, mixing, queries, secrets
from tests.llm.test_minhash import brute as near
from tests.llm.test_mixing import brute as mixed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, component_id int, kept int, lang_pred double"
WORDS = {"en": "the cat sat on a mat while it was raining over there".split(), "de": "der hund lief durch das nasse gras und bellte sehr laut".split()}


def rows():
    out = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        text = " ".join(WORDS[lang][(i * k + k * k) % 11] for k in range(40))
        out.append((i, text, lang if i % 7 else None, f"src{i % 3}" if i % 5 else None, len(text)))
    out += [(300 + i, out[10][1].upper() if i % 2 else out[10][1], None, "src0", None) for i in range(40)]
    out += [(400, None, "en", "a", 1), (401, "", "en", "a", 0), (402, "123 456", None, None, None), (None, out[3][1] + " tail", "en", "b", 5), (None, None, None, None, None)]
    out += [(403, out[5][1] + " twice", "en", "a", 9)] * 2 + [(404, "the cat " * 20_000, "en", "a", 9)]
    out += [(405, "the cat said token = 'abcdefgh12345678' and the dog it was raining over there", "en", "src0", 9)]
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and result of every stage, each written and read again."""
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(*r, "x", 1, 0, 0.5) for r in rows()], SCHEMA).write.parquet(f"{at}/documents.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(at)).write.parquet(f"{at}/{k}")
        done = spark.read.parquet(f"{at}/{k}")
        assert set(done.columns) >= set(docs.columns)
        out[name] = (docs.select(*corpus_pipeline.COLUMNS).collect(), done.collect())
        docs = done
    return out


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "mixing", "tokens"]


def test_language_rejects_only_what_has_none(stages):
    before, after = stages["language_id"]
    gone = {r.text for r in before} - {r.text for r in after}
    assert gone == {None, "", "123 456"}


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    found = near([(r.doc_id, r.text) for r in before if r.doc_id is not None])
    kept = {i for i, _, _, k in found if k} - {i for i, _, _, k in found if not k}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(kept)
    assert [r.text for r in after if r.doc_id is None] == [r.text for r in before if r.doc_id is None]


def test_an_id_with_different_texts(spark):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(40))
    t, u, near_u, own = text(), text(), None, [text() for _ in range(30)]
    near_u = u + " tail"
    docs = [(1, t), (2, t), (2, u), (3, near_u), (0, near_u + " more"), (4, None), (4, ""), (None, u)]
    docs += [(7, x) for x in own] + [(7, own[0])] * 5 + [(6, own[3])]
    df = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    # (2, u) is a copy of document 0, (2, t) of document 1; both belong to other groups.
    want = [(1, t), (0, near_u + " more"), (4, None), (4, ""), (None, u), (6, own[3])] + [(7, x) for k, x in enumerate(own) if k != 3]
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, want))
    got = corpus_pipeline.drop_near_duplicates(spark, df.where("doc_id IN (1, 2)"), "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, t), (2, u)]


def test_documents_of_one_hash_stay(spark, monkeypatch):
    rng = random.Random(9)
    t, u = (" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(40)) for _ in range(2))
    df = spark.createDataFrame([(0, t), (1, t), (2, u), (3, t)], "doc_id long, text string")
    one = F.when(F.col("doc_id").isin(1, 2), F.lit(7)).otherwise(F.col("doc_id"))
    monkeypatch.setattr(corpus_pipeline, "document_hashes", lambda: (one, F.xxhash64("text", "doc_id")))
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    # Documents 1 and 2 share a hash; 1 is a copy of 0, and 2 must not go with it.
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(0, t), (1, t), (2, u)]


def test_columns_of_any_name(spark, tmp_path):
    names = ["_key", "_found", "_mix", "_clean", "_tokens", "_bucket", "held0", "a.b", "größe", "two words"]
    made = [(i, f"the cat sat on a mat while {i} it was raining over there", "en", "s", 9, *[f"{n}{i}" for n in names]) for i in range(40)]
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n}` string" for n in names)])
    docs = spark.createDataFrame(made, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        rows = out.collect()
        assert rows and all(tuple(r)[5:15] == tuple(f"{n}{r.doc_id}" for n in names) for r in rows), name


def test_secrets_are_masked(stages):
    before, after = stages["secrets"]
    want = sorted((str(r.doc_id), secrets.redacted(r.text)) for r in before)
    assert sorted((str(r.doc_id), r.text) for r in after) == want and any("[secret]" in t for _, t in want)
    assert all(r.n_chars == len(r.text) for r in after if "[secret]" in r.text)


def test_mix(spark, stages):
    before, after = stages["mixing"]
    targets = mixing.balanced(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long" if len(before[0]) == 5 else SCHEMA))
    kept = [r[0] for r in mixed([(r.doc_id, r.text, r.lang, r.source) for r in before], targets, 0.5, 1) if r[-1]]
    assert sorted(str(r.doc_id) for r in after) == kept


def test_tokens(stages):
    before, after = stages["tokens"]
    with open(queries.tokenizer(), encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary.read(f.read())
    assert len(before) == len(after)
    for r in after:
        assert r.token_ids == list(array("I", vocabulary.encode(r.text))) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert set(corpus_pipeline.COLUMNS) <= set(got.columns)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
