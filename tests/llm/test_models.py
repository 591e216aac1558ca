from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from procura.llm import langid, quality, queries
from procura.llm.common import fold, word_hashes


def test_fold_is_crc32_of_the_text(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 7, 123456, -5)] + [(None,)], "doc_id long")
    got = [r[0] for r in df.select(fold("doc_id", 5)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in (0, 7, 123456, -5)] + [None]


def test_words():
    assert len(word_hashes("A\x0bb\tc\u00a0d")) == 3  # a no-break space is no separator
    assert (word_hashes("ABC É") == word_hashes("abc É")).all()
    assert not (word_hashes("é") == word_hashes("É")).any()


@pytest.mark.parametrize("size", [3, 10, 200_000])
def test_ngram_counts_do_not_depend_on_slices(monkeypatch, size):
    text = "abc déf " * 5
    want = langid.counts(text, 512, 3)
    monkeypatch.setattr(langid, "SLICE", size)
    assert (langid.counts(text, 512, 3) == want).all()
    assert want.sum() == sum(len(text) - n + 1 for n in (1, 2, 3))


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 2, 2 + int(rng.integers(50))]), np.array([1.0, 0.02]), k % 2) for k in range(200)]
    w = langid.ftrl(rows, 60, 2, 3)
    assert ((w[0] > 0) == [True, False]).all() and (w == 0).mean() > 0.5


def test_dual_descent_meets_its_margins():
    rows, y = [np.array([0, 2]), np.array([1, 2])] * 20, np.array([1, -1] * 20)
    w, c = quality.dual_descent(rows, y, np.array([1.0, 1.0, 0.5]), 1.0, 50)
    assert all(y[k] * (w[r].sum() - w[2] * 0.5 + c) >= 0.99 for k, r in enumerate(rows))


HARD = [(1, None), (2, ""), (3, "123 !!"), (4, "\x00퟿ a"), (5, "katze " * 100_000), (None, "the cat"), (7, "the cat"), (7, "the cat"), (8, "漢字")]


def test_language_of_hard_texts(spark):
    known = [(i, ("the house and the cat " if i % 2 else "das haus und die katze ") * 3, "en" if i % 2 else "de", 1) for i in range(100, 200)]
    docs = spark.createDataFrame([*known, *[(i, t, None, 0) for i, t in HARD]], "doc_id long, text string, lang string, score int")
    model = langid.fit(docs, fold("doc_id", 3) != 1, buckets=1024)
    got = langid.identify(docs, model).where("doc_id < 100 OR doc_id IS NULL").collect()
    assert len(got) == len(HARD) and all(0 <= r["score"] <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[5].lang_pred == "de" and by[7].lang_pred == by[None].lang_pred == "en" and by[8].lang_pred in ("en", "de")
    known = langid.identify(docs, model).where("doc_id >= 100").collect()
    assert all(r.lang == r.lang_pred for r in known)


def test_language_without_examples(spark):
    docs = spark.createDataFrame([(1, "the cat", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.fit(docs, F.lit(True))).first()["lang_pred"] == "und"
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0), F.lit(True))).collect() == []


def test_quality_of_hard_texts(spark):
    docs = spark.createDataFrame([*HARD, *[(i, "GOOD!! BAD!!" if i % 4 == 0 else "a calm text.") for i in range(100, 300)]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), None) for i in range(100, 300)] + [(1, None, 0), (None, 1, 0), (7, 1, 1), (7, 0, 1), (100, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, F.lit(True), buckets=4096)
    got = docs.select("doc_id", quality.score(model, F.col("text")).alias("score")).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in got if r.doc_id and r.doc_id >= 100)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame(HARD, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = docs.select(quality.score(quality.fit(docs, none, F.lit(True)), F.col("text")).alias("s")).collect()
    assert {round(r.s, 6) for r in got} == {0.5}


def test_held_out_accuracy(spark, folder):
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = queries.op5_langid(spark, folder).join(documents.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    found = queries.op1_quality(spark, folder).join(labels, "doc_id").where("held_out")
    means = dict(found.groupBy("quality").agg(F.avg("score")).collect())
    assert means[1] > means[0] + 0.3


def test_shapes_are_of_whole_words():
    long = "Ab1!" * 12
    first, second = (quality.features(long + end, 1 << 17, {}) for end in ("x", "9"))
    assert not set(quality._shapes(long + "x", {})) & set(quality._shapes(long + "9", {})) and len(first) == len(second)


def test_copies_of_an_id_push_out_no_example(spark):
    """Samples are of ids: one id with very many rows is one example, in either model."""
    known = [(i, ("the house and the cat " if i % 2 else "das haus und die katze ") * 3, "en" if i % 2 else "de") for i in range(100, 140)]
    docs = spark.createDataFrame(known + [(100, "das haus und die katze", "de")] * 500, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), buckets=512, sample=40)
    assert model.languages == ["de", "en"]
    found = langid.identify(docs, model).where("lang <> lang_pred").count()
    assert found == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 140)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True), buckets=512, sample=40, fitted=40)
    good = docs.select(F.col("doc_id") % 2 == 1, quality.score(model, F.col("text")) >= 0.5).collect()
    assert all(a == b for a, b in good)


def test_language_sample_is_the_first_of_each_language(spark):
    """The rank in parts changes nothing: ids by hash, as many of each language as there are."""
    docs = spark.createDataFrame([(i, "the cat" if i % 9 else "die katze", "en" if i % 9 else "de") for i in range(900)], "doc_id long, text string, lang string")
    want = langid.fit(docs, F.lit(True), buckets=256, sample=60).weights
    parts, langid.PARTS = langid.PARTS, 1
    try:
        assert (langid.fit(docs, F.lit(True), buckets=256, sample=60).weights == want).all()
    finally:
        langid.PARTS = parts


def test_small_batches_keep_a_bound_of_the_session(spark):
    from procura.llm import common

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        common.small_batches(spark)
        assert spark.conf.get(key) == str(common.BATCH_BYTES)
        spark.conf.set(key, "1000")
        common.small_batches(spark)
        assert spark.conf.get(key) == "1000"
        # Texts longer than the bound come through whole.
        docs = spark.createDataFrame([(i, "ab" * (5000 * (i % 3))) for i in range(50)], "doc_id long, text string")
        same = docs.mapInPandas(lambda batches: batches, docs.schema)
        assert sorted(same.collect()) == sorted(docs.collect())
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
