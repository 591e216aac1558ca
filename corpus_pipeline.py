"""A corpus from raw documents: five stages, each written and read again."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm import bpe, langid, minhash, mixing, secrets
from procura.llm.common import bucket, buckets, fold, small_batches, table
from procura.llm.queries import tokenizer
from procura.operators.joins import checkpoint_folder, checkpointed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# A document stays when its language is recognised with at least this probability.
LEAST_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def any_columns(stage: Stage) -> Stage:
    """Lets a stage use any helper column that starts with ``_``.

    Columns of the caller with such names, or with other signs than letters, digits and
    ``_``, have another name inside the stage and come out as they went in.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        odd = [c for c in docs.columns if not re.fullmatch(r"[A-Za-z0-9]\w*", c, re.A)]
        free = (n for n in (f"held{k}" for k in itertools.count()) if n not in docs.columns)
        inside = dict(zip(odd, free, strict=False))
        out = stage(spark, docs.withColumnsRenamed(inside), folder)
        return out.withColumnsRenamed({n: c for c, n in inside.items()})

    return run


def document_hashes() -> tuple[Column, Column]:
    """Two 64-bit hashes of an id and its text."""
    return F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id")


@any_columns
def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rejects texts without a letter and such that fit no language well.

    Null and empty texts have no letter, so they go; a text of any length is read whole.
    Rows that repeat an id are judged each by its own text. Without a row to learn from
    nothing is recognised and the result is empty.
    """
    small_batches(spark)
    model = langid.fit(docs, fold("doc_id", 3) != 1)
    found = langid.predict(model, F.col("text"))
    keep = (F.col("_found.lang_pred") != langid.UNKNOWN) & (F.col("_found.score") >= LEAST_SCORE)
    return docs.withColumn("_found", found).where(keep).select(*docs.columns)


@any_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near duplicates.

    A document is an id and a text: rows that repeat an id are judged each by its own
    text, and of rows that repeat both one stays. Rows with a null id, and such without
    a word, are in no group. Documents go by a 64-bit hash of id and text; where a second
    one tells two documents with the same hash apart, all of them stay.
    """
    small_batches(spark)
    columns = docs.columns
    known, (key, other) = F.col("doc_id").isNotNull(), document_hashes()
    docs = docs.withColumns({"_key": F.when(known, key), "_other": F.when(known, other)})
    found = minhash.near_duplicates(docs.select("_key", "text"), id_column="_key").where("_key IS NOT NULL AND n_shingles > 0")
    found = found.groupBy("_key").agg(F.count("*").alias("_n"), F.min("component_id").alias("_component"))
    clash = (F.min("_other") < F.max("_other")).alias("_clash")
    ids = docs.where("_key IS NOT NULL").groupBy("_key").agg(F.min("doc_id").alias("_id"), clash)
    found = checkpointed(found.join(ids, "_key"))
    # One document of every group stays; a document without near copies is its own group.
    first = found.groupBy("_component").agg(F.min(F.struct("_id", "_key")).alias("_first"))
    first = first.select(F.col("_first._key").alias("_key"), F.lit(True).alias("_kept"))
    kept = (F.col("_kept").isNotNull() | F.col("_clash")).alias("_kept")
    odd = checkpointed(found.join(first, "_key", "left").where("_kept IS NULL OR _n > 1").select("_key", kept))
    # Documents in no bucket of these keys stay, without a shuffle of their texts.
    marked, held = docs.withColumn("_bucket", bucket("_key")), buckets(odd, "_key")
    clear = marked.join(held, "_bucket", "left_anti").select(*columns)
    near = marked.join(held, "_bucket", "left_semi")
    rest = clear.unionByName(near.join(odd.select("_key"), "_key", "left_anti").select(*columns))  # nulls stay
    again = near.join(odd.where("_kept").select("_key"), "_key")
    order = F.struct(*[F.col(c) for c in ("text", *[c for c in columns if c != "text"])])
    one = again.groupBy("_key", "_other").agg(F.min(order).alias("_row")).select(*[F.col(f"_row.{c}") for c in columns])
    return rest.unionByName(one)


@any_columns
def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replaces every secret by a mask; ``n_chars`` follows where a text changed.

    Every row stays; null and empty texts stay as they are.
    """
    small_batches(spark)
    found = docs.withColumn("_clean", secrets.redact(F.col("text")))
    changed = ~F.col("_clean").eqNullSafe(F.col("text"))
    size = F.when(changed, F.length("_clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    new = {"text": F.col("_clean").alias("text"), "n_chars": size}
    return found.select(*[new.get(c, F.col(c)) for c in docs.columns])


@any_columns
def sample_to_targets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps documents with the calibrated probability of their source, language and topic.

    Every source has a target, in proportion to the square root of its tokens. Null and
    empty texts hold no token; rows with a null source or language belong to the rest
    (``*``). Rows that repeat an id draw the same number.
    """
    return mixing.mix_balanced(docs).where("_mix.kept").select(*docs.columns)


@any_columns
def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Adds ``token_ids``, ``n_tokens`` and ``decoded_sha256``, the digest of what the ids decode to.

    Every row stays; null and empty texts have no ids. Columns of these names are replaced.
    """
    small_batches(spark)
    sent = bpe.vocabulary(spark, tokenizer())
    found = docs.withColumn("_tokens", bpe.tokens(F.col("text"), sent))
    names = ("token_ids", "n_tokens", "decoded_sha256")
    return found.withColumns({n: F.col(f"_tokens.{n}") for n in names}).drop("_tokens")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", sample_to_targets),
    ("tokens", tokenize),
]

# Hash functions, learned models and tokenizers are beyond SQL; tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = table(spark, folder, "documents")
    base = f"{checkpoint_folder(spark)}/pipeline-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
