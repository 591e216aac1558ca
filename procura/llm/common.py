"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.operators.batches import BATCH_BYTES, release_memory, small_batches
from procura.operators.joins import checkpoint_folder

__all__ = [
    "BATCH_BYTES", "BUCKETS", "bucket", "buckets", "fold", "mix", "release_memory", "shared_table", "shingles",
    "small_batches", "table", "word_hashes",
]

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds))


@contextmanager
def shared_table(df: DataFrame) -> Iterator[DataFrame]:
    """``df``, written once as Parquet to the shared folder and gone after the block.

    For large tables that are read several times: smaller on disk than a checkpoint, and
    read by column. What is made from the table must be written inside the block.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{spark.sparkContext.applicationId}-{uuid.uuid4()}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield spark.read.parquet(path)
    finally:
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# Buckets of ids: a table of them has so many rows at most, whatever it was made from.
BUCKETS = 1 << 20


def bucket(id_column: str) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(BUCKETS)).cast("int")


def buckets(ids: DataFrame, id_column: str) -> DataFrame:
    """The distinct ``_bucket`` of some ids, to be broadcast.

    Rows outside these buckets are surely not among the ids, so they need not be shuffled
    to find that out; rows inside may be and are then joined by id.
    """
    return F.broadcast(ids.select(bucket(id_column).alias("_bucket")).distinct())


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text: A-Z lower-cased, cut at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text.

    With fewer words than ``width`` the whole sequence is one shingle; without words
    there is none.
    """
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for i in range(min(width, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)
