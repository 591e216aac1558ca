"""Joins whose strategy depends on a measured size, and safe checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table that is sent to every executor, in bytes.
BROADCAST_BYTES = 128 * 1024 * 1024
# Copies of a small side against one hot key of the other side.
SALTS = 16
# An input of fewer splits is at most a few gigabytes and may be dealt out again.
FEW_SPLITS = 16
_ROW_BYTES = 32


def size_expr(df: DataFrame) -> Column:
    """Aggregate that estimates the bytes of ``df`` as rows of a hash table."""
    row = F.lit(_ROW_BYTES)
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype in ("string", "binary"):
            row = row + F.coalesce(F.octet_length(c), F.lit(0))
        elif dtype.startswith(("array", "map", "struct")):
            row = row + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            row = row + F.lit(8)
    return F.coalesce(F.sum(row.cast("long")), F.lit(0))


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` (one aggregate, one row to the driver) against ``limit``."""
    return df.agg(size_expr(df).alias("bytes")).first()["bytes"] <= limit


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    fits: bool | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join a table of any skew with a lookup table that has few rows per key.

    The lookup is broadcast when its measured size is within ``limit`` (``fits``
    passes a measurement made earlier). Beyond it both sides are shuffled on the
    key and a salt: the rows of one hot key of ``big`` spread over ``salts`` tasks,
    and ``small`` is repeated that many times.
    """
    if fits is None:
        fits = fits_broadcast(small, limit)
    keys = list(on)
    if fits:
        return big.join(F.broadcast(small), keys, how)
    # Maps and variants cannot be hashed; the other columns tell rows apart as well.
    plain = [c for c, t in big.dtypes if "map<" not in t and "variant" not in t]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(salts))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = big.withColumn("_salt", salt.cast("int"))
    right = small.withColumn("_salt", copies)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that comes in a few large splits.

    Only an input of fewer splits than ``FEW_SPLITS`` is shuffled, before work that is
    heavy per row; any other passes through untouched, on a cluster of any size (smaller
    splits are what ``spark.sql.files.maxPartitionBytes`` is for). For plain scans:
    counting the splits of a plan with shuffles would run them.
    """
    if df.rdd.getNumPartitions() >= FEW_SPLITS:
        return df
    return df.repartition(FEW_SPLITS)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out exactly once per row.

    A predicate on a projected column is pushed below the projection and repeats its
    expression there, as often as it is used. For long expressions that costs more
    than the rows saved, so they pass through a one-row generator, which stops it.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The one the session names in ``spark.checkpoint.dir``, or the one that was set on
    the context. Where neither is (tests, one machine), a folder of this application on
    the default file system. A cluster whose default file system is each machine's own
    disk has no such folder, which is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    root = context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if root.startswith("file:") and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/') if root != 'file:///' else 'file://'}/tmp/checkpoints/{context.applicationId}"


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    ``spark.cleaner.referenceTracking.cleanCheckpoints`` makes Spark remove the files
    once nothing refers to them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager)
