"""Dense numbers and queues over tables of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.operators.joins import checkpointed, lookup_join

# Rows a queue may gather with a plain sort and limit.
_TOP_ROWS = 10_000
_POSITION_BITS = 33


def ordinal(
    df: DataFrame, order: Sequence[Column], alias: str, group: str | None = None
) -> DataFrame:
    """Number the rows 1..n in ``order``, per ``group`` value if one is given.

    ``order`` must be total. Rows are range-partitioned and sorted, so neither the
    whole table nor one large group meets in a single task; each task's position is
    then shifted by the counts of the tasks before it. The sorted rows are
    checkpointed, as both passes must see the same partitions even when executors
    are lost.
    """
    keys = ([F.col(group)] if group else []) + list(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    placed = checkpointed(
        ranged.withColumn("_part", F.shiftright(at, _POSITION_BITS)).withColumn(
            "_pos", at.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
        )
    )
    on = ["_part"] + ([group] if group else [])
    counts = placed.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    # One row per task (and group) here; a group's rows lie in adjacent tasks.
    scope = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    earlier = scope.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *on, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    if group:
        # A NULL group is a group of its own.
        shifts = shifts.withColumnRenamed(group, "_group")
        small = shifts.withColumn("_null", F.col("_group").isNull()).withColumn(
            "_group", F.coalesce(F.col("_group").cast("string"), F.lit(""))
        )
        placed = placed.withColumn("_null", F.col(group).isNull()).withColumn(
            "_group", F.coalesce(F.col(group).cast("string"), F.lit(""))
        )
        # A key holds at most one task's rows, so no salt is needed beyond broadcast.
        joined = lookup_join(placed, small, ["_part", "_null", "_group"], salts=1)
    else:
        joined = lookup_join(placed, shifts, ["_part"])
    number = F.col("_before") + F.col("_pos") - F.col("_first") + 1
    return joined.withColumn(alias, number).select(*df.columns, alias)


def by_deadline() -> list[Column]:
    return [F.col("deadline_at").asc_nulls_last(), F.col("row_number").asc()]


def by_deadline_and_title() -> list[Column]:
    return [
        F.col("deadline_at").asc_nulls_last(),
        F.lower("title").asc(),
        F.col("row_number").asc(),
    ]


def queue(
    lots: DataFrame,
    skip: int = 0,
    limit: int | None = None,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Lots in working order, after ``skip`` rows, at most ``limit`` of them."""
    if skip < 0 or (limit is not None and limit < 0):
        raise ValueError("skip and limit must not be negative")
    order = list(order or by_deadline())
    if not skip and limit is None:
        return lots.orderBy(*order)
    if limit is not None and skip + limit <= _TOP_ROWS:
        return lots.orderBy(*order).offset(skip).limit(limit)
    numbered = ordinal(lots, order, "_ordinal").filter(F.col("_ordinal") > skip)
    if limit is not None:
        numbered = numbered.filter(F.col("_ordinal") <= skip + limit)
    return numbered.orderBy("_ordinal").drop("_ordinal")


def unique_names(df: DataFrame, name: str, order: Sequence[Column]) -> DataFrame:
    """Suffix repeated names: second use ``x (2)``, third ``x (3)``, in ``order``.

    The first row of every name keeps it. Numbers that would give a name which another
    row already has by itself are left out, so all results differ.
    """
    numbered = ordinal(df, order, "_use", group=name)
    # Names such as "x (2)" take a number of "x". The i-th of them, t, lies behind
    # t - 1 - i free numbers, and is skipped by all uses from t + 1 - i on. Put among
    # the uses as rows of their own, the taken numbers shift each use to its number.
    part = r"(?s)^(.*) \(([1-9][0-9]{0,8})\)$"
    number = F.regexp_extract(name, part, 2).try_cast("long")
    taken = (
        df.select(F.regexp_extract(name, part, 1).alias("_base"), number.alias("_t"))
        .filter(F.col("_t") >= 2)
        .distinct()
    )
    taken = ordinal(taken, [F.col("_t").asc()], "_i", group="_base")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != name]
    marks = taken.select(
        F.col("_base").alias(name), *blank, (F.col("_t") + 1 - F.col("_i")).alias("_use"), "_t"
    )
    uses = numbered.withColumn("_t", F.lit(None).cast("long"))
    line = [F.col("_use").asc(), F.col("_t").asc_nulls_last()]
    placed = ordinal(uses.unionByName(marks), line, "_number", group=name).filter("_t IS NULL")
    suffixed = F.when(
        F.col("_use") > 1, F.concat(F.col(name), F.lit(" ("), F.col("_number").cast("string"), F.lit(")"))
    ).otherwise(F.col(name))
    return placed.withColumn("_name", suffixed).withColumn(name, F.col("_name")).select(*df.columns)
