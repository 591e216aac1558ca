"""Results, monthly report, tag counts and the folder manifest."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import cells, text
from procura.operators.joins import checkpointed
from procura.operators.ordering import by_deadline, by_deadline_and_title, ordinal
from procura.sources import snapshots

RESULT_COLUMNS = (
    "tender_id",
    "title",
    "url",
    "deadline_at",
    "customer",
    "customer_inn",
    "status",
    "classification_tag",
    "confidence_percent",
    "classification_comment",
    "downloaded_files",
    "analysis_markdown",
    "error",
)


def results(lots: DataFrame, classified: DataFrame) -> DataFrame:
    """Result rows of classified lots (``tender_id, payload, files``)."""
    return (
        lots.join(classified, "tender_id")
        .select(
            "*",
            "payload.*",
            F.lit("ok").alias("status"),
            F.col("files").alias("downloaded_files"),
            F.lit("").alias("error"),
        )
        .select(*RESULT_COLUMNS)
    )


def failed_results(lots: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Result rows of lots whose documents were not obtained."""
    return (
        lots.join(outcomes.filter(F.col("status") != "ok"), "tender_id")
        .withColumn("classification_tag", F.lit(vocab.DEFAULT_TAG))
        .withColumn("downloaded_files", F.array().cast("array<string>"))
        .withColumn("analysis_markdown", F.lit(""))
        .select(*RESULT_COLUMNS)
    )


def latest(rows: DataFrame, key: str, written: Sequence[Column]) -> DataFrame:
    """Last written row per key; the rank limit also runs before the shuffle."""
    newest = Window.partitionBy(key).orderBy(*written)
    return rows.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") == 1).drop("_rn")


def upsert(existing: DataFrame, new: DataFrame, key: str = "tender_id", version: str = "version") -> DataFrame:
    """New results replace old ones of the same key, whatever sheet they were in.

    ``version`` orders the writes; at equal versions the new row wins.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, key, [F.col(version).desc(), F.col("_new").desc()]).drop("_new")


def with_tag(rows: DataFrame) -> DataFrame:
    """Empty tags read as not examined."""
    tag = F.coalesce(F.nullif("classification_tag", F.lit("")), F.lit(vocab.DEFAULT_TAG))
    return rows.withColumn("classification_tag", tag)


def monthly(
    rows: DataFrame, order: Sequence[Column] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Report rows with their month sheet and a running number in it.

    ``order`` needs a unique last column; the default needs ``row_number``. ``keep``
    names further columns of ``rows`` to carry along.
    """
    sheets = with_tag(rows).withColumn("sheet", cells.sheet_name(F.col("deadline_at")))
    numbered = ordinal(sheets, order or by_deadline(), "number", group="sheet")
    return numbered.select(
        "sheet",
        F.col("classification_tag").alias("tag"),
        "confidence_percent",
        F.col("classification_comment").alias("comment"),
        "number",
        "title",
        "url",
        cells.format_deadline(F.col("deadline_at")).alias("deadline"),
        *keep,
    )


def tag_summary(rows: DataFrame, tags: Sequence[str] = vocab.TAGS) -> DataFrame:
    """``sheet, ord, tag, n``: every tag of every sheet, zero where unused.

    One aggregation counts all tags of a sheet side by side, then unfolds them.
    """
    sheets = with_tag(rows).select(
        cells.sheet_name(F.col("deadline_at")).alias("sheet"),
        F.col("classification_tag").alias("tag"),
    )
    counts = sheets.groupBy("sheet").agg(
        *[F.count_if(F.col("tag") == t).alias(f"n{i}") for i, t in enumerate(tags)]
    )
    return _unfolded(counts, tags)


def _unfolded(counts: DataFrame, tags: Sequence[str]) -> DataFrame:
    """A row per tag from the counts ``n0, n1, ...`` of a sheet."""
    unfolded = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("ord"), F.lit(t).alias("tag"), F.col(f"n{i}").alias("n")
            )
            for i, t in enumerate(tags)
        ]
    )
    return counts.select("sheet", F.explode(unfolded).alias("t")).select("sheet", "t.*")


def write_monthly(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the sheets present in ``report``, each one replaced as a whole.

    Numbered rows already lie in ranges of sheet and number, so a task writes few
    sheets and a large sheet is written by many tasks.
    """
    (
        report.write.partitionBy("sheet")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .format(fmt)
        .save(path)
    )


# What a stored report holds besides its shown columns, so that it can be updated.
STORED = ("tender_id", "version", "deadline_at", "row_number")


_RESULT = (
    "title", "url", "deadline_at", "classification_tag", "confidence_percent",
    "classification_comment", "tender_id", "version", "row_number",
)
# Tables of count changes that a report holds before they are summed up into one.
COUNT_PARTS = 16


def update_report(path: str, new: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """Upsert results into the report stored at ``path``, as one step; its version after it.

    ``new`` has result columns with ``tender_id, version, row_number``. A lot that moves
    to another month leaves its old sheet: sheets that lose or gain a row are written
    again, the others stay where they are, and sheets without rows go. Readers
    (``read_report``) see the report as before or after, also when the update fails. A
    writer that was overtaken gets ``snapshots.Conflict`` and may run again. ``batch``, a
    stream and a number, marks an update that is done once, however often it is called.
    The names of touched sheets (one per month) pass the driver.
    """
    spark = new.sparkSession
    base = snapshots.head(spark, path)
    batches = base.notes.get("batches", {})
    if batch and batches.get(batch[0], -1) >= batch[1]:
        return base.version
    new = latest(new.select(*_RESULT), "tender_id", [F.col("version").desc()])
    new = checkpointed(new.withColumn("_won", F.lit(True)))
    if base.version:
        stored = _as_results(snapshots.read(spark, base))
        before = _matching(stored, new, "left_semi")
        won = upsert(before.withColumn("_won", F.lit(False)), new)
        won = checkpointed(won.filter("_won").drop("_won"))
        lost = _matching(before, won, "left_semi")
    else:
        won = new.drop("_won")
        lost = won.limit(0)
    changes = checkpointed(
        _tags(won, 1).unionByName(_tags(lost, -1)).groupBy("sheet", "tag").agg(F.sum("n").alias("n"))
    )
    touched = {r["sheet"] for r in changes.select("sheet").distinct().collect()}
    rows = won
    if base.version:
        near = _as_results(snapshots.read(spark, base, touched))
        rows = _matching(near, won, "left_anti").unionByName(won)
    report = monthly(rows, keep=STORED)
    written = snapshots.write(report, path, "sheet") if touched else {}
    parts = {f: p for f, p in base.parts.items() if snapshots.value_of(f) not in touched} | written
    notes = base.notes | {"counts": _store_counts(base, changes)}
    if batch:
        notes["batches"] = batches | {batch[0]: batch[1]}
    return snapshots.commit(spark, base, parts, report.schema, notes).version


def _matching(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """Rows whose id is, or is not, an id of ``others``; a null id equals a null id."""
    ids = others.select(F.col("tender_id").alias("_id"))
    return rows.join(ids, F.col("tender_id").eqNullSafe(F.col("_id")), how)


def _as_results(stored: DataFrame) -> DataFrame:
    shown = {"tag": "classification_tag", "comment": "classification_comment"}
    return stored.withColumnsRenamed(shown).select(*_RESULT)


def _tags(rows: DataFrame, n: int) -> DataFrame:
    sheet = cells.sheet_name(F.col("deadline_at"))
    return with_tag(rows).select(sheet.alias("sheet"), F.col("classification_tag").alias("tag"), F.lit(n).cast("long").alias("n"))


def _store_counts(base: snapshots.Snapshot, changes: DataFrame) -> list[str]:
    """Write the changes of tag counts beside the report; the tables that now count."""
    parts = base.notes.get("counts", [])
    if len(parts) >= COUNT_PARTS:
        earlier = _counts(changes.sparkSession, base)
        changes = changes.unionByName(earlier).groupBy("sheet", "tag").agg(F.sum("n").alias("n"))
        parts = []
    part = f"p{uuid.uuid4().hex}"
    changes.filter("n <> 0").write.parquet(f"{base.path}/counts/part={part}")
    return [*parts, part]


def _counts(spark: SparkSession, snapshot: snapshots.Snapshot) -> DataFrame:
    folders = [f"{snapshot.path}/counts/part={p}" for p in snapshot.notes["counts"]]
    return spark.read.schema("sheet string, tag string, n long").parquet(*folders)


def read_report(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored report as it is now, or as it was at a version that is still kept."""
    chosen = snapshots.head(spark, path) if version is None else snapshots.at(spark, path, version)
    return snapshots.read(spark, chosen)


def stored_summary(spark: SparkSession, path: str, tags: Sequence[str] = vocab.TAGS) -> DataFrame:
    """``tag_summary`` of the stored report, from the counts kept with it.

    Every update leaves the changes of its counts, signed; they are summed up here, so
    the rows of the report are not read.
    """
    changes = _counts(spark, snapshots.head(spark, path))
    n = [F.coalesce(F.sum(F.when(F.col("tag") == t, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, t in enumerate(tags)]
    held = changes.groupBy("sheet").agg(F.sum("n").alias("_all"), *n)
    return _unfolded(held.filter("_all > 0"), tags)


def manifest(lots: DataFrame) -> DataFrame:
    """Ordered folder list: ``order, tender_id, title, folder_name, deadline_at, url``.

    The number makes each folder name unique, so ``unique_names`` has no work here.
    """
    numbered = ordinal(lots, by_deadline_and_title(), "order")
    folder = text.ordinal_prefix(
        F.col("order"), text.sanitize_folder_name(F.col("title"))
    )
    return numbered.select(
        F.col("order").cast("int").alias("order"),
        "tender_id",
        "title",
        folder.alias("folder_name"),
        cells.manifest_deadline(F.col("deadline_at")).alias("deadline_at"),
        "url",
    )


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.orderBy("order").write.mode("overwrite").option("header", True).csv(path)


__all__ = [
    "RESULT_COLUMNS",
    "failed_results",
    "latest",
    "manifest",
    "monthly",
    "read_report",
    "results",
    "stored_summary",
    "tag_summary",
    "update_report",
    "upsert",
    "with_tag",
    "write_manifest",
    "write_monthly",
]
