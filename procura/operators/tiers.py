"""Files named for a tender: by folder, by path, by title folder, else by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import text
from procura.operators.joins import BROADCAST_BYTES, checkpointed, fits_broadcast, lookup_join
from procura.operators.matching import prioritize_files
from procura.operators.needles import find_needles

BY_FOLDER, BY_PATH, BY_TITLE, BY_SCORE = 1, 2, 3, 4


def path_hits(
    files: DataFrame, lots: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``path, tender_id`` where the path contains the id, as written."""
    texts = files.select("path", F.col("path").alias("hay"))
    ids = lots.select(F.col("tender_id").alias("needle"))
    hits = find_needles(texts, ids, ["path"], limit)
    return hits.withColumnRenamed("needle", "tender_id").distinct()


def title_folders(
    folders: DataFrame, lots: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``tender_id, top_dir``: smallest folder whose name contains the title.

    The search runs once per distinct title, so repeated titles add no work to it.
    """
    titled = lots.select("tender_id", text.normalize_name(F.col("title")).alias("needle"))
    titled = titled.filter(F.col("needle") != "")
    texts = folders.select("top_dir", text.normalize_name(F.col("top_dir")).alias("hay"))
    hits = find_needles(texts, titled.select("needle"), ["top_dir"], limit)
    first = hits.groupBy("needle").agg(F.min("top_dir").alias("top_dir"))
    # Both sides are small next to the files; at run time Spark picks how they meet.
    return titled.join(first, "needle").select("tender_id", "top_dir")


def assign_tiers(
    files: DataFrame,
    lots: DataFrame,
    folders: DataFrame | None = None,
    limit: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Best tier of each tender that has one of the first three, and the path hits.

    Returns ``(tiers, hits)``: ``tiers`` has ``tender_id, tier, top_dir``, one row per
    tender. ``folders`` (column ``top_dir``) adds folders without files, which a
    file listing cannot show: such a tender has a tier and no files.
    """
    dirs = files.filter(F.col("top_dir").isNotNull()).select("top_dir")
    if folders is not None:
        dirs = dirs.unionByName(folders.select("top_dir"))
    dirs = dirs.distinct()
    ids = lots.select("tender_id").distinct()
    hits = checkpointed(path_hits(files, ids, limit))
    by_folder = ids.join(dirs.withColumnRenamed("top_dir", "tender_id"), "tender_id", "left_semi")
    found = (
        by_folder.select("tender_id", F.lit(BY_FOLDER).alias("tier"), F.col("tender_id").alias("top_dir"))
        .unionByName(
            hits.select("tender_id")
            .distinct()
            .select(
                "tender_id",
                F.lit(BY_PATH).alias("tier"),
                F.lit(None).cast("string").alias("top_dir"),
            )
        )
        .unionByName(
            title_folders(dirs, lots, limit).select(
                "tender_id", F.lit(BY_TITLE).alias("tier"), "top_dir"
            )
        )
    )
    best = Window.partitionBy("tender_id").orderBy("tier")
    tiers = (
        found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") == 1).drop("rn")
    )
    return checkpointed(tiers), hits


def without_explicit(lots: DataFrame, tiers: DataFrame) -> DataFrame:
    """Lots left for scoring: those no folder and no path names."""
    return lots.join(tiers.select("tender_id").distinct(), "tender_id", "left_anti")


def tender_files(
    files: DataFrame,
    tiers: DataFrame,
    hits: DataFrame,
    scored: DataFrame | None = None,
    max_files: int | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``tender_id, path, tier``: the files of each tender's best tier.

    With ``max_files`` only the most telling files of each tender are kept. Folders
    are then cut down *before* lots meet them: the rank of a file within a folder
    is the same for every tender that uses the folder, so a huge folder shared by
    many lots never turns into all pairs.
    """
    in_dir = files.filter(F.col("top_dir").isNotNull()).select("top_dir", "path")
    if max_files is not None:
        in_dir = prioritize_files(in_dir, max_files, "top_dir").drop("priority")
    small = tiers.select("tender_id", "tier", "top_dir")
    fits = fits_broadcast(small, limit)  # one table, a row per lot at most
    by_dir = lookup_join(
        in_dir, small.filter(F.col("top_dir").isNotNull()), ["top_dir"], fits=fits
    ).select("tender_id", "path", "tier")
    by_path = lookup_join(
        hits, small.filter(F.col("tier") == BY_PATH), ["tender_id"], fits=fits
    ).select("tender_id", "path", "tier")
    out = by_dir.unionByName(by_path)
    if scored is not None:
        rest = lookup_join(
            scored.select("tender_id", "path"), small, ["tender_id"], "left_anti", fits=fits
        )
        out = out.unionByName(rest.withColumn("tier", F.lit(BY_SCORE)))
    if max_files is not None:
        out = prioritize_files(out, max_files).drop("priority")
    return out


def scoreable_files(files: DataFrame, skipped: tuple[str, ...] = vocab.SKIPPED_NAMES) -> DataFrame:
    """Files that take part in scored matching."""
    return files.filter(~text.file_name(F.col("path")).isin(*skipped))


def readable_files(
    files: DataFrame, unreadable: tuple[str, ...] = vocab.UNREADABLE_ARCHIVES
) -> DataFrame:
    """Files that are offered for a choice: not an archive without text."""
    kind = F.lower(text.suffix(F.col("path")))
    return files.filter(
        ~((F.coalesce(F.col("text_sample"), F.lit("")) == "") & kind.isin(*unreadable))
    )
