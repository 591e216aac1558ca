"""Archives expanded once, as they arrive.

The stream's checkpoint remembers which archives were read, and the file sink
commits each batch as a whole; so every archive is expanded exactly once, also
across restarts and lost executors.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from procura.sources import inventory

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def expand_arrivals(
    spark: SparkSession,
    root: str,
    target: str,
    checkpoint: str,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Expand the archives under ``root`` that are new, then stop.

    ``target`` becomes a Parquet table of members; keep it outside ``root``.
    """
    arrived = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", inventory.ARCHIVES)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(root)
        .select(inventory.local_path(F.col("path")).alias("path"), "content")
    )
    return (
        inventory.expand_archives(arrived)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
