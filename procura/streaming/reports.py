"""Results that enter the stored report as they arrive.

Every micro-batch is one commit of the report, and the commit holds the number of the
batch. A batch that is played again after a failure, between its commit and the stream's
own record of it, finds its number there and changes nothing: each result counts once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from procura.operators import report
from procura.sources import snapshots


def follow_results(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Upsert the rows of a stream into the report at ``path`` until all that is there is read.

    ``results`` has the columns that ``report.update_report`` takes. The highest version
    of an id wins, in whatever order rows arrive. The stream is known by the id in its
    checkpoint folder, so a new checkpoint counts its batches anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        stream = json.loads(snapshots.text(batch.sparkSession, f"{checkpoint}/metadata"))["id"]
        report.update_report(path, batch, batch=(stream, number))

    return (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
