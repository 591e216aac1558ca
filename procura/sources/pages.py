"""Anchors of HTML pages, in document order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from procura.functions import markup, text, urls
from procura.operators.joins import once

# Anchors that a task hands on at once; a page may have any number of them.
_ROWS = 10_000


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.select(["page_id", "page_url"])
        rows: list[tuple[int, int, str, str]] = []
        for n, page in enumerate(batch.column("html").to_pylist()):
            rows += [(n, *anchor) for anchor in markup.anchors(page or "")]
            while len(rows) >= _ROWS:
                yield _table(pages, rows[:_ROWS])
                rows = rows[_ROWS:]
        yield _table(pages, rows)


def _table(pages: pa.RecordBatch, rows: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
    n, number, href, label = zip(*rows, strict=True) if rows else ((), (), (), ())
    taken = pages.take(pa.array(n, pa.int64()))
    columns = [*taken.columns, pa.array(number, pa.int32()), pa.array(href, pa.string()), pa.array(label, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "page_url", "pos", "href", "label"])


def anchors(pages: DataFrame) -> DataFrame:
    """``page_id, page_url, pos, href, abs_url, text`` of each anchor with an href.

    Pages are read by ``markup.anchors`` where they lie; only anchors leave the task. A
    null page has none.
    """
    rows = pages.select("page_id", F.col("url").alias("page_url"), "html")
    schema = StructType([rows.schema["page_id"], rows.schema["page_url"]])
    schema = schema.add("pos", "integer").add("href", "string").add("label", "string")
    found = rows.mapInArrow(_read, schema).filter(F.col("href") != "")
    return once(
        found,
        abs_url=urls.resolve(F.col("page_url"), F.col("href")),
        text=text.strip(F.regexp_replace("label", r"[ \t\n\r]+", " ")),
    ).drop("label")
