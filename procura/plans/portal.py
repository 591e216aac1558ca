"""Portal run: from tender pages and a fetch log to results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura import vocab
from procura.operators import links, ordering, report, scoring
from procura.operators.joins import checkpointed
from procura.sources import listing, pages as html


def downloads(
    pages: DataFrame,
    fetch_log: DataFrame,
    source_pages: DataFrame | None = None,
    document_keywords: Sequence[str] = vocab.DOCUMENT_KEYWORDS,
    source_keywords: Sequence[str] = vocab.SOURCE_KEYWORDS,
) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, files)`` per page.

    Document links are looked for on the page itself. Where it has none, its source
    page is used: ``source_pages`` has ``page_id, url, html`` of the source links found
    (fetched outside), keyed by the page they belong to.
    """
    # Pages are parsed once; links are a small part of them.
    anchors = checkpointed(links.followable(html.anchors(pages)))
    documents = checkpointed(links.document_links(anchors, keywords=document_keywords))
    sources = links.source_links(anchors, keywords=source_keywords)
    files = links.fetched_files(documents, fetch_log)
    if source_pages is not None:
        without = source_pages.join(documents.select("page_id").distinct(), "page_id", "left_anti")
        selected = links.selected_links(html.anchors(without))
        files = files.unionByName(links.fetched_files(selected, fetch_log))
    return links.page_outcomes(pages, documents, files, sources), files


def portal_results(
    lots: DataFrame,
    pages: DataFrame,
    fetch_log: DataFrame,
    template: str,
    source_pages: DataFrame | None = None,
    scorer: Callable[[DataFrame], DataFrame] = scoring.stub_scorer,
    **keywords: Sequence[str],
) -> DataFrame:
    """One result row per lot id; ``pages.page_id`` is the lot's ``row_number``.

    Of rows that repeat an id the first counts. A lot whose files come from its source
    page is listed with the address of that page.
    """
    lots = listing.one_per_id(lots)
    outcomes, files = downloads(pages, fetch_log, source_pages, **keywords)
    outcomes, files = checkpointed(outcomes), checkpointed(files)
    ids = lots.select("tender_id", F.col("row_number").cast("long").alias("page_id"))
    by_tender = outcomes.join(ids, "page_id")
    if source_pages is not None:
        moved = by_tender.filter("n_links = 0 AND n_files > 0 AND source_url IS NOT NULL")
        moved = moved.select("tender_id", "source_url")
        stay = lots.join(moved, "tender_id", "left_anti")
        lots = stay.unionByName(listing.retarget(lots, moved))
    ok = lots.join(by_tender.filter(F.col("status") == "ok").select("tender_id"), "tender_id", "left_semi")
    listed = files.join(ids, "page_id").select(
        "tender_id", F.col("filename").alias("path"), F.col("pos").alias("priority")
    )
    requests = scoring.analysis_requests(ok, listed, template)
    good = report.results(ok, scoring.classify_requests(requests, scorer))
    return good.unionByName(report.failed_results(lots, by_tender))


def portal_report(
    path: str,
    lots: DataFrame,
    pages: DataFrame,
    fetch_log: DataFrame,
    template: str,
    version: int,
    skip: int = 0,
    limit: int | None = None,
    **options: object,
) -> None:
    """A whole run: lots in working order, their results, the stored report updated."""
    chosen = ordering.queue(listing.one_per_id(lots), skip, limit)
    done = portal_results(chosen, pages, fetch_log, template, **options)
    numbered = done.join(chosen.select("tender_id", "row_number"), "tender_id")
    report.update_report(path, numbered.withColumn("version", F.lit(version).cast("long")))
