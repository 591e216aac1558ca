"""Links of portal pages: documents, source pages, outcome of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import text, urls


def followable(anchors: DataFrame, ignored_hosts: Sequence[str] = vocab.IGNORED_HOSTS) -> DataFrame:
    """http(s) anchors outside the ignored hosts."""
    return anchors.filter(
        urls.is_supported_scheme(F.col("abs_url"))
        & ~urls.is_ignored_host(F.col("abs_url"), ignored_hosts)
    )


def distinct_links(anchors: DataFrame) -> DataFrame:
    """One row per page and URL: first position, last text."""
    return anchors.groupBy("page_id", "abs_url").agg(
        F.min("pos").alias("pos"), F.max_by("text", "pos").alias("text")
    )


def document_links(
    anchors: DataFrame,
    extensions: Sequence[str] = vocab.DOCUMENT_EXTENSIONS,
    keywords: Sequence[str] = vocab.DOCUMENT_KEYWORDS,
) -> DataFrame:
    """Distinct document links of each page."""
    chosen = urls.is_document_link(F.col("abs_url"), F.col("text"), extensions, keywords)
    return distinct_links(followable(anchors).filter(chosen))


def source_links(
    anchors: DataFrame,
    portal_hosts: Sequence[str] = vocab.PORTAL_HOSTS,
    service_host: str = vocab.PORTAL_SERVICE_HOST,
    keywords: Sequence[str] = vocab.SOURCE_KEYWORDS,
) -> DataFrame:
    """``page_id, source_url``: first link of a page that leads to a source page."""
    chosen = urls.is_source_host(
        F.col("abs_url"), portal_hosts, service_host
    ) & urls.is_source_page(F.col("abs_url"), keywords)
    return (
        followable(anchors)
        .filter(chosen)
        .groupBy("page_id")
        .agg(F.min_by("abs_url", "pos").alias("source_url"))
    )


def _matches(href: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    found = F.lit(False)
    for kind, value in patterns:
        if kind == "*=":
            found = found | F.contains(href, F.lit(value))
        elif kind == "$=":
            found = found | F.endswith(href, F.lit(value))
        elif kind == "^=":
            found = found | F.startswith(href, F.lit(value))
        else:
            raise ValueError(f"unknown attribute pattern {kind!r}")
    return found


def selected_links(
    anchors: DataFrame, patterns: Sequence[tuple[str, str]] = vocab.LINK_PATTERNS
) -> DataFrame:
    """Links whose href fits a pattern; all links of a page where none does.

    Patterns are attribute tests ``*=`` (contains), ``$=`` (ends with), ``^=``. One
    aggregation decides for each page; distinct URLs keep their first position.
    """
    marked = followable(anchors.withColumn("hit", _matches(F.col("href"), patterns)))
    links = marked.groupBy("page_id", "abs_url").agg(
        F.min("pos").alias("pos"),
        F.max_by("text", "pos").alias("text"),
        F.max("hit").alias("hit"),
    )
    pages = marked.groupBy("page_id").agg(F.max("hit").alias("any_hit"))
    return (
        links.join(pages, "page_id")
        .filter(F.col("hit") | ~F.col("any_hit"))
        .select("page_id", "abs_url", "pos", "text")
    )


def fetched_files(links: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Files that a fetch of ``links`` brought, with their names.

    ``fetch_log`` has ``page_id, url, status, content_type, content_disposition``.
    Failed fetches and web pages instead of documents are left out. The log may hold
    retries: of a link fetched more than once, the file of the largest ``attempt`` (a
    column of the log, if it has one) counts.
    """
    attempt = F.col("attempt") if "attempt" in fetch_log.columns else F.lit(0)
    # Equal attempts of a link are one; what a name is made from does not tell them apart.
    fetched = (
        fetch_log.filter(F.col("status").between(200, 299))
        .groupBy("page_id", F.col("url").alias("abs_url"), "content_type", "content_disposition")
        .agg(F.max(attempt).alias("_attempt"))
    )
    named = links.join(fetched, ["page_id", "abs_url"]).withColumn(
        "filename",
        text.filename_from_header(
            F.col("content_disposition"),
            text.detect_filename(F.col("abs_url"), F.col("text")),
        ),
    )
    good = named.filter(~urls.is_html_response(F.col("content_type"), F.col("filename")))
    return good.groupBy("page_id", "abs_url", "pos").agg(
        F.max_by("filename", F.struct("_attempt", "filename")).alias("filename")
    )


def outcome(
    n_links: Column, n_files: Column, has_source: Column, portal: str = vocab.PORTAL_LABEL
) -> Column:
    """``struct(status, confidence_percent, classification_comment, error)``.

    Files found: ok, to be classified. Document links without files: blocked. No
    link and no source page: nothing found. A source page without files: error.
    ``portal`` is what messages call the portal.
    """
    def row(status: str, confidence: int | None, comment: str | None, error: str) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            F.lit(confidence).cast("int").alias("confidence_percent"),
            F.lit(comment).cast("string").alias("classification_comment"),
            F.lit(error).alias("error"),
        )

    return (
        F.when(n_files > 0, row("ok", None, None, ""))
        .when(n_links > 0, row("blocked", 10, vocab.BLOCKED_COMMENT, vocab.BLOCKED_ERROR))
        .when(
            ~has_source,
            row(
                "error",
                5,
                vocab.NOTHING_FOUND_COMMENT.format(portal=portal),
                vocab.NOTHING_FOUND_ERROR.format(portal=portal),
            ),
        )
        .otherwise(row("error", 0, vocab.PIPELINE_ERROR_COMMENT, vocab.SOURCE_EMPTY_ERROR))
    )


def page_outcomes(
    pages: DataFrame,
    links: DataFrame,
    files: DataFrame,
    sources: DataFrame,
    portal: str = vocab.PORTAL_LABEL,
) -> DataFrame:
    """Outcome of every page from its document links, fetched files and source link."""
    n_links = links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))
    n_files = files.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_files"))
    counted = (
        pages.select("page_id")
        .join(n_links, "page_id", "left")
        .join(n_files, "page_id", "left")
        .join(sources.select("page_id", "source_url"), "page_id", "left")
        .withColumn("n_links", F.coalesce("n_links", F.lit(0)))
        .withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    )
    return counted.withColumn(
        "o", outcome(F.col("n_links"), F.col("n_files"), F.col("source_url").isNotNull(), portal)
    ).select("page_id", "n_links", "n_files", "source_url", "o.*")
