"""Named queries over the star-schema tables: one per operator or pipeline step."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import cells, responses, text
from procura.operators import links, matching, ordering, report, scoring, tiers, tournament
from procura.operators.joins import checkpoint_folder, checkpointed
from procura.plans import portal, review
from procura.sources import inventory, listing, pages, snapshots, star
from procura.streaming import reports

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

TEMPLATE = "Проанализируй документы и ответь по разделам 1-6."
LINK_KEYWORDS = ("tion", "re", "en")
SOURCE_WORDS = ("on", "er")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- text, cells, keys --------------------------------------------------------


@query
def normalize_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = star.table(spark, folder, "documents")
    return docs.select(
        "doc_id", F.posexplode(text.significant_tokens(F.col("text"))).alias("pos", "token")
    )


@query
def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names for links and folders, and what a name says about a file."""
    named = star.files(spark, folder)
    norm = text.normalize_name(F.col("name"))
    label = F.col("text_sample")
    header = F.when(
        F.length("text_sample") % 2 == 0,
        F.concat(F.lit('attachment; FileName="'), "name", F.lit('"; size=1')),
    )
    return named.select(
        "path",
        text.suffix(F.col("path")).alias("suffix"),
        text.is_generic_name(norm).alias("is_generic"),
        text.is_project_name(norm).alias("is_project"),
        text.keyword_count(norm).alias("keywords"),
        text.safe_dirname(F.col("name")).alias("dirname"),
        text.detect_filename(F.concat("path", F.lit("/?v=1")), label).alias("by_label"),
        text.detect_filename(F.concat("path", F.lit("?v=1/2")), F.lit("")).alias("by_href"),
        text.filename_from_header(header, F.lit("fallback.bin")).alias("by_header"),
    )


@query
def parse_cells(spark: SparkSession, folder: str) -> DataFrame:
    orders = star.table(spark, folder, "orders")
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    clock = F.concat((key % 30).cast("string"), F.lit(":"), (key % 70).cast("string"))
    raw = (
        F.when(key % 7 == 0, F.date_format(day, "dd.MM.yyyy"))
        .when(key % 7 == 1, F.concat(F.date_format(day, "d.M.yyyy"), F.lit("  "), clock))
        .when(key % 7 == 2, F.date_format(day, " dd.MM.yy "))
        .when(key % 7 == 3, F.concat((key % 40).cast("string"), F.date_format(day, ".M.yyyy")))
        .when(key % 7 == 4, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 7 == 5, F.concat(F.lit("1.2."), F.lpad((key % 100).cast("string"), 2, "0")))
        .otherwise("")
    )
    serial = F.col("o_totalprice") / 10
    return orders.select(
        "o_orderkey",
        cells.text_datetime(raw).alias("from_text"),
        cells.serial_datetime(serial).alias("from_serial"),
        cells.serial_datetime(serial, date1904=True).alias("from_serial_1904"),
        cells.display_number(F.col("o_totalprice")).alias("shown"),
        cells.display_number(F.col("o_orderkey").cast("double")).alias("shown_key"),
    )


@query
def derive_ids(spark: SparkSession, folder: str) -> DataFrame:
    """URL and id choice for every page, as if it were listed in a sheet."""
    key = F.col("page_id").cast("string")
    card = F.concat(F.lit("https://CARDS.portal.example.org/ru/Tender/"), key, F.lit("/x"))
    found = F.when(F.col("page_id") % 3 == 0, F.array("url", card)).otherwise(F.array("url"))
    shown = (
        F.when(F.col("page_id") % 4 == 0, "Источник")
        .when(F.col("page_id") % 4 == 1, "")
        .otherwise(F.concat(F.lit("№"), key))
    )
    chosen = star.table(spark, folder, "pages").select(
        "page_id",
        cells.choose_url(found, F.lit(""), F.col("url")).alias("url"),
        cells.portal_url(found).alias("portal_url"),
        shown.alias("shown"),
    )
    number = F.col("page_id") + 1
    return chosen.select(
        "page_id",
        "url",
        "portal_url",
        cells.choose_id(F.col("shown"), F.col("url"), number).alias("tender_id"),
        cells.derive_tender_id(F.col("url"), number).alias("derived_id"),
    )


@query
def tender_listing(spark: SparkSession, folder: str) -> DataFrame:
    """A raw listing bound to the tender schema by its headers."""
    rows = star.sheet_rows(spark, folder)
    names = [f"c{i}" for i in range(len(star.HEADERS))]
    return listing.lots_from_rows(
        rows, star.HEADERS, names, title_column="Наименование лота", hyperlinks="links"
    ).select(
        "row_number", "tender_id", "title", "url", "deadline_at", "customer", "customer_inn",
        F.col("raw")["Номер"].alias("raw_number"),
        F.size("hyperlinks").alias("n_links"),
    )


@query
def deadline_day(spark: SparkSession, folder: str) -> DataFrame:
    lots = star.order_lots(spark, folder)
    return listing.due_on(lots, "1998-10-03").select("tender_id", "title", "deadline_at")


@query
def due_days(spark: SparkSession, folder: str) -> DataFrame:
    """Lots of a stored listing that are due on a day of a large order."""
    target = _scratch(spark, "due")
    listing.store_by_due(star.order_lots(spark, folder), target)
    large = star.table(spark, folder, "orders").filter("o_totalprice > 400000")
    days = large.select(F.col("o_orderdate").alias("day"))
    return listing.stored_due(spark, target, days).select("tender_id", "title", "deadline_at")


@query
def deadline_queue(spark: SparkSession, folder: str) -> DataFrame:
    """All lots behind the first hundred, numbered in working order."""
    lots = star.order_lots(spark, folder)
    left = ordering.queue(lots, skip=100)
    return left.select("tender_id", "deadline_at", "row_number")


@query
def queue_head(spark: SparkSession, folder: str) -> DataFrame:
    """Skip and limit, as for a trial run."""
    lots = star.order_lots(spark, folder)
    return ordering.queue(lots, 20, 500).select("tender_id", "deadline_at", "row_number")


# --- links ---------------------------------------------------------------------


@query
def page_anchors(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.anchors(star.table(spark, folder, "pages"))
    return found.select("page_id", "pos", "href", "abs_url", "text")


@query
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    anchors = pages.anchors(star.table(spark, folder, "pages"))
    return links.document_links(anchors, keywords=LINK_KEYWORDS)


@query
def source_link(spark: SparkSession, folder: str) -> DataFrame:
    anchors = pages.anchors(star.table(spark, folder, "pages"))
    return links.source_links(anchors, keywords=SOURCE_WORDS)


@query
def selected_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links that fit an attribute pattern, else all links of the page."""
    anchors = pages.anchors(star.table(spark, folder, "pages"))
    return links.selected_links(anchors, (("*=", "ent"), ("$=", "."), ("^=", "/da")))


def _fetch_log(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """Every event is one round of fetches of a page, so most links are fetched again."""
    n_pages = star.table(spark, folder, "pages").agg(F.count("*").alias("n")).scalar()
    events = star.table(spark, folder, "events").withColumn("page_id", F.col("event_id") % n_pages)
    number = F.col("page_id").cast("string")
    return found.join(events, "page_id").select(
        "page_id",
        F.col("event_id").alias("attempt"),
        F.col("abs_url").alias("url"),
        F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"),
        F.when(F.col("value") > 10, "text/html; charset=utf-8")
        .otherwise("application/pdf")
        .alias("content_type"),
        F.when(
            F.col("user_id") % 3 == 0,
            F.concat(F.lit('attachment; filename="doc_'), number, F.lit('.pdf"')),
        )
        .when(F.col("user_id") % 3 == 1, "attachment; filename=scan.html")
        .alias("content_disposition"),
    )


def _outcomes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    source = star.table(spark, folder, "pages")
    anchors = checkpointed(links.followable(pages.anchors(source)))
    found = checkpointed(links.document_links(anchors, keywords=LINK_KEYWORDS))
    fetched = checkpointed(links.fetched_files(found, _fetch_log(spark, folder, found)))
    sources = links.source_links(anchors, keywords=SOURCE_WORDS)
    return links.page_outcomes(source, found, fetched, sources), fetched


@query
def fetched_files(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, folder)[1]


@query
def link_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(spark, folder)[0]


@query
def portal_run(spark: SparkSession, folder: str) -> DataFrame:
    """Whole portal run with the test scorer, one result per tender page."""
    source = star.table(spark, folder, "pages")
    found = links.distinct_links(links.followable(pages.anchors(source)))
    lots = star.order_lots(spark, folder)
    out = portal.portal_results(
        lots,
        source,
        _fetch_log(spark, folder, found),
        TEMPLATE,
        document_keywords=LINK_KEYWORDS,
        source_keywords=SOURCE_WORDS,
    )
    return out.select(
        "tender_id", "status", "classification_tag", "confidence_percent",
        "classification_comment", F.size("downloaded_files").alias("n_files"), "error",
    )


# --- matching -------------------------------------------------------------------


def _scoring_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Readable files, and the lots that no path names."""
    listed = star.files(spark, folder)
    lots = listing.one_per_id(star.lots(spark, folder))
    named = tiers.path_hits(listed, lots)
    return (
        tiers.readable_files(tiers.scoreable_files(listed)),
        tiers.without_explicit(lots, named),
    )


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return matching.rank_candidates(matching.score_pairs(*_scoring_inputs(spark, folder)))


@query
def match_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).select("path", "tender_id", "score", "rn")


@query
def match_assign(spark: SparkSession, folder: str) -> DataFrame:
    return matching.choose_by_margin(_ranked(spark, folder))


@query
def match_band(spark: SparkSession, folder: str) -> DataFrame:
    return matching.band_files(match_assign(spark, folder))


@query
def match_tiers(spark: SparkSession, folder: str) -> DataFrame:
    listed, lots = star.filed(spark, folder), star.lots(spark, folder)
    found = review.files_of_lots(listed, lots, max_files=None)
    return found.select("tender_id", "path", "tier")


@query
def file_priority(spark: SparkSession, folder: str) -> DataFrame:
    """The four most telling files of each folder."""
    listed = star.files(spark, folder).select("top_dir", "path")
    return matching.prioritize_files(listed, group="top_dir")


@query
def match_prompts(spark: SparkSession, folder: str) -> DataFrame:
    listed, lots = _scoring_inputs(spark, folder)
    ranked = matching.rank_candidates(matching.score_pairs(listed, lots))
    return scoring.match_requests(listed, ranked)


@query
def match_options(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates that prompts offer, and once the list of all lots."""
    return scoring.match_options(_ranked(spark, folder), star.lots(spark, folder))


def first_option() -> scoring.Scorer:
    """A model that takes the first option, and fails on some files."""
    import json

    def answer(prompt: str, files: list[str]) -> str:
        head, _, options = prompt.rpartition(vocab.MATCH_PROMPT_OPTIONS)
        return json.dumps({"tender_id": options.split('"')[1], "confidence": 90})

    return answer


@query
def match_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Choices of a Python model; files without candidates may name any lot.

    Answers for a third of the files are lost and fall back to the margin test.
    """
    listed, lots = _scoring_inputs(spark, folder)
    ranked = checkpointed(matching.rank_candidates(matching.score_pairs(listed, lots)))
    everyone = star.lots(spark, folder)
    requests = scoring.match_requests(listed, ranked)
    options = scoring.match_options(ranked, everyone)
    answers = scoring.run_match_scorer(requests, options, first_option)
    lost = F.length("path") % 3 == 0
    answers = answers.withColumn("error", F.when(lost, F.lit("lost")).otherwise(F.col("error")))
    return matching.choose_by_response(answers, ranked, everyone)


def longest_option() -> scoring.Scorer:
    """A model that takes the longest option, of equal ones that with the smallest id."""
    import json
    import re

    def answer(prompt: str, files: list[str]) -> str:
        # Titles may hold line breaks.
        lines = re.split(r'\n(?=- ")', prompt.rpartition(vocab.MATCH_PROMPT_OPTIONS)[2])
        best = min(lines, key=lambda o: (-len(o), o.split('"')[1]))
        return json.dumps({"tender_id": best.split('"')[1], "confidence": 90})

    return answer


@query
def match_paged(spark: SparkSession, folder: str) -> DataFrame:
    """Choices of a Python model that sees 20 options at a time.

    Files without candidates choose from all lots, page by page and from the winners.
    """
    listed, lots = _scoring_inputs(spark, folder)
    ranked = checkpointed(matching.rank_candidates(matching.score_pairs(listed, lots)))
    everyone = star.lots(spark, folder)
    requests = scoring.match_requests(listed, ranked)
    options = scoring.match_options(ranked, everyone)
    answers = tournament.run_match_tournament(requests, options, longest_option, page=20)
    return matching.choose_by_response(answers, ranked, everyone, written=True)


def _match_answers(ranked: DataFrame) -> DataFrame:
    """Answers to the match prompts: the best candidate, with flaws by score and name."""
    first = ranked.filter(F.col("rn") == 1)
    confidence = (
        F.when(F.length("path") % 5 == 0, F.lit('"75"'))
        .when(F.length("path") % 5 == 1, F.lit("59"))
        .when(F.length("path") % 5 == 2, F.lit("88.9"))
        .when(F.length("path") % 5 == 3, F.lit('"high"'))
        .otherwise(F.lit("60"))
    )
    chosen = (
        F.when(F.col("score") % 4 == 0, "none")
        .when(F.col("score") % 4 == 1, "99999")
        .otherwise(F.col("tender_id"))
    )
    answer = F.concat(
        F.lit('{"tender_id": " '), chosen, F.lit('", "confidence": '), confidence, F.lit("}")
    )
    return first.select("path", answer.alias("response"), F.lit(None).cast("string").alias("error"))


@query
def match_choices(spark: SparkSession, folder: str) -> DataFrame:
    listed, lots = _scoring_inputs(spark, folder)
    ranked = matching.rank_candidates(matching.score_pairs(listed, lots))
    return matching.choose_by_response(_match_answers(ranked), ranked, lots)


@query
def folder_review(spark: SparkSession, folder: str) -> DataFrame:
    """Whole folder review with the test scorer."""
    out = review.review(star.filed(spark, folder), star.lots(spark, folder), TEMPLATE)
    return out.select(
        "tender_id", "status", "classification_tag", "confidence_percent",
        "classification_comment", F.array_join("downloaded_files", "|").alias("files"),
    )


# --- scoring ----------------------------------------------------------------------


def _order_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for orders; the documents of an order are its files."""
    lots = star.order_lots(spark, folder)
    docs = star.files(spark, folder).select(
        F.regexp_extract("name", "([0-9]{7})", 1).cast("int").cast("string").alias("tender_id"),
        "path",
    )
    top = matching.prioritize_files(docs)
    return scoring.analysis_requests(lots, top, TEMPLATE)


@query
def analysis_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _order_requests(spark, folder).select("tender_id", "prompt", "n_files")


def stub() -> scoring.Scorer:
    """Row-wise twin of the built-in test scorer, for the Python interface."""
    import json

    def answer(prompt: str, files: list[str]) -> str:
        names = ", ".join(f.rsplit("/", 1)[-1] for f in files) or vocab.STUB_NO_FILES
        if "CRM" in names:
            raise RuntimeError(f"no access to {names}")
        return json.dumps(
            {
                "classification_tag": vocab.DEFAULT_TAG,
                "confidence_percent": vocab.STUB_CONFIDENCE,
                "classification_comment": vocab.STUB_COMMENT.format(files=names),
                "analysis_markdown": vocab.STUB_ANALYSIS,
            },
            ensure_ascii=False,
        )

    return answer


@query
def scorer_results(spark: SparkSession, folder: str) -> DataFrame:
    """Classification through a Python scorer that fails on some files."""
    requests = _order_requests(spark, folder)
    done = scoring.classify_requests(requests, lambda r: scoring.run_scorer(r, stub))
    return done.select("tender_id", "payload.*", F.size("files").alias("n_files"))


def unsteady() -> scoring.Scorer:
    """``stub``, whose first call for each prompt in a task fails."""
    steady, seen = stub(), set()

    def answer(prompt: str, files: list[str]) -> str:
        if prompt not in seen:
            seen.add(prompt)
            raise ConnectionError("try again")
        return steady(prompt, files)

    return answer


def silent() -> scoring.Scorer:
    """A scorer that has no answer to anything."""

    def answer(prompt: str, files: list[str]) -> str:
        raise PermissionError("no access to " + ", ".join(f.rsplit("/", 1)[-1] for f in files))

    return answer


@query
def scorer_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Classification by an unsteady scorer with retries, then again from stored answers.

    The second run meets a scorer without answers; what it returns was kept by the first.
    """
    requests, store = _order_requests(spark, folder), _scratch(spark, "answers")
    calls = scoring.Calls(attempts=2, pause=0.0, concurrency=4)
    scoring.run_scorer(requests.filter("n_files > 0"), unsteady, calls=calls, store=store)
    done = scoring.classify_requests(requests, lambda r: scoring.run_scorer(r, silent, store=store))
    return done.select("tender_id", "payload.*", F.size("files").alias("n_files"))


@query
def stub_results(spark: SparkSession, folder: str) -> DataFrame:
    """Classification through the built-in test scorer."""
    requests = _order_requests(spark, folder)
    done = scoring.classify_requests(requests, scoring.stub_scorer, skip_empty=False)
    out = report.results(star.order_lots(spark, folder), done)
    return out.select(
        "tender_id", "title", "customer", "status", "classification_tag",
        "confidence_percent", "classification_comment", "analysis_markdown",
        F.array_join("downloaded_files", "|").alias("files"),
    )


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers of many shapes, one per event."""
    key = F.col("event_id")
    tag = F.element_at(
        F.array(*[F.lit(t) for t in vocab.TAGS], F.lit("Иное")), (key % 11 + 1).cast("int")
    )
    confidence = F.element_at(
        F.array(
            *[
                F.lit(c)
                for c in (
                    "85", '" 140 "', "85.7", "-3", "true", "null", '"85%"', '"85.7"', "[1]",
                    '"+7"', "1e2", "false",
                )
            ]
        ),
        (key % 12 + 1).cast("int"),
    )
    body = F.concat(
        F.lit('{"classification_tag": " '), tag,
        F.lit('", "confidence_percent": '), confidence,
        F.lit(', "classification_comment": "'), F.when(key % 4 == 0, "  ").otherwise(F.col("event_type")),
        F.lit('", "analysis_markdown": '), F.when(key % 5 == 0, "null").otherwise('"разбор\\n1"'),
        F.lit("}"),
    )
    response = (
        F.when(key % 13 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(key % 13 == 1, F.col("props"))
        .when(key % 13 == 2, F.concat(F.lit("["), body, F.lit("]")))
        .when(key % 13 == 3, F.concat(F.lit(" "), F.col("event_type"), F.lit("\n")))
        .otherwise(body)
    )
    error = F.when(key % 29 == 0, F.lit("timeout"))
    return star.table(spark, folder, "events").select(
        "event_id", response.alias("response"), error.alias("error")
    )


@query
def parse_responses(spark: SparkSession, folder: str) -> DataFrame:
    return responses.classify(_responses(spark, folder)).select("event_id", "payload.*")


# --- report ----------------------------------------------------------------------


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    """Results of all orders, graded by their priority and status."""
    order = F.col("o_orderpriority")
    tag = (
        F.when(order == "1-URGENT", "В работу")
        .when(order == "2-HIGH", "Подано")
        .when(order == "3-MEDIUM", "Не наш стек")
        .when(order == "5-LOW", "")
        .otherwise("Не изучено")
    )
    return star.order_lots(spark, folder).select(
        "row_number", "tender_id", "title", "url", "deadline_at",
        tag.alias("classification_tag"),
        (F.col("row_number") % 101).alias("confidence_percent"),
        F.concat(F.lit("статус "), "o_orderstatus").alias("classification_comment"),
    )


@query
def report_months(spark: SparkSession, folder: str) -> DataFrame:
    return report.monthly(_graded(spark, folder))


@query
def tag_summary(spark: SparkSession, folder: str) -> DataFrame:
    return report.tag_summary(_graded(spark, folder))


def _by_customer(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Results of orders by customer, and later ones of the events."""
    old = star.order_lots(spark, folder).select(
        F.col("customer_inn").alias("tender_id"),
        F.col("tender_id").cast("long").alias("version"),
        "title",
        "deadline_at",
    )
    new = star.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("tender_id"),
        F.col("event_id").alias("version"),
        F.col("event_type").alias("title"),
        F.col("ts").alias("deadline_at"),
    )
    return old, new


@query
def report_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Results of orders by customer, replaced by later ones of the events."""
    merged = report.upsert(*_by_customer(spark, folder))
    return merged.select(
        "tender_id", "version", "title",
        cells.sheet_name(F.col("deadline_at")).alias("sheet"),
        cells.format_deadline(F.col("deadline_at")).alias("deadline"),
    )


@query
def report_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stored report of orders by customer that follows the events as they arrive."""
    old, new = (
        rows.select(
            "tender_id", "version", "title", F.col("deadline_at").cast("timestamp_ntz").alias("deadline_at"),
            F.lit("").alias("url"), F.lit("").alias("classification_tag"), F.lit("").alias("classification_comment"),
            F.lit(0).alias("confidence_percent"), F.col("version").alias("row_number"),
        )
        for rows in _by_customer(spark, folder)
    )
    base = _scratch(spark, "stream")
    target, arrivals = f"{base}/report", f"{base}/arrivals"
    report.update_report(target, old)
    new.repartitionByRange("version").write.parquet(arrivals)
    files = [n for n in snapshots.names(spark, arrivals) if n.endswith(".parquet")]
    # In three batches, whatever the number of files.
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", -(-len(files) // 3) or 1)
    reports.follow_results(stream.parquet(arrivals), target, f"{base}/checkpoint").awaitTermination()
    return report.read_report(spark, target).select("tender_id", "version", "title", "sheet", "deadline")


@query
def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Folders for all benchmark lots: long titles are cut at a byte limit."""
    return report.manifest(star.lots(spark, folder))


@query
def order_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return report.manifest(star.order_lots(spark, folder))


@query
def folder_names(spark: SparkSession, folder: str) -> DataFrame:
    """Documents' texts as folder names."""
    docs = star.table(spark, folder, "documents")
    return docs.select("doc_id", text.sanitize_folder_name(F.col("text")).alias("folder_name"))


@query
def unique_names(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated titles get a running suffix."""
    suffix = F.when(F.col("row_number") % 97 == 0, " (2)").when(F.col("row_number") % 89 == 0, " (3)").otherwise("")
    lots = star.order_lots(spark, folder).select("row_number", F.concat("title", suffix).alias("title"))
    return ordering.unique_names(lots, "title", [F.col("row_number").asc()])


# --- archives and text -----------------------------------------------------------


@query
def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    members = inventory.expand_archives(star.archives(spark, folder))
    return members.select(
        "archive", "member", "path", "size", F.md5("content").alias("content_md5")
    )


@query
def text_samples(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.text_samples(star.raw_files(spark, folder))



# --- whole runs, sinks read back ---------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{checkpoint_folder(spark)}/{name}-{spark._jvm.java.util.UUID.randomUUID()}"


@query
def listing_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A listing exported to CSV, with line breaks in its titles, and read again."""
    target = _scratch(spark, "listing")
    orders = star.order_lots(spark, folder)
    orders.select(
        "row_number",
        F.concat(F.lit("N"), "tender_id").alias("c0"),
        F.concat(F.col("title"), F.lit('\nline "two"')).alias("c1"),
        "url",
        F.date_format("deadline_at", "dd.MM.yyyy H:mm").alias("c3"),
        "customer",
        "customer_inn",
    ).write.option("escape", '"').csv(target)
    headers = ["row", *star.HEADERS]
    found = listing.read_listing(spark, target, headers, title_column="Наименование лота")
    return found.select("row_number", "tender_id", "title", "url", "deadline_at", "customer", "customer_inn")


@query
def folder_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Folders and kinds of files found by an inventory of written texts."""
    target = _scratch(spark, "inbox")
    docs = star.table(spark, folder, "documents").select("source", F.hex(F.encode("text", "UTF-8")).alias("text"))
    docs.write.partitionBy("source").text(target)
    found = inventory.inventory(spark, target)
    known = found.filter(F.col("suffix") == ".txt")
    return known.groupBy("top_dir", "suffix").agg(F.sum("length").alias("bytes"))


@query
def manifest_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest as its file says it."""
    target = _scratch(spark, "manifest")
    report.write_manifest(report.manifest(star.order_lots(spark, folder)), target)
    back = spark.read.option("header", True).option("escape", '"').csv(target)
    return back.select(
        F.col("order").cast("int").alias("order"), "tender_id", "title", "folder_name",
        F.coalesce("deadline_at", F.lit("")).alias("deadline_at"), "url",
    )


def _cycle(spark: SparkSession, folder: str) -> str:
    """A report written and updated twice; lots change and leave months.

    First every seventh lot moves on by forty days, then all lots of 1992 lose their
    deadline, so that the sheets of that year go.
    """
    target = _scratch(spark, "report")
    first = _graded(spark, folder).withColumn("version", F.lit(1).cast("long"))
    report.update_report(target, first)
    late = F.col("deadline_at") + F.expr("INTERVAL 40 DAYS")
    moved = first.filter(F.col("row_number") % 7 == 0).withColumn("deadline_at", late)
    report.update_report(target, moved.withColumn("version", F.lit(2).cast("long")))
    gone = first.filter(F.year("deadline_at") == 1992)
    undated = gone.withColumn("deadline_at", F.lit(None).cast("timestamp_ntz"))
    report.update_report(target, undated.withColumn("version", F.lit(3).cast("long")))
    return target


@query
def report_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """A stored report after two updates, read back."""
    back = report.read_report(spark, _cycle(spark, folder))
    return back.select("sheet", "number", "tender_id", "tag", "title", "deadline", "version")


@query
def report_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tag counts of a stored report after two updates, from the counts kept with it."""
    return report.stored_summary(spark, _cycle(spark, folder))


@query
def portal_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """Portal run in working order, past a few lots, into a stored report."""
    source = star.table(spark, folder, "pages")
    found = links.distinct_links(links.followable(pages.anchors(source)))
    paged = star.order_lots(spark, folder).join(
        source.select(F.col("page_id").cast("int").alias("row_number")), "row_number", "left_semi"
    )
    target = _scratch(spark, "portal")
    portal.portal_report(
        target, paged, source, _fetch_log(spark, folder, found), TEMPLATE, 1, skip=5,
        document_keywords=LINK_KEYWORDS, source_keywords=SOURCE_WORDS,
    )
    back = report.read_report(spark, target)
    return back.select("sheet", "number", "tender_id", "tag", "confidence_percent", "comment", "deadline")


@query
def review_run(spark: SparkSession, folder: str) -> DataFrame:
    """Folder review from raw files and archives, a page of lots only, to report rows."""
    return _reviewed(spark, folder, skip=3, limit=30)


@query
def review_all(spark: SparkSession, folder: str) -> DataFrame:
    """Folder review of all lots, from raw files and archives to report rows."""
    return _reviewed(spark, folder)


def _reviewed(spark: SparkSession, folder: str, **page: int) -> DataFrame:
    binary = star.raw_files(spark, folder).unionByName(star.archives(spark, folder))
    done = review.review_folder(binary, "/inbox", star.lots(spark, folder), TEMPLATE, **page)
    return done.select("sheet", "number", "title", "tag", "confidence_percent", "comment", "deadline")


@query
def retargeted(spark: SparkSession, folder: str) -> DataFrame:
    """Lots that go by the source page found on their own page."""
    anchors = pages.anchors(star.table(spark, folder, "pages"))
    found = links.source_links(anchors, keywords=SOURCE_WORDS)
    found = found.select(F.col("page_id").cast("string").alias("tender_id"), "source_url")
    lots = star.order_lots(spark, folder)
    return listing.retarget(lots, found).select("tender_id", "title", "url")


@query
def target_day(spark: SparkSession, folder: str) -> DataFrame:
    """Lots due the day before a given one, and how many each customer has."""
    day = cells.target_date("yesterday", today=datetime.date(1998, 10, 4))
    lots = listing.due_on(star.order_lots(spark, folder), day)
    return lots.groupBy("customer").agg(F.count("*").alias("n"))


@query
def files_by_path(spark: SparkSession, folder: str) -> DataFrame:
    """Files numbered in path order."""
    listed = star.filed(spark, folder).select("path")
    return _numbered(matching.order_by_path(listed))


@query
def matched_order(spark: SparkSession, folder: str) -> DataFrame:
    """Matched files numbered in the order they are shown."""
    return _numbered(matching.order_matched(match_assign(spark, folder)))


def _numbered(ordered: DataFrame) -> DataFrame:
    """Running numbers of sorted rows; sorted partitions follow each other."""
    kept = checkpointed(ordered).withColumn("_part", F.spark_partition_id())
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition meets in one task here.
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = kept.withColumn("_at", at).join(starts, "_part")
    return placed.withColumn("n", F.col("_before") + F.col("_at") + 1).select(*ordered.columns, "n")
