from __future__ import annotations

from pyspark.sql import functions as F

from procura import vocab
from procura.operators import links
from procura.plans import portal
from procura.sources import listing, pages

HTML = """<html><!-- <a href="/hidden.pdf">no</a> --><script>var x='<a href="/s.pdf">s</a>'</script>
<A class=x href='/docs/a.pdf?v=1&amp;w=2'> First <b>doc</b>&amp;more </A>
<a href="/docs/a.pdf?v=1&amp;w=2">Last text</a>
<a name="top">no link</a><a href="">empty</a>
<a href="https://t.me/file.pdf">ignored</a><a href="mailto:x@y.z">mail</a>
<a href=download/7>Скачать
всё</a>
<a data-href="/no" href="https://cards.portal.example.org/tender/1">portal</a>
<a href="https://service.portal.example.org/tender/1">service</a>
<a href="https://etp.example.org/about">other</a>
<a href="https://etp.example.org/ZAKUP/5">source</a>
<a href="https://etp2.example.org/trade/6">second</a></html>"""


def page(spark, *htmls):
    rows = [(i, "https://h.org/a/b", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_anchors(spark):
    got = [(r["href"], r["abs_url"], r["text"]) for r in pages.anchors(page(spark, HTML)).orderBy("pos").collect()]
    assert got[0] == ("/docs/a.pdf?v=1&w=2", "https://h.org/docs/a.pdf?v=1&w=2", "First doc&more")
    assert ("download/7", "https://h.org/a/download/7", "Скачать всё") in got
    assert len(got) == 10 and not any("hidden" in h or "s.pdf" in h for h, _, _ in got)


def test_open_anchors(spark):
    html = '<a href=/1>one <a href="/2">two</a> x <A\nHREF="/3"><i>three</i>'
    got = [(r["href"], r["text"], r["pos"]) for r in pages.anchors(page(spark, html)).orderBy("pos").collect()]
    assert got == [("/1", "one", 0), ("/2", "two", 1), ("/3", "three", 2)]
    # Thousands of open tags stay linear.
    assert pages.anchors(page(spark, "<a href=/x>" * 20_000)).count() == 20_000


def test_document_and_source_links(spark):
    anchors = pages.anchors(page(spark, HTML, "<p>none</p>"))
    docs = links.document_links(anchors).orderBy("pos").collect()
    assert [(r["abs_url"], r["pos"], r["text"]) for r in docs] == [
        ("https://h.org/docs/a.pdf?v=1&w=2", 0, "Last text"),
        ("https://h.org/a/download/7", docs[1]["pos"], "Скачать всё"),
    ]
    source = links.source_links(anchors).collect()
    assert [tuple(r) for r in source] == [(0, "https://etp.example.org/ZAKUP/5")]


def test_selected_links_fall_back_per_page(spark):
    anchors = pages.anchors(page(spark, HTML, '<a href="/x">x</a><a href="/y">y</a>'))
    got = sorted((r["page_id"], r["abs_url"]) for r in links.selected_links(anchors).collect())
    assert got == [(0, "https://h.org/a/download/7"), (1, "https://h.org/x"), (1, "https://h.org/y")]


LOG = "page_id long, url string, status int, content_type string, content_disposition string"


def test_outcomes_and_portal_run(spark):
    doc = '<a href="/d%d.pdf">d</a>'
    source = '<a href="https://etp.org/tender/1">s</a>'
    shown = page(spark, doc % 0, doc % 1, "<p>", source, source)
    log = spark.createDataFrame(
        [
            (0, "https://h.org/d0.pdf", 200, "application/pdf", 'attachment; filename="ТЗ.pdf"'),
            (1, "https://h.org/d1.pdf", 403, "application/pdf", None),
            (3, "https://etp.org/files/f.zip", 200, "application/zip", None),
            (4, "https://etp.org/files/g", 200, "text/html", None),
        ],
        LOG,
    )
    rows = [(3, "https://etp.org/tender/1", '<a href="/files/f.zip">f</a>'), (4, "https://etp.org/tender/1", '<a href="/files/g">g</a>')]
    sources = spark.createDataFrame(rows, "page_id long, url string, html string")
    lots = spark.createDataFrame(
        [(i, f"T{i}", f"t{i}", "https://h.org/a/b", None, "c", "1") for i in range(5)],
        "row_number int, tender_id string, title string, url string, deadline_at timestamp_ntz, customer string, customer_inn string",
    )
    out = {r["tender_id"]: r for r in portal.portal_results(lots, shown, log, "шаблон", sources).collect()}
    assert {k: (v["status"], v["confidence_percent"], v["error"]) for k, v in out.items()} == {
        "T0": ("ok", 1, ""),
        "T1": ("blocked", 10, vocab.BLOCKED_ERROR),
        "T2": ("error", 5, vocab.NOTHING_FOUND_ERROR.format(portal=vocab.PORTAL_LABEL)),
        "T3": ("ok", 1, ""),
        "T4": ("error", 0, vocab.SOURCE_EMPTY_ERROR),
    }
    assert out["T0"]["downloaded_files"] == ["ТЗ.pdf"] and out["T3"]["downloaded_files"] == ["f.zip"]
    retargeted = listing.retarget(lots, sources.select(F.concat(F.lit("T"), "page_id").alias("tender_id"), F.col("url").alias("source_url")))
    assert {r["tender_id"]: r["url"] for r in retargeted.collect()} == {"T3": "https://etp.org/tender/1", "T4": "https://etp.org/tender/1"}


def test_repeated_ids_give_one_result(spark):
    pages_ = page(spark, '<a href="/a.pdf">a</a><a href="/b.pdf">b</a>')
    log = [(0, f"https://h.org/{n}.pdf", 200, "application/pdf", f"attachment; filename={n}{k}.pdf", k) for n in "ab" for k in (2, 1)]
    log = spark.createDataFrame(log, "page_id long, url string, status int, content_type string, content_disposition string, attempt int")
    lots = spark.createDataFrame(
        [(0, "T", "first", "u", None, "c", "1"), (0, "T", "second", "u", None, "c", "1")],
        "row_number int, tender_id string, title string, url string, deadline_at timestamp_ntz, customer string, customer_inn string",
    )
    out = portal.portal_results(lots, pages_, log, "шаблон").collect()
    # The last attempt of each link is its file.
    assert [(r["tender_id"], sorted(r["downloaded_files"])) for r in out] == [("T", ["a2.pdf", "b2.pdf"])]


def test_the_portal_has_a_name(spark):
    row = spark.range(1).select(links.outcome(F.lit(0), F.lit(0), F.lit(False), "Cards").alias("o")).first()
    assert "Cards" in row["o"]["error"] and "Cards" in row["o"]["classification_comment"]
