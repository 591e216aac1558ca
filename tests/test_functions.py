from __future__ import annotations

from datetime import date, datetime
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import cells, responses, text, urls
from tests.conftest import one


def check(spark, fn, cases, kind="string"):
    rows = [(i, c[0]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    got = [r[0] for r in df.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]
    assert got == [c[1] for c in cases]


def test_normalize_name(spark):
    check(
        spark,
        text.normalize_name,
        [
            ("  Ёж_Й-Ъ ", "еж и ъ"),
            ("й", "и"),
            (" ТЗ\t", "тз"),
            ("ABC", "abc"),
            ("", ""),
        ],
    )


def test_significant_tokens(spark):
    check(
        spark,
        text.significant_tokens,
        [
            ("Оказание услуг: ремонт РЕМОНТ школы-12", ["ремонт", "ремонт", "школы"]),
            ("для по на и", []),
            ("система1 abc abcd", ["система1", "abcd"]),
            # A listed word with й is spelled with и after normalising: it stays.
            ("информационной", ["информационнои"]),
        ],
    )


def test_suffix_and_name(spark):
    check(
        spark,
        text.suffix,
        [
            ("/a/b.PDF", ".PDF"),
            ("/a/.pdf", ""),
            ("/a/b.", ""),
            ("/x.tar.gz", ".gz"),
            ("/d/f.doc/", ".doc"),
            ("/d.x/f", ""),
            ("..pdf", ".pdf"),
        ],
    )


def test_name_marks(spark):
    check(spark, text.is_generic_name, [("проект договора 2", True), ("смета", True), ("план", False)])
    # The marker with й cannot occur in a normalised name.
    check(spark, text.is_project_name, [("crm план", True), ("сеисмо", False), ("аммиач", True)])
    check(spark, text.keyword_count, [("тз и договор", 2), ("договор договор", 1), ("x", 0)])


def test_dirname_and_filename(spark):
    check(spark, text.safe_dirname, [("а/б-1_2 x", "а_б-1_2_x"), ("", "tender"), ("q" * 150, "q" * 100)])
    rows = [
        ("http://h/a/doc.pdf?x=1", "Текст", "doc.pdf"),
        ("http://h/a/", " Скачать (2) файл ", "Скачать_2_файл.bin"),
        ("http://h/a/get", "План.docx", "План.docx.bin"),
        ("http://h/a/", "", "document"),
        ("http://h/?x/y", "", "y"),
        ("http://h/" + "q" * 200, "", "q" * 180),
        ("http://h/", " _" * 300 + "а" + "_" * 300 + "b" + " " * 300, "а" + "_" * 179),
        ("http://h/", "a^ _[b" + "_ " * 300, "a___b.bin"),
    ]
    got = one(
        spark, "h string, t string, e string", rows,
        y=text.detect_filename(F.col("h"), F.col("t")), e=F.col("e"),
    )
    assert all(y == e for y, e in got), got
    rows = [
        ('attachment; filename="a b.pdf"; x', "a b.pdf"),
        ("attachment; FILENAME=c.zip", "c.zip"),
        ("inline", "f"),
        (None, "f"),
    ]
    got = one(
        spark, "h string, e string", rows,
        y=text.filename_from_header(F.col("h"), F.lit("f")), e=F.col("e"),
    )
    assert all(y == e for y, e in got), got


def test_filename_of_a_long_label(spark):
    """Only as much of a label is read as a name can show."""
    label = str(text.detect_filename(F.lit("http://h/"), F.col("t")))
    assert "{0,180}+" in label
    rows = [("слово " * 200_000, ("слово_" * 30))]
    got = one(spark, "t string, e string", rows, y=text.detect_filename(F.lit("/"), F.col("t")), e=F.col("e"))
    assert all(y == e for y, e in got), got


def cut(value: str, size: int) -> str:
    raw = value.encode()
    if len(raw) <= size:
        return value
    return raw[: size - 3].decode(errors="ignore").rstrip() + "..."


def test_folder_names(spark):
    values = ["я" * 90, "я" * 91, "a" + "я" * 100, "𝄞" * 60, "b " * 100, "q" * 181]
    check(spark, lambda c: text.truncate_utf8(c, 180), [(v, cut(v, 180)) for v in values])
    check(
        spark,
        text.sanitize_folder_name,
        [
            (" a/b. . ", "a／b"),
            ("...", vocab.UNTITLED_FOLDER),
            ("", vocab.UNTITLED_FOLDER),
            ("x\0y", "xy"),
        ],
    )
    check(
        spark,
        lambda c: text.ordinal_prefix(c, F.lit("n")),
        [(7, "007. n"), (1234, "1234. n")],
        "int",
    )


def test_text_datetime(spark):
    check(
        spark,
        cells.text_datetime,
        [
            ("01.02.2024", datetime(2024, 2, 1)),
            ("1.2.2024 9:05", datetime(2024, 2, 1, 9, 5)),
            ("01.02.70", datetime(1970, 2, 1)),
            ("01.02.68", datetime(2068, 2, 1)),
            ("01.02.69 23:59", datetime(1969, 2, 1, 23, 59)),
            (" 01.02.2024  ", datetime(2024, 2, 1)),
            ("31.02.2024", None),
            ("01.02.2024 24:00", None),
            ("01.02.0000", None),
            ("01.02.024", None),
            ("x", None),
            ("", None),
        ],
    )


def test_serial_datetime(spark):
    check(
        spark,
        cells.serial_datetime,
        [
            (45323.0, datetime(2024, 2, 1)),
            (45323.5, datetime(2024, 2, 1, 12)),
            (1.0, datetime(1900, 1, 1)),
            (59.0, datetime(1900, 2, 28)),
            (61.0, datetime(1900, 3, 1)),
            (45323.999988426, datetime(2024, 2, 1, 23, 59, 59)),
            (2958465.0, datetime(9999, 12, 31)),
            (2958466.0, None),
            (float("nan"), None),
        ],
        "double",
    )
    check(
        spark,
        lambda c: cells.serial_datetime(c, date1904=True),
        [(0.0, datetime(1904, 1, 1)), (43861.25, datetime(2024, 2, 1, 6))],
        "double",
    )


def test_display(spark):
    check(spark, cells.display_value, [(" a ", "a"), (None, "")])
    check(
        spark,
        cells.display_number,
        [(7707083893.0, "7707083893"), (1.5, "1.5"), (12345678.25, "12345678.25"), (-2.0, "-2"), (None, "")],
        "double",
    )


def test_ids_and_urls(spark):
    check(
        spark,
        lambda c: cells.derive_tender_id(c, F.lit(5)),
        [
            ("https://h/a/123/view", "123"),
            ("https://h/12/34?x=99", "34"),
            ("https://h/lot-abc123/x", "lot-abc123"),
            ("https://h/ab/c", "row-5"),
            ("no url", "row-5"),
            ("https://h/77;p=1", "77"),
        ],
    )
    rows = [
        (["mailto:x@y", "https://CARDS.portal.example.org/ru/Tender/1"], "https://cell", "t", "https://CARDS.portal.example.org/ru/Tender/1"),
        (["https://cards.portal.example.org/ru/news/1"], " https://cell ", "t", "https://cell"),
        ([], "", " t ", "t"),
        ([], "", None, ""),
    ]
    got = one(
        spark, "l array<string>, c string, t string, e string", rows,
        y=cells.choose_url(F.col("l"), F.col("c"), F.col("t")), e=F.col("e"),
    )
    assert all(y == e for y, e in got), got
    rows = [("Источник", "7"), ("SOURCE", "7"), ("", "7"), ("A-1", "A-1")]
    got = one(
        spark, "v string, e string", rows,
        y=cells.choose_id(F.col("v"), F.lit("https://h/7"), F.lit(1)), e=F.col("e"),
    )
    assert all(y == e for y, e in got), got


def test_deadline_texts(spark):
    d = datetime(2024, 2, 1, 9, 5)
    midnight = datetime(2024, 12, 31)
    check(spark, cells.sheet_name, [(d, "Февраль 2024"), (midnight, "Декабрь 2024"), (None, "Без даты")], "timestamp_ntz")
    check(
        spark,
        cells.format_deadline,
        [(d, "1.2.2024 09:05"), (midnight, "31.12.2024"), (datetime(2024, 1, 1, 0, 0, 9), "1.1.2024"), (None, "")],
        "timestamp_ntz",
    )
    check(spark, cells.manifest_deadline, [(d, "2024-02-01 09:05"), (None, "")], "timestamp_ntz")
    check(spark, cells.option_deadline, [(d, "01.02.2024 09:05"), (None, "")], "timestamp_ntz")


def test_target_date():
    assert cells.target_date(" Yesterday ", date(2024, 3, 1)) == date(2024, 2, 29)
    assert cells.target_date("2026-03-11") == date(2026, 3, 11)
    with pytest.raises(ValueError):
        cells.target_date("11.03.2026")


BASES = ["https://m.e.net/en/25?q=1#top", "https://m.e.net", "http://h/a/b/", "http://u@h:8080/x;p?q"]
REFS = [
    "/The", "b.pdf", "?x=1", "#f", "//cdn.x/y", "../up", "./s", "../../../z", "a/../b/./c", "..", ".",
    "/a/../b", "/..", "/../x", "http://o.org/p/../q", "HTTPS://o.org", "mailto:a@b.c", "javascript:f()",
    "tel:1", "a//b", "/a//b", "", "x?y#z", "g;x=1/../y", "  /pad ", "new\nline", "ftp://h/x", "я/б", "a b.doc",
]


def test_resolve_equals_standard_library(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    got = one(
        spark, "b string, r string", rows,
        y=urls.resolve(F.col("b"), F.col("r")), b=F.col("b"), r=F.col("r"),
    )
    # Pages hand over trimmed attribute values, hence the strip.
    wrong = [(b, r, y, urljoin(b, r.strip())) for y, b, r in got if y != urljoin(b, r.strip())]
    assert not wrong


def test_link_predicates(spark):
    rows = [
        ("https://h/a.PDF", "", True),
        ("https://h/a.pdf?x=1", "", True),
        ("https://h/page", "Скачать", True),
        ("https://h/download/1", "", True),
        ("https://h/page", "text", False),
        ("ftp://h/a.pdf", "", False),
        ("https://h#file", "", False),
        ("https://h/x#file", "", True),
    ]
    got = one(
        spark, "h string, t string, e boolean", rows,
        y=urls.is_document_link(F.col("h"), F.col("t")), e=F.col("e"),
    )
    assert all(y == e for y, e in got), got
    check(spark, urls.is_ignored_host, [("https://T.me/x", True), ("https://bit.media.org", True), ("https://h/t.me", False)])
    check(spark, urls.is_source_host, [("https://cards.portal.example.org/x", False), ("https://a.service.portal.example.org", False), ("https://h/x", True), ("mailto:x", False)])
    rows = [("text/HTML; x", "a", True), ("text/html", "a.pdf", False), ("application/pdf", "a", False), (None, "a", False)]
    got = one(
        spark, "c string, f string, e boolean", rows,
        y=urls.is_html_response(F.col("c"), F.col("f")), e=F.col("e"),
    )
    assert all(y == e for y, e in got), got


def body(confidence: str) -> str:
    return '{"classification_tag": "В работу", "confidence_percent": %s}' % confidence


@pytest.mark.parametrize(
    "confidence, value",
    [
        ('"85"', 85), ("85.7", 85), ("-3", 0), ('" 140 "', 100), ("true", 1), ("false", 0),
        ('"+7"', 7), ('"1_0"', 10), ("1e2", 100), ("null", None), ('"85%"', None),
        ('"85.7"', None), ("[]", None), ("{}", None), ('""', None),
    ],
)
def test_confidence(spark, confidence, value):
    rows = spark.createDataFrame([(body(confidence), None)], "response string, error string")
    p = responses.classify(rows).first()["payload"]
    if value is None:
        assert (p.classification_tag, p.confidence_percent) == (vocab.DEFAULT_TAG, 0)
        assert p.classification_comment == vocab.NOT_JSON_COMMENT
        assert p.analysis_markdown == body(confidence)
    else:
        assert (p.classification_tag, p.confidence_percent) == ("В работу", value)
        assert p.classification_comment == vocab.NO_COMMENT


def test_classify_shapes(spark):
    rows = [
        ("{}", None), ("[1]", None), (" plain ", None), ('"text"', None), (None, "boom"),
        ('{"classification_tag": " Подано ", "classification_comment": null, "analysis_markdown": " x "}', None),
    ]
    df = spark.createDataFrame(rows, "response string, error string")
    got = [tuple(r["payload"]) for r in responses.classify(df.coalesce(1)).collect()]
    default = vocab.DEFAULT_TAG
    assert got == [
        (default, 0, vocab.NO_COMMENT, "{}"),
        (default, 0, vocab.NOT_JSON_COMMENT, "[1]"),
        (default, 0, vocab.NOT_JSON_COMMENT, "plain"),
        (default, 0, vocab.NOT_JSON_COMMENT, '"text"'),
        (default, 0, vocab.PROVIDER_ERROR_PREFIX + "boom", "boom"),
        ("Подано", 0, vocab.NO_COMMENT, "x"),
    ]


def test_match_answers(spark):
    rows = [
        ('{"tender_id": " 5 ", "confidence": 80}', True, "5", 80.0),
        ('{"tender_id": 5, "confidence": null}', True, "5", 0.0),
        ('{"tender_id": "5", "confidence": ""}', True, "5", 0.0),
        ('{"tender_id": "5", "confidence": "high"}', False, "5", None),
        ("{}", True, "", 0.0),
        ("[]", False, "", 0.0),
        ("none", False, "", None),
    ]
    df = spark.createDataFrame([(r[0], None) for r in rows], "response string, error string")
    got = [(r["response"], r["valid"], r["chosen"], r["confidence"]) for r in responses.parse_matches(df.coalesce(1)).collect()]
    assert [g[:2] for g in got] == [r[:2] for r in rows]
    assert [g[2:] for g in got if g[1]] == [r[2:] for r in rows if r[1]]


def test_numbers_and_serials_without_limits(spark):
    from procura.functions import cells

    got = one(
        spark, "x double", [(4.07028109e19,), (1e30,), (1e300,), (float("inf"),), (float("nan"),), (None,), (1.5e7,), (12345678.5,)],
        shown=cells.display_number(F.col("x")), day=cells.serial_datetime(F.col("x")), old=cells.serial_datetime(F.col("x"), date1904=True),
    )
    assert [r[0] for r in got] == ["40702810900000000000", "1" + "0" * 30, "1.0E300", "Infinity", "NaN", "", "15000000", "12345678.5"]
    assert all(r[1:] == (None, None) for r in got)


def test_repeated_keys_of_an_answer_count_as_unreadable(spark):
    from procura.functions import responses

    df = spark.createDataFrame([('{"confidence_percent": 1, "confidence_percent": 2}', None)], "response string, error string")
    assert responses.classify(df).first()["payload"]["classification_comment"] == vocab.NOT_JSON_COMMENT


def test_checkpoints_need_a_shared_folder():
    from procura.operators import joins

    class Context:
        master, applicationId = "spark://host", "app"
        _jsc = type("J", (), {"hadoopConfiguration": lambda self: {"fs.defaultFS": "file:///"}})()
        getCheckpointDir = staticmethod(lambda: None)

    session = type("S", (), {"sparkContext": Context, "conf": {}})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        joins.checkpoint_folder(session)
    Context.master = "local[2]"
    assert joins.checkpoint_folder(session) == "file:///tmp/checkpoints/app"
    session.conf["spark.checkpoint.dir"] = "hdfs://x/y"
    assert joins.checkpoint_folder(session) == "hdfs://x/y"
