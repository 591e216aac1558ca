"""The logical inputs of the pipelines, derived from the star-schema tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from procura.operators.batches import release_memory, small_batches
from procura.operators.joins import spread

HEADERS = (
    "Номер",
    "Наименование лота",
    "Ссылка",
    "Дата окончания приема заявок",
    "Заказчик",
    "ИНН Заказчика",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lots(spark: SparkSession, folder: str) -> DataFrame:
    """Lots for matching: one per benchmark item, its whole text as title."""
    dates = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("deadline_at")
    )
    code = F.lpad((F.col("item_id") * 97 + 13).cast("string"), 5, "0")
    return (
        table(spark, folder, "benchmark")
        .join(dates, "item_id", "left")
        .select(
            F.col("item_id").cast("int").alias("row_number"),
            code.alias("tender_id"),
            F.col("text").alias("title"),
            F.concat(F.lit("https://zakupki.example.org/tender/"), code).alias("url"),
            "deadline_at",
            F.regexp_extract("text", "([a-zA-Z]+ [a-zA-Z]+)", 1).alias("customer"),
            F.lpad(F.col("item_id").cast("string"), 10, "7").alias("customer_inn"),
        )
    )


def _file_columns(docs: DataFrame) -> DataFrame:
    """``doc_id, source, name, text_sample``: kinds of names, whole texts.

    Every fiftieth document has an archive beside it, of which there is no text.
    """
    number = F.lpad(F.col("doc_id").cast("string"), 7, "0")
    kind = F.col("doc_id") % 9
    start = (
        F.when(kind == 0, F.lit("Техническое задание_"))
        .when(kind == 1, F.lit("CRM-отчёт "))
        .when(kind == 2, F.lit("Проект договора "))
        .otherwise("doc ")
    )
    ext = F.element_at(
        F.array(*[F.lit(x) for x in (".txt", ".docx", ".PDF", ".md")]),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    own = F.struct(F.concat(start, number, ext).alias("name"), F.col("text").alias("text_sample"))
    packed = F.struct(
        F.concat(F.lit("doc "), number, F.lit(".rar")).alias("name"),
        F.lit("").alias("text_sample"),
    )
    both = F.when(F.col("doc_id") % 50 == 7, F.array(own, packed)).otherwise(F.array(own))
    return docs.select("doc_id", "source", F.inline(both))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Files for matching: one per document, in a folder per source."""
    named = _file_columns(spread(table(spark, folder, "documents")))
    return named.select(
        F.concat(F.lit("/inbox/"), "source", F.lit("/"), "name").alias("path"),
        F.col("source").alias("top_dir"),
        "name",
        "text_sample",
    )


def filed(spark: SparkSession, folder: str) -> DataFrame:
    """The same files, some of them in folders named after a tender id or title."""
    titles = table(spark, folder, "benchmark").select(
        (F.col("item_id") * 11 + 3).alias("doc_id"), F.col("text").alias("lot")
    )
    docs = spread(table(spark, folder, "documents"))
    named = _file_columns(docs).join(titles, "doc_id", "left")
    code = F.lpad((F.col("doc_id") * 97 + 13).cast("string"), 5, "0")
    top = (
        F.when(F.col("doc_id") % 13 == 5, code)
        .when(
            F.col("lot").isNotNull(),
            F.concat(F.lit("Лот "), F.translate("lot", "/ ", "__")),
        )
        .otherwise(F.col("source"))
    )
    return named.withColumn("top_dir", top).select(
        F.concat(F.lit("/inbox/"), "top_dir", F.lit("/"), "name").alias("path"),
        "top_dir",
        "name",
        "text_sample",
    )


def sheet_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A raw listing: one row per order, deadline as text, links as an array."""
    customers = table(spark, folder, "customer")
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey").cast("string")
    link = F.concat(
        F.when(F.col("o_orderkey") % 3 == 0, "https://cards.portal.example.org/ru/tender/").otherwise(
            "https://etp.example.com/lot/"
        ),
        key,
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("o_orderkey") + 2).cast("int").alias("row_number"),
        F.when(F.col("o_orderkey") % 5 == 0, "Источник")
        .when(F.col("o_orderkey") % 5 == 1, "")
        .otherwise(F.concat(F.lit(" L"), key))
        .alias("c0"),
        F.concat_ws(" ", "c_mktsegment", "o_orderpriority", "c_name").alias("c1"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit(" "))
        .otherwise(F.concat(F.lit("https://etp.example.com/card/x"), key))
        .alias("c2"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("c3"),
        F.col("c_name").alias("c4"),
        F.col("c_acctbal").alias("c5"),
        F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("mailto:a@example.com"), link))
        .otherwise(F.array().cast("array<string>"))
        .alias("links"),
    )


def order_lots(spark: SparkSession, folder: str) -> DataFrame:
    """Lots for queues and reports: one per order, with its deadline."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey").cast("string")
    deadline = F.when(
        F.col("o_orderkey") % 19 != 0,
        F.col("o_orderdate")
        + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"), F.lit(0)),
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("int").alias("row_number"),
        key.alias("tender_id"),
        F.concat_ws(" ", "c_mktsegment", F.lit("/"), "o_orderpriority").alias("title"),
        F.concat(F.lit("https://etp.example.com/lot/"), key).alias("url"),
        deadline.alias("deadline_at"),
        F.col("c_name").alias("customer"),
        F.col("o_custkey").cast("string").alias("customer_inn"),
        "o_orderstatus",
        "o_orderpriority",
    )


@F.pandas_udf(BinaryType())
def _zip(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def pack(member: str, text: str) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"docs/{member}.txt", text)
            archive.writestr("readme.md", str(len(text)))
        return buffer.getvalue()

    try:
        for name, body in batches:
            yield pd.Series([pack(n, b) for n, b in zip(name, body)])
    finally:
        release_memory()


@F.pandas_udf(BinaryType())
def _docx(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def pack(text: str) -> bytes:
        nodes = "".join(f"<w:t>{escape(part)}</w:t>" for part in text.split("\n"))
        xml = f'<w:document xmlns:w="urn:w"><w:body>{nodes}</w:body></w:document>'
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            archive.writestr("word/document.xml", xml)
        return buffer.getvalue()

    try:
        for body in batches:
            yield body.map(pack)
    finally:
        release_memory()


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content``: each document packed into a zip archive of its own.

    Every seventh archive is damaged: its bytes are plain text.
    """
    small_batches(spark)
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    content = F.when(F.col("doc_id") % 7 == 6, F.encode("text", "UTF-8")).otherwise(
        _zip(name, F.col("text"))
    )
    return docs.select(
        F.concat(F.lit("/inbox/"), "source", F.lit("/"), name, F.lit(".ZIP")).alias("path"),
        content.alias("content"),
    )


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content``: documents as plain, word-processor and other files."""
    small_batches(spark)
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    plain = docs.filter(F.col("doc_id") % 3 != 1).select(
        F.concat(
            F.lit("/inbox/"),
            F.col("doc_id").cast("string"),
            F.when(F.col("doc_id") % 3 == 0, ".TXT").otherwise(".bin"),
        ).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    docx = docs.filter(F.col("doc_id") % 3 == 1).select(
        F.concat(F.lit("/inbox/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"),
        _docx(F.col("text")).alias("content"),
    )
    return plain.unionByName(docx)
