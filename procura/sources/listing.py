"""Tender listings: column binding, typed cells, derived keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import cells
from procura.operators.joins import lookup_join

LOT_COLUMNS = (
    "row_number",
    "tender_id",
    "title",
    "url",
    "deadline_at",
    "customer",
    "customer_inn",
    "raw",
    "hyperlinks",
)


def header_index(headers: Sequence[str | None]) -> dict[str, int]:
    """Stripped header -> column position; blanks dropped, the last repeat wins."""
    return {h.strip(): i for i, h in enumerate(headers) if h and h.strip()}


def find_column(
    index: dict[str, int], preferred: str, aliases: Sequence[str]
) -> int | None:
    """Position of the preferred header, else of the first alias present.

    A miss is an error only when a preferred name was asked for.
    """
    for name in (preferred, *aliases):
        if name in index:
            return index[name]
    if preferred:
        raise ValueError(
            f"no column {preferred!r}; columns present: {', '.join(index)}"
        )
    return None


def _cell_text(name: str, dtype: str) -> Column:
    c = F.col(f"`{name}`")
    if dtype in ("double", "float"):
        return cells.display_number(c)
    return cells.display_value(c.cast("string"))


def _cell_datetime(name: str, dtype: str, date1904: bool) -> Column:
    c = F.col(f"`{name}`")
    if dtype in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp_ntz")
    if dtype == "string":
        return cells.text_datetime(c)
    return cells.serial_datetime(c, date1904)


def lots_from_rows(
    rows: DataFrame,
    headers: Sequence[str | None],
    cell_columns: Sequence[str],
    url_column: str = "Ссылка",
    id_column: str = "Номер",
    title_column: str = "Наименование",
    row_number: str = "row_number",
    hyperlinks: str | None = None,
    url_link: str | None = None,
    date1904: bool = False,
) -> DataFrame:
    """Lots from headerless rows.

    ``cell_columns[i]`` holds the cells under ``headers[i]``. Binding happens on
    the header list alone, so it costs no pass over the data. ``hyperlinks`` names
    an array column with the links of the row, ``url_link`` the link of the URL
    cell. Rows without a URL are dropped.
    """
    index = header_index(headers)
    dtypes = dict(rows.dtypes)
    url_at = find_column(index, url_column, vocab.URL_COLUMNS)
    id_at = find_column(index, id_column, vocab.ID_COLUMNS)
    title_at = find_column(index, title_column, vocab.TITLE_COLUMNS)
    deadline_at = find_column(index, "", vocab.DEADLINE_COLUMNS)
    customer_at = find_column(index, "", vocab.CUSTOMER_COLUMNS)
    inn_at = find_column(index, "", vocab.CUSTOMER_INN_COLUMNS)

    def shown(at: int | None) -> Column:
        if at is None:
            return F.lit("")
        return _cell_text(cell_columns[at], dtypes[cell_columns[at]])

    no_links = F.array().cast("array<string>")
    links = F.coalesce(F.col(hyperlinks), no_links) if hyperlinks else no_links
    cell_link = F.coalesce(F.col(url_link), F.lit("")) if url_link else F.lit("")
    number = F.col(row_number).cast("int")
    url = cells.choose_url(links, cell_link, shown(url_at))
    deadline = (
        F.lit(None).cast("timestamp_ntz")
        if deadline_at is None
        else _cell_datetime(
            cell_columns[deadline_at], dtypes[cell_columns[deadline_at]], date1904
        )
    )
    # Only the winning column of a repeated header enters the map.
    raw = F.create_map(
        *[
            part
            for name, at in index.items()
            for part in (
                F.lit(name),
                F.coalesce(F.col(f"`{cell_columns[at]}`").cast("string"), F.lit("")),
            )
        ]
    )
    return (
        rows.withColumn("_url", url)
        .filter(F.col("_url") != "")
        .select(
            number.alias("row_number"),
            cells.choose_id(shown(id_at), F.col("_url"), number).alias("tender_id"),
            shown(title_at).alias("title"),
            F.col("_url").alias("url"),
            deadline.alias("deadline_at"),
            shown(customer_at).alias("customer"),
            shown(inn_at).alias("customer_inn"),
            raw.alias("raw"),
            links.alias("hyperlinks"),
        )
    )


def read_listing(
    spark: SparkSession,
    path: str,
    headers: Sequence[str],
    row_number_column: int = 0,
    multi_line: bool = True,
    strict: bool = True,
    **options: object,
) -> DataFrame:
    """Lots from headerless CSV exports.

    A file split has no stable line number, so the export carries the sheet row
    number itself, in column ``row_number_column``; ``headers`` names all columns.
    Quoted cells may hold line breaks, so a file is one task; ``multi_line=False`` lets
    large files without such cells be split. A row without a number stops the job, as
    nothing may be lost in silence; with ``strict=False`` it stays, unnumbered.
    """
    names = [f"_c{i}" for i in range(len(headers))]
    schema = ", ".join(f"{n} STRING" for n in names)
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("escape", '"')
    number = F.trim(F.col(names[row_number_column])).try_cast("int")
    if strict:
        shown = F.concat_ws(" | ", *names)
        problem = F.raise_error(F.concat(F.lit("listing row without a number: "), shown))
        number = F.coalesce(number, problem.cast("int"))
    rows = reader.csv(path).withColumn("_row", number)
    bound = [None if i == row_number_column else h for i, h in enumerate(headers)]
    return lots_from_rows(
        rows, bound, names, row_number="_row", **options
    )


def due_on(lots: DataFrame, day: object) -> DataFrame:
    """Lots whose deadline lies on ``day``; a range, so partitions are pruned."""
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    end = F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")
    return lots.filter((F.col("deadline_at") >= start) & (F.col("deadline_at") < end))


# Days that are listed in a filter; a table of more is joined.
LISTED_DAYS = 5000


def store_by_due(lots: DataFrame, path: str) -> None:
    """Store a listing by due month, rows by due day within; lots without a deadline last.

    Ranges of day and row number make the files, so a hot day is written by many tasks and
    the statistics of a file span few days.
    """
    day = F.col("deadline_at").cast("date")
    keys = ["due_month", "due_day", "row_number"]
    rows = lots.withColumns({"due_day": day, "due_month": F.year(day) * 100 + F.month(day)})
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("due_month").parquet(path)


def stored_due(spark: SparkSession, path: str, days: DataFrame) -> DataFrame:
    """Lots of a listing stored by ``store_by_due`` that are due on one of ``days`` (``day``).

    The days are looked up first: only folders of their months are read, and of those only
    row groups that may hold one of the days.
    """
    day = F.col("day").cast("date")
    wanted = days.select(day.alias("due_day"), (F.year(day) * 100 + F.month(day)).alias("due_month"))
    wanted = wanted.filter("due_day IS NOT NULL").distinct()
    stored = spark.read.parquet(path)
    few = wanted.limit(LISTED_DAYS + 1).collect()
    if len(few) > LISTED_DAYS:
        found = lookup_join(stored, wanted, ["due_month", "due_day"])
    else:
        months = sorted({r["due_month"] for r in few})
        listed = sorted({r["due_day"] for r in few})
        found = stored.filter(F.col("due_month").isin(months) & F.col("due_day").isin(listed))
    return found.drop("due_month", "due_day")


def retarget(lots: DataFrame, sources: DataFrame) -> DataFrame:
    """Same lots with ``url`` replaced by the source page found for them.

    ``sources`` has one row per tender: ``tender_id, source_url``.
    """
    return (
        lots.join(sources, "tender_id")
        .withColumn("url", F.col("source_url"))
        .select(*lots.columns)
    )


def one_per_id(lots: DataFrame) -> DataFrame:
    """One row per tender id: the one with the lowest row number."""
    first = Window.partitionBy("tender_id").orderBy("row_number")
    return (
        lots.withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") == 1)
        .drop("_rn")
    )

