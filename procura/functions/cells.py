"""Typed cells, derived keys and deadline texts as column expressions."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura import vocab
from procura.functions import text, urls

_DATE_TEXT = r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})(?:\s+(\d{1,2}):(\d{1,2}))?$"


def display_value(c: Column) -> Column:
    """Text of a text cell."""
    return text.strip(F.coalesce(c, F.lit("")))


def display_number(c: Column) -> Column:
    """Text of a numeric cell; whole numbers lose their decimal point."""
    whole = c.try_cast("decimal(38,0)").cast("string")
    # Large fractions in plain digits, not in exponent form.
    large = F.rtrim(c.try_cast("decimal(38,10)").cast("string"), F.lit("0"))
    broken = F.when(F.abs(c) >= 1e7, large).otherwise(c.cast("string"))
    shown = F.when(c == F.rint(c), whole).otherwise(broken)
    # Beyond 38 digits the number stays in exponent form.
    return F.coalesce(shown, c.cast("string"), F.lit(""))


def text_datetime(c: Column) -> Column:
    """``d.m.Y`` or ``d.m.y``, with optional ``H:M``; NULL for anything else.

    Two-digit years turn at 69: 00-68 are 20xx, 69-99 are 19xx.
    """
    raw = text.strip(c)
    part = [F.regexp_extract(raw, _DATE_TEXT, i) for i in range(1, 6)]
    number = [F.nullif(p, F.lit("")).cast("int") for p in part]
    day, month, year = number[0], number[1], number[2]
    full_year = F.when(F.length(part[2]) == 4, year).otherwise(
        F.when(year >= 69, year + 1900).otherwise(year + 2000)
    )
    return F.when(
        full_year >= 1,
        F.try_make_timestamp_ntz(
            full_year,
            month,
            day,
            F.coalesce(number[3], F.lit(0)),
            F.coalesce(number[4], F.lit(0)),
            F.lit(0).cast("decimal(16,6)"),
        ),
    )


def serial_datetime(c: Column, date1904: bool = False) -> Column:
    """Spreadsheet serial day to a timestamp; NULL outside years 1-9999.

    The 1900 calendar of spreadsheets has a 29 February 1900, hence the two
    starting days around serial 60.
    """
    x = c.cast("double")
    x = F.when(F.abs(x) < 1e8, x)  # NULL for what no calendar holds, infinity too
    days = x.cast("long")
    millis = F.rint((x - days) * 86_400_000.0)
    seconds = (millis / 1000).cast("decimal(18,6)")

    def from_day(start: str, low: int, high: int) -> Column:
        moment = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(
            F.when((days >= low) & (days <= high), days).cast("int"),
            F.lit(0),
            F.lit(0),
            seconds,
        )
        return moment

    if date1904:
        return F.when(~F.isnan(x), from_day("1904-01-01 00:00:00", -695_055, 2_957_003))
    early = from_day("1899-12-31 00:00:00", -693_594, 59)
    late = from_day("1899-12-30 00:00:00", 60, 2_958_465)
    return F.when(~F.isnan(x), F.when(x < 60, early).otherwise(late))


def derive_tender_id(url: Column, row_number: Column) -> Column:
    """Key from a URL: last all-digit part, else last part with a code in it."""
    parts = F.filter(F.split(urls.path(url), "/"), lambda p: p != "")
    digits = F.filter(parts, lambda p: p.rlike(r"^\p{Nd}+$"))
    coded = F.filter(parts, lambda p: p.rlike("[A-Za-z0-9]{6,}"))
    return F.coalesce(
        F.try_element_at(digits, F.lit(-1)),
        F.try_element_at(coded, F.lit(-1)),
        F.concat(F.lit("row-"), row_number.cast("string")),
    )


def portal_url(
    links: Column,
    host: str = vocab.PORTAL_HOST,
    marker: str = vocab.PORTAL_CARD_MARKER,
) -> Column:
    """First link of the array that is a tender card of the portal, else ``''``."""
    cards = F.filter(
        links,
        lambda link: F.contains(urls.host(link), F.lit(host))
        & F.contains(F.lower(urls.path(link)), F.lit(marker)),
    )
    return F.coalesce(F.try_element_at(cards, F.lit(1)), F.lit(""))


def choose_url(links: Column, cell_link: Column, cell_text: Column) -> Column:
    """Portal card, else the link of the URL cell, else the text of the cell."""
    return F.coalesce(
        F.nullif(portal_url(links), F.lit("")),
        F.nullif(text.strip(cell_link), F.lit("")),
        text.strip(F.coalesce(cell_text, F.lit(""))),
    )


def choose_id(value: Column, url: Column, row_number: Column) -> Column:
    """Listed id, or a derived one where the cell is empty or a placeholder."""
    missing = value.isNull() | (value == "") | F.lower(value).isin(*vocab.PLACEHOLDER_IDS)
    return F.when(missing, derive_tender_id(url, row_number)).otherwise(value)


def sheet_name(deadline: Column) -> Column:
    """Month sheet of a deadline; month names do not depend on the locale."""
    months = F.array(*[F.lit(m) for m in vocab.MONTHS])
    name = F.concat_ws(
        " ", F.element_at(months, F.month(deadline)), F.year(deadline).cast("string")
    )
    return F.when(deadline.isNull(), F.lit(vocab.UNDATED_SHEET)).otherwise(name)


def format_deadline(deadline: Column) -> Column:
    """``d.m.yyyy``, with the time unless it is midnight; ``''`` for NULL."""
    midnight = (F.hour(deadline) == 0) & (F.minute(deadline) == 0)
    return F.coalesce(
        F.when(midnight, F.date_format(deadline, "d.M.yyyy")).otherwise(
            F.date_format(deadline, "d.M.yyyy HH:mm")
        ),
        F.lit(""),
    )


def manifest_deadline(deadline: Column) -> Column:
    return F.coalesce(F.date_format(deadline, "yyyy-MM-dd HH:mm"), F.lit(""))


def option_deadline(deadline: Column) -> Column:
    return F.coalesce(F.date_format(deadline, "dd.MM.yyyy HH:mm"), F.lit(""))


def target_date(value: str, today: date | None = None) -> date:
    """``yesterday`` or an ISO day, as an argument for the deadline filter."""
    if value.strip().lower() == "yesterday":
        return (today or date.today()) - timedelta(days=1)
    return datetime.strptime(value, "%Y-%m-%d").date()
