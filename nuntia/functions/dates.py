"""Date functions as columns. What is no date becomes null, and null closing dates mean: keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nuntia.functions.text import col, strip_accents

#: Months by name.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def found(text: Column | str, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def day_month_year(text: Column | str) -> Column:
    """d/m/yyyy as the whole text."""
    return F.try_to_date(col(text), "d/M/yyyy")


def iso(text: Column | str) -> Column:
    """yyyy-mm-dd as the first word."""
    return F.try_to_date(found(text, r"^\s*(\d{4}-\d{2}-\d{2})(?:\s|$)", 1), "yyyy-MM-dd")


def first_day_month_year(text: Column | str) -> Column:
    """The first d/m/yyyy anywhere in a text."""
    return day_month_year(found(text, r"\d{1,2}/\d{1,2}/\d{4}"))


def rfc_date(text: Column | str) -> Column:
    """Calendar day of an RFC 2822 date, in the date's own offset."""
    return F.try_to_date(found(text, r"\b(\d{1,2} [A-Z][a-z]{2} \d{4})\b", 1), "d MMM yyyy")


def spanish_date(text: Column | str) -> Column:
    """The first d/m/yyyy, or else the first `d de <month> de yyyy`."""
    worded = r"(\d{1,2})\s+de\s+(\p{L}+)\s+de\s+(\d{4})"
    number = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, MONTHS)), F.array(*[F.lit(i) for i in range(1, 13)])), F.lower(strip_accents(F.regexp_extract(col(text), worded, 2))))
    numeric = F.when(number.isNotNull(), F.concat_ws("/", F.regexp_extract(col(text), worded, 1), number.cast("string"), F.regexp_extract(col(text), worded, 3)))
    return F.when(col(text).rlike(r"\d{1,2}/\d{1,2}/\d{4}"), first_day_month_year(text)).otherwise(day_month_year(numeric))


def cell_date(cells: Column | str) -> Column:
    """Date of the first cell that has three parts between slashes, date or not."""
    cell = F.get(F.filter(col(cells), lambda c: F.size(F.split(c, "/")) == 3), 0)
    return day_month_year(F.regexp_replace(cell, r"\s", ""))


def open_on(closing: Column | str, as_of: Column) -> Column:
    """Not closed yet on as_of; unknown dates count as open."""
    return col(closing).isNull() | (col(closing) >= as_of)


def bulletin_url(base: str, date: Column) -> Column:
    """base/yyyy/d-m-yy/d-m-yy.pdf, days and months without leading zeros."""
    name = F.format_string("%d-%d-%02d", F.dayofmonth(date), F.month(date), F.year(date) % 100)
    return F.concat_ws("/", F.lit(base.rstrip("/")), F.year(date).cast("string"), name, F.concat(name, F.lit(".pdf")))


def compact_url(base: str, date: Column) -> Column:
    """base followed by yyyymmdd."""
    return F.concat(F.lit(base), F.date_format(date, "yyyyMMdd"))
