"""Printed provincial bulletin: text by page, with section and organism headings that hold until the next one."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.functions.tables import document_rows
from nuntia.functions.text import clean_text, lines, squeezed, strip
from nuntia.operators.windows import sticky
from nuntia.schema import NO_ORGANISM
from nuntia.sources.common import as_pages

# Headings, and the section that is read.
SECTION = r"(?iuU)^\s*([IVXLCDM]+)\.?\s+(ADMINISTRACI[OÓ]N\s+[A-ZÁÉÍÓÚÑ\s]+|DISPOSICIONES|ANUNCIOS)"
ORGANISM = r"(?U)^\s*(?:EXCMO\.|ILUSTRE|M\.I\.|R\.I\.)?\s*(?:AYUNTAMIENTO|CABILDO|CONSORCIO)\s+(?:INSULAR\s+)?(?:DE\s+)?[A-ZÁÉÍÓÚÑ\s\-]{4,}\b"
LOCAL = ("III.", "ADMINISTRACIÓN LOCAL")


def read_pdf_pages(spark: SparkSession, path: str | list[str], extract: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """doc_id, page_number and raw_text of PDF files; extract gives the texts of a file's pages. A file that can't be
    read gives one row with the message in error."""
    return extracted(spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content"), "doc_id", extract)


def extracted(files: DataFrame, name: str, extract: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """name, page_number, raw_text and error of files (name, content)."""
    return document_rows(files.select(name, "content"), "content", extract).drop("content")


def last_match(array: Column, pattern: str) -> Column:
    return F.try_element_at(F.filter(array, lambda x: x.rlike(pattern)), F.lit(-1))


def headed(raw: DataFrame, every: bool = False) -> DataFrame:
    """raw with _head, the section that a page names last, and _line, its last organism; null where it names none. Pages
    without text are left out unless `every`."""
    read = (raw if every else raw.where(F.col("raw_text") != "")).withColumn("_lines", F.transform(lines("raw_text"), strip))
    head = last_match(F.col("_lines"), SECTION)
    name = F.concat(F.upper(F.regexp_extract(head, SECTION, 1)), F.lit(". "), F.upper(F.regexp_extract(head, SECTION, 2)))
    line = last_match(F.filter("_lines", lambda x: ~x.rlike(SECTION)), ORGANISM)
    return read.withColumn("_head", F.when(head.isNotNull(), name)).withColumn("_line", F.when(line.isNotNull(), squeezed(F.regexp_extract(line, ORGANISM, 0))))


def local(strict_section: bool) -> Column:
    """Whether _section is the one that is read."""
    section = F.col("_section")
    return section.contains(LOCAL[1]) | (section.startswith(LOCAL[0]) if strict_section else section.contains(LOCAL[0]))


def is_local(section: str | None) -> bool:
    """The same of a value."""
    return section is not None and (LOCAL[1] in section or LOCAL[0] in section)


def finished(kept: DataFrame) -> DataFrame:
    """Pages of rows with _section and _organism."""
    kept = kept.withColumn("_text", clean_text("raw_text")).where(F.col("_text") != "")
    organism = F.coalesce("_organism", F.lit(NO_ORGANISM))
    return as_pages(kept, "BOP", ordinal=F.col("page_number"), page_number=F.col("page_number"), text=F.col("_text"), section=F.col("_section"), detected_organism=organism)


def pages(raw: DataFrame, strict_section: bool = False) -> DataFrame:
    """Pages of the local section. raw: doc_id, page_number, raw_text.

    A page belongs to the section of the last heading on it or before it; organisms count on kept pages only. Pages
    without text change nothing. strict_section: the numeral must be III itself, not merely end with it.
    """
    order = ["page_number"]
    held = headed(raw).withColumn("_section", F.coalesce(sticky("_head", ["doc_id"], order), F.lit("")))
    return finished(held.where(local(strict_section)).withColumn("_organism", sticky("_line", ["doc_id"], order)))
