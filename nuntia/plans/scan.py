"""The whole scan: files of any source in, findings out."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.functions.text import decoded, resolve_url
from nuntia.operators import match, select
from nuntia.operators.classify import validate
from nuntia.operators.joins import union_all
from nuntia.operators.lexicon import Lexicon
from nuntia.operators.stored import stored
from nuntia.schema import FINDINGS, SOURCES
from nuntia.sources import aena, boc, boe, bop, epso, eulisa, eures, sagulpa
from nuntia.sources.common import FAIL
from nuntia.sources.detect import source_column
from nuntia.sources.feed import fetch_each


@dataclass(frozen=True)
class ScanOptions:
    """as_of: day for closing dates and for feeds by day; without it nothing is closed and whole feeds are read.

    fetch (address -> bytes or text) and extract_pdf (bytes -> texts of pages) give details and documents that listings
    link to; without fetch, entries are what their listings say. bulletin_day: the day of regional items, or "latest".
    broken: FAIL raises an error for a document that can't be parsed, DROP leaves it out. failed: gets a table of the
    addresses that couldn't be fetched or read, with their errors; without it a warning counts them. fetch_tasks: how
    many tasks fetch at a time, at most. verdicts: a folder that keeps the classifier's answers, so that no text is asked twice.
    """

    as_of: date | None = None
    sources: tuple[str, ...] = ("ALL",)
    lexicon: Lexicon = Lexicon()
    classify: Callable[[str], list[dict]] | None = None
    prompt: str = "{jobs_json}"
    extract_pdf: Callable[[bytes], list[str]] | None = None
    fetch: Callable[[str], bytes | str | None] | None = None
    bulletin_day: date | str | None = None
    broken: str = FAIL
    failed: Callable[[DataFrame], None] | None = None
    fetch_tasks: int | None = None
    verdicts: str | None = None


def lost(rows: DataFrame, column: str, options: ScanOptions) -> None:
    """Report what couldn't be had: rows of a stored table with an error, by address."""
    failed = rows.where("error IS NOT NULL").select(F.col(column).alias("address"), "error")
    if options.failed is not None:
        options.failed(failed)
    elif n := failed.count():
        warnings.warn(f"{n} documents couldn't be fetched or read, such as {failed.first()['address']}: {failed.first()['error']}", stacklevel=2)


def document_pages(addresses: DataFrame, column: str, options: ScanOptions) -> DataFrame:
    """column, page_number and raw_text of the documents at the addresses in a column; of what can't be had, nothing."""
    read = stored(bop.extracted(fetched(addresses, column, options), column, options.extract_pdf), "extracted")
    lost(read, column, options)
    return read.where("error IS NULL").drop("error")


def fetched(addresses: DataFrame, column: str, options: ScanOptions) -> DataFrame:
    """column and content of each distinct address, fetched once."""
    got = stored(fetch_each(addresses.where(F.col(column) != ""), column, options.fetch, tasks=options.fetch_tasks), "fetched")
    lost(got, column, options)
    return got.where("content IS NOT NULL").drop("error")


def airport_pages(found: DataFrame, options: ScanOptions) -> DataFrame:
    """Pages of the airport board, of the documents that the detail pages link to where there is a fetcher."""
    if options.fetch is None or options.extract_pdf is None:
        return aena.pages(found)
    found = stored(found, "listings")
    details = fetched(found, "url", options).select("url", decoded("content", "ISO-8859-1").alias("text"))
    links = aena.document_links(details).withColumn("_at", resolve_url(F.lit(aena.SITE), F.col("href")))
    texts = document_pages(links, "_at", options).join(links.select("_at", "href").distinct(), "_at")
    # an entry whose detail page can't be had is its listing, like one whose documents give no text
    lost = found.join(details.select("url"), "url", "left_anti")
    return aena.pages(found, links.drop("_at"), texts).unionByName(aena.pages(lost))


#: Sources whose documents are read as Latin-1 if they aren't UTF-8.
LATIN = ("AENA", "EPSO", "EURES", "EULISA")


def pages_of(spark: SparkSession, source: str, path: str | list[str], options: ScanOptions = ScanOptions()) -> DataFrame:
    """Pages of a source's files, in the common schema."""
    return pages_in_files(spark.read.format("binaryFile").load(path), source, options)


def pages_in_files(files: DataFrame, source: str, options: ScanOptions) -> DataFrame:
    """Pages of a source's documents (path, content)."""
    day = F.lit(options.as_of) if options.as_of else None
    docs = files.select(F.col("path").alias("doc_id"), decoded("content", "ISO-8859-1" if source in LATIN else None).alias("text"))
    if source == "BOP":
        if options.extract_pdf is None:
            raise ValueError("reading PDF files needs ScanOptions.extract_pdf")
        return bop.pages(bop.extracted(files.select(F.col("path").alias("doc_id"), "content"), "doc_id", options.extract_pdf))
    if source == "BOC":
        items = boc.items(docs, options.broken)
        if options.bulletin_day == "latest":
            items = boc.of_latest_day(items)
        elif options.bulletin_day:
            items = boc.on_day(items, F.lit(options.bulletin_day))
        return boc.pages(items)
    if source == "BOE":
        found = boe.candidates(docs, options.broken)
        return boe.pages(found, document_pages(found, "pdf_url", options) if options.fetch and options.extract_pdf else None)
    if source == "AENA":
        return airport_pages(aena.listings(docs, day, options.lexicon), options)
    if source == "SAGULPA":
        found = sagulpa.listings(docs, day)
        return sagulpa.pages(found, fetched(found, "url", options).select("url", decoded("content").alias("text")) if options.fetch else None)
    if source == "EPSO":
        return epso.pages(epso.vacancies(docs, options.broken), day)
    if source == "EURES":
        return eures.pages(eures.vacancies(docs, options.broken))
    if source == "EULISA":
        return eulisa.pages(eulisa.entries(docs), day)
    raise ValueError(f"unknown source {source}")


def findings_of(pages: DataFrame, options: ScanOptions) -> DataFrame:
    return match.find(select.only_sources(pages, list(options.sources)), options.lexicon)


def scan_pages(pages: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings in pages of the wanted sources, after the classifier if there is one."""
    return validate(findings_of(pages, options), options.classify, options.prompt, store=options.verdicts)


def scan_each(spark: SparkSession, pages: dict[str, Callable[[], DataFrame | None]], options: ScanOptions, errors: dict[str, str] | None) -> DataFrame:
    """Findings of all sources, each given as a function that makes its pages, or None if it has none.

    With errors, a dict, every source is scanned by itself; one that fails has its message there and no findings, and the
    others go on. Without it the first failure is raised.
    """
    parts = []
    for source, make in pages.items():
        if errors is None:
            if (made := make()) is not None:
                parts.append(findings_of(made, options))
            continue
        try:
            if (made := make()) is not None:
                parts.append(stored(findings_of(made, options), "findings"))
        except Exception as e:  # whatever fails one source must not keep the others from being scanned
            errors[source] = f"{type(e).__name__}: {e}"
    found = union_all(parts) if parts else spark.createDataFrame([], FINDINGS)
    return validate(found, options.classify, options.prompt, store=options.verdicts)


def routed(spark: SparkSession, path: str | list[str], options: ScanOptions = ScanOptions()) -> dict[str, DataFrame]:
    """Files of a folder by the source that each is found to come from: path and content. The folder is read once.

    A file of no known kind raises an error, or is left out with options.broken DROP.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content").withColumn("source", source_column("path", "content"))
    if options.broken == FAIL:
        unknown = F.raise_error(F.concat(F.lit("neither PDF, XML, HTML, CSV nor JSON: "), "path")).cast("string")
        files = files.withColumn("source", F.coalesce("source", unknown))
    files = stored(files.where("source IS NOT NULL"), "files", "source")
    found = [r["source"] for r in files.select("source").distinct().collect()]
    return {s: files.where(F.col("source") == s).drop("source") for s in SOURCES if s in found}


def scan(spark: SparkSession, inputs: dict[str, str | list[str]] | str, options: ScanOptions = ScanOptions(), errors: dict[str, str] | None = None) -> DataFrame:
    """Findings in files: inputs maps sources to paths, or is a file or folder whose files' sources are detected. errors: see
    scan_each."""
    if isinstance(inputs, str):
        make = {s: partial(pages_in_files, files, s, options) for s, files in routed(spark, inputs, options).items()}
    else:
        make = {s: partial(pages_of, spark, s, path, options) for s, path in inputs.items()}
    wanted = [s for s in select.source_names(list(options.sources)) if s in make]
    return scan_each(spark, {s: make[s] for s in wanted}, options, errors)


def status(findings: DataFrame) -> dict[str, int]:
    """Number of findings, and an exit code: 0 if there are any, else 1."""
    n = findings.count()
    return {"findings": n, "exit_code": 0 if n else 1}
