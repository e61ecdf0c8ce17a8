"""European agency: vacancies in an HTML page, as table rows and as links in lists."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import count
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.functions.dates import cell_date, first_day_month_year, found, open_on
from nuntia.functions.markup import Node
from nuntia.functions.tables import node_rows
from nuntia.functions.text import strip
from nuntia.operators.windows import numbered
from nuntia.sources.common import as_pages, documents

# The site, links that are no vacancies, links that are, and the agency's name.
SITE = "https://www.eulisa.europa.eu/"
NOISE = "home|login|register|contact|about|privacy"
VACANCY = r"vacancy|vacancies|job|recruitment\.eulisa\.europa\.eu"
AGENCY, PORTAL = "eu-LISA", "Source Portal: eu-LISA Careers"
ITEM = "ordinal int, in_row boolean, title string, href string, cells array<string>, around string, url string"


def _entries(root: Node, site: str = SITE) -> Iterator[tuple]:
    """First links of table rows without header cells, then all links outside of rows. Noise has no url."""
    number = count()
    url = lambda href: None if re.search(NOISE, href.lower()) else urljoin(site, href)
    for row in root.find_all("tr"):
        link = row.find("a")
        if not row.find("th") and link is not None and link.get("href"):
            yield next(number), True, link.text().strip(), link.get("href"), [c.text().strip() for c in row.find_all("td")], None, url(link.get("href"))
    for link in root.find_all("a"):
        if link.get("href") and link.above("tr") is None:
            item = link.above("li")
            yield next(number), False, link.text().strip(), link.get("href"), [], item.text() if item else None, url(link.get("href"))


def entries(docs: DataFrame, site: str = SITE) -> DataFrame:
    """Links of HTML pages (doc_id, text) that may be vacancies, with url, absolute."""
    return node_rows(docs.select("doc_id", "text"), "text", partial(_entries, site=site), ITEM).drop("text").where("url IS NOT NULL")


def read_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return entries(documents(spark, path, "ISO-8859-1"))


def pages(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Pages of vacancies: of all table rows, then of listed links whose url no row of the page has, each url once.

    Rows are put side by side, not joined with themselves, so documents are parsed once.
    """
    vacancy = (F.lower("href").rlike(VACANCY) | F.lower("url").rlike(VACANCY)) & (F.length("title") >= 5)
    iso = F.try_to_date(found("around", r"\d{4}-\d{2}-\d{2}"), "yyyy-MM-dd")
    day = F.when(F.col("around").rlike(r"\d{1,2}/\d{1,2}/\d{4}"), first_day_month_year("around")).otherwise(iso)
    if as_of is not None:
        vacancy = vacancy & open_on(day, as_of)
    kept = rows.where(F.when(F.col("in_row"), F.lit(True) if as_of is None else open_on(cell_date("cells"), as_of)).otherwise(vacancy))
    # all that follows goes by document, so one shuffle serves
    kept = kept.repartition("doc_id").withColumn("_place", numbered(["doc_id", "url"], [F.col("in_row").desc(), "ordinal"])).where("in_row OR _place = 1")
    details = F.coalesce(F.nullif(F.array_join("cells", " | "), F.lit("")), "title")
    around = F.nullif(F.replace(strip("around"), F.lit("\n"), F.lit(" ")), F.lit(""))
    line = F.when(F.col("in_row"), F.concat(F.lit("Reference/Details: "), details)).otherwise(F.concat(F.lit("Details: "), around))
    return as_pages(
        kept, "EULISA", ordinal=F.col("ordinal"), page_number=numbered(["doc_id"], ["ordinal"]), text=F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), line, F.lit(PORTAL)), detected_organism=F.lit(AGENCY), url=F.col("url"),
    )
