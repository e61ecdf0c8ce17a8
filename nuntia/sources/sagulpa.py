"""Municipal company's board: a listing page and detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.functions.dates import open_on, spanish_date
from nuntia.functions.markup import Node, html_rows
from nuntia.functions.text import clean_text, resolve_url, squeezed
from nuntia.operators.windows import numbered
from nuntia.sources.common import as_pages, computed, documents

# The site, titles of closed processes, labels of dates, and names.
SITE = "https://www.sagulpa.com/"
CLOSED = "cerrado|suspendido|parado|cerrar"
PUBLISHED = r"(?iu)Fecha de publicación:\s*(\d{2}/\d{2}/\d{4})"
CLOSING = r"(?iu)Fecha finalizaci[oó]n de presentaci[oó]n de candidaturas:\s*(.*)"
LABEL, ORGANISM, DETAIL = "Ofertas de Empleo", "SAGULPA", "margen_menu_lateral_columna"


def _listed(root: Node) -> list[dict]:
    """Entries with a heading in lists of the board, with their text and links."""
    out = []
    for block in root.find_all("ul", "fa-ul"):
        for item in block.find_all("li"):
            if (head := item.find("h2")) is not None:
                out.append({"ordinal": len(out), "title": head.text(strip=True), "around": item.text(), "hrefs": [a.get("href") for a in item.find_all("a")]})
    return out


def listings(docs: DataFrame, as_of: Column | None = None, only_open: bool = True, site: str = SITE) -> DataFrame:
    """Active entries of listing pages (doc_id, text) in the schema of listings.

    The link is the first into the board's folder, or else the first that isn't a script or the privacy notice; an
    entry without a publication date counts as published on as_of. only_open: without entries closed on as_of.
    Without as_of nothing is closed, and unknown publication dates stay unknown.
    """
    # outer, as for the plain form Spark takes every list apart a second time
    rows = docs.select("doc_id", F.inline_outer(html_rows(F.col("text"), _listed, "ordinal:int,title:string,around:string,hrefs:array<string>")))
    rows = rows.where(~F.lower("title").rlike(CLOSED))
    inside = F.filter("hrefs", lambda h: h.contains("/ofertas-empleo/"))
    other = F.filter("hrefs", lambda h: (h != "") & ~h.startswith("javascript:") & ~h.contains("politica-privacidad"))
    rows = rows.withColumn("href", F.coalesce(F.get(inside, F.lit(0)), F.get(other, F.lit(0))))
    published = F.try_to_date(F.nullif(F.regexp_extract("around", PUBLISHED, 1), F.lit("")), "dd/MM/yyyy")
    rows = computed(rows, _closing=F.nullif(F.regexp_extract(squeezed("around"), CLOSING, 1), F.lit("")))
    rows = computed(rows, url=F.coalesce(resolve_url(F.lit(site), F.col("href")), F.lit("")), published=published if as_of is None else F.coalesce(published, as_of), closing_date=spanish_date("_closing"))
    rows = rows.select("doc_id", "ordinal", "title", "url", "published", "closing_date")
    return rows.where(open_on("closing_date", as_of)) if only_open and as_of is not None else rows


def read_listings(spark: SparkSession, path: str | list[str], as_of: Column | None = None) -> DataFrame:
    return listings(documents(spark, path), as_of)


def _described(root: Node) -> list[dict]:
    place = next((n for n in root.walk() if DETAIL in n.classes), None) or root.find("body") or root
    return [{"text": place.text("\n")}]


def detail_text(html: Column) -> Column:
    """Description in a detail page: of its main column, or else of the whole page."""
    return F.get(html_rows(html, _described, "text:string"), F.lit(0))["text"]


def pages(found: DataFrame, details: DataFrame | None = None, also: list[str] | None = None) -> DataFrame:
    """Pages of entries, and the columns of found in also: the listing, and below it the description where details (url, text) has
    the entry's page."""
    brief = F.concat("title", F.lit("\nFecha de publicación: "), F.coalesce(F.date_format("published", "dd/MM/yyyy"), F.lit("")))
    if details is None:
        rows = found.withColumn("_text", clean_text(brief))
    else:
        texts = computed(details, _detail=detail_text(F.col("text"))).select("url", clean_text("_detail").alias("_body"))
        rows = found.join(texts, "url", "left").withColumn("_text", F.when(F.col("_body").isNull(), clean_text(brief)).otherwise(F.concat(brief, F.lit("\n\n"), "_body")))
    return as_pages(rows, "SAGULPA", also, ordinal=F.col("ordinal"), page_number=numbered(["doc_id"], ["ordinal"]), text=F.col("_text"), section=F.lit(LABEL), detected_organism=F.lit(ORGANISM), url=F.col("url"))
