"""Airport operator's board: a listing page, detail pages with links to documents, and the documents' text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.functions.dates import day_month_year, open_on
from nuntia.functions.markup import Node, html_rows
from nuntia.functions.text import clean_text, resolve_url
from nuntia.operators.lexicon import Lexicon
from nuntia.operators.match import rejects_title
from nuntia.operators.windows import first_per_key, numbered
from nuntia.sources.common import as_pages, documents

# The site, documents of interest by words in their links, and labels.
SITE = "https://empleo.aena.es/empleo/"
WANTED = "base|requisito"
LABEL, ORGANISM, UNKNOWN_DAY = "Convocatorias Aena", "Aena", "Desconocida"


def _listed(root: Node) -> list[dict]:
    """Title, closing text and detail link of each heading block; the link comes before the end of the block's row."""
    out = []
    for block in root.find_all("div", "th"):
        head = block.find("h3")
        if head is None:
            continue
        closing = href = None
        label = next((s for s in block.find_all("span") if "Fecha fin" in s.text()), None)
        if label is not None and (after := label.following()) and isinstance(after[0], str):
            closing = after[0].strip()
        for node in (n for n in block.following() if isinstance(n, Node)):
            if node.name == "div" and "td3" in node.classes and (link := node.find("a", "botonAvisos")) is not None and "href" in link.attributes:
                href = link.get("href")
                break
            if node.name == "span" and "brkfila" in node.classes:
                break
        out.append({"ordinal": len(out), "title": head.text(strip=True), "closing": closing, "href": href})
    return out


def listings(docs: DataFrame, as_of: Column | None = None, lexicon: Lexicon | None = None, site: str = SITE) -> DataFrame:
    """Open entries of listing pages (doc_id, text) in the schema of listings. Titles are rejected and closed entries
    dropped here, before any detail page is needed; entries with an unreadable date stay, those without a link don't."""
    rows = docs.select("doc_id", F.explode(html_rows(F.col("text"), _listed, "ordinal:int,title:string,closing:string,href:string")).alias("e")).select("doc_id", "e.*")
    rows = rows.where(~rejects_title("title", lexicon)).withColumn("closing_date", day_month_year("closing"))
    rows = rows.where(F.col("href") != "")
    if as_of is not None:
        rows = rows.where(open_on("closing_date", as_of))
    return rows.select("doc_id", "ordinal", "title", resolve_url(F.lit(site), F.col("href")).alias("url"), F.lit(None).cast("date").alias("published"), "closing_date")


def read_listings(spark: SparkSession, path: str | list[str], as_of: Column | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    return listings(documents(spark, path, "ISO-8859-1"), as_of, lexicon)


def _links(root: Node) -> list[dict]:
    return [{"ordinal": i, "href": a.get("href"), "words": f"{a.text(strip=True)} {a.get('title')}".lower()} for i, a in enumerate(root.find_all("a")) if a.get("href")]


def document_links(details: DataFrame) -> DataFrame:
    """Links of detail pages (url, text) to documents of interest, each once, in order: url, ordinal, href."""
    rows = details.select("url", F.explode(html_rows(F.col("text"), _links, "ordinal:int,href:string,words:string")).alias("e")).select("url", "e.*")
    served = F.col("href").contains("documentos?get") | (F.col("href").contains("PFSrv") & F.col("href").contains("docId="))
    return first_per_key(rows.where(served & F.col("words").rlike(WANTED)), ["url", "href"], ["ordinal"]).drop("words")


def pages(found: DataFrame, links: DataFrame | None = None, pdf_pages: DataFrame | None = None) -> DataFrame:
    """Pages of entries. With links (see document_links) and pdf_pages (href, page_number, raw_text): one page per
    document page with text; entries without links are dropped, entries whose documents gave no text fall back to the
    listing. Without them every entry is one page, made of the listing."""
    name = F.concat(F.lit("CONVOCATORIA: "), "title")
    brief = clean_text(F.concat(name, F.lit("\nFecha fin inscripción: "), F.coalesce(F.date_format("closing_date", "dd/MM/yyyy"), F.lit(UNKNOWN_DAY))))
    if links is None:
        rows = found.withColumn("_text", brief)
        number = numbered(["doc_id"], ["ordinal"])
    else:
        texts = pdf_pages.select("href", "page_number", clean_text("raw_text").alias("_body")).where("_body != ''")
        every = found.join(links.select("url", "href", F.col("ordinal").alias("_link")), "url").join(texts, "href", "left")
        full = every.where("_body IS NOT NULL").withColumn("_text", F.concat(name, F.lit("\n\n"), "_body"))
        bare = found.join(links.select("url").distinct(), "url", "left_semi").join(full.select("url"), "url", "left_anti")
        bare = bare.withColumn("_text", brief).withColumn("_link", F.lit(0)).withColumn("page_number", F.lit(1))
        kept = ["doc_id", "ordinal", "url", "_text", "_link", "page_number"]
        rows = full.select(*kept).unionByName(bare.select(*kept))
        number = numbered(["doc_id", "ordinal"], ["_link", "page_number"])
    return as_pages(rows, "AENA", ordinal=F.col("ordinal"), page_number=number, text=F.col("_text"), section=F.lit(LABEL), detected_organism=F.lit(ORGANISM), url=F.col("url"))
