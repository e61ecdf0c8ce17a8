"""Regional bulletin: RSS feeds whose descriptions hold escaped HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.functions.dates import rfc_date
from nuntia.functions.text import clean_text, filled, html_unescape, sanitize_ampersands, strip, strip_tags, tag_block, tag_blocks
from nuntia.operators.select import latest
from nuntia.operators.windows import numbered
from nuntia.sources.common import FAIL, as_pages, computed, documents, kept_if_sound

ITEM = "struct<title:string,link:string,description:string,pubDate:string>"
FEED = f"channel struct<item:array<{ITEM}>>, item array<{ITEM}>, _corrupt_record string"


def items(docs: DataFrame, broken: str = FAIL) -> DataFrame:
    """Items of feeds (doc_id, text): doc_id, ordinal, title, link, description, published. Feeds that are no XML raise
    an error, or give nothing with `broken` DROP."""
    feed = F.from_xml(sanitize_ampersands("text"), FEED, {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = computed(docs.select("doc_id", "text"), f=feed)
    parsed = kept_if_sound(parsed, F.col("f").isNotNull() & F.col("f._corrupt_record").isNull() & F.col("text").contains("<"), "text", "feed", broken).select("doc_id", F.coalesce("f.channel.item", "f.item").alias("items"))
    rows = parsed.select("doc_id", F.posexplode("items").alias("ordinal", "i")).select("doc_id", "ordinal", "i.*")
    return rows.select("doc_id", "ordinal", "title", strip("link").alias("link"), "description", rfc_date("pubDate").alias("published"))


def read_items(spark: SparkSession, path: str | list[str], broken: str = FAIL) -> DataFrame:
    return items(documents(spark, path), broken)


def on_day(rows: DataFrame, day: Column) -> DataFrame:
    """Items published on a day, of all feeds, duplicates kept; items without a readable date are left out."""
    return rows.where(F.col("published") == day)


def of_latest_day(rows: DataFrame) -> DataFrame:
    """Items of the latest day in any feed."""
    return latest(rows, "published")


def is_target(section: Column, subsection: Column) -> Column:
    """Whether a place in the hierarchy is read: the first rule whose section fits decides."""
    s, sub = F.lower(section), F.lower(subsection)
    fits = lambda *words: [s.contains(w) for w in words]
    staff, other, notices = fits("ii.", "autoridades", "personal"), fits("iii.", "otras", "resoluciones"), fits("v.", "anuncios")
    decided = F.when(staff[0] & staff[1] & staff[2], sub.contains("oposiciones") | sub.contains("concursos"))
    decided = decided.when(other[0] & other[1] & other[2], F.lit(True))
    return decided.when(notices[0] & notices[1], sub.contains("administracion local") | sub.contains("administración local")).otherwise(F.lit(False))


def pages(rows: DataFrame) -> DataFrame:
    """Pages of items (see items); kept ones are numbered anew in each document."""
    marked = computed(rows.where(F.col("description") != ""), _html=html_unescape("description"))
    path = F.transform(F.split(strip_tags(tag_block("_html", "h5")), " - "), strip)
    marked = computed(marked, _path=path).where("_path IS NOT NULL")
    marked = marked.withColumn("_section", F.get("_path", F.lit(0))).withColumn("_sub", F.coalesce(F.get("_path", F.lit(1)), F.lit("")))
    marked = marked.where(is_target(F.col("_section"), F.col("_sub")))
    marked = computed(marked, _head=strip_tags(tag_block("_html", "h3")))
    title = F.coalesce(filled("_head", "title"), F.lit(""))
    paragraphs = F.filter(F.transform(tag_blocks("_html", "p"), strip_tags), lambda p: (p != "") & ~p.startswith("CVE:"))
    marked = computed(marked, _raw=F.array_join(F.concat(F.array(title), paragraphs), "\n\n"))
    marked = computed(marked, _text=clean_text("_raw")).where(F.col("_text") != "")
    return as_pages(
        marked,
        "BOC",
        ordinal=F.col("ordinal"),
        page_number=numbered(["doc_id"], ["ordinal"]),
        text=F.col("_text"),
        section=F.concat_ws(" -> ", "_section", "_sub"),
        detected_organism=F.element_at("_path", -1),
        url=F.coalesce("link", F.lit("")),
    )
