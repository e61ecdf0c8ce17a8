"""State bulletin: a nested summary in XML, with PDF files of single notices as an optional second source of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nuntia.functions.text import clean_text, filled, sanitize_ampersands, strip
from nuntia.operators.match import rejects_words
from nuntia.operators.windows import numbered, sticky
from nuntia.sources.common import FAIL, as_pages, computed, documents, kept_if_sound

ITEM = "identificador string, titulo string, url_pdf string, url_html string"
# The section that is read, its label, and the name of a department without one.
BLOCK = r"""(?s)<seccion\b[^>]*\bcodigo\s*=\s*["']2B["'][^>]*>.*?</seccion>"""
LABEL, NO_DEPARTMENT = "II.B. Oposiciones y concursos", "Administración Pública (Desconocido)"
#: A department; within one, an item as a whole or any other tag; the name in a tag.
DEPARTMENT, PART, NAME = r"(?s)<departamento\b[^>]*>.*?</departamento>", r"(?s)<item\b(?:[^>]*[^/>])?>.*?</item>|<[^>]+>", r"""\bnombre\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def named(tag: Column) -> Column:
    """The name in a tag, entities decoded; null if it has none."""
    value = F.concat(F.regexp_extract(tag, NAME, 1), F.regexp_extract(tag, NAME, 2))
    plain = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")), value)
    return F.when(tag.rlike(NAME), plain)


def items_of(departments: DataFrame) -> DataFrame:
    """Items of departments (doc_id, _d, department, _xml) at any depth: doc_id, _d, department, _i, which grows with their order,
    item, and epigraph, that right above the item.

    Tags become rows. A running sum of opened and closed ones is the depth of each, and the tag right above an item is the
    last one opened at its depth; so the work grows in proportion to a department's tags.
    """
    t = F.col("_t")
    rows = departments.select("doc_id", "_d", "department", F.posexplode(F.regexp_extract_all("_xml", F.lit(PART), F.lit(0))).alias("_i", "_t"))
    is_item, closes = t.rlike(r"^<item\b(?:[^>]*[^/>])?>"), t.startswith("</")
    alone = t.endswith("/>") | t.startswith("<!") | t.startswith("<?")
    rows = rows.withColumn("_step", F.when(closes, -1).when(is_item | alone, 0).otherwise(1))
    order = Window.partitionBy("doc_id", "_d").orderBy("_i")
    rows = rows.withColumn("_depth", F.sum("_step").over(order))
    above = sticky(F.when(F.col("_step") == 1, t), ["doc_id", "_d", "_depth"], ["_i"])
    found = rows.withColumn("_above", above).where(is_item)
    epigraph = F.when(F.col("_above").rlike(r"^<epigrafe\b"), F.coalesce(named(F.col("_above")), F.lit(""))).otherwise("")
    return found.select("doc_id", "_d", "department", "_i", epigraph.alias("epigraph"), t.alias("item"))


def candidates(docs: DataFrame, broken: str = FAIL) -> DataFrame:
    """Notices of the first section 2B of each summary (doc_id, text), but for those with a rejected word in the title.

    Items are found below a department at any depth, in the order of the document. Columns: doc_id,
    ordinal, title, ident, pdf_url, url, department, section. Summaries that are no XML raise an error, or give nothing
    with `broken` DROP.
    """
    checked = computed(docs.select("doc_id", "text"), _xml=sanitize_ampersands("text"))
    checked = computed(checked, _check=F.from_xml("_xml", "_corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    checked = kept_if_sound(checked, F.col("_check._corrupt_record").isNull() & F.col("_xml").contains("<"), "_xml", "summary", broken)
    blocks = computed(checked, _block=F.regexp_extract("_xml", BLOCK, 0)).where("_block != ''").select("doc_id", "_block")
    # all that follows goes by document, so one shuffle serves
    blocks = blocks.repartition("doc_id")
    departments = blocks.select("doc_id", F.posexplode(F.regexp_extract_all("_block", F.lit(DEPARTMENT), F.lit(0))).alias("_d", "_xml"))
    head = F.regexp_extract("_xml", r"^<departamento\b[^>]*>", 0)
    items = items_of(departments.select("doc_id", "_d", filled(named(head), F.lit(NO_DEPARTMENT)).alias("department"), "_xml"))
    rows = computed(items, i=F.from_xml("item", ITEM))
    text = lambda name: F.coalesce(strip(f"i.{name}"), F.lit(""))
    rows = computed(rows, title=text("titulo"))
    rows = rows.select(
        "doc_id", "_d", "_i", "department", "title", text("identificador").alias("ident"), text("url_pdf").alias("pdf_url"), filled(text("url_html"), text("url_pdf")).alias("url"),
        F.concat_ws(" -> ", F.lit(LABEL), F.nullif("epigraph", F.lit(""))).alias("section"),
    )
    rows = rows.where((F.col("title") != "") & ~rejects_words("title"))
    return rows.withColumn("ordinal", numbered(["doc_id"], ["_d", "_i"])).drop("_d", "_i")


def read_candidates(spark: SparkSession, path: str | list[str], broken: str = FAIL) -> DataFrame:
    return candidates(documents(spark, path), broken)


def pages(found: DataFrame, pdf_pages: DataFrame | None = None) -> DataFrame:
    """Pages of notices: of their PDF pages (pdf_url, page_number, raw_text) where there are any with text, else of
    their titles; numbered through in each document."""
    tag = F.when(F.col("ident") != "", F.concat(F.lit("["), "ident", F.lit("] "))).otherwise("")
    title = clean_text(F.concat(tag, "title"))
    # numbers first: below the Python function in clean_text the rows are already together by document
    number = numbered(["doc_id"], ["ordinal"] if pdf_pages is None else ["ordinal", "_page"])
    rows = found
    if pdf_pages is None:
        rows = rows.withColumn("_number", number).withColumn("_text", title)
    else:
        texts = pdf_pages.select("pdf_url", F.col("page_number").alias("_page"), clean_text("raw_text").alias("_body"))
        body = F.when(F.col("ident") != "", F.concat(tag, F.lit("(PDF Pag "), F.col("_page").cast("string"), F.lit(") "), "_body")).otherwise(F.col("_body"))
        rows = rows.join(texts, "pdf_url", "left").withColumn("_number", number).withColumn("_text", F.coalesce(F.nullif(body, F.lit("")), title))
    return as_pages(
        rows, "BOE", ordinal=F.col("ordinal"), page_number=F.col("_number"), text=F.col("_text"), section=F.col("section"), detected_organism=F.col("department"), url=F.coalesce("url", F.lit("")),
    )
