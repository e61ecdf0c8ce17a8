"""Schemas of the tables that flow between operators."""

from __future__ import annotations

from pyspark.sql import types as T


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


TEXT, INT, DATE, WORDS = T.StringType(), T.IntegerType(), T.DateType(), T.ArrayType(T.StringType(), False)
#: A page, feed item or vacancy. doc_id names the document it comes from, ordinal is its place there.
PAGES = table(doc_id=TEXT, ordinal=INT, page_number=INT, text=TEXT, section=TEXT, detected_organism=TEXT, source=TEXT, url=TEXT)
#: A paragraph that matched, with the lexicon entries that did.
FINDINGS = table(doc_id=TEXT, ordinal=INT, para_no=INT, organism=TEXT, description=TEXT, page_number=INT, matched_keywords=WORDS, source=TEXT, url=TEXT)
#: An entry of a listing page that leads to a detail page.
LISTINGS = table(doc_id=TEXT, ordinal=INT, title=TEXT, url=TEXT, published=DATE, closing_date=DATE)
#: What an external classifier says about a row.
VERDICTS = table(id=INT, is_tech_job=T.BooleanType(), job_title=TEXT, organism=TEXT, confidence=TEXT, reason=TEXT)
#: Order of sources in reports.
SOURCES = ("BOP", "BOC", "BOE", "SAGULPA", "AENA", "EPSO", "EURES", "EULISA")
SOURCE_GROUPS = {"ALL": SOURCES, "ES": SOURCES[:5], "EU": SOURCES[5:]}
#: Organism of a page that names none.
NO_ORGANISM = "Administración Local (Desconocido)"
