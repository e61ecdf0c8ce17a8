"""European mobility portal: vacancies in JSON, with other names for the same fields in some versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.functions.markup import html_text
from nuntia.functions.text import strip
from nuntia.sources.common import FAIL, as_pages, documents, kept_if_sound

VACANCY = "struct<vacancyTitle:string,title:string,employerName:string,employer:string,location:string,applyUrl:string,url:string,description:string,shortDescription:string>"
# What stands for missing fields.
NO_TITLE, NO_EMPLOYER, NO_LOCATION, PORTAL = "Job Vacancy", "EURES Employer", "Europe", "https://europa.eu/eures/portal/jv-se/search"


def vacancies(docs: DataFrame, broken: str = FAIL) -> DataFrame:
    """Vacancies of JSON documents (doc_id, text): an object with a list under `vacancies` or `vacancyList`, or a list.
    Documents that are no JSON raise an error, or give nothing with `broken` DROP."""
    docs = kept_if_sound(docs, F.try_parse_json("text").isNotNull(), "text", "vacancies", broken)
    lists = F.from_json("text", f"vacancies array<{VACANCY}>, vacancyList array<{VACANCY}>")
    found = F.coalesce(lists["vacancies"], lists["vacancyList"], F.when(F.ltrim("text").startswith("["), F.from_json("text", f"array<{VACANCY}>")))
    return docs.select("doc_id", F.posexplode(found).alias("ordinal", "v")).select("doc_id", "ordinal", "v.*")


#: Fields that are read, and where lists of vacancies are.
FIELDS, LISTS = re.findall(r"(\w+):string", VACANCY), ("vacancies", "vacancyList")


def variants(docs: DataFrame) -> DataFrame:
    """Vacancies of JSON documents as they are, whatever fields they have: doc_id, ordinal and vacancy, a variant."""
    whole = docs.select("doc_id", F.try_parse_json("text").alias("_v"))
    listed = F.coalesce(*[F.try_variant_get("_v", f"$.{name}", "array<variant>") for name in LISTS], F.try_variant_get("_v", "$", "array<variant>"))
    return whole.select("doc_id", F.posexplode(listed).alias("ordinal", "vacancy"))


def drifted_fields(docs: DataFrame) -> DataFrame:
    """Fields of vacancies that nothing reads, and read ones of another type than text: field, kind, known, vacancies, documents.

    A portal that renames its fields shows up here, where the vacancies themselves only become empty.
    """
    rows = variants(docs).lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("vacancy").outer())).where("key IS NOT NULL")
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^\w+", 0)
    rows = rows.select("doc_id", F.col("key").alias("field"), F.col("key").isin(*FIELDS).alias("known"), kind.alias("kind"))
    odd = rows.where(~F.col("known") | ~F.col("kind").isin("STRING", "VOID"))
    return odd.groupBy("field", "kind", "known").agg(F.count("*").alias("vacancies"), F.count_distinct("doc_id").alias("documents"))


def read_vacancies(spark: SparkSession, path: str | list[str], broken: str = FAIL) -> DataFrame:
    return vacancies(documents(spark, path, "ISO-8859-1"), broken)


def pages(rows: DataFrame) -> DataFrame:
    """Pages of vacancies, numbered by their place. Descriptions with tags are reduced to their text."""
    value = lambda *names: strip(F.coalesce(*names))
    raw = F.coalesce("description", "shortDescription", F.lit(""))
    tagged = raw.contains("<") & raw.contains(">")
    described = strip(F.coalesce(html_text(F.when(tagged, raw)), raw))
    employer = value("employerName", "employer", F.lit(NO_EMPLOYER))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), value("vacancyTitle", "title", F.lit(NO_TITLE))),
        F.concat(F.lit("Employer/Agency: "), employer),
        F.concat(F.lit("Location: "), value("location", F.lit(NO_LOCATION))),
        F.concat(F.lit("Description: "), described),
    )
    number = F.col("ordinal") + 1
    return as_pages(rows, "EURES", ordinal=number, page_number=number, text=text, detected_organism=employer, url=value("applyUrl", "url", F.lit(PORTAL)))
