"""European selection office: a CSV file of vacancies, found through the metadata of an open data portal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.functions.dates import iso, open_on
from nuntia.functions.tables import csv_rows
from nuntia.functions.text import filled, strip
from nuntia.sources.common import FAIL, as_pages, documents

# Words in headers by meaning (the last header that fits counts), and the address without a link.
HEADERS = {"agency": ("institution", "agency"), "location": ("location",), "contract": ("contract",), "deadline": ("deadline",), "url": ("link", "url")}
EXACT = ("title", "grade")
REQUIRED = ("agency", "title", "location", "contract", "grade", "deadline")
PORTAL = "https://epso.europa.eu/en/job-opportunities/open-for-application"


#: The same for one file at a time.
COLUMNS = ",".join([f"{k}~{'|'.join(v)}" for k, v in HEADERS.items() if k == "agency"] + [f"{k}={k}" for k in EXACT] + [f"{k}~{'|'.join(v)}{'' if k in REQUIRED else '?'}" for k, v in HEADERS.items() if k != "agency"])


def meaning(header: str) -> str | None:
    """What a column holds, by its header."""
    name = header.lstrip("\ufeff").strip().lower()
    if any(w in name for w in HEADERS["agency"]):
        return "agency"
    if name in EXACT:
        return name
    return next((k for k, words in HEADERS.items() if any(w in name for w in words)), None)


def resolve(columns: list[str]) -> dict[str, str]:
    """Columns by meaning; a ValueError names the required ones that are missing."""
    found = {m: c for c in columns if (m := meaning(c))}
    if missing := [k for k in REQUIRED if k not in found]:
        raise ValueError(f"the headers {columns} lack {missing}")
    return found


def vacancies(docs: DataFrame, broken: str = FAIL) -> DataFrame:
    """Rows of CSV documents (doc_id, text), each under its own headers: doc_id, row, the row's number in its document, and
    the columns by meaning. Headers that lack a required column raise an error, or the document gives nothing with `broken` DROP."""
    return csv_rows(docs.select("doc_id", "text"), "text", COLUMNS, broken).drop("text")


def read_rows(spark: SparkSession, path: str | list[str], broken: str = FAIL) -> DataFrame:
    """vacancies() of files. Each file that isn't UTF-8 is read as Latin-1, by one task, as values may hold line ends."""
    return vacancies(documents(spark, path, "ISO-8859-1"), broken)


def pages(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Pages of vacancies, numbered by row, so that rows closed on as_of leave gaps. Missing values are empty."""
    names = resolve([c for c in rows.columns if c not in ("doc_id", "row")])
    value = {k: F.coalesce(strip(F.col(f"`{c}`")), F.lit("")) for k, c in names.items()}
    if as_of is not None:
        rows = rows.where(open_on(iso(value["deadline"]), as_of))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Position: "), value["title"]),
        F.concat(F.lit("Institution/Agency: "), value["agency"]),
        F.concat(F.lit("Location: "), value["location"]),
        F.concat(F.lit("Type of Contract: "), value["contract"], F.lit(" ("), value["grade"], F.lit(")")),
        F.concat(F.lit("Deadline for Applications: "), value["deadline"]),
    )
    return as_pages(rows, "EPSO", ordinal=F.col("row"), page_number=F.col("row"), text=text, detected_organism=value["agency"], url=filled(value.get("url", F.lit("")), F.lit(PORTAL)))


def csv_address(metadata: DataFrame, column: str = "json") -> DataFrame:
    """csv_url of each document of dataset metadata: of the first CSV distribution of a linked-data graph, or else of
    a plain list of distributions; null if there is none. Values are plain strings or objects with an id."""
    text = F.col(column)
    value = lambda j: F.coalesce(F.get_json_object(j, "$.@id"), F.get_json_object(j, "$.id"), F.when(~j.startswith("{"), j))
    entries = lambda path: F.from_json(F.get_json_object(text, path), "array<map<string,string>>")
    address = lambda e, keys: F.coalesce(*[value(e[k]) for k in keys])
    csv = lambda c: F.coalesce(F.lower(c).contains("csv"), F.lit(False))
    keys = ("dcat:downloadURL", "dcat:accessURL")
    named = lambda c: F.coalesce(F.lower(c).contains("distribution"), F.lit(False))
    is_distribution = lambda e: named(e["@type"]) | named(e["@id"])
    graph = F.filter(entries("$.@graph"), lambda e: is_distribution(e) & (csv(value(e["dct:format"])) | F.coalesce(F.lower(address(e, keys)).contains(".csv"), F.lit(False))))
    plain = F.filter(entries("$.distributions"), lambda e: csv(value(e["format"])))
    listed = lambda j: F.when(j.startswith("["), F.get(F.from_json(j, "array<string>"), F.lit(0))).otherwise(j)
    first = F.get(F.transform(plain, lambda e: F.coalesce(*[F.nullif(listed(e[k]), F.lit("")) for k in ("download_url", "access_url", "url")])), F.lit(0))
    return metadata.select("*", F.coalesce(F.get(F.transform(graph, lambda e: address(e, keys)), F.lit(0)), first).alias("csv_url"))
