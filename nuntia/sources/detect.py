"""Which source a local file comes from, by its name, and by how it begins where the name doesn't tell."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from nuntia.functions.text import col


def html_source(name: str, head: str) -> str:
    return next((s.upper() for where in (name, head) for s in ("eulisa", "aena") if s in where), "SAGULPA")


def xml_source(name: str, head: str) -> str:
    if "<rss" in head:
        return "BOC"
    return "BOE" if "<response" in head or "<sumario" in head or "boe" in name else "BOC"


def source_of(name: str, head: bytes) -> str:
    """Source of a file by its name and first bytes (2,000 are enough). HTML is told from XML before XML is assumed."""
    name = PurePosixPath(name).name.lower()
    suffix, text = PurePosixPath(name).suffix, head.decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    low = text.lower()
    if suffix == ".pdf" or not suffix and head.startswith(b"%PDF"):
        return "BOP"
    if suffix in (".html", ".htm") or suffix not in (".xml", ".rss") and low.startswith(("<!doctype html", "<html")):
        return html_source(name, low)
    if suffix in (".xml", ".rss") or low.startswith("<"):
        return xml_source(name, text)
    if suffix == ".json" or low.startswith(("{", "[")):
        return "EURES"
    if suffix == ".csv" or "," in low.split("\n")[0] or ";" in low.split("\n")[0]:
        return "EPSO"
    raise ValueError(f"{name}: neither PDF, XML, HTML, CSV nor JSON")


def detect(spark: SparkSession, path: str) -> str:
    """Source of one file, which Spark reads, so any store will do."""
    row = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 2000).alias("head")).first()
    if row is None:
        raise FileNotFoundError(path)
    return source_of(row["path"], bytes(row["head"]))


def source_column(path: Column | str, content: Column | str) -> Column:
    """source_of() as a column, for the files of a folder; null for a file that is of no known kind."""
    name = F.lower(F.element_at(F.split(col(path), "/"), -1))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    head = F.ltrim(F.make_valid_utf8(F.substring(col(content), 1, 2000).cast("string")), F.lit("\ufeff \t\r\n"))
    low = F.lower(head)
    line = F.substring_index(low, "\n", 1)
    html = F.when(name.contains("eulisa"), "EULISA").when(name.contains("aena"), "AENA").when(low.contains("eulisa"), "EULISA").when(low.contains("aena"), "AENA").otherwise("SAGULPA")
    xml = F.when(head.contains("<rss"), "BOC").when(head.contains("<response") | head.contains("<sumario") | name.contains("boe"), "BOE").otherwise("BOC")
    is_xml = suffix.isin(".xml", ".rss")
    return (
        F.when((suffix == ".pdf") | ((suffix == "") & F.startswith(col(content), F.lit(b"%PDF"))), "BOP")
        .when(suffix.isin(".html", ".htm") | (~is_xml & (low.startswith("<!doctype html") | low.startswith("<html"))), html)
        .when(is_xml | low.startswith("<"), xml)
        .when((suffix == ".json") | low.startswith("{") | low.startswith("["), "EURES")
        .when((suffix == ".csv") | line.contains(",") | line.contains(";"), "EPSO")
    )
