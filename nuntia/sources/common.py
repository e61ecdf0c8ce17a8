"""Reading documents as whole texts, and pages in the common schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.functions.text import decoded, strip
from nuntia.schema import PAGES


def documents(spark: SparkSession, path: str | list[str], fallback: str | None = None) -> DataFrame:
    """doc_id (the file's path) and text of each file; `fallback`: the charset for files that aren't UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), decoded("content", fallback).alias("text"))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are made once per row, however often what follows reads them. Spark writes the columns of a projection
    into all filters and projections above, where parsers, Python functions and chains of replacements run again each time; it
    doesn't take a generated row apart."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


#: What to do with documents that can't be parsed: raise an error that names one, or leave them out.
FAIL, DROP = "fail", "drop"


def kept_if_sound(df: DataFrame, is_sound: Column, text: str, what: str, broken: str) -> DataFrame:
    """Rows that parsed. Blank documents hold nothing and are no error; others raise one, unless `broken` is DROP."""
    if broken not in (FAIL, DROP):
        raise ValueError(f"broken is {FAIL!r} or {DROP!r}, not {broken!r}")
    sound = F.coalesce(is_sound, F.lit(False))
    blank = F.coalesce(strip(text) == "", F.lit(True))
    if broken == DROP:
        return df.where(sound & ~blank)
    return df.where(F.when(blank, F.lit(False)).when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"broken {what}: "), "doc_id")).cast("boolean")))


def as_pages(df: DataFrame, source: str, also: list[str] | None = None, **values: Column) -> DataFrame:
    """df in the schema of pages, and the columns in also; what isn't given is an empty string."""
    given = values | {"source": F.lit(source), "doc_id": F.col("doc_id")}
    return df.select(*[given.get(f.name, F.lit("")).cast(f.dataType).alias(f.name) for f in PAGES.fields], *(also or []))
