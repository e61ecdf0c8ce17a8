"""Table functions: one document in, rows out. They are joined laterally, in DataFrames and in SQL.

Rows are yielded one after the other, so a long document is no array in one cell. What a function returns may follow from
its arguments: they are analysed before the query is planned, and must be constants there.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from nuntia.functions.markup import Node, parsed


class CsvRows:
    """Rows of a CSV text under the headers of that text: (text, columns, broken) -> row, the columns, as strings.

    columns says what is wanted, comma-separated: `name=header` for a header as it is, `name~word|word` for one that holds
    one of the words, with a question mark after it where the header may be missing. White space and case of headers
    don't count. A header has the first meaning that fits it, and of several headers with one meaning the last counts. Rows are
    numbered from 1, blank lines left out; missing values are empty. A text without a header that is needed raises an error,
    or gives no rows if broken is 'drop'. Null and blank texts give none.
    """

    @staticmethod
    def parsed(columns: str) -> list[tuple[str, str, list[str], bool]]:
        """name, = or ~, words, and whether the column must be there."""
        out = []
        for part in columns.split(","):
            spec, optional = part.strip().removesuffix("?"), part.strip().endswith("?")
            at = min(i for i in (spec.find("="), spec.find("~")) if i >= 0)
            out.append((spec[:at].strip(), spec[at], [w.strip().lower() for w in spec[at + 1 :].split("|")], not optional))
        return out

    @staticmethod
    def analyze(text: AnalyzeArgument, columns: AnalyzeArgument, broken: AnalyzeArgument) -> AnalyzeResult:
        names = [name for name, *_ in CsvRows.parsed(columns.value)]
        return AnalyzeResult(T.StructType([T.StructField("row", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in names]]))

    @staticmethod
    def places(headers: list[str], columns: str) -> list[int | None]:
        """Where each wanted column is, from its header."""
        wanted, found = CsvRows.parsed(columns), {}
        for i, header in enumerate(headers):
            own = header.lstrip("﻿").strip().lower()
            name = next((n for n, how, words, _ in wanted if (own in words if how == "=" else any(w in own for w in words))), None)
            if name:
                found[name] = i
        if missing := [n for n, _, _, needed in wanted if needed and n not in found]:
            raise ValueError(f"the headers {headers} lack {missing}")
        return [found.get(n) for n, *_ in wanted]

    def eval(self, text: str, columns: str, broken: str) -> Iterator[tuple]:
        csv.field_size_limit(1 << 30)
        rows = csv.reader(io.StringIO((text or "").lstrip("﻿").strip(), newline=""))
        try:
            places = self.places(next(rows), columns)
        except StopIteration:
            return
        except ValueError:
            if broken == "drop":
                return
            raise
        number = 0
        for row in rows:
            if row:
                number += 1
                yield (number, *[row[i] if i is not None and i < len(row) else "" for i in places])


def csv_rows(docs: DataFrame, text: str, columns: str, broken: str = "fail") -> DataFrame:
    """docs with the rows of the CSV text in a column."""
    return docs.lateralJoin(udtf(CsvRows)(F.col(text).outer(), F.lit(columns), F.lit(broken)))


def node_rows(docs: DataFrame, text: str, extract: Callable[[Node], Iterator[tuple]], schema: str) -> DataFrame:
    """docs with the rows that extract yields for the HTML tree of each; null texts give none."""

    class Rows:
        def eval(self, text: str) -> Iterator[tuple]:
            if text is not None:
                with parsed(text) as root:
                    yield from extract(root)

    return docs.lateralJoin(udtf(Rows, returnType=schema)(F.col(text).outer()))


def document_rows(files: DataFrame, content: str, extract: Callable[[bytes], Iterator[str]]) -> DataFrame:
    """files with page_number, raw_text and error: a row for each text that extract yields from a file. A file that fails
    has the pages up to there, and a row with the message in error."""

    class Pages:
        def eval(self, content: bytes) -> Iterator[tuple]:
            number = 0
            try:
                for text in extract(bytes(content)):
                    number += 1
                    yield number, text, None
            except Exception as e:  # one file's failure must not stop the others; it is reported in its row
                yield number + 1, None, f"{type(e).__name__}: {e}"

    return files.lateralJoin(udtf(Pages, returnType="page_number int, raw_text string, error string")(F.col(content).outer()))


def register_tables(spark: SparkSession, extract_pdf: Callable[[bytes], Iterator[str]] | None = None) -> list[str]:
    """Register csv_rows, html_links and, with an extractor, pdf_pages for SQL, to be used in LATERAL; returns their names."""

    class Links:
        def eval(self, text: str) -> Iterator[tuple]:
            with parsed(text or "") as root:
                for i, link in enumerate(root.find_all("a")):
                    yield i, link.get("href"), link.text().strip()

    found = {"csv_rows": udtf(CsvRows), "html_links": udtf(Links, returnType="ordinal int, href string, title string")}
    if extract_pdf is not None:

        class Pages:
            def eval(self, content: bytes) -> Iterator[tuple]:
                yield from enumerate(extract_pdf(bytes(content)), 1)

        found["pdf_pages"] = udtf(Pages, returnType="page_number int, raw_text string")
    for name, function in found.items():
        spark.udtf.register(name, function)
    return list(found)
