"""The functions that Spark lacks, under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nuntia.functions import text
from nuntia.functions.markup import text_function


def register_functions(spark: SparkSession) -> list[str]:
    """Register normalize_unicode, fold_accents, html_unescape, html_text and resolve_url for SQL; returns their names.

    In DataFrames, text.strip_accents is the better choice for accents: it stays inside the JVM.
    """

    plain = text.plain  # functions travel by value, modules had better not

    @F.pandas_udf(T.StringType())
    def fold_accents(s: pd.Series) -> pd.Series:
        return s.map(plain, na_action="ignore")

    functions = {"normalize_unicode": text._nfc, "fold_accents": fold_accents, "html_unescape": text.html_unescape, "html_text": text_function(), "resolve_url": text.resolve_url}
    for name, function in functions.items():
        spark.udf.register(name, function)
    return list(functions)
