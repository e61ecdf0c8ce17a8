import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, one very long text, repeated rows, a null id, and columns with clashing names."""
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n\t ", None), (4, "The long text. " * 20_000, "s"), (5, "the same row", "t"), (5, "the same row", "t"), (None, "no id here", "t"), (None, "no id here", "t"), (6, "the same row", None), (7, "é" * 5, "s"), (8, "#\\<>:\x00\u2028", "s"), (9, "12 34", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ["score", "id", "size", "target", "taken", "lang", "label", "row", "runs", "base", "spans", "component_id", "n_shingles", "th", "sources", "bin", "y", "n_chars", "window", "paragraph", "kind"]
    return df.select("*", *[F.lit(f"other {n}").alias(n) for n in names])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
