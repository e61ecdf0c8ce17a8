"""Incremental scans: pages land as files, findings come out once each.

The matching operators keep no state, so they run on a stream unchanged. Repeats within the delay are dropped by Spark's
own state store; numbering and reports need whole batches and run in foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nuntia.operators.lexicon import Lexicon
from nuntia.operators.match import find
from nuntia.schema import PAGES

LANDED = T.StructType([*PAGES.fields, T.StructField("landed", T.TimestampType())])


def read_landing(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Pages with their time of landing, from Parquet files that are added to a folder."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fresh_findings(pages: DataFrame, lexicon: Lexicon | None = None, delay: str = "7 days", separator: str = r"\n\n") -> DataFrame:
    """Findings, with landed, whose url and description haven't come up within the delay."""
    found = find(pages.withWatermark("landed", delay), lexicon, separator, ["landed"])
    return found.dropDuplicatesWithinWatermark(["url", "description"])


def run_available(findings: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that has landed, batch by batch, then stop; a later call continues where this one ended."""
    return findings.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
