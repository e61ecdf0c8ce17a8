"""Tables kept in the folder that all machines share, so that what is dear or must not run twice runs once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that this process has stored and not yet deleted, in order.
MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a single machine without that setting, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'nuntia-shared')}"
    return found.rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, computed now and read back from the shared folder; it outlives lost executors. Its files stay until discard()
    or sweep(), as results that haven't been computed read them. by: a column by whose values they are kept apart."""
    path = f"{shared_folder(df.sparkSession)}/nuntia/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.partitionBy(*[by] if by else []).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.nuntia_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more; other tables are left alone."""
    if path := getattr(df, "nuntia_path", None):
        deleted(df.sparkSession, path)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in MADE:
        MADE.remove(path)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Delete what has been stored since MADE had that length: for when every result that reads it has been computed."""
    for path in MADE[since:]:
        deleted(spark, path)
