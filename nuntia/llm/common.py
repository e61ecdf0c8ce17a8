"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as white space between words in every contract: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes up to which a table is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a single machine without that setting, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return found.rstrip("/")


#: Paths of the tables that this process has written and not yet discarded, in order.
MADE: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: a cut of its lineage that outlives lost executors.

    The files stay until discard() or sweep(), as results that are not yet computed read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nuntia/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.nuntia_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table that written() made and that nothing reads any more."""
    if df is not None and (path := getattr(df, "nuntia_path", None)):
        deleted(df.sparkSession, path)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in MADE:
        MADE.remove(path)


def sweep(spark: SparkSession, but: set[str] = frozenset()) -> None:
    """Delete the files of all tables that written() made in this process, but for some paths. For when every result
    that reads them has been computed."""
    for path in [p for p in MADE if p not in but]:
        deleted(spark, path)


def weight(df: DataFrame) -> Column:
    """Bytes that the rows of df take in memory, as an aggregate: 16 per row and number, and strings and arrays as long as they are."""
    sizes = []
    for field in df.schema:
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            sizes.append(F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)))
        elif isinstance(field.dataType, T.AtomicType):
            sizes.append(F.lit(0))
        else:
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))), F.lit(0)))
    return F.sum(reduce(add, sizes, F.lit(16 * (1 + len(df.columns)))).cast("long"))


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if its rows take at most `limit` bytes (measured), else df as it is."""
    return F.broadcast(df) if (df.agg(weight(df)).first()[0] or 0) <= (BROADCAST_BYTES if limit is None else limit) else df


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0, one more than rows) of a string column; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + n + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about `most` bytes together, so that work arrays stay small; one long row may exceed it."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


#: Bytes above which a single row is worked on in pieces, too.
LONG = 1 << 20


def pieces(data: np.ndarray, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """A long row in runs of about `most` bytes that end with white space, so that no word is cut."""
    begin, n = 0, len(data)
    while n - begin > most:
        end = 0
        for at in range(begin + most, n, 1 << 16):
            near = data[at : at + (1 << 16)]
            if len(hit := np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13)))):
                end = at + int(hit[0]) + 1
                break
        if not end:
            break
        yield data[begin:end]
        begin = end
    yield data[begin:]


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case; other bytes stay."""
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a logistic curve for scores x of labels y (Newton's method, smoothed targets)."""
    if len(x) == 0:
        return 1.0, 0.0
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = float(x.std()) or 1.0
    z = (x - x.mean()) / scale
    w = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    a = np.stack([z, np.ones_like(z)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (p - t) + 1e-4 * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * x.mean() / scale)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, skip: Column, per_class: int, seed: int, max_chars: int) -> tuple[list, dict[int, int]]:
    """(text, 0 or 1) of at most about 2 * per_class labelled documents, and the labels' counts over all rows.

    Which rows: those with a non-null 0/1 label outside `skip`, taken by a hash of the id under a threshold that
    the class counts set, so the choice needs one small aggregate and no sort. Only ids travel to the join;
    the texts of the chosen ids come from one scan. Texts over max_chars characters don't serve for fitting.
    """
    spark = documents.sparkSession
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~F.coalesce(skip, F.lit(True)))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], {}
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (share < min(1.0, per_class / n)))
    ids = usable.where(keep).dropDuplicates(["doc_id"]).limit(4 * per_class)
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y").limit(8 * per_class).collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))], counts


def prior_shift(rows: list[tuple[str, int]], counts: dict[int, int]) -> float:
    """What a logit fitted on a balanced sample needs so that it holds at the labels' true shares."""
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    if not (n0 and n1 and counts.get(0) and counts.get(1)):
        return 0.0
    return float(np.log(counts[1] / counts[0] * n0 / n1))
