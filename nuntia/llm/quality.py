"""Compression classifier for text quality.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is cut into blocks, each
block is compressed with either dictionary, and d = (bad size - good size) / text size over all blocks says which of
the two explains it better. Blocks keep the dictionaries' influence alike at every text length; dividing by the text's
own size leaves a text that repeats itself, and so compresses well with either, without the credit of good text.
A logistic curve, fitted on labelled rows that the dictionaries have not seen, turns d into a probability of label 1;
it holds at the labels' true shares, and short texts are drawn towards these shares as their d says little.
Lines that good and bad rows share are no evidence and stay out of both dictionaries.

Defined results: a null or empty text carries no evidence and gets the share of label 1 (0.5 without any
labels). An empty table gives no rows. A very long text is read in blocks. Repeated rows are scored alike; extra columns
are kept, but for one that has the score column's name: it is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nuntia.llm.common import fold, labelled_sample, platt, prior_shift, sigmoid, table

BLOCK = 512
LEVEL = 3
#: Bytes of text at which d and the labels' shares weigh the same.
HALF = 80


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    prior: float

    def coders(self) -> tuple:
        return tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) if d else None for d in (self.good, self.bad))

    def scores(self, texts: Iterable[str | None], coders: tuple) -> np.ndarray:
        return np.array([self.prior if not t else self.score(t, coders) for t in texts])

    def score(self, text: str, coders: tuple) -> float:
        n = len(text.encode("utf-8", "replace"))
        own, base = self.slope * difference(text, coders) + self.intercept, np.log(self.prior / (1 - self.prior))
        return float(sigmoid((n * own + HALF * base) / (n + HALF)))


def blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def difference(text: str, coders: tuple) -> float:
    """Difference of the compressed sizes per byte of text: above 0 where the good dictionary does better."""
    good, bad = coders
    if good is None or bad is None:
        return 0.0
    g = b = n = 0
    for block in blocks(text):
        g += len(good.compress(block))
        b += len(bad.compress(block))
        n += len(block)
    return (b - g) / n


def dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary; where the texts are too few for the trainer, their own bytes."""
    samples = [x for t in texts for x in blocks(t)]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def without_shared(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows without the lines that occur under both labels."""
    lines = [{x for t, y in rows if y == k for x in t.split("\n")} for k in (0, 1)]
    both = lines[0] & lines[1]
    return [("\n".join(x for x in t.split("\n") if x not in both), y) for t, y in rows]


def fit(rows: list[tuple[str, int]], counts: dict[int, int] | None = None, dictionary_bytes: int = 112_640) -> QualityModel:
    """Every third row calibrates, the others build the dictionaries. counts: of each label, over all rows."""
    rows = [(t, y) for t, y in rows if t]
    counts = counts or {k: sum(y == k for _, y in rows) for k in (0, 1)}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    build, hold = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    if len({y for _, y in build}) < 2 or len({y for _, y in hold}) < 2:
        build = hold = rows
    if len({y for _, y in build}) < 2:
        return QualityModel(b"", b"", 1.0, float(np.log(prior / (1 - prior))), prior)
    parts = [dictionary([t for t, y in without_shared(build) if y == k], dictionary_bytes) for k in (1, 0)]
    model = QualityModel(parts[0], parts[1], 1.0, 0.0, prior)
    coders = model.coders()
    slope, intercept = platt(np.array([difference(t, coders) for t, _ in hold]), np.array([y for _, y in hold], float))
    return QualityModel(parts[0], parts[1], slope, intercept + prior_shift(hold, counts), prior)


def score_quality(documents: DataFrame, model: QualityModel, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """All columns of documents and the score, one row per row; one pass without a shuffle."""
    documents = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() != score_column.lower()])
    at = documents.columns.index(text_column)
    names = [*documents.columns, score_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = model.coders()
        for batch in batches:
            scores = model.scores((x.as_py() for x in batch.column(at)), coders)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(score_column, T.DoubleType())]))


def fitted(documents: DataFrame, labels: DataFrame, per_class: int = 3000, max_chars: int = 20_000) -> QualityModel:
    """A model of labels.quality from the rows whose crc32(doc_id) mod 3 is not 1 (bounded sample, see labelled_sample)."""
    return fit(*labelled_sample(documents, labels, "quality", fold("doc_id", 3) == 1, per_class, 7, max_chars))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(documents, fitted(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
