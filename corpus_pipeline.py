"""From raw documents to a mixed training corpus: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.llm.common import MADE, discard, small, sweep, table, written
from nuntia.llm.decontaminate import contamination
from nuntia.llm.mixing import mixed_by_source
from nuntia.llm.near_dup import near_duplicates
from nuntia.llm.quality import fitted, score_quality
from nuntia.llm.secrets import redact

#: Tokens that a benchmark item needs for its documents to go.
SHORTEST = 8


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores as keep it apart from the columns."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather bad than good go.

    A null or empty text has the score of the labels' share of good texts. Repeated rows share their fate; an empty table
    gives no rows; columns of any name are kept.
    """
    score = unused(docs, "nuntia_score")
    scored = score_quality(docs, fitted(docs, table(spark, sf_dir, "labels")), score_column=score)
    return scored.where(F.col(score) >= 0.5).drop(score)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 80 percent) one document stays: the one with the smallest id, and of
    several with that id the one whose text has the smallest hash.

    Decisions are by row: rows that share an id but not the text are documents of their own. Of rows that repeat id and
    text one stays. Documents without words or without an id stay. An empty table gives no rows; columns of any name
    are kept.
    """
    key, other_id, other_hash = (unused(docs, n) for n in ("nuntia_hash", "nuntia_other_id", "nuntia_other_hash"))
    own = docs.withColumn(key, F.xxhash64("text"))
    found = written(near_duplicates(docs.select("doc_id", "text"), 5, 80).withColumnRenamed("text_hash", key), "found")
    gone = written(found.where("NOT first").select(F.col("doc_id").alias(other_id), F.col(key).alias(other_hash)).distinct(), "gone")
    kept = own.join(small(gone), (F.col("doc_id") == F.col(other_id)) & (F.col(key) == F.col(other_hash)), "left_anti")
    # only rows that repeat id and text are compared with one another
    repeated = written(found.where("first").groupBy(F.col("doc_id").alias(other_id), F.col(key).alias(other_hash)).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    if not repeated.isEmpty():
        is_repeated = F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_hash))
        once = kept.join(small(repeated), is_repeated, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(small(repeated), is_repeated, "left_anti").unionByName(once)
    discard(found)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go: each row by its own text, whether its id is null or repeated or not.

    Items of fewer than SHORTEST tokens are ordinary words that clean documents hold, too, and aren't looked for. Null and empty texts hold none and stay; an empty table gives no rows; columns of any name are kept.
    """
    key = unused(docs, "nuntia_hash")
    own = F.sha2(F.col("text").cast("binary"), 256)
    found = written(contamination(docs.select(own.alias(key), "text"), table(spark, sf_dir, "benchmark"), id_column=key, shortest=SHORTEST).select(key).distinct(), "leaks")
    return docs.withColumn(key, own).join(small(found), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, and n_chars follows, if there is such a column.

    All rows stay, null texts as null; repeated rows are treated alike; columns of any name are kept.
    """
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each: size, source_size, target and taken.

    A null or empty text has size 0; a null source is a source; columns of the input with these names are replaced.
    """
    return mixed_by_source(docs)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicate), ("benchmark decontamination", decontaminated), ("secret scan", secrets), ("source mixing", mixing)]

#: SQL cannot express the trained classifier nor the components of near duplicates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over all documents. Once a stage is written, what it was made from is deleted."""
    docs = table(spark, sf_dir, "documents")
    others = set(MADE)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
            sweep(spark, others | {docs.nuntia_path})
    return docs
