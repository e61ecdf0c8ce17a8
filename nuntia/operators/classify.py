"""A second opinion on findings by an external classifier, in batches, keeping what it is silent about."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nuntia.functions.text import filled, truncated
from nuntia.operators.stored import discard, stored
from nuntia.operators.windows import first_per_key

#: Texts after which verdicts are stored.
PORTION = 1000
#: Rows in a call, characters of a row, attempts, and seconds to wait after an error of each kind.
BATCH, MOST_CHARS, ATTEMPTS = 10, 1500, 3
WAIT_RATE_LIMIT, WAIT_UNAVAILABLE, WAIT_OTHER = 60.0, 10.0, 2.0


def request_json(ids_and_texts: Column) -> Column:
    """JSON of an array of (id, text) structs."""
    return F.to_json(ids_and_texts)


def prompt(template: str, jobs: str) -> str:
    """The template with the rows in it; other braces stay."""
    mark = "{jobs_json}" if "{jobs_json}" in template else "{extracted_text}"
    return template.replace(mark, jobs)


def wait_after(error: Exception) -> tuple[float, bool]:
    """Seconds to wait after an error, and whether to wait after the last attempt too."""
    codes = {getattr(error, name, None) for name in ("code", "status_code")}
    if 429 in codes or "429" in str(error) or "RESOURCE_EXHAUSTED" in str(error):
        return WAIT_RATE_LIMIT, True
    if 503 in codes or "503" in str(error) or "UNAVAILABLE" in str(error):
        return WAIT_UNAVAILABLE, True
    return WAIT_OTHER, False


def called(classify: Callable[[str], list[dict]], batch: list[dict], sleep: Callable[[float], None], template: str) -> dict[int, dict]:
    """Verdicts by id of one batch; none if all attempts fail."""
    request = prompt(template, json.dumps(batch, ensure_ascii=False))
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return {v["id"]: v for v in classify(request)}
        except Exception as error:  # whatever it is, the rows stay
            seconds, always = wait_after(error)
            if always or attempt < ATTEMPTS:
                sleep(seconds)
    return {}


def judged(asked: DataFrame, classify: Callable[[str], list[dict]], template: str, sleep: Callable[[float], None]) -> DataFrame:
    """_key and is_tech_job, null where there is no answer, of rows (_key, text), BATCH of them in a call."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), BATCH):
                part = frame.iloc[i : i + BATCH]
                answers = called(classify, [{"id": j, "text": t} for j, t in enumerate(part["text"])], sleep, template)
                verdicts = [answers.get(j, {}).get("is_tech_job") for j in range(len(part))]
                yield pd.DataFrame({"_key": part["_key"].values, "is_tech_job": pd.array([None if v is None else bool(v) for v in verdicts], dtype="boolean")})

    return asked.select("_key", "text").mapInPandas(judge, "_key string, is_tech_job boolean")


STORED = "key string, is_tech_job boolean"


def with_stored_verdicts(asked: DataFrame, classify: Callable[[str], list[dict]], template: str, sleep: Callable[[float], None], store: str, portion: int = PORTION) -> DataFrame:
    """_key and is_tech_job of rows (_key, text), asking only for texts without a verdict in the store.

    The store is a folder of Parquet files, in any file system of Spark's, with a row for each text and prompt (by their
    hash) that has been answered. Texts that aren't in it are asked for once each, about `portion` at a time, and each
    portion is stored before the next one: what has been paid for is not asked again, in whatever run, and a run
    that breaks off loses one portion at most. Rows without an answer aren't stored, and are asked again by the next run.
    """
    spark = asked.sparkSession
    keyed = stored(asked.withColumn("key", F.sha2(F.concat(F.lit(template + "\x1f"), "text"), 256)), "asked")
    known = lambda: spark.read.schema(STORED).parquet(store)
    spark.createDataFrame([], STORED).write.mode("append").parquet(store)  # so that there is something to read
    fresh = keyed.join(known().select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))
    fresh = stored(fresh.select(F.col("key").alias("_key"), "text"), "fresh")
    n = max(1, -(-fresh.count() // portion))
    for i in range(n):
        part = fresh.where(F.pmod(F.xxhash64("_key"), F.lit(n)) == i)
        judged(part, classify, template, sleep).where("is_tech_job IS NOT NULL").withColumnRenamed("_key", "key").write.mode("append").parquet(store)
    answers = known().groupBy("key").agg(F.bool_and("is_tech_job").alias("is_tech_job"))
    discard(fresh)
    return keyed.join(answers, "key", "left").select("_key", "is_tech_job")


def validate(findings: DataFrame, classify: Callable[[str], list[dict]] | None, template: str = "{jobs_json}", sleep: Callable[[float], None] = time.sleep, store: str | None = None) -> DataFrame:
    """Findings that the classifier doesn't call irrelevant.

    Findings of one url share the verdict on its first paragraph; findings without a url are judged one by one. A
    call holds BATCH rows; classify gets the request and returns dicts with id and is_tech_job. Rows without an
    answer are kept. Without a classifier all findings are. store: a folder in which verdicts are kept, see
    with_stored_verdicts(); without it each action on the result calls the classifier.
    """
    if classify is None:
        return findings
    row = F.concat_ws("\x1f", "doc_id", F.col("ordinal").cast("string"), F.col("para_no").cast("string"))
    keyed = findings.withColumn("_key", filled("url", F.concat(F.lit("\x1f"), row)))
    unique = first_per_key(keyed, ["_key"], ["doc_id", "ordinal", "para_no"])
    asked = unique.select("_key", truncated("description", MOST_CHARS, "...").alias("text"))
    verdicts = judged(asked, classify, template, sleep) if store is None else with_stored_verdicts(asked, classify, template, sleep, store)
    return keyed.join(verdicts.where("NOT is_tech_job"), "_key", "left_anti").drop("_key")
