import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipe
from nuntia.llm.common import MADE, shared_dir, written


def test_stages_and_queries_are_registered():
    assert [n for n, _ in pipe.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "secret scan", "source mixing"] and pipe.ORACLE_SQL is None
    names = [re.match(r"op(\d+)_", q)[1] for q in entry.queries() if q.startswith("op")]
    assert sorted(map(int, names)) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_the_core_does_not_import_this_subpackage():
    import subprocess
    import sys

    code = "import sys, nuntia.plans.scan, nuntia.plans.queries, nuntia.plans.sinks, nuntia.streaming.stream, nuntia.sources.feed; print([m for m in sys.modules if m.startswith('nuntia.llm')])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "[]"


def test_every_stage_takes_effect_on_all_it_is_given(spark, sf_dir, docs):
    before, columns = docs, docs.columns
    kept = {"documents": docs.count()}
    for name, stage in pipe.STAGES:
        after = written(stage(spark, before, sf_dir), "test")
        kept[name] = after.count()
        if name != "source mixing":
            assert after.columns == columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes]
        before = after
    counts = list(kept.values())
    assert counts == sorted(counts, reverse=True) and counts[4] == counts[3] == counts[5] and counts[1] < counts[0] and counts[3] < counts[1]
    final = before
    assert {"size", "source_size", "target", "taken"} <= set(final.columns) and final.agg(F.sum("taken")).first()[0] > 0
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    first = written(pipe.quality(spark, docs, sf_dir), "test")
    assert first.join(good, "doc_id", "left_semi").count() >= 0.9 * docs.join(good, "doc_id", "left_semi").count()


@pytest.fixture
def few(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta eta"), (2, "Alpha beta gamma delta epsilon zeta eta"), (3, "quite another text of some words"), (3, "quite another text of some words"), (3, "the same id with another text"), (None, "no id"), (None, "no id"), (4, None), (5, ""), (6, "")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_keep_one_of_each_group(spark, few, sf_dir):
    out = pipe.near_duplicate(spark, few, sf_dir)
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.where("text IS NOT NULL").collect()) == sorted([("1", "alpha beta gamma delta epsilon zeta eta"), ("3", "quite another text of some words"), ("3", "the same id with another text"), ("None", "no id"), ("5", ""), ("6", "")])
    assert out.where("doc_id = 4").count() == 1 and out.columns == few.columns


def test_secrets_and_decontamination(spark, few, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    df = few.withColumn("text", F.when(F.col("doc_id") == 1, F.lit(f"before {item} after")).when(F.col("doc_id") == 2, F.lit("token = abcdefghijklmnop end")).otherwise(F.col("text")))
    assert pipe.decontaminated(spark, df, sf_dir).count() == df.count() - 1
    row = pipe.secrets(spark, df, sf_dir).where("doc_id = 2").first()
    assert (row["text"], row["n_chars"]) == ("[SECRET] end", 12)


def test_decontamination_decides_by_row(spark, few, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    bad = f"before {item} after"
    rows = [(None, bad), (None, "no id"), (3, bad), (3, "the same id, clean"), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], few.schema)
    got = pipe.decontaminated(spark, df, sf_dir)
    assert got.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(None, "no id"), (3, "the same id, clean"), (4, None)], key=str)


def test_short_items_take_no_documents(spark, few, sf_dir, tmp_path):
    """Four to seven ordinary words are no leak; eight are one, whole or with one replaced."""
    items = [(4, "one of the most"), (7, "which of the following is not true"), (8, "name all rivers that reach the northern sea")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [f"It is {items[0][1]} common", f"{items[1][1]} today", f"Please {items[2][1]}.", "Please name all lakes that reach the northern sea."]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], few.schema)
    assert sorted(r["doc_id"] for r in pipe.decontaminated(spark, df, str(tmp_path)).collect()) == [0, 1]


def test_empty_documents(spark, few, sf_dir):
    for _, stage in pipe.STAGES:
        assert stage(spark, few.where("false"), sf_dir).collect() == []
        assert stage(spark, few.where("doc_id IN (4, 5)"), sf_dir).count() <= 2


def test_run(spark, sf_dir):
    before = set(MADE)
    out = pipe.run(spark, sf_dir)
    assert sum("stage-" in p for p in set(MADE) - before) == 1
    assert out.count() > 0 and shared_dir(spark).startswith("file:") and out.where("taken > 3 * size").count() == 0


def test_near_duplicates_are_decided_by_row(spark, few, sf_dir):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "nothing like the other text but for its id", "one two three four five six seven eight")
    rows = [(1, a), (7, a), (7, b), (9, c), (9, c), (None, c), (None, c), (9, c.upper()), (12, None), (12, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], few.schema).withColumn("nuntia_hash", F.lit("kept"))
    out = pipe.near_duplicate(spark, df, sf_dir)
    assert out.columns == df.columns and out.where("nuntia_hash = 'kept'").count() == out.count()
    got = sorted(((r["doc_id"], (r["text"] or "").lower() or None) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (7, b), (9, c), (None, c), (12, None)], key=str)


def test_stages_keep_columns_of_any_name(spark, few, sf_dir):
    names = ["nuntia_score", "nuntia_hash", "first", "node", "gone", "hash", "again", "row", "spans", "runs", "id"]
    df = few.select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in pipe.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns, name
        assert all(r[n] == n for r in out.collect() for n in names), name
