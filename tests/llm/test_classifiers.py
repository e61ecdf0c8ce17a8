import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nuntia.llm import language, quality, toxicity
from nuntia.llm.common import buffers, fold, slices

RNG = random.Random(4)
SOUNDS = {"aa": "ka ra ta mo", "bb": "zsch ung ber lich", "cc": "eau oux ier éan"}


def prose(lang, n, rng=RNG):
    return " ".join("".join(rng.choices(SOUNDS[lang].split(), k=rng.randint(1, 4))) for _ in range(n))


def held(ids, modulus, rest):
    return np.array([zlib.crc32(str(i).encode()) % modulus == rest for i in ids])


def test_fold_is_crc32_of_the_text_of_the_id(spark):
    rows = spark.createDataFrame([(1,), (12345678901,), (-7,), (None,)], "doc_id long").select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert [r["f"] for r in rows] == [zlib.crc32(str(i).encode()) % 5 for i in (1, 12345678901, -7)] + [None]


def test_slices_cover_all_rows():
    offsets = np.array([0, 0, 5, 5, 100, 101, 101])
    assert list(slices(np.zeros(101, np.uint8), offsets, 10)) == [(0, 3), (3, 4), (4, 6)]
    data, at = buffers(pa.array(["a", None, "é"])[1:])
    assert data.tobytes().decode() == "é" and at.tolist() == [0, 0, 2]


# language ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(1)
    return language.fit([(prose(k, 60, rng), k) for k in SOUNDS for _ in range(40)], epochs=8)


def test_backward_is_the_gradient():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language.fresh(3, rng, 4).items()}
    tokens = rng.integers(0, 256, (6, 5)).astype(np.uint8)
    weight = rng.normal(size=(6, 4, 5))

    def value(x, u):
        state, total = np.zeros((4, 5)), 0.0
        for t in range(6):
            a = x[:, tokens[t]]
            z, r = (language.gate(a[i : i + 4] + u[i : i + 4] @ state) for i in (0, 4))
            c = np.tanh(a[8:] + u[8:] @ (r * state))
            state = c + z * (state - c)
            total += (weight[t] * state).sum()
        return total

    kept = []
    language.advance(w["Xf"].astype(np.float32), w["Uf"].astype(np.float32), tokens, kept)
    dx, du = language.backward(weight, kept, tokens, w["Xf"], w["Uf"])
    for g, name in ((dx, "Xf"), (du, "Uf")):
        for i, j in [(0, tokens[0, 0] if name == "Xf" else 1), (5, tokens[2, 1] if name == "Xf" else 2), (9, tokens[3, 3] if name == "Xf" else 3)]:
            up, down = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
            up[name][i, j] += 1e-5
            down[name][i, j] -= 1e-5
            assert abs((value(up["Xf"], up["Uf"]) - value(down["Xf"], down["Uf"])) / 2e-5 - g[i, j]) < 1e-3


def test_whole_texts_are_labelled(spark, languages, odd, none):
    texts = [(i, prose(k, n), k) for i, (k, n) in enumerate((k, n) for k in SOUNDS for n in (3, 30, 3000))]
    rows = language.identify(spark.createDataFrame(texts, "doc_id long, text string, lang_pred string"), languages).collect()
    assert [r["lang_pred"] for r in rows] == [t[2] for t in texts] and all(0 <= r["score"] <= 1 for r in rows)
    # most of a text decides, wherever it stands
    mixed = spark.createDataFrame([(1, prose("aa", 10) + " " + prose("bb", 400)), (2, prose("bb", 400) + " " + prose("aa", 10))], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(mixed, languages).collect()] == ["bb", "bb"]
    out = {r["doc_id"]: r for r in language.identify(odd, languages).collect()}
    assert language.identify(odd, languages).count() == odd.count() and language.identify(none, languages).collect() == []
    for i in (1, 2, 3, 8, 9):
        assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
    assert out[7]["lang_pred"] in SOUNDS


def test_windows_do_not_change_the_result(languages):
    text = prose("cc", 500)
    alone = language.pooled(*buffers(pa.array([text])), languages)
    among = language.pooled(*buffers(pa.array(["", text, "aa" * 200, text])), languages, at_once=3)
    assert np.allclose(alone[0], among[1], atol=1e-5) and np.allclose(among[1], among[3], atol=1e-5) and among[0].sum() == 0


def test_without_languages_all_is_undetermined(spark, odd):
    assert {r["lang_pred"] for r in language.identify(odd, language.fit([])).collect()} == {"und"}
    assert {r["lang_pred"] for r in language.identify(odd.where("doc_id = 5"), language.fit([("abc", "xx")])).collect()} == {"xx"}


def test_every_language_is_learned(spark):
    rng = random.Random(7)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * rng.randint(5, 30), f"l{i % 230:03}") for i in range(690)]
    rows += [(1000 + i, "zzyzx " * 5000, "long") for i in range(3)] + [(2000, "x", None), (2001, None, "l000"), (None, "no id", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.language_sample(df, F.col("doc_id") < 0, max_chars=2000)
    assert {k for _, k in sample} == {f"l{i:03}" for i in range(230)} | {"long"} and max(len(t) for t, _ in sample) <= 2000
    assert language.fit([r for r in sample if r[1] < "l003" or r[1] == "long"], epochs=1).languages == ("l000", "l001", "l002", "long")


def test_rows_of_one_id_serve_once(spark):
    many = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("same id "), "id").alias("text"), F.lit("aa").alias("lang"))
    copies = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("no id").alias("text"), F.lit("bb").alias("lang"))
    others = spark.range(100, 300).select(F.col("id").alias("doc_id"), F.concat(F.lit("other "), "id").alias("text"), F.lit("cc").alias("lang"))
    sample = language.language_sample(many.union(copies).union(others), F.lit(False), per_language=10_000)
    assert len(sample) == 202 and {("same id 0", "aa"), ("no id", "bb")} <= set(sample)


def test_language_query(spark, sf_dir, docs):
    df = language.op4_language(spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = df.toPandas().set_index("doc_id")
    want = docs.select("doc_id", "lang").toPandas().set_index("doc_id").lang
    assert len(got) == len(want) and (got.held_out.values == held(got.index, 4, 2)).all()
    assert (got.lang_pred[got.held_out] == want[got.index][got.held_out]).mean() >= 0.9


# quality ----------------------------------------------------------------------------------------------------------


def quality_rows(n, seed=2):
    rng = random.Random(seed)
    good = [(prose(rng.choice(list(SOUNDS)), rng.randint(20, 400), rng), 1) for _ in range(n)]
    return good + [(" ".join(w.upper() + "!!" for w in prose("aa", rng.randint(20, 400), rng).split()), 0) for _ in range(n)]


def test_quality_separates_held_out_texts(spark, odd, none):
    model = quality.fit(quality_rows(120))
    test = quality_rows(60, seed=9)
    scores = model.scores([t for t, _ in test], model.coders())
    assert np.mean((scores >= 0.5) == np.array([y for _, y in test])) >= 0.97
    out = quality.score_quality(odd, model)
    assert out.columns == [*odd.drop("score").columns, "score"] and quality.score_quality(none, model).collect() == []
    rows = {r["doc_id"]: r["score"] for r in out.collect()}
    assert out.count() == odd.count() and rows[1] == rows[2] == pytest.approx(0.5) and all(0 <= s <= 1 for s in rows.values())


def test_quality_holds_at_true_shares_and_short_texts_lean_to_them():
    rows = quality_rows(120)
    rare = quality.fit(rows, {1: 9000, 0: 1000})
    assert rare.prior == pytest.approx(0.9, abs=0.01)
    scores = rare.scores(["ka", None, "KA!!"], rare.coders())
    assert (scores > 0.5).all() and scores[1] == pytest.approx(0.9, abs=0.01)


@pytest.mark.parametrize("rows,want", [([], 0.5), ([("a", 1)] * 8, 0.9), ([("a", 0)] * 8, 0.1)])
def test_quality_of_few_labels(rows, want):
    model = quality.fit(rows)
    assert model.scores([None], model.coders())[0] == pytest.approx(want) and 0 <= model.scores(["a b c"], model.coders())[0] <= 1


def test_quality_query(spark, sf_dir):
    df = quality.op7_quality(spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = df.toPandas().set_index("doc_id")
    assert (got.held_out.values == held(got.index, 3, 1)).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id").quality
    labels = labels[[i for i in labels.index if i in got.index and got.held_out[i]]]
    assert (got.predicted[labels.index] == labels).mean() >= 0.85


# toxicity ---------------------------------------------------------------------------------------------------------

BAD = ["gromblok", "zwarfnit", "plubbert"]


def toxic_rows(n, seed=5, words=BAD):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = prose(rng.choice(list(SOUNDS)), rng.randint(10, 200), rng).split()
        if i % 2:
            for _ in range(rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(words))
        out.append((" ".join(w), i % 2))
    return out


@pytest.fixture(scope="module")
def toxic():
    return toxicity.fit(toxic_rows(300))


def scored(model, texts):
    x = toxicity.evidence(*buffers(pa.array(texts, pa.string())), model)
    return toxicity.sigmoid(model.slope * x + model.intercept)


def test_toxicity_separates_held_out_texts_of_any_length(toxic):
    test = toxic_rows(200, seed=8)
    s = scored(toxic, [t for t, _ in test])
    assert np.mean((s >= 0.5) == np.array([y for _, y in test])) >= 0.98
    long = prose("cc", 20_000)
    assert scored(toxic, [long])[0] < 0.5 <= scored(toxic, [long + " Gromblok! " + long + " PLUBBERT"])[0]


def test_misspellings_share_their_subwords(toxic):
    s = scored(toxic, ["ka grombloks mo plubbet ra", "ka rata ZWARFNITT mo grombblok", "ka rata grombblok mo zwafnit", "ka rata taka mo", "gromblok"])
    assert (s[[0, 1, 2, 4]] >= 0.5).all() and s[3] < 0.5


def test_toxicity_of_odd_rows(spark, toxic, odd, none):
    out = toxicity.score_toxicity(odd, toxic)
    rows = {r["doc_id"]: r["score"] for r in out.collect()}
    assert out.count() == odd.count() and rows[1] == rows[2] == rows[3] < 0.5 and all(0 <= s <= 1 for s in rows.values())
    assert toxicity.score_toxicity(none, toxic).collect() == []
    for labels, want in (([], 0.5), ([("a", 1)] * 8, 0.9), ([("a", 0)] * 8, 0.1)):
        assert {round(r["score"], 6) for r in toxicity.score_toxicity(odd, toxicity.fit(labels)).collect()} == {want}


def test_batches_do_not_change_scores(toxic):
    texts = [t for t, _ in toxic_rows(40, seed=3)] + ["", "x" * 300_000]
    together = scored(toxic, texts)
    assert np.allclose(together, [scored(toxic, [t])[0] for t in texts])


def test_toxicity_query(spark, sf_dir):
    df = toxicity.op8_toxicity(spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = df.toPandas().set_index("doc_id")
    assert (got.held_out.values == held(got.index, 5, 0)).all() and ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_toxicity_of_held_out_rows_of_a_table(spark, sf_dir):
    """On a table large enough to learn from."""
    large = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.1")
    if not os.path.isdir(large):
        pytest.skip("no larger table")
    got = toxicity.op8_toxicity(spark, large).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{large}/labels.parquet").where("toxic IS NOT NULL").toPandas().set_index("doc_id").toxic
    labels = labels[[i for i in labels.index if i in got.index and got.held_out[i]]]
    hit = got.predicted[labels.index] == 1
    assert hit[labels == 1].mean() >= 0.9 and hit[labels == 0].mean() <= 0.01


def test_sample_is_bounded_and_skips_rows(spark):
    from nuntia.llm.common import labelled_sample

    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, None).otherwise((F.col("doc_id") % 2).cast("int")).alias("quality"))
    rows, counts = labelled_sample(docs, labels, "quality", F.col("doc_id") >= 1000, 100, 1, 100)
    assert counts == {1: 500, 0: 400} and 140 <= len(rows) <= 260 and all(int(t[1:]) < 1000 and int(t[1:]) % 10 for t, _ in rows)
    assert labelled_sample(docs, labels.where("false"), "quality", F.lit(False), 100, 1, 100) == ([], {})
