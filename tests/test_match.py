import re

import pytest
from pyspark.sql import functions as F

from nuntia.functions.text import plain
from nuntia.operators import match
from nuntia.operators.lexicon import Lexicon
from nuntia.schema import NO_ORGANISM, PAGES


def page(spark, *texts, source="BOP", organism="Cabildo"):
    return spark.createDataFrame([("d", i, i + 1, t, "", organism, source, "u") for i, t in enumerate(texts)], PAGES)


def found(spark, *texts, **kw):
    return match.find(page(spark, *texts, **kw)).orderBy("ordinal", "para_no").collect()


def test_two_steps(spark):
    text = "Texto sin más.\n\n Convocatoria de plaza de INFORMÁTICO. \n\nUn informático sin ancla.\n\n\n\nBases de bolsa de trabajo: programadora."
    rows = found(spark, text)
    assert [(r["para_no"], r["matched_keywords"]) for r in rows] == [(1, ["informátic[ao]s?"]), (4, ["programador[a]?"])]
    assert rows[0]["description"] == "Convocatoria de plaza de INFORMÁTICO." and rows[0]["organism"] == "Cabildo"
    assert found(spark, text, organism="")[0]["organism"] == NO_ORGANISM
    assert found(spark, "", None) == []


def test_exclusions_hide_terms_but_not_anchors(spark):
    assert found(spark, "La plaza se solicita por medios informáticos y aplicación informática.") == []
    assert len(found(spark, "Plaza de informático por medios informáticos.")) == 1
    # an anchor inside an excluded phrase still counts
    assert len(found(spark, "programador, incidencias informáticas bases")) == 1


def test_european_rule(spark):
    assert len(found(spark, "We want a DBA now", source="EPSO")) == 1
    assert found(spark, "ADBAX", source="EULISA") == []
    assert found(spark, "éDBA", source="EULISA") == []
    assert found(spark, "plaza de informático", source="EURES") == []
    assert found(spark, "We want a DBA, plaza", source="BOC") == []


@pytest.mark.parametrize(
    "title,rejected",
    [
        ("110 CONTRATOS FORMATIVOS PCA. PROFESIONAL", True), ("Curso formativo de Sistemas", True), ("ACTUALIZACIÓN BOLSAS BOMBERO/A", True), ("Bolsa de Bomberos", True),
        ("Técnico de Mantenimiento de Edificios", True), ("TÉCNICO MANTENIMIENTO SISTEMAS INFORMÁTICOS", False), ("Ingeniero de Sistemas y Mantenimiento", False),
        ("Administrativo de Contratación", False), ("Técnico Auxiliar de Informática", False), ("", False), (None, False),
    ],
)
def test_titles(spark, title, rejected):
    assert spark.createDataFrame([(title,)], "t string").select(match.rejects_title("t")).first()[0] is rejected


def test_patterns_mean_in_java_what_they_mean_in_python(spark):
    samples = [
        "informática", "INFORMATICOS", "sistemas y redes", "sistema  microinformático", "telecomunicación", "telecomunicaciones", "las TIC hoy", "tictac", "ingeniera de software", "ingeniero telecomunicaciones",
        "desarrolladora", "tecnologías de la información", "auxiliar técnico informático", "la IA y", "iac", "Ingeniería de datos", "científica de datos", "administradora de base de datos", "data  lake", "metadata lake", "Machine\nLearning", "éia", "iaé",
    ]
    lexicon = Lexicon()
    df = spark.createDataFrame([(i, plain(s)) for i, s in enumerate(samples)], "i int, x string")
    rows = df.select("i", match.matched("x", lexicon.folded("terms"), list(lexicon.terms)).alias("m")).collect()
    for r in rows:
        assert r["m"] == [p for p in lexicon.terms if re.search(plain(p), plain(samples[r["i"]]), re.IGNORECASE)], samples[r["i"]]


def test_lexicon_files(spark, tmp_path):
    path = tmp_path / "l.yaml"
    path.write_text("it_keywords: ['gato']\ncontest_anchors: ['casa']\n", encoding="utf-8")
    lexicon = Lexicon.load(path)
    assert (lexicon.terms, lexicon.anchors, lexicon.exclusions) == (("gato",), ("casa",), ())
    assert len(match.find(page(spark, "gato en casa", "gato"), lexicon).collect()) == 1
    assert match.find(page(spark, "gato en casa"), Lexicon(terms=())).collect() == []
    with pytest.warns(UserWarning):
        assert Lexicon.load(tmp_path / "none.yaml") == Lexicon()
    assert lexicon.table(spark).where("kind = 'terms'").collect()[0]["pattern"] == "gato"


def test_rejected_words(spark):
    df = spark.createDataFrame([("Plazas de POLICÍA LOCAL",), ("Médicos",), ("Informática",)], "t string")
    assert [r[0] for r in df.select(match.rejects_words("t")).collect()] == [True, True, False]


def test_plan_reads_few_columns_and_stays_in_the_jvm(spark, tmp_path):
    page(spark, "x").withColumn("unread", F.lit("y")).write.parquet(str(tmp_path / "p"))
    plan = match.find(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and "unread" not in plan and "section#" not in plan
