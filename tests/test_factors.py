import random
import re

import pytest
from pyspark.sql import functions as F

from nuntia.operators import factors
from nuntia.operators.lexicon import ENGLISH_TERMS, TERMS


def test_fragments():
    assert factors.fragments(r"\bplazas?\s+de\s+(?:inform[aá]tic|telecomunic)") == [["plaza"], ["inform", "telecomunic"]]
    assert factors.fragments("(abc)+d(?:ef)?ghi") == [["abc"], ["ghi"]]
    assert factors.fragments(r"(?:ab)c\b-def|xyz") == [["abc", "xyz"]] or factors.fragments(r"(?:ab)c\b-def|xyz") == [["def", "xyz"]]
    assert factors.fragments("(?<=abc)de") is None and factors.fragments("a|bcd") is None and factors.fragments("(?:abc)*") is None and factors.fragments(r"\p{L}+abc") is None
    assert factors.fragments("informe_anual") == [["informe"], ["anual"]]


def table(spark, patterns):
    return spark.createDataFrame([(f"p{i}", p) for i, p in enumerate(patterns)], "name string, pattern string").repartition(3)


def unrolled(texts, patterns):
    """What Java's engine finds, pattern by pattern."""
    columns = [F.when(F.col("t").rlike("(?iuU)" + p), F.lit(f"p{i}")) for i, p in enumerate(patterns)]
    return {r["i"]: sorted(r["m"]) for r in texts.select("i", F.array_compact(F.array(*columns)).alias("m")).collect() if r["m"]}


def indexed(texts, spark, patterns):
    index = factors.indexed(table(spark, patterns))
    return {r["i"]: r["matched_keywords"] for r in factors.match_indexed(texts, ["i"], index, "t").collect()}


@pytest.mark.parametrize("bounds", [{}, {"BROADCAST_ROWS": 0}, {"UNROLLED": 0}, {"BITS": 64}])
def test_random_patterns_agree_with_the_unrolled_match(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(factors, name, value)
    rng = random.Random(len(bounds) + sum(map(len, bounds)))
    words = ["informe", "Plaza", "redes", "DATOS", "soft", "ab", "x9y", "σοφος", "straße", "kilo"]

    def pattern(depth=0):
        kind = rng.randrange(8 if depth < 3 else 3)
        if kind < 3:
            return rng.choice(words).lower() + rng.choice(["", "s?", r"\b", "[ao]", ".", r"\s+"])
        if kind < 5:
            return pattern(depth + 1) + rng.choice(["", r"\s+", "-?"]) + pattern(depth + 1)
        if kind == 5:
            return f"(?:{pattern(depth + 1)}|{pattern(depth + 1)})"
        return f"({pattern(depth + 1)}){rng.choice(['?', '+', '{2}', '*'])}"

    patterns = [pattern() for _ in range(60)] + ["^a", r"\d", r"\p{Lu}x", "(?<=plaza) de"]
    patterns = [p for p in patterns if not re.search(r"[?+*}]{2}|\)[?*]$", p)]
    texts = [(i, rng.choice([" ", "", "-", "  "]).join(rng.choice([str.lower, str.upper, str.title, str])(rng.choice(words)) for _ in range(rng.randrange(7)))) for i in range(150)]
    texts += [(900, None), (901, "ΣΟΦΟΣ ΣΟΦΟσx"), (902, "Kilo İNFORME ınforme"), (903, "plaza de")]
    df = spark.createDataFrame(texts, "i int, t string")
    assert indexed(df, spark, patterns) == unrolled(df, patterns)


def test_terms_of_the_built_in_lexicon(spark):
    patterns = [*TERMS, *ENGLISH_TERMS]
    texts = ["Plaza de INFORMÁTICO y de ingeniera de  software", "a DBA wanted", "bases: la tic, ia, big   data", "Full Stack Developer / full-stack", "nada", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert indexed(df, spark, patterns) == unrolled(df, patterns) != {}


def test_no_patterns_and_no_texts(spark):
    df = spark.createDataFrame([(1, "abc")], "i int, t string")
    assert indexed(df, spark, []) == {} and indexed(df.where("false"), spark, ["abc"]) == {} and indexed(df, spark, ["b", "abcd", "bc"]) == {1: ["p0", "p2"]}


def test_ten_thousand_patterns_make_no_larger_plan(spark):
    """Each text gets the patterns that need one of its words, and these only are run."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "ion"
    texts = spark.range(2000).select(F.col("id").alias("i"), F.concat_ws(" ", *[F.element_at(F.array(*[F.lit(word(n * 37)) for n in range(200)]), (F.col("id") * k % 200 + 1).cast("int")) for k in (1, 7, 11)]).alias("t"))
    sizes, found = [], None
    for n in (100, 10_000):
        index = factors.indexed(spark.range(n).select(F.col("id").cast("string").alias("name"), F.lit("").alias("pattern")).join(spark.createDataFrame([(str(i), rf"\b{word(i)}s?\b") for i in range(n)], "name string, p string"), "name").select("name", F.col("p").alias("pattern")))
        found = factors.match_indexed(texts, ["i"], index, "t")
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().treeString().split("\n")))
    assert sizes[0] == sizes[1]
    got = {r["i"]: sorted(map(int, r["matched_keywords"])) for r in found.collect()}
    assert len(got) == 2000 and all(set(v) == {i * k % 200 * 37 for k in (1, 7, 11) if i * k % 200 * 37 < 10_000} for i, v in got.items())


WORD = "[a-z0-9]"


def whole(words):
    return f"(?<!{WORD}){words}(?!{WORD})"


def test_phrases():
    gap = "[^a-z0-9]+"
    assert factors.phrases(whole(f"plaza{gap}(?:de|la)")) == ["plaza de", "plaza la"]
    assert factors.phrases(whole("bases?")) == ["base", "bases"] and factors.phrases(whole("(?:ab|ac|a)d[ef]")) == ["abde", "abdf", "acde", "acdf", "ade", "adf"]
    for other in (rf"\bplaza{gap}de\b", whole(f"{gap}de"), whole(f"(?:a{gap})?{gap}b"), whole("pla.a"), whole("añ"), whole("ab+"), whole("a de"), whole("(?:a|b)" * 9), whole(""), "(?i)" + whole("ab"), f"(?<!{WORD})ab", whole("a[^a-z]+b"), whole(f"a{gap}b")[4:]):
        assert factors.phrases(other) is None, other


@pytest.mark.parametrize("bounds", [{}, {"BROADCAST_HASHES": 0}])
def test_phrases_are_joined_with_what_the_patterns_match(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(factors, name, value)
    rng = random.Random(5)
    words, gaps = ["abc", "ab", "x9", "kilo", "is", "sin", "7", "a"], [" ", "-", ", ", "\n", "é", "_", "", "ß", "̇", "İ", "ı", "ſ", "K", "Σ"]
    patterns = [whole("[^a-z0-9]+".join(rng.choice(words) for _ in range(n))) for n in (1, 2, 2, 2, 3, 3) for _ in range(5)]
    patterns += [whole(f"{a}[^a-z0-9]+(?:{b}|{c})") for a in words for b, c in (("ab", "abc"), ("kilo", "x9"))] + [r"\bkilo", "sin"]
    texts = [(i, "".join(rng.choice([str.lower, str.upper, str])(rng.choice(words)) + rng.choice(gaps) for _ in range(rng.randrange(9)))) for i in range(500)]
    df = spark.createDataFrame([*texts, (900, None), (901, "Kilo ıS"), (902, "ſin abc"), (903, "İs, x9")], "i int, t string")
    assert indexed(df, spark, patterns) == unrolled(df, patterns) != {}


def test_patterns_of_whole_words_are_not_run(spark):
    """A common word in the lexicon's patterns costs no candidates: they are found by their words, side by side."""
    patterns = [whole(f"common[^a-z0-9]+(?:w{i}|v{i})") for i in range(300)]
    index = factors.indexed(table(spark, patterns))
    assert (index.phrase_rows, index.rows, index.others_count) == (600, 0, 0)
    texts = spark.range(50).select(F.col("id").alias("i"), F.concat(F.lit("Common, W"), F.col("id"), F.lit(" common")).alias("t"))
    found = factors.match_indexed(texts, ["i"], index, "t")
    assert "rlike" not in found._jdf.queryExecution().optimizedPlan().treeString().lower()
    assert {r["i"]: r["matched_keywords"] for r in found.collect()} == {i: [f"p{i}"] for i in range(50)}
