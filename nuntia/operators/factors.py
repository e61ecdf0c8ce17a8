r"""Matching against lexicons of any size, by an index of what patterns can't match without.

A pattern such as `\bplazas?\s+de\s+(?:inform[aá]tic|telecomunic)` can't match a text that lacks `plaza`, nor one that lacks
both `inform` and `telecomunic`. Such fragments of letters and digits are read off each pattern; of several that are
all needed, the ones least common in the lexicon are its key. Patterns become a table of grams (beginnings of the
fragments), texts are taken apart into the grams that the table has at all, and a join gives each text the few
patterns that may match it. Only these are run. Plan and code are the same for ten patterns and for a million, where
unrolled patterns would each be a part of the plan and be run on every text.

Texts and fragments are compared with case folded away, more coarsely than any pattern does, so nothing is lost. Patterns
without a fragment of at least SHORT characters are run on every text.

Patterns that are whole words of a-z and 0-9 with anything else between them, such as
`(?<![a-z0-9])base[^a-z0-9]+(?:legal|text)(?![a-z0-9])`, aren't run at all: a text matches if and only if the words stand in
it side by side, so its runs of words are joined with those of the patterns.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nuntia.functions.text import col
from nuntia.operators.joins import union_all
from nuntia.operators.match import matched
from nuntia.operators.stored import stored

#: Characters of the shortest and longest gram.
SHORT, LONG = 3, 5
#: Bits that tell a text's grams apart from those of no pattern: part of the plan, and so of a fixed size.
BITS = 1 << 17
#: Rows of the index up to which it is broadcast, and patterns without fragments up to which they are unrolled.
BROADCAST_ROWS, UNROLLED = 200_000, 100
FRAGMENT = re.compile(rf"[^\W_]{{{SHORT},}}")
#: Words of the longest phrase and different phrases of a pattern up to which it is taken for phrases, and phrases of the index
#: up to which their hashes are broadcast.
WORDS, VARIANTS, BROADCAST_HASHES = 6, 64, 4_000_000
#: The class of characters of words, as parsed, and all other characters that patterns without case take for one of them.
WORD_CLASS, ALSO_WORD = [("RANGE", (97, 122)), ("RANGE", (48, 57))], ("ſ\u212aİı", "skii")


def folded(c: Column | str) -> Column:
    """Without case: characters that some pattern takes for the same become the same. Between upper and lower stands another
    step, as Spark takes lower(upper(x)) for lower(x), which keeps a long s."""
    return F.translate(F.lower(F.translate(F.upper(col(c)), "İ", "I")), "ςı̇", "σi")


def required(items) -> list[list[str]]:
    """What every match of a parsed pattern holds: lists of fragments, of each at least one."""
    out: list[list[str]] = []
    run = ""

    def ended() -> None:
        nonlocal run
        out.extend([f] for f in FRAGMENT.findall(run))
        run = ""

    def walk(sequence) -> None:
        nonlocal run
        for op, value in sequence:
            kind = str(op)
            if kind == "LITERAL":
                run += chr(value)
            elif kind == "SUBPATTERN":
                walk(value[3])
            elif kind == "ATOMIC_GROUP":
                walk(value)
            elif kind == "AT":
                continue
            else:
                ended()
                if kind.endswith("_REPEAT") and value[0] > 0:
                    out.extend(required(value[2]))
                elif kind == "BRANCH":
                    branches = [required(b) for b in value[1]]
                    if all(branches):
                        out.append(sorted({f for b in branches for f in max(b, key=lambda fs: min(map(len, fs)))}))

    walk(items)
    ended()
    return out


def is_class(items, *first: tuple) -> bool:
    """Whether a parsed pattern is one character of the class of words, or with a negation first, one that isn't."""
    return len(items) == 1 and str(items[0][0]) == "IN" and [(str(op), value) for op, value in items[0][1]] == [*first, *WORD_CLASS]


def spelled(items) -> list[str] | None:
    """All that a parsed pattern matches, with one space for each gap between words; none if that isn't so simple."""
    out = [""]
    for op, value in items:
        kind = str(op)
        parts: list[str] | None = None
        if kind == "LITERAL" and chr(value).isascii() and chr(value).isalnum():
            parts = [chr(value).lower()]
        elif kind == "IN":
            chars = [spelled([x]) if str(x[0]) == "LITERAL" else None for x in value]
            parts = None if None in chars else [c for found in chars for c in found]
        elif kind == "SUBPATTERN" and not value[1] and not value[2]:
            parts = spelled(value[3])
        elif kind == "BRANCH":
            branches = [spelled(b) for b in value[1]]
            parts = None if None in branches else [s for b in branches for s in b]
        elif kind == "MAX_REPEAT" and tuple(value[:2]) == (0, 1) and (inner := spelled(value[2])) is not None:
            parts = ["", *inner]
        elif kind == "MAX_REPEAT" and value[0] == 1 and str(value[1]) == "MAXREPEAT" and is_class(value[2], ("NEGATE", None)):
            parts = [" "]
        if parts is None:
            return None
        out = sorted({a + b for a in out for b in parts})
        if len(out) > VARIANTS:
            return None
    return out


def phrases(pattern: str) -> list[str] | None:
    """Words side by side, one space apart, one of which every match of a pattern is and which match wherever they are whole
    words; none for patterns that aren't just that."""
    from re import _parser

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    items = list(parsed)
    if parsed.state.flags & ~re.UNICODE or len(items) < 3 or [str(items[i][0]) for i in (0, -1)] != ["ASSERT_NOT"] * 2:
        return None
    if any(items[i][1][0] != way or not is_class(items[i][1][1]) for i, way in ((0, -1), (-1, 1))):
        return None
    found = spelled(items[1:-1])
    return found if found and all(0 < len(p.split(" ")) <= WORDS and all(p.split(" ")) for p in found) else None


def fragments(pattern: str) -> list[list[str]] | None:
    """required() of a pattern as written; none if it can't be read or needs nothing."""
    from re import _parser

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return required(_parser.parse(pattern)) or None
    except (re.error, RecursionError, OverflowError):
        return None


@F.pandas_udf(T.StructType([T.StructField("needs", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("phrases", T.ArrayType(T.StringType()))]))
def parts_of(patterns: pd.Series, without_case: pd.Series) -> pd.DataFrame:
    """phrases of the patterns that are just that and are run without case, needs of the others."""
    spelt = [phrases(p) if same else None for p, same in zip(patterns, without_case, strict=True)]
    return pd.DataFrame({"needs": pd.Series([fragments(p) if s is None else None for p, s in zip(patterns, spelt, strict=True)], dtype=object), "phrases": pd.Series(spelt, dtype=object)})


@dataclass(frozen=True)
class Index:
    """grams: gram, fragment, name, pattern, needs. lengths: those of grams. bits: a gram's hash in the table, as longs.
    others: name and pattern of what has no fragment. phrases: phrase, name; words: how many words phrases have; phrase_rows: their
    number."""

    grams: DataFrame
    lengths: list[int]
    bits: list[int]
    rows: int
    others: DataFrame
    others_count: int
    phrases: DataFrame
    words: list[int]
    phrase_rows: int


def at_bit(gram: Column) -> tuple[Column, Column]:
    """Number of the long and of the bit in it that stand for a gram."""
    h = F.xxhash64(gram).bitwiseAND(F.lit(BITS - 1))
    return F.call_function("shiftright", h, F.lit(6)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def indexed(patterns: DataFrame, flags: str = "(?iuU)") -> Index:
    """The index of a table of patterns (name, pattern). flags: set before each pattern when it is run."""
    without_case = F.lit({"i", "u"} <= set(flags))
    parts = patterns.where("pattern IS NOT NULL").select("name", "pattern", parts_of("pattern", without_case).alias("_parts"))
    needs = F.transform("_parts.needs", lambda any_of: F.transform(any_of, folded))
    read = stored(parts.select("name", F.concat(F.lit(flags), "pattern").alias("pattern"), needs.alias("needs"), "_parts.phrases"), "patterns")
    groups = read.where("needs IS NOT NULL").select("name", "pattern", "needs", F.posexplode("needs").alias("set", "any_of"))
    rows = groups.select("name", "pattern", "needs", "set", F.explode("any_of").alias("fragment"))
    rows = rows.withColumn("gram", F.substring("fragment", 1, LONG))
    common = rows.groupBy("gram").agg(F.count("*").alias("n"))
    rows = stored(rows.join(common, "gram").select("name", "pattern", "needs", "set", "fragment", "gram", "n"), "fragments")
    # of what a pattern needs, the list whose grams stand for the fewest patterns, and of these the longest
    best = rows.groupBy("name", "pattern", "set").agg(F.sum("n").alias("n"), F.min(F.length("fragment")).alias("size"))
    best = best.groupBy("name", "pattern").agg(F.min_by("set", F.struct("n", -F.col("size"), "set")).alias("set"))
    grams = stored(rows.join(best, ["name", "pattern", "set"]).select("gram", "fragment", "name", "pattern", "needs").distinct(), "grams")
    words = [0] * (BITS // 64)
    word, bit = at_bit(F.col("gram"))
    for r in grams.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).collect():
        words[r["word"]] = r["bits"]
    sizes = grams.groupBy(F.length("gram").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()
    others = read.where("needs IS NULL AND phrases IS NULL").select("name", "pattern")
    spelt = stored(read.where("phrases IS NOT NULL").select("name", F.explode("phrases").alias("phrase")).distinct(), "phrases")
    runs = spelt.groupBy(F.size(F.split("phrase", " ")).alias("words")).agg(F.count("*").alias("n")).orderBy("words").collect()
    return Index(grams, [r["size"] for r in sizes], words, sum(r["n"] for r in sizes), others, others.count(), spelt, [r["words"] for r in runs], sum(r["n"] for r in runs))


def grams_in(text: Column, index: Index) -> Column:
    """The different grams of a folded text that some pattern may have."""
    each = [F.regexp_extract_all(text, F.lit(rf"(?=([\p{{L}}\p{{N}}]{{{n}}}))"), F.lit(1)) for n in index.lengths]
    bits = F.from_json(F.lit(str(index.bits)), "array<bigint>")

    def known(gram: Column) -> Column:
        word, bit = at_bit(gram)
        return F.call_function("shiftright", F.get(bits, word), bit).bitwiseAND(F.lit(1).cast("long")) == 1

    return F.filter(F.array_distinct(F.concat(*each)), known)


def words_in(text: Column) -> Column:
    """Words of a text in lower case: runs of what patterns without case take for a-z and 0-9."""
    plain = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, *ALSO_WORD))
    return F.regexp_extract_all(F.lower(plain), F.lit("[a-z0-9]+"), F.lit(0))


def phrase_hits(texts: DataFrame, keys: list[str], index: Index) -> DataFrame:
    """keys and name for each phrase of the index in a text (column _text).

    All runs of words meet the hashes of the phrases where they are; only those that a hash lets through travel.
    """
    words, most = F.col("_words"), max(index.words)
    runs = F.arrays_zip(*[F.slice(words, i + 1, F.size(words)).alias(f"w{i}") for i in range(most)])
    # outer, as for the plain form Spark makes all words a second time to drop texts without any
    rows = texts.select(*keys, words_in(F.col("_text")).alias("_words")).select(*keys, F.explode_outer(F.when(F.size(words) > 0, runs)).alias("_run"))
    joined = [F.concat(*[x for i in range(n) for x in (F.lit(" "), F.col(f"_run.w{i}"))][1:]) for n in index.words]
    rows = rows.select(*keys, (joined[0] if len(joined) == 1 else F.explode_outer(F.array(*joined))).alias("phrase")).where("phrase IS NOT NULL")
    if index.phrase_rows <= BROADCAST_HASHES:
        hashes = index.phrases.select(F.xxhash64("phrase").alias("_hash")).distinct()
        rows = rows.withColumn("_hash", F.xxhash64("phrase")).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")
    return rows.distinct().join(index.phrases, "phrase").select(*keys, "name")


def hits(texts: DataFrame, keys: list[str], index: Index, text: str = "folded") -> DataFrame:
    """keys and name of every pattern that matches a text, each once. keys tell the rows apart."""
    rows = texts.select(*keys, col(text).alias("_text"))
    parts = [phrase_hits(rows, keys, index)] if index.words else []
    if index.lengths:
        parts.append(gram_hits(rows.withColumn("_folded", folded("_text")), keys, index))
    if index.others_count > UNROLLED:
        parts.append(rows.join(F.broadcast(index.others), F.rlike("_text", F.col("pattern"))).select(*keys, "name"))
    elif index.others_count:
        others = index.others.collect()
        names = matched("_text", [r["pattern"] for r in others], [r["name"] for r in others])
        parts.append(rows.select(*keys, F.explode(names).alias("name")))
    return union_all(parts or [rows.select(*keys, F.lit("").alias("name")).where(F.lit(False))]).distinct()


def gram_hits(rows: DataFrame, keys: list[str], index: Index) -> DataFrame:
    """keys and name for each pattern with fragments that matches a text (columns _text and _folded)."""
    grams = F.explode(grams_in(F.col("_folded"), index)).alias("gram")
    if index.rows <= BROADCAST_ROWS:
        candidates = rows.select("*", grams).join(F.broadcast(index.grams), "gram")
    else:  # texts don't travel with their grams
        candidates = rows.select(*keys, grams).join(index.grams, "gram").join(rows, keys)
    # looking for fragments costs far less than a pattern, which is compiled for each row
    held = F.forall("needs", lambda any_of: F.exists(any_of, lambda f: F.col("_folded").contains(f)))
    return candidates.where(F.col("_folded").contains(F.col("fragment")) & held).where(F.rlike("_text", F.col("pattern"))).select(*keys, "name")


def match_indexed(texts: DataFrame, keys: list[str], index: Index, text: str = "folded") -> DataFrame:
    """keys and matched_keywords, sorted, of the texts in which a pattern occurs."""
    return hits(texts, keys, index, text).groupBy(*keys).agg(F.array_sort(F.collect_list("name")).alias("matched_keywords"))
