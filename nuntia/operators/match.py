"""Two-step matching of paragraphs against a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nuntia.functions.text import col, filled, scrub, strip, strip_accents
from nuntia.operators.lexicon import REJECTED_WORDS, Lexicon, either
from nuntia.schema import NO_ORGANISM, SOURCE_GROUPS


def explode_paragraphs(pages: DataFrame, separator: str = r"\n\n", text: str = "text", fold: bool = False) -> DataFrame:
    """One row per paragraph that isn't blank: para_no, its place in the text from 0, and paragraph, trimmed.

    fold: also folded, the paragraph without accents. It is made while the text is taken apart, so that filters and
    projections above read it instead of each making it again. The outer form is for the same reason: for the plain
    one, Spark adds a filter that takes every text apart a second time.
    """
    parts = F.split(text, separator)
    if fold:
        parts = F.transform(parts, lambda p: F.struct(strip(p).alias("paragraph"), strip_accents(strip(p)).alias("folded")))
        out = pages.select("*", F.posexplode_outer(parts).alias("para_no", "_part")).select("*", "_part.*").drop("_part")
    else:
        out = pages.select("*", F.posexplode_outer(parts).alias("para_no", "paragraph")).withColumn("paragraph", strip("paragraph"))
    return out.where(F.col("paragraph") != "")


def matched(text: Column | str, patterns: list[str], names: list[str]) -> Column:
    """Names of the patterns that occur, in their order. Patterns are literals, so each is compiled once."""
    hits = [F.when(col(text).rlike(p), F.lit(n)) for p, n in zip(patterns, names, strict=True)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def scrubbed_text(folded: Column | str, lexicon: Lexicon) -> Column:
    """Text without accents and without exclusion phrases; one alternation spares most texts the single replacements."""
    patterns = lexicon.folded("exclusions")
    return F.when(col(folded).rlike(either(patterns)), scrub(folded, patterns)).otherwise(col(folded))


def match_terms(paragraphs: DataFrame, lexicon: Lexicon, text: str = "paragraph", excluded: bool = True) -> DataFrame:
    """Step 1 for Spanish sources: rows in which a term occurs once exclusion phrases are taken out; adds
    folded (text without accents) and matched_keywords. One alternation decides before single terms are looked up."""
    out = paragraphs if "folded" in paragraphs.columns else paragraphs.withColumn("folded", strip_accents(text))
    target = scrubbed_text("folded", lexicon) if excluded else F.col("folded")
    out = out.withColumn("scrubbed", target).where(F.col("scrubbed").rlike(either(lexicon.folded("terms"))))
    return out.withColumn("matched_keywords", matched("scrubbed", lexicon.folded("terms"), list(lexicon.terms))).drop("scrubbed")


def require_anchor(paragraphs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Step 2: rows whose folded text, exclusion phrases and all, has an anchor."""
    return paragraphs.where(F.col("folded").rlike(either(lexicon.folded("anchors"))))


def match_english(paragraphs: DataFrame, lexicon: Lexicon, text: str = "paragraph") -> DataFrame:
    """Rows of European sources: English terms in the text as it is, no exclusions and no anchors."""
    patterns = lexicon.raw("english_terms")
    hits = paragraphs.where(F.col(text).rlike(either(patterns)))
    return hits.withColumn("matched_keywords", matched(text, patterns, list(lexicon.english_terms)))


def findings_of(matches: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Matches in the schema of findings, and the columns in also."""
    return matches.select("doc_id", "ordinal", "para_no", filled("detected_organism", F.lit(NO_ORGANISM)).alias("organism"), F.col("paragraph").alias("description"), "page_number", "matched_keywords", "source", "url", *(also or []))


def find(pages: DataFrame, lexicon: Lexicon | None = None, separator: str = r"\n\n", also: list[str] | None = None) -> DataFrame:
    """Findings in pages, each source by its own rule, in one pass over the pages.

    The filter tries anchors first, whose alternation is the cheaper one, and the alternation of all terms only for
    what that leaves; single terms are looked up in the few rows that pass both.
    """
    lexicon = lexicon or Lexicon()
    rows = explode_paragraphs(pages, separator, fold=True).withColumn("european", F.coalesce(F.col("source").isin(*SOURCE_GROUPS["EU"]), F.lit(False)))
    folded = F.col("folded")
    scrubbed = scrubbed_text(folded, lexicon)
    spanish = folded.rlike(either(lexicon.folded("anchors"))) & scrubbed.rlike(either(lexicon.folded("terms")))
    english = F.col("paragraph").rlike(either(lexicon.raw("english_terms")))
    hits = rows.where(F.when(F.col("european"), english).otherwise(spanish))
    target = F.when(F.col("european"), F.col("paragraph")).otherwise(scrubbed)
    hits = hits.withColumn("target", target)
    english_terms = matched("target", lexicon.raw("english_terms"), list(lexicon.english_terms))
    terms = matched("target", lexicon.folded("terms"), list(lexicon.terms))
    return findings_of(hits.withColumn("matched_keywords", F.when(F.col("european"), english_terms).otherwise(terms)), also)


def rejects_title(title: Column | str, lexicon: Lexicon | None = None) -> Column:
    """Whether a title is to be dropped: always with some words, with others unless a term occurs. Empty titles stay."""
    lexicon = lexicon or Lexicon()
    folded = strip_accents(F.coalesce(col(title), F.lit("")))
    has = lambda field: folded.rlike(either(lexicon.folded(field)))
    return has("reject_always") | (has("reject_unless_term") & ~has("terms"))


def rejects_words(title: Column | str, words: tuple[str, ...] = REJECTED_WORDS) -> Column:
    """Whether a word of the list occurs in the title, without case and accents."""
    return strip_accents(F.lower(col(title))).rlike("|".join(words))
