"""Text functions as columns. Regular expressions follow Java; (?U) gives \\w, \\s and \\d their Unicode sense."""

from __future__ import annotations

import html
import sys
import unicodedata
from functools import lru_cache, reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ends a line, and what counts as white space, as a pattern and as single characters.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
SPACE = r"[\s\x1C-\x1F]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Lines with these patterns are page headers, footers and signatures of printed bulletins.
BOILERPLATE = (
    r"bolet[ií]n\s+oficial\s+de\s+la\s+provincia\s+de\s+las\s+palmas",
    r"n[oº\.\s]*\d+\s+-\s+\d+\s+de\s+[a-z]+\s+de\s+\d{4}",
    r"bop\s+las\s+palmas\s+-\s+n[oº\.\s]*\d+",
    r"c[oó]digo\s+de\s+verificaci[oó]n\s+electr[oó]nica",
    r"firmado\s+digitalmente\s+por",
)
#: An ampersand that starts no entity known to XML.
BARE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#[xX][a-fA-F0-9]+);)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java(pattern: str, case: bool = False) -> str:
    """A pattern with Unicode classes, and without case unless `case`."""
    return ("(?U)" if case else "(?iuU)") + pattern


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (trim() alone takes spaces only). Looks at the ends only."""
    return F.btrim(col(c), F.lit(SPACES))


def squeezed(c: Column | str) -> Column:
    """Every run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(col(c), rf"(?U){SPACE}+", " "))


def filled(c: Column | str, *others: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(x), F.lit("")) for x in (c, *others)])


# Unicode normal forms ---------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize_unicode(c: Column | str) -> Column:
    """NFC. Text whose characters all lie below U+0300 is composed already and doesn't go to Python."""
    c = col(c)
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\u02FF]"), c)), c)


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character with marks, and these base characters."""
    pairs = []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", char) if unicodedata.category(x) != "Mn")
        if base != char and len(base) == 1:
            pairs.append((char, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain(text: str) -> str:
    """Python twin of strip_accents, for patterns."""
    return "".join(x for x in unicodedata.normalize("NFD", text) if unicodedata.category(x) != "Mn")


def strip_accents(c: Column | str) -> Column:
    """Letters without marks, by a translation table and so inside the JVM. Only Hangul stays composed. Text in ASCII,
    as its number of bytes tells, has none and is left alone."""
    text = col(c)
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.regexp_replace(F.translate(text, *_folds()), r"\p{Mn}", ""))


# Cleaning ---------------------------------------------------------------------------------------------------------


def lines(c: Column | str) -> Column:
    return F.split(F.regexp_replace(col(c), rf"(?:{LINE_END})\z", ""), LINE_END)


def remove_boilerplate(c: Column | str, patterns: tuple[str, ...] = BOILERPLATE) -> Column:
    """Without the lines in which a pattern occurs; blank lines become empty ones."""
    drop = java("|".join(f"(?:{p})" for p in patterns))
    blank = F.transform(lines(c), lambda line: F.when(strip(line) == "", "").otherwise(line))
    return F.array_join(F.filter(blank, lambda line: ~strip(line).rlike(drop)), "\n")


def remove_hyphenation(c: Column | str) -> Column:
    """Words that a hyphen breaks at a line end, joined."""
    return F.regexp_replace(col(c), r"(?U)(\w+)-\s*\n\s*(\w+)", "$1$2")


def collapse_line_breaks(c: Column | str) -> Column:
    """Single line breaks and runs of blanks as one space; paragraphs, trimmed and not empty, two line breaks apart."""
    text = F.regexp_replace(col(c), r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.array_join(F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != ""), "\n\n")


def clean_text(c: Column | str, lowercase: bool = False) -> Column:
    """All cleaning steps in order; null gives an empty text."""
    text = collapse_line_breaks(remove_hyphenation(remove_boilerplate(normalize_unicode(col(c)))))
    return F.coalesce(F.lower(text) if lowercase else text, F.lit(""))


def scrub(c: Column | str, patterns: list[str]) -> Column:
    """A space in place of each pattern's matches, one pattern after another."""
    return reduce(lambda text, p: F.regexp_replace(text, p, " "), patterns, col(c))


# Markup -----------------------------------------------------------------------------------------------------------


def sanitize_ampersands(c: Column | str) -> Column:
    return F.regexp_replace(col(c), BARE_AMPERSAND, "&amp;")


def strip_tags(c: Column | str) -> Column:
    return squeezed(F.regexp_replace(col(c), r"<[^>]+>", ""))


def tag_block(c: Column | str, tag: str) -> Column:
    """Content of the first <tag> without attributes, null if there is none."""
    pattern = rf"(?is)<{tag}>(.*?)</{tag}>"
    return F.when(col(c).rlike(pattern), F.regexp_extract(col(c), pattern, 1))


def tag_blocks(c: Column | str, tag: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """All HTML entities decoded."""
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """href relative to base, by RFC 3986."""
    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href, strict=True)], dtype=object)


def root_relative(base: str, c: Column | str) -> Column:
    """resolve_url for a site's root and hrefs that are absolute or start with a slash, inside the JVM."""
    return F.when(col(c).startswith("/"), F.concat(F.lit(base.rstrip("/")), col(c))).otherwise(col(c))


def escape_markup(c: Column | str) -> Column:
    """&, < and > as entities."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), col(c))


def escape_html(c: Column | str) -> Column:
    """Quotation marks too."""
    return F.replace(F.replace(escape_markup(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def truncated(c: Column | str, most: int, mark: str = "") -> Column:
    """At most `most` characters, then the mark if something was cut."""
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit(mark))).otherwise(col(c))


def decoded(content: Column | str, fallback: str | None = None) -> Column:
    """Bytes as UTF-8 without a byte order mark: invalid ones replaced, or everything read in another charset."""
    raw = col(content).cast("string")
    text = F.make_valid_utf8(raw) if fallback is None else F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(col(content), fallback))
    return F.regexp_replace(text, "\\A\ufeff", "")


def template(text: str, **values: Column) -> Column:
    """text with {name} replaced by values; other braces stay as they are."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), F.lit(text))
