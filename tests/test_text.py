import gc
import unicodedata
import weakref
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nuntia.functions import dates, markup, text


def value(spark, column, given=None):
    return spark.createDataFrame([(given,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("given", ["ÁÉÍÓÚÜÑ áéíóúüñ ç", "Ångström ø ß", "éä", "Ελλάδα ή", "Й", "", "plain"])
def test_strip_accents_follows_decomposition(spark, given):
    assert value(spark, text.strip_accents("x"), given) == text.plain(given)


@pytest.mark.parametrize("given", ["Café", "Cafe", "à̖", "가", "Ω", None])
def test_normalize_unicode(spark, given):
    assert value(spark, text.normalize_unicode("x"), given) == (given and unicodedata.normalize("NFC", given))


def test_cleaning_steps(spark):
    assert value(spark, text.remove_hyphenation("x"), "informá-\ntico y tele- \n comunicación") == "informático y telecomunicación"
    assert value(spark, text.collapse_line_breaks("x"), "uno\ndos\n\n\n\n tres  \tcuatro\n\n \n\ncinco") == "uno dos\n\ntres cuatro\n\ncinco"
    page = "BOLETÍN OFICIAL DE LA PROVINCIA DE LAS PALMAS\nN.º 60 - 20 de mayo de 2026\n  \nTexto ú-\ntil\nFirmado digitalmente por X\n"
    assert value(spark, text.remove_boilerplate("x"), page) == "\nTexto ú-\ntil"
    assert value(spark, text.clean_text("x"), page) == "Texto útil"
    assert value(spark, text.clean_text("x", lowercase=True), page) == "texto útil"
    assert value(spark, text.clean_text("x"), None) == "" == value(spark, text.clean_text("x"), "")


def test_strip_takes_all_white_space(spark):
    assert value(spark, text.strip("x"), " \t\n a b  \x1c") == "a b"


def test_markup(spark):
    assert value(spark, text.sanitize_ampersands("x"), "a&b &amp; &#12; &nbsp; &#xA;") == "a&amp;b &amp; &#12; &amp;nbsp; &#xA;"
    assert value(spark, text.strip_tags("x"), "<b>a</b>\n <i>b </i> c") == "a b c"
    assert value(spark, text.tag_block("x", "h3"), "<H3>a\nb</H3><h3>c</h3>") == "a\nb"
    assert value(spark, text.tag_block("x", "h3"), "<h3 class='z'>a</h3>") is None
    assert value(spark, text.html_unescape("x"), "&lt;a&gt; &eacute;&nbsp;") == "<a> é "
    assert value(spark, text.resolve_url(F.lit("https://a.org/x/y"), F.col("x")), "../z?q=1") == "https://a.org/z?q=1"
    assert value(spark, text.escape_html("x"), "<a href=\"b\">'&'") == "&lt;a href=&quot;b&quot;&gt;&#x27;&amp;&#x27;"
    assert value(spark, text.template("a {b} {c} {d}", b=F.col("x"), c=F.lit("z")), "{c}x") == "a zx z {d}"


def test_decoding(spark):
    def read(raw, fallback=None):
        return spark.createDataFrame([(bytearray(raw),)], "b binary").select(text.decoded("b", fallback).alias("y")).first()["y"]

    assert read("﻿é".encode()) == "é"
    assert read(b"caf\xe9") == "caf�"
    assert read(b"caf\xe9", "ISO-8859-1") == "café"


@pytest.mark.parametrize(
    "f,given,want",
    [
        (dates.day_month_year, "1/6/2026", date(2026, 6, 1)), (dates.day_month_year, "31/02/2026", None), (dates.day_month_year, "2026-06-01", None),
        (dates.iso, "2026-09-30 12:00", date(2026, 9, 30)), (dates.iso, "open", None),
        (dates.rfc_date, "Thu, 21 May 2026 00:00:00 +0200", date(2026, 5, 21)), (dates.rfc_date, "soon", None),
        (dates.spanish_date, "el 11 de Junio de 2025", date(2025, 6, 11)), (dates.spanish_date, "3 de setiembre de 2025", None), (dates.spanish_date, "5/7/2026 o 1 de mayo de 2026", date(2026, 7, 5)),
        (dates.spanish_date, "31/02/2026", None), (dates.spanish_date, None, None),
    ],
)
def test_dates(spark, f, given, want):
    assert value(spark, f("x"), given) == want


def test_cell_date_takes_the_first_cell_with_three_parts(spark):
    row = spark.sql("SELECT array('x', 'A/B/C', '01/02/2026') AS a, array('x', ' 1/ 2/2026 ') AS b, array('x') AS c").select(*[dates.cell_date(c).alias(c) for c in "abc"]).first()
    assert tuple(row) == (None, date(2026, 2, 1), None)


def test_bulletin_urls(spark):
    row = spark.sql("SELECT DATE '2026-05-20' AS d, DATE '2001-12-01' AS e").select(dates.bulletin_url("http://x/b/", F.col("d")).alias("a"), dates.bulletin_url("http://x/b", F.col("e")).alias("b"), dates.compact_url("http://y/", F.col("d")).alias("c")).first()
    assert tuple(row) == ("http://x/b/2026/20-5-26/20-5-26.pdf", "http://x/b/2001/1-12-01/1-12-01.pdf", "http://y/20260520")


def test_html_trees_are_freed_without_the_collector():
    """Elements and their parents hold each other: a tree must go with its document, not when Python looks for such rings."""
    gc.collect()
    gc.disable()
    try:
        with markup.parsed("<ul><li>a</li></ul>") as root:
            item = weakref.ref(root.find("li"))
            assert item().above("ul") is not None
        del root
        assert item() is None
        pages = pa.array(["<p>a</p><script>x</script>b", None, "", *["<b>c</b>"] * 200])
        nodes = lambda: sum(isinstance(x, markup.Node) for x in gc.get_objects())
        before = nodes()
        assert markup.text_function("|").func(pages).to_pylist() == ["a|b", None, "", *["c"] * 200] and nodes() == before
        assert markup.text_function().func(pages.slice(0, 0)).to_pylist() == []
    finally:
        gc.enable()
