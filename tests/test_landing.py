import shutil
from datetime import date
from pathlib import Path

import pytest

from nuntia.__main__ import main
from nuntia.functions.register import register_functions
from nuntia.plans.landing import days_of, scan_landing
from nuntia.plans.scan import ScanOptions
from nuntia.sources.feed import fetch_each

HERE = Path(__file__).parent / "fixtures"


@pytest.fixture
def zone(tmp_path):
    def put(name, source, day):
        where = tmp_path / source / day
        where.mkdir(parents=True, exist_ok=True)
        shutil.copy(HERE / name, where)

    put("state.xml", "BOE", "2026-05-20")
    put("regional.xml", "BOC", "2026-05-21")
    put("vacancies.csv", "EPSO", "2026-05-01")
    put("vacancies.csv", "EPSO", "2026-06-01")
    (tmp_path / "BOE" / "notes").mkdir()
    return str(tmp_path)


def sources(df):
    return sorted({r["source"] for r in df.collect()})


def test_days_issues_and_fallbacks(spark, zone, monkeypatch):
    assert days_of(spark, zone, "EPSO") == [date(2026, 6, 1), date(2026, 5, 1)] and days_of(spark, zone, "BOP") == [] == days_of(spark, zone, "AENA")
    options = ScanOptions(sources=("BOC", "BOE", "EPSO"))
    # a day that was asked for has no stand-in
    assert sources(scan_landing(spark, zone, options, date(2026, 5, 21))) == ["BOC", "EPSO"]
    assert sources(scan_landing(spark, zone, options, date(2026, 5, 20))) == ["BOE", "EPSO"]
    assert scan_landing(spark, zone, options, date(2026, 4, 1)).count() == 0
    import nuntia.plans.landing as landing

    class Day(date):
        @classmethod
        def today(cls):
            return date(2026, 5, 22)

    monkeypatch.setattr(landing, "date", Day)
    # without a day the state bulletin falls back to the latest issue, but not in scheduled runs
    assert sources(scan_landing(spark, zone, options)) == ["BOE", "EPSO"]
    assert sources(scan_landing(spark, zone, options, scheduled=True)) == ["EPSO"]


def test_command_line(spark, zone, tmp_path, capsys):
    out = tmp_path / "r.html"
    assert main(["--file", str(HERE / "regional.xml"), "--output", str(out)], spark) == 0
    assert "Total Findings: 3" in out.read_text(encoding="utf-8") and "3 findings" in capsys.readouterr().out
    out = tmp_path / "r.md"
    assert main(["--landing", zone, "--date", "2026-04-01", "-s", "ES", "-s", "EPSO", "--output", str(out)], spark) == 1
    assert main(["--landing", zone, "--date", "2026-05-20", "-s", "BOE", "--output", str(out)], spark) == 0
    for wrong in (["--file", "x", "--date", "2026-01-01"], [], ["--landing", "x", "--date", "1/1/26"]):
        with pytest.raises(SystemExit):
            main(wrong, spark)


def test_fetching_details(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "url string")

    def fetch(url):
        return "página" if url == "a" else 1 / 0

    rows = {r["url"]: r for r in fetch_each(df, "url", fetch).collect()}
    assert bytes(rows["a"]["content"]).decode() == "página" and rows["b"]["error"].startswith("ZeroDivisionError") and len(rows) == 2


def test_sql_functions(spark):
    assert len(register_functions(spark)) == 5
    row = spark.sql("SELECT normalize_unicode('é') a, fold_accents('Ñandú') b, html_unescape('&eacute;') c, html_text('<p>x</p><p>y</p>') d, resolve_url('http://a/b/', '../c') e").first()
    assert tuple(row) == ("é", "Nandu", "é", "x\ny", "http://a/c")
