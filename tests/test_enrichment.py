import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nuntia.__main__ import main
from nuntia.operators import windows
from nuntia.plans.landing import run_scheduled, scan_landing
from nuntia.plans.scan import ScanOptions, pages_of, scan
from nuntia.functions.tables import register_tables
from nuntia.sources import boe, epso

HERE = Path(__file__).parent / "fixtures"
LISTED = "https://empleo.aena.es/empleo/PFSrv?accion=aviso&codigo=1"


def file(name):
    return str(HERE / name)


def reader():
    def extract(content):
        return content.decode().split("\x0c") if content != b"broken" else 1 / 0

    return extract  # made here, as executors can't import this module


extract = reader()


def web(pages):
    def fetch(address):
        if address not in pages:
            raise OSError(f"no route to {address}")
        return pages[address]

    return fetch


def texts(df):
    return [r["text"] for r in df.orderBy("ordinal", "page_number").collect()]


def test_notices_of_the_state_bulletin_are_read_from_their_documents(spark):
    fetch = web({"https://example.org/1.pdf": b"Se convoca plaza de T\xc3\xa9cnico de Inform\xc3\xa1-\ntica mediante convocatoria.\x0cdos", "https://example.org/2.pdf": b"broken"})
    got = texts(pages_of(spark, "BOE", file("state.xml"), ScanOptions(fetch=fetch, extract_pdf=extract)))
    # no document, a document that can't be read, and one that can't be had: the title
    assert got[:3] == ["[X-1] (PDF Pag 1) Se convoca plaza de Técnico de Informática mediante convocatoria.", "[X-1] (PDF Pag 2) dos", "[X-2] Convocatoria del cuerpo de Abogados."] and len(got) == 6
    found = scan(spark, {"BOE": file("state.xml")}, ScanOptions(fetch=fetch, extract_pdf=extract))
    assert any("(PDF Pag 1)" in r["description"] for r in found.collect())


def test_airport_entries_are_read_from_the_documents_of_their_detail_pages(spark):
    detail = (HERE / "airport_detail.html").read_text()
    site = "https://empleo.aena.es/empleo/"
    options = ScanOptions(as_of=date(2026, 7, 15), extract_pdf=extract, fetch=web({LISTED: detail, f"{site}documentos?get=1": b"uno\x0c\x0ctres", f"{site}PFSrv?docId=2": b"broken"}))
    got = texts(pages_of(spark, "AENA", file("airport_list.html"), options))
    name = "CONVOCATORIA: Técnico Informática y Sistemas"
    assert got == [f"{name}\n\nuno", f"{name}\n\ntres", "CONVOCATORIA: Fecha rara Fecha fin inscripción: Desconocida"]
    bare = ScanOptions(as_of=date(2026, 7, 15), extract_pdf=extract, fetch=web({LISTED: "<html></html>"}))
    assert texts(pages_of(spark, "AENA", file("airport_list.html"), bare)) == [got[2]]  # no documents: dropped


def test_company_entries_are_read_from_their_detail_pages(spark):
    fetch = web({"https://www.sagulpa.com/ofertas-empleo/1": (HERE / "company_detail.html").read_text()})
    got = texts(pages_of(spark, "SAGULPA", file("company_list.html"), ScanOptions(as_of=date(2026, 7, 8), fetch=fetch)))
    assert got == ["Programador de sistemas\nFecha de publicación: 08/07/2026\n\nSe ofrece plaza de programador.", "Peón Fecha de publicación: 08/07/2026"]


def test_addresses_are_fetched_once(spark, tmp_path):
    log = tmp_path / "log"
    pages = {LISTED: (HERE / "airport_detail.html").read_text()}

    def fetch(address):
        with open(log, "a") as f:
            f.write(address + "\n")
        return pages.get(address, b"text")

    pages_of(spark, "AENA", file("airport_list.html"), ScanOptions(as_of=date(2026, 7, 15), extract_pdf=extract, fetch=fetch)).collect()
    asked = log.read_text().split()
    assert len(asked) == len(set(asked)) >= 3


@pytest.fixture
def zone(tmp_path):
    import shutil

    for name, source, day in (("state.xml", "BOE", "2026-05-21"), ("regional.xml", "BOC", "2026-05-20"), ("regional.xml", "BOC", "2026-05-21"), ("regional.xml", "BOC", "2026-05-22"), ("vacancies.csv", "EPSO", "2026-05-01")):
        (tmp_path / source / day).mkdir(parents=True)
        shutil.copy(HERE / name, tmp_path / source / day)
    (tmp_path / "BOP" / "2026-05-21").mkdir(parents=True)
    (tmp_path / "BOP" / "2026-05-21" / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "EURES" / "2026-05-21").mkdir(parents=True)
    (tmp_path / "EURES" / "2026-05-21" / "a.json").write_text("broken")
    return str(tmp_path)


def test_sources_fail_alone(spark, zone):
    errors = {}
    found = scan_landing(spark, zone, ScanOptions(), date(2026, 5, 21), errors=errors)
    assert {r["source"] for r in found.collect()} == {"BOC", "BOE", "EPSO"}
    assert set(errors) == {"BOP", "EURES"} and "extract_pdf" in errors["BOP"] and "broken vacancies" in errors["EURES"]
    with pytest.raises(ValueError, match="extract_pdf"):
        scan_landing(spark, zone, ScanOptions(), date(2026, 5, 21))


def test_regional_items_of_the_day_only(spark, zone, monkeypatch):
    import nuntia.plans.landing as landing

    options = ScanOptions(sources=("BOC",))
    by_day = {d: {r["url"][-6] for r in scan_landing(spark, zone, options, date(2026, 5, d)).collect()} for d in (20, 21, 22)}
    assert len(by_day[21]) >= 1 and not by_day[20] & by_day[21] and by_day[22] == set()

    class Day(date):
        @classmethod
        def today(cls):
            return date(2026, 5, 22)

    monkeypatch.setattr(landing, "date", Day)
    assert {r["url"][-6] for r in scan_landing(spark, zone, options).collect()} == by_day[21]  # the latest day in the feeds
    assert scan_landing(spark, zone, options, scheduled=True).count() == 0


def test_scheduled_runs_send_findings(spark, zone):
    sent = []
    channels = {"a": lambda f: 1 / 0, "b": lambda f: sent.extend(f.collect()) or len(sent)}
    options = ScanOptions(sources=("BOC", "BOE", "BOP"), classify=lambda request: [{"id": 0, "is_tech_job": "Técnico de Sistemas" not in request}])
    out = run_scheduled(spark, zone, options, channels, date(2026, 5, 21))
    assert out["status"] == 200 and out["findings"] == len(sent) > 0 and out["sent"]["b"] == len(sent) and "ZeroDivisionError" in out["sent"]["a"] and set(out["errors"]) == {"BOP"}
    assert run_scheduled(spark, zone, ScanOptions(sources=("BOP",)), channels, date(2026, 5, 21))["status"] == 500
    quiet = run_scheduled(spark, zone, options, channels, date(2026, 1, 1))
    assert (quiet["findings"], quiet["sent"]) == (0, {})


def test_command_line_hooks(spark, zone, tmp_path, monkeypatch, capsys):
    (tmp_path / "hooks.py").write_text("SENT = []\ndef no(request):\n    return [{'id': i, 'is_tech_job': False} for i in range(10)]\ndef post(payload):\n    SENT.append(payload)\ndef pdf(content):\n    return ['III. ADMINISTRACIÓN LOCAL\\nnada']\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    prompt = tmp_path / "prompt.txt"
    prompt.write_text("Which of {jobs_json}?")
    common = ["--landing", zone, "--date", "2026-05-21", "-s", "BOC", "-s", "BOP", "--output", str(tmp_path / "r.md"), "--extract-pdf", "hooks:pdf"]
    assert main([*common, "--notify-cards", "hooks:post", "--notify-texts", "hooks:post"], spark) == 0
    import hooks

    assert any("embeds" in json.loads(p) for p in hooks.SENT if p.startswith("{")) and any(p.startswith("📌") for p in hooks.SENT)
    assert "cards: 1" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([*common, "--classifier", "hooks:missing"], spark)


def test_files_of_different_charsets(spark, tmp_path):
    head = "Agency,Title,Location,Contract,Grade,Deadline,Link\n"
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + f"{head}Ñandú,DBA,,,,,\n\"two\nlines\",x,,,,,\nthird,y,,,,,\n".encode())
    (tmp_path / "b.csv").write_bytes(f"{head}École,DBA,,,,,\n".encode("latin-1"))
    rows = epso.pages(epso.read_rows(spark, str(tmp_path))).orderBy("doc_id", "ordinal").collect()
    assert [(r["detected_organism"], r["ordinal"]) for r in rows] == [("Ñandú", 1), ("two\nlines", 2), ("third", 3), ("École", 1)]


def test_each_vacancy_file_has_its_own_headers(spark, tmp_path):
    """Same headers in another order, whatever the order of files; other names; a file that lacks one."""
    (tmp_path / "a.csv").write_text("Agency,Title,Location,Contract,Grade,Deadline,Link\nAgencyA,DBA,Rome,TA,AD5,2031-01-01,http://a\n")
    (tmp_path / "b.csv").write_text("Link,Deadline,Grade,Contract,Location,Title,Agency\nhttp://b,2020-01-01,FG4,CA,Oslo,Clerk,AgencyB\n")
    (tmp_path / "c.csv").write_text("TITLE,Institution/Agency,Parent-Location,Type of Contract,grade,Deadline\nCook,AgencyC,Vigo,TA,AD1\n")
    want = {("AgencyA", "http://a", "Position: DBA"), ("AgencyB", "http://b", "Position: Clerk"), ("AgencyC", epso.PORTAL, "Position: Cook")}
    shown = lambda df: {(r["detected_organism"], r["url"], r["text"].split("\n")[0]) for r in df.collect()}
    files = [str(tmp_path / f"{n}.csv") for n in "abc"]
    assert shown(epso.pages(epso.read_rows(spark, files))) == want == shown(epso.pages(epso.read_rows(spark, files[::-1])))
    day = F.lit("2026-01-01").cast("date")
    assert {a for a, _, _ in shown(epso.pages(epso.read_rows(spark, files), day))} == {"AgencyA", "AgencyC"}
    (tmp_path / "d.csv").write_text("Agency,Title\nx,y\n")
    with pytest.raises(Exception, match="lack .*location"):
        epso.read_rows(spark, str(tmp_path)).collect()
    assert shown(epso.pages(epso.read_rows(spark, str(tmp_path), "drop"))) == want


def test_table_functions_in_sql(spark):
    assert register_tables(spark, lambda content: content.decode().split("|")) == ["csv_rows", "html_links", "pdf_pages"]
    spark.createDataFrame([("a", "B;x,A\n1,2\n,\n"), ("b", None), ("c", "a,b\n\"q\n\"\"r\"\"\",4")], "d string, t string").createOrReplaceTempView("csv_texts")
    rows = spark.sql("SELECT d, r.* FROM csv_texts, LATERAL csv_rows(t, 'a=a, b~b|bee, c=c?', 'fail') r ORDER BY d, row")
    assert rows.columns == ["d", "row", "a", "b", "c"] and [tuple(r) for r in rows.collect()] == [("a", 1, "2", "1", ""), ("a", 2, "", "", ""), ("c", 1, 'q\n"r"', "4", "")]
    links = spark.sql("SELECT l.* FROM VALUES ('<p><a href=x>one</a><a>two</a>') v(t), LATERAL html_links(t) l")
    assert [tuple(r) for r in links.collect()] == [(0, "x", "one"), (1, "", "two")]
    assert [tuple(r) for r in spark.sql("SELECT p.* FROM VALUES (CAST('p|q' AS BINARY)) v(c), LATERAL pdf_pages(c) p").collect()] == [(1, "p"), (2, "q")]


def test_state_items_at_any_depth_in_order_of_the_document(spark):
    item = lambda ident, title: f"<item><identificador>{ident}</identificador><titulo>{title}</titulo></item>"
    xml = (
        f"<sumario><seccion codigo='2B'><departamento nombre='Uno &amp; dos'>{item('BOE-A-2026-10', 'ten')}{item('BOE-A-2026-1', 'one')}"
        f"<epigrafe nombre=\"A 'b' &lt;c&gt;\">{item('', 'no id')}<texto>{item('D', 'deeper')}</texto>{item('E', 'after')}<br/>{item('F', 'last')}</epigrafe>{item('G', 'outside')}</departamento>"
        f"<departamento>{item('H', 'unnamed')}<grupo><epigrafe nombre='Z'><grupo2/>{item('I', 'nested')}</epigrafe></grupo></departamento></seccion></sumario>"
    )
    rows = boe.candidates(spark.createDataFrame([("d", xml)], "doc_id string, text string")).orderBy("ordinal").collect()
    label = "II.B. Oposiciones y concursos"
    assert [(r["title"], r["section"]) for r in rows] == [("ten", label), ("one", label), ("no id", f"{label} -> A 'b' <c>"), ("deeper", label), ("after", f"{label} -> A 'b' <c>"), ("last", f"{label} -> A 'b' <c>"), ("outside", label), ("unnamed", label), ("nested", f"{label} -> Z")]
    assert [r["department"] for r in rows][:1] + [r["department"] for r in rows][-1:] == ["Uno & dos", boe.NO_DEPARTMENT]


def test_places_within_groups_of_any_size(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))).alias("g"), ((F.col("id") * 7919) % 2003).alias("o"))
    got = {r["id"]: r["at"] for r in windows.places(df, ["g"], ["o"], "at").collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).append((r["o"], r["id"]))
    want = {i: n for rows in groups.values() for n, (_, i) in enumerate(sorted(rows))}
    assert got == want and windows.places(df.where("false"), ["g"], ["o"], "at").count() == 0
    assert sorted(r["number"] for r in windows.numbered_overall(df, ["o"]).collect()) == list(range(1, 2001))
