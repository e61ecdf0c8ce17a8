from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nuntia.operators import match
from nuntia.plans.scan import ScanOptions, pages_of, scan, status
from nuntia.schema import NO_ORGANISM, PAGES
from nuntia.sources import aena, boc, boe, bop, epso, eulisa, eures, sagulpa
from nuntia.sources.common import DROP
from nuntia.sources.detect import detect, source_of
from nuntia.sources.feed import last_days, read_feeds

HERE = Path(__file__).parent / "fixtures"


def file(name):
    return str(HERE / name)


def ordered(df):
    return df.orderBy("page_number").collect()


def day(y, m, d):
    return F.lit(date(y, m, d))


def test_every_source_gives_pages_in_the_schema(spark):
    names = {"BOC": "regional.xml", "BOE": "state.xml", "EPSO": "vacancies.csv", "EURES": "vacancies.json", "EULISA": "agency.html", "AENA": "airport_list.html", "SAGULPA": "company_list.html"}
    for source, name in names.items():
        pages = pages_of(spark, source, file(name))
        assert [(f.name, f.dataType) for f in pages.schema] == [(f.name, f.dataType) for f in PAGES]
        assert {r["source"] for r in pages.collect()} == {source}
    every = scan(spark, {k: file(v) for k, v in names.items()})
    one_by_one = sum(scan(spark, {k: file(v)}).count() for k, v in names.items())
    assert status(every) == {"findings": one_by_one, "exit_code": 0}
    assert status(scan(spark, {k: file(v) for k, v in names.items()}, ScanOptions(sources=("BOP",)))) == {"findings": 0, "exit_code": 1}


def test_regional_bulletin(spark):
    items = boc.read_items(spark, file("regional.xml"))
    rows = ordered(boc.pages(items))
    assert [r["page_number"] for r in rows] == [1, 2, 3, 4, 5] and rows[4]["text"] == "Resolución E"
    assert rows[0]["text"] == "1 Se convoca proceso para cubrir una plaza de Técnico de Sistemas Microinformáticos."
    assert rows[0]["section"] == "II. Autoridades y Personal -> Oposiciones y concursos" and rows[0]["detected_organism"] == "Consejería de Presidencia"
    assert rows[1]["url"] == "https://example.org/boc/2.html?a=1&b=2" and rows[2]["text"] == "Anuncio\n\nBases de la bolsa de empleo de programador."
    assert match.find(boc.pages(items)).count() == 3


def test_regional_items_without_heading_use_the_feed_title(spark):
    docs = spark.createDataFrame([("a", "<rss><item><title>Feed title</title><description>&lt;h5&gt;III. Otras Resoluciones - X&lt;/h5&gt;</description></item></rss>"), ("b", "<rss><it"), ("c", "")], "doc_id string, text string")
    assert [r["text"] for r in boc.pages(boc.items(docs, DROP)).collect()] == ["Feed title"]
    with pytest.raises(Exception, match="broken feed: b"):
        boc.items(docs).collect()


def test_regional_days(spark):
    one = boc.read_items(spark, file("regional.xml"))
    assert boc.on_day(one, day(2026, 5, 21)).count() == 2
    assert boc.on_day(one.unionByName(one).unionByName(one), day(2026, 5, 21)).count() == 6  # duplicates of several feeds are kept
    assert boc.on_day(one, day(2020, 1, 1)).count() == 0
    assert {r["published"] for r in boc.of_latest_day(one).collect()} == {date(2026, 5, 21)}


def test_state_bulletin(spark):
    found = boe.read_candidates(spark, file("state.xml"))
    rows = ordered(boe.pages(found))
    assert [r["text"].split("]")[0][1:] for r in rows] == ["X-1", "X-2", "X-3", "X-4", "X-6"] and [r["page_number"] for r in rows] == [1, 2, 3, 4, 5]
    assert rows[1]["url"] == "https://example.org/2.pdf" and rows[2]["section"] == "II.B. Oposiciones y concursos" and rows[3]["section"] == "II.B. Oposiciones y concursos -> Personal laboral"
    assert rows[2]["text"] == "[X-3] Bases para analista de datos & programador." and rows[2]["detected_organism"] == "UNIVERSIDADES"
    assert match.find(boe.pages(found)).count() == 3
    broken = spark.createDataFrame([("a", "<broken"), ("b", "")], "doc_id string, text string")
    assert boe.candidates(broken, DROP).count() == 0
    with pytest.raises(Exception, match="broken summary: a"):
        boe.candidates(broken).collect()


def test_state_bulletin_with_documents(spark):
    pdf = spark.createDataFrame([("https://example.org/1.pdf", 1, "Pá-\ngina una"), ("https://example.org/1.pdf", 2, "dos"), ("https://example.org/2.pdf", 1, None)], "pdf_url string, page_number int, raw_text string")
    rows = ordered(boe.pages(boe.read_candidates(spark, file("state.xml")), pdf))
    assert [r["text"] for r in rows][:2] == ["[X-1] (PDF Pag 1) Página una", "[X-1] (PDF Pag 2) dos"]
    assert len(rows) == 6 and [r["page_number"] for r in rows] == list(range(1, 7))


def test_printed_bulletin(spark):
    texts = [
        ("d", 1, "portada\nAYUNTAMIENTO DE ANTES"), ("d", 2, "III. ADMINISTRACIÓN LOCAL\nAYUNTAMIENTO DE SANTA BRÍGIDA\ntexto uno"), ("d", 3, None), ("d", 4, "sigue\nILUSTRE  AYUNTAMIENTO DE TELDE \nCABILDO"),
        ("d", 5, "IV. ADMINISTRACIÓN DE JUSTICIA\nAYUNTAMIENTO DE NADIE"), ("d", 6, "XIII. ANUNCIOS\nfin"), ("e", 1, "iii administración local\nnada"),
    ]
    raw = spark.createDataFrame(texts, "doc_id string, page_number int, raw_text string")
    rows = bop.pages(raw).orderBy("doc_id", "page_number").collect()
    assert [(r["doc_id"], r["page_number"], r["detected_organism"]) for r in rows] == [
        ("d", 2, "AYUNTAMIENTO DE SANTA BRÍGIDA"), ("d", 4, "ILUSTRE AYUNTAMIENTO DE TELDE"), ("d", 6, "ILUSTRE AYUNTAMIENTO DE TELDE"), ("e", 1, NO_ORGANISM),
    ]
    assert rows[0]["section"] == "III. ADMINISTRACIÓN LOCAL" and rows[0]["url"] == ""
    assert bop.pages(raw, strict_section=True).count() == 3


def test_documents_by_a_pluggable_reader(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"III. ADMINISTRACI\xc3\x93N LOCAL\nuno\x0cdos")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def extract(content):
        return content.decode().split("\x0c") if content != b"broken" else 1 / 0

    rows = bop.read_pdf_pages(spark, str(tmp_path), extract).orderBy("doc_id", "page_number").collect()
    assert [(r["page_number"], r["error"] is None) for r in rows] == [(1, True), (2, True), (1, False)]
    assert pages_of(spark, "BOP", str(tmp_path / "a.pdf"), ScanOptions(extract_pdf=extract)).count() == 2
    with pytest.raises(ValueError):
        pages_of(spark, "BOP", str(tmp_path))


def test_selection_office(spark, tmp_path):
    rows = epso.read_rows(spark, file("vacancies.csv"))
    assert [r["page_number"] for r in ordered(epso.pages(rows))] == [1, 2, 3]
    kept = ordered(epso.pages(rows, day(2026, 8, 1)))
    assert [r["page_number"] for r in kept] == [1, 3]  # closed rows leave gaps, unreadable dates stay
    assert kept[0]["text"] == "Position: Software Engineer, senior\nInstitution/Agency: Agency One\nLocation: Lisbon\nType of Contract: Temporary (AD6)\nDeadline for Applications: 2026-09-30"
    assert kept[0]["url"] == epso.PORTAL and match.find(epso.pages(rows)).count() == 2
    with pytest.raises(ValueError, match="grade"):
        epso.resolve(["Agency", "Title", "Location", "Contract", "Deadline"])
    assert epso.resolve(["﻿Agency", "Institution", "Title ", "Location", "Contract", "Grade", "Deadline", "URL"])["agency"] == "Institution"
    (tmp_path / "l.csv").write_bytes("Agency,Title,Location,Contract,Grade,Deadline,Link\nÉcole,DBA,,,,,http://x\nshort\n".encode("latin-1"))
    rows = ordered(epso.pages(epso.read_rows(spark, str(tmp_path / "l.csv"))))
    assert rows[0]["detected_organism"] == "École" and rows[0]["url"] == "http://x" and rows[1]["text"].startswith("Position: \nInstitution/Agency: short")


def test_dataset_metadata(spark):
    plain = '{"distributions": [{"format": {"id": "PDF"}, "download_url": ["http://x/p"]}, {"format": {"id": "CSV"}, "download_url": ["http://x/c.csv", "http://x/d"]}]}'
    graph = '{"@graph": [{"@type": "dcat:Dataset"}, {"@type": ["dcat:Distribution"], "dct:format": {"@id": "http://f/XML"}, "dcat:accessURL": "http://x/a.xml"}, {"@id": "http://x/distribution/2", "dct:format": "http://f/CSV", "dcat:downloadURL": {"@id": "http://x/g.csv"}}]}'
    by_name = '{"@graph": [{"@type": "dcat:Distribution", "dcat:accessURL": {"@id": "http://x/h.csv"}}]}'
    df = spark.createDataFrame([(0, plain), (1, graph), (2, by_name), (3, "{}"), (4, "nonsense")], "i int, json string")
    assert [r["csv_url"] for r in epso.csv_address(df).orderBy("i").collect()] == ["http://x/c.csv", "http://x/g.csv", "http://x/h.csv", None, None]


def test_mobility_portal(spark):
    rows = ordered(eures.pages(eures.read_vacancies(spark, file("vacancies.json"))))
    assert rows[0]["text"] == "Title: DevOps Engineer\nEmployer/Agency: Firm A\nLocation: Madrid\nDescription: Run \nsystems\nat scale"
    assert rows[1]["text"] == "Title: Cook\nEmployer/Agency: Firm B\nLocation: Europe\nDescription: Kitchen 3 < 4" and rows[1]["url"] == eures.PORTAL
    assert match.find(eures.pages(eures.read_vacancies(spark, file("vacancies.json")))).count() == 1
    docs = spark.createDataFrame([("a", '[{"title": "x"}]'), ("b", '{"vacancyList": [{"title": "y"}, {}]}'), ("c", "broken"), ("d", "")], "doc_id string, text string")
    with pytest.raises(Exception, match="broken vacancies: c"):
        eures.vacancies(docs).collect()
    assert sorted(r["text"].split("\n")[0] for r in eures.pages(eures.vacancies(docs, DROP)).collect()) == ["Title: Job Vacancy", "Title: x", "Title: y"]


def test_drifted_fields_of_the_mobility_portal(spark):
    docs = spark.createDataFrame([("a", '[{"title": "x", "newTitle": 1}, {"newTitle": 2}, {"newTitle": null}]'), ("b", '{"vacancies": [{"newTitle": 2.5, "url": 7}], "vacancyList": []}'), ("c", "broken"), ("d", None), ("e", '{"vacancies": "none"}'), ("f", "[]")], "doc_id string, text string")
    got = {(r["field"], r["kind"]): (r["known"], r["vacancies"], r["documents"]) for r in eures.drifted_fields(docs).collect()}
    assert got == {("newTitle", "BIGINT"): (False, 2, 1), ("newTitle", "VOID"): (False, 1, 1), ("newTitle", "DECIMAL"): (False, 1, 1), ("url", "BIGINT"): (True, 1, 1)}
    assert eures.drifted_fields(spark.createDataFrame([(str(i), f'[{{"title": "{i}", "description": "<p>"}}]') for i in range(5)], "doc_id string, text string")).count() == 0


def test_state_items_of_a_large_department(spark):
    """Ten thousand items of one department, each under the tag right above it."""
    item = "<item><titulo>t{i}</titulo></item>"
    body = "".join(f"<epigrafe nombre='e{i}'>{item.replace('{i}', str(i))}<x>{item.replace('{i}', f'x{i}')}</x></epigrafe>" for i in range(5000))
    docs = spark.createDataFrame([("d", f"<sumario><seccion codigo='2B'><departamento nombre='n'>{body}</departamento></seccion></sumario>")], "doc_id string, text string")
    rows = boe.candidates(docs).orderBy("ordinal").collect()
    assert len(rows) == 10_000 and [(r["title"], r["section"].endswith(f"-> e{r['ordinal'] // 2}")) for r in rows[4000:4002]] == [("t2000", True), ("tx2000", False)]


def test_agency(spark):
    entries = eulisa.read_entries(spark, file("agency.html"))
    rows = ordered(eulisa.pages(entries))
    assert [r["text"].split("\n")[0] for r in rows] == ["Title: ICT Expert (Systems)", "Title: Legal Advisor", "Title: Solution Architect", "Title: DBA team assistant"]
    assert rows[0]["url"] == "https://www.eulisa.europa.eu/vacancies/expert.html" and "R/1 | ICT Expert (Systems) | Temporary | 15/09/2026" in rows[0]["text"]
    assert rows[2]["text"] == "Title: Solution Architect\nDetails: R/4 Solution Architect Deadline: 01/10/2026\nSource Portal: eu-LISA Careers"
    assert [r["page_number"] for r in ordered(eulisa.pages(entries, day(2026, 8, 1)))] == [1, 2, 3]
    assert match.find(eulisa.pages(entries)).count() == 3
    assert eulisa.pages(entries, day(2026, 9, 1)).count() == 2


def test_airport_board(spark):
    found = aena.read_listings(spark, file("airport_list.html"), day(2026, 7, 15))
    assert [(r["title"], r["closing_date"]) for r in found.orderBy("ordinal").collect()] == [("Técnico Informática y Sistemas", date(2026, 7, 20)), ("Fecha rara", None)]
    assert found.orderBy("ordinal").first()["url"] == "https://empleo.aena.es/empleo/PFSrv?accion=aviso&codigo=1"
    assert aena.read_listings(spark, file("airport_list.html"), day(2026, 7, 21)).count() == 1
    rows = ordered(aena.pages(found))
    assert rows[0]["text"] == "CONVOCATORIA: Técnico Informática y Sistemas Fecha fin inscripción: 20/07/2026" and rows[1]["text"].endswith("Desconocida")
    details = spark.createDataFrame([(found.orderBy("ordinal").first()["url"], (HERE / "airport_detail.html").read_text())], "url string, text string")
    links = aena.document_links(details)
    assert [r["href"] for r in links.orderBy("ordinal").collect()] == ["documentos?get=1", "PFSrv?docId=2"]
    pdf = spark.createDataFrame([("documentos?get=1", 1, "uno"), ("PFSrv?docId=2", 1, "dos"), ("PFSrv?docId=2", 2, "")], "href string, page_number int, raw_text string")
    full = ordered(aena.pages(found, links, pdf))
    assert [r["text"] for r in full] == ["CONVOCATORIA: Técnico Informática y Sistemas\n\nuno", "CONVOCATORIA: Técnico Informática y Sistemas\n\ndos"]  # no links: dropped
    assert [r["text"] for r in aena.pages(found, links, pdf.where("false")).collect()] == [rows[0]["text"]]  # no text: the listing


def test_company_board(spark):
    path = file("company_list.html")
    rows = sagulpa.read_listings(spark, path, day(2026, 7, 8)).orderBy("ordinal").collect()
    assert [r["title"] for r in rows] == ["Programador de sistemas", "Peón"]
    assert rows[0]["published"] == date(2026, 7, 8) and rows[0]["closing_date"] == date(2026, 7, 11) and rows[0]["url"] == "https://www.sagulpa.com/ofertas-empleo/1"
    every = sagulpa.listings(spark.createDataFrame([("d", (HERE / "company_list.html").read_text())], "doc_id string, text string"), day(2026, 7, 12), only_open=False).orderBy("ordinal").collect()
    assert [(r["title"], r["closing_date"], r["url"]) for r in every][1:] == [("Auxiliar", date(2026, 7, 5), "https://www.sagulpa.com/otra"), ("Peón", None, "")]
    details = spark.createDataFrame([(rows[0]["url"], (HERE / "company_detail.html").read_text())], "url string, text string")
    found = sagulpa.pages(sagulpa.read_listings(spark, path, day(2026, 7, 8)), details)
    assert ordered(found)[0]["text"] == "Programador de sistemas\nFecha de publicación: 08/07/2026\n\nSe ofrece plaza de programador."
    assert ordered(found)[1]["text"] == "Peón Fecha de publicación: 08/07/2026"


@pytest.mark.parametrize(
    "name,head,want",
    [
        ("a.pdf", b"x", "BOP"), ("a", b"%PDF-1.4", "BOP"), ("a.xml", b"<?xml?><rss>", "BOC"), ("a.xml", b"<response>", "BOE"), ("boe-x.xml", b"<x>", "BOE"), ("a", b"<?xml version='1'?><sumario>", "BOE"),
        ("a", b"<!DOCTYPE html><html>", "SAGULPA"), ("a", b"<html> eu-lisa eulisa", "EULISA"), ("aena.html", b"", "AENA"), ("a.htm", b"x", "SAGULPA"), ("a.csv", b"", "EPSO"), ("a", b"h1;h2\n", "EPSO"),
        ("a.json", b"", "EURES"), ("a", b"[1]", "EURES"),
    ],
)
def test_detection(name, head, want):
    assert source_of("/dir/" + name, head) == want


def test_detection_of_files(spark, tmp_path):
    assert detect(spark, file("regional.xml")) == "BOC" and detect(spark, file("state.xml")) == "BOE"
    assert scan(spark, file("vacancies.csv")).count() == 2
    with pytest.raises(ValueError):
        source_of("x", b"plain")


def test_feeds_are_read_by_source_and_day(spark):
    issues = {("BOE", date(2026, 5, 22)): b"friday"}

    def fetch(source, issue):
        if source == "EPSO":
            raise OSError("no route")
        return issues.get((source, issue))

    df = read_feeds(spark, fetch, ["BOE", "EPSO"], last_days(date(2026, 5, 24), 3))
    assert df.rdd.getNumPartitions() == 6
    rows = df.collect()
    assert [(r["day"], bytes(r["content"])) for r in rows if r["source"] == "BOE"] == [(date(2026, 5, 22), b"friday")]
    assert {r["error"] for r in rows if r["source"] == "EPSO"} == {"OSError: no route"}


def test_agency_pages_are_parsed_once(spark):
    """Rows and links of a page come from one parse; links that rows have, repeat or are noise go, whatever their address."""
    page = '<a href="/jobs/1">Later one</a><a href="http://[contact">Contact</a><table><tr><td><a href="/jobs/1">Row</a></td></tr><tr><td><a href="/jobs/1">Row again</a></td></tr></table><li><a href="/jobs/2">Second</a></li><a href="/jobs/2">Second again</a>'
    docs = spark.createDataFrame([("a", page), ("b", '<a href="/jobs/1">Of another page</a>')], "doc_id string, text string")
    pages = eulisa.pages(eulisa.entries(docs), F.lit("2026-08-01").cast("date"))
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PythonUDTF") == 1 and "ArrowEvalPython" not in plan
    got = [(r["doc_id"], r["page_number"], r["text"].split("\n")[0], r["url"]) for r in pages.orderBy("doc_id", "page_number").collect()]
    site = "https://www.eulisa.europa.eu/jobs/"
    assert got == [("a", 1, "Title: Row", f"{site}1"), ("a", 2, "Title: Row again", f"{site}1"), ("a", 3, "Title: Second", f"{site}2"), ("b", 1, "Title: Of another page", f"{site}1")]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summaries_and_their_items_are_parsed_once_and_shuffled_once(spark):
    docs = spark.createDataFrame([("a", "<s/>")], "doc_id string, text string")
    plan = planned(boe.pages(boe.candidates(docs)))
    assert plan.count("from_xml(StructField(_corrupt_record") == plan.count("from_xml(StructField(identificador") == plan.count("Exchange hashpartitioning") == 1


def test_feeds_are_parsed_and_their_descriptions_decoded_once(spark):
    docs = spark.createDataFrame([("a", "<rss/>")], "doc_id string, text string")
    plan = planned(boc.pages(boc.items(docs)))
    assert plan.count("from_xml(") == plan.count("ArrowEvalPython [html_unescape(") == plan.count("ArrowEvalPython [_nfc(") == 1


def test_listings_of_the_company_board_are_parsed_once(spark):
    item = '<li><h2>{0}</h2> Fecha de publicación: 01/07/2026 <a href="/ofertas-empleo/{0}">Ver</a></li>'
    docs = spark.createDataFrame([("a", f'<ul class="fa-ul">{item.format("x")}{item.format("y")}</ul>'), ("b", "<p>no list</p>"), ("c", None)], "doc_id string, text string")
    details = spark.createDataFrame([("https://www.sagulpa.com/ofertas-empleo/x", "<body>Se ofrece</body>")], "url string, text string")
    pages = sagulpa.pages(sagulpa.listings(docs, F.lit("2026-07-08").cast("date")), details, also=["title", "published", "closing_date"])
    plan = planned(pages)
    assert plan.count("ArrowEvalPython [extracted(") == 2 and plan.count("ArrowEvalPython [resolve_url(") == 1  # listings and details
    assert [(r["title"], str(r["published"]), r["closing_date"], "Se ofrece" in r["text"]) for r in ordered(pages)] == [("x", "2026-07-01", None, True), ("y", "2026-07-01", None, False)]
