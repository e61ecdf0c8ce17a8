import json
from datetime import datetime

import pytest

import __spark_entry__ as entry
from nuntia.plans import queries, sinks
from nuntia.schema import FINDINGS

NOW = datetime(2026, 5, 21, 8, 0)


@pytest.fixture
def findings(spark):
    rows = [
        ("d", 1, 0, "agency <x>", 'A "b" & <c> ' + "word " * 40, 3, [r"\bDBA\b", "x"], "EPSO", "http://a?b&c"), ("d", 0, 0, "Cabildo", "Plaza", 2, ["k"], "BOP", ""), ("d", 2, 0, "o", "y" * 5000, 1, ["k" * 2000], "BOE", "http://z"),
    ]
    return spark.createDataFrame(rows, FINDINGS)


def test_markdown_report(findings, tmp_path):
    path = tmp_path / "f.md"
    assert sinks.save_markdown(findings, path, NOW) == 3
    out = path.read_text(encoding="utf-8")
    assert out.startswith("# 🔎 IT Job Findings\n\n**Scan Date:** 2026-05-21 08:00\n**Total Findings:** 3\n\n---\n\n## 📌 CABILDO (BOP - Página 2)")
    assert out.index("BOP -") < out.index("BOE - Item 1") < out.index("EPSO - Item 3") and out.count("---\n\n") == 3 and "**URL:** [Link to announcement](http://a?b&c)" in out
    assert sinks.save_markdown(findings.where("false"), path, NOW) == 0
    assert sinks.NOTHING in path.read_text(encoding="utf-8")


def test_html_report(findings, tmp_path):
    path = tmp_path / "f.html"
    assert sinks.save_html(findings, path, NOW) == 3
    out = path.read_text(encoding="utf-8")
    assert "AGENCY &lt;X&gt;" in out and "A &quot;b&quot; &amp; &lt;c&gt;" in out and "Total Findings: 3" in out and out.count("<article") == 3 and 'href="http://a?b&amp;c"' in out and out.count("<footer") == 2
    sinks.save_html(findings.where("false"), path, NOW)
    assert sinks.NOTHING in path.read_text(encoding="utf-8")


def test_parts(findings, spark, tmp_path):
    sinks.write_markdown_parts(findings, str(tmp_path / "parts"))
    assert sum("## 📌" in r["value"] for r in spark.read.text(str(tmp_path / "parts")).collect()) == 3


def test_console(findings):
    block = findings.where("source = 'EPSO'").select(sinks.console_block()).first()[0].split("\n")
    assert block[0] == "📌 AGENCY <X> (EPSO - Item 3)" and all(x.startswith("   ") and len(x) <= 76 for x in block[1:-2]) and block[-2] == r"   🔑 Keywords matched: \bDBA\b, x"


def test_messages(findings):
    cards = [json.loads(r["payload"]) for r in sinks.card_messages(findings).orderBy("message").collect()]
    assert [len(c["embeds"]) for c in cards] == [2, 1] and [bool(c["content"]) for c in cards] == [True, False]
    first, long = cards[0]["embeds"]
    assert "url" not in first and first["title"] == "📌 CABILDO" and first["fields"][0]["value"] == "BOP (Page/Item 2)"
    assert len(long["description"]) == 2048 and len(long["fields"][1]["value"]) == 1024
    texts = {r["source"]: r["text"] for r in sinks.text_messages(findings).collect()}
    assert "AGENCY &lt;X&gt;" in texts["EPSO"] and len(texts["BOE"].split("\n")[2]) == 3003 and "🔗" not in texts["BOP"]
    sent, waits = [], []
    assert sinks.send(sinks.text_messages(findings), "text", sent.append, waits.append) == 3 == len(sent) and waits == [0.5] * 3


def test_channels_fail_alone(findings):
    out = sinks.route(findings, {"a": lambda f: 1 / 0, "b": lambda f: f.count()})
    assert out["b"] == 3 and "ZeroDivisionError" in out["a"]


def test_entry_and_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "para_no", "organism", "description", "matched"] and df.count() > 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_agree_with_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "events", "orders", "part", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(map(str, r)) for r in got.select(sorted(names)).collect()) == want


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in queries.ORACLES])
def test_queries_without_sql_run(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
