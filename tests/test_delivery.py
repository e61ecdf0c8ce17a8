"""Feeds read as they come out, folders of mixed files, back-fills, and messages that are sent once."""

import json
import shutil
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nuntia.operators import select
from nuntia.plans import outbox
from nuntia.plans.scan import ScanOptions, routed, scan
from nuntia.sources.detect import source_column, source_of
from nuntia.sources.feed import FeedStreamReader, fetch_each, stream_feeds

HERE = Path(__file__).parent / "fixtures"
DAY = date(2026, 5, 20)


def test_offsets_hold_each_issue_once():
    """Whatever comes out when, in whatever batches: between the offsets lies each issue once."""
    out = {"BOP": {0: 0, 1: 1, 2: 5, 3: 3, 9: 20}, "BOE": {n: n for n in range(0, 30, 2)}}  # day of issue: day on which it comes out
    now = [0]
    published = lambda s, days: [d for d in days if out[s].get((d - DAY).days, 999) <= now[0]]
    reader = FeedStreamReader(["BOP", "BOE"], DAY, None, published, lambda: DAY + timedelta(now[0]))
    start, got = reader.initialOffset(), []
    for now[0] in (0, 0, 1, 4, 5, 6, 9, 10, 20, 21):
        end = reader.latestOffset()
        got += [(p.source, (p.day - DAY).days) for p in reader.partitions(start, end) if (p.day - DAY).days in out[p.source]]
        assert len(json.dumps(end)) < 500
        start = json.loads(json.dumps(end))
    assert len(got) == len(set(got))
    # the issue of day 9 came out while nobody looked for ten days, and is asked for once more
    assert {n for s, n in got if s == "BOP"} == {0, 1, 2, 3, 9} and {n for s, n in got if s == "BOE"} == set(range(0, 21, 2))


def test_stream_goes_on_after_a_restart_and_picks_up_late_issues(spark, tmp_path):
    world, log, got = tmp_path / "world.json", tmp_path / "log", []
    log.mkdir()
    path, folder = str(world), str(log)

    def now():
        return json.loads(Path(path).read_text())

    def fetch(source, day):
        import uuid

        (Path(folder) / f"{source}-{day}-{uuid.uuid4().hex}").touch()
        return 1 / 0 if source == "BAD" else f"{source} {day}".encode() if str(day) in now()["out"] else None

    def run(today, *days):
        world.write_text(json.dumps({"today": str(today), "out": [str(d) for d in days]}))
        stream = stream_feeds(spark, fetch, lambda s, ds: [d for d in ds if str(d) in now()["out"]], ["BOP", "BAD"], DAY, lambda: date.fromisoformat(now()["today"]))
        query = stream.writeStream.foreachBatch(lambda df, i: got.extend((r["source"], r["day"], r["error"] is not None) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        assert query.awaitTermination(60)

    d = [DAY + timedelta(n) for n in range(5)]
    run(d[1], d[0])
    assert sorted(got) == [("BAD", d[0], True), ("BOP", d[0], False)]
    run(d[3], d[0], d[3])
    run(d[3], d[0], d[3])
    assert sorted(x for x in got if x[0] == "BOP") == [("BOP", d[0], False), ("BOP", d[3], False)]
    run(d[4], d[0], d[1], d[3])  # the second day's issue is late
    assert sorted(x for x in got if x[0] == "BOP") == [("BOP", d[0], False), ("BOP", d[1], False), ("BOP", d[3], False)]
    fetched = [p.name.rsplit("-", 1)[0] for p in log.iterdir()]
    assert len(fetched) == len(set(fetched)) == 6


@pytest.fixture
def folder(tmp_path):
    """All kinds of files in one folder, and some below it."""
    where = tmp_path / "mixed"
    (where / "more").mkdir(parents=True)
    for name, to in (("state.xml", "boe-1.xml"), ("regional.xml", "feed.xml"), ("vacancies.csv", "list.txt"), ("vacancies.json", "jobs"), ("agency.html", "eulisa.html"), ("airport_list.html", "aena.htm"), ("company_list.html", "offers.html")):
        shutil.copy(HERE / name, where / ("more" if name == "agency.html" else ".") / to)
    (where / "bulletin.pdf").write_bytes("III. ADMINISTRACIÓN LOCAL\nAYUNTAMIENTO DE TELDE\nPlaza de informático".encode())
    return where


def test_a_mixed_folder_gives_what_its_files_give(spark, folder):
    extract = lambda content: [content.decode()]
    options = ScanOptions(extract_pdf=extract)
    paths = [p for p in folder.rglob("*") if p.is_file()]
    by_file = {}
    for p in paths:
        by_file.setdefault(source_of(p.name, p.read_bytes()[:2000]), []).append(str(p))
    assert len(by_file) == 8
    glob = [f"{folder}/*.*", f"{folder}/jobs", f"{folder}/more/*"]
    files = routed(spark, glob, options)
    assert {s: sorted(r["path"].rsplit("/", 1)[1] for r in f.collect()) for s, f in files.items()} == {s: sorted(Path(p).name for p in ps) for s, ps in by_file.items()}
    shutil.move(folder / "more" / "eulisa.html", folder / "eulisa.html")
    by_file["EULISA"] = [str(folder / "eulisa.html")]
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    found = rows(scan(spark, str(folder), options))
    assert found == rows(scan(spark, by_file, options)) and {r[7] for r in found} >= {"BOP", "BOC", "BOE", "EPSO", "EURES", "EULISA"}
    (folder / "notes.txt").write_text("nothing known")
    with pytest.raises(Exception, match="notes.txt"):
        scan(spark, str(folder), options)
    assert rows(scan(spark, str(folder), ScanOptions(extract_pdf=extract, broken="drop"))) == found


def test_detection_as_a_column(spark):
    names = ["a.pdf", "x", "Aena-List.HTML", "b.xml", "boe.xml", "c.rss", "d.json", "e.csv", "f", "eulisa", ".pdf", "g.tar.gz", "h.PDF", "i.html", "k.xml.txt"]
    heads = [b"", b"%PDF", b"<html>eulisa", b"<!DOCTYPE html>aena", b"\xef\xbb\xbf  <response>", b"<rss>", b"<RSS>", b"[1", b" {", b"a;b\nc", b"a\nb,c", b"\xff\xfe,", b"<sumario"]
    rows = [(f"s3://x/y.z/{n}", bytearray(h), source_of_or_none(n, h)) for n in names for h in heads]
    df = spark.createDataFrame(rows, "path string, content binary, want string")
    assert df.where(~source_column("path", "content").eqNullSafe(F.col("want"))).collect() == []


def source_of_or_none(name, head):
    try:
        return source_of(name, head)
    except ValueError:
        return None


def test_back_fill_of_many_days(spark):
    d = [DAY + timedelta(n) for n in range(12)]
    issues = spark.createDataFrame([("BOP", d[0], 2), ("BOP", d[8], 0), ("BOC", d[0], 1), ("BOC", d[3], 0), ("BOE", d[2], 5), ("BOE", d[3], None), ("BOE", d[3], 0), (None, d[0], 1)], "source string, day date, items int")
    asked = [(s, day, False) for s in ("BOP", "BOC", "BOE", "EPSO", None) for day in d] + [("BOE", d[3], True), ("BOP", None, False)]
    requests = spark.createDataFrame(asked, "source string, day date, asked boolean")
    got = {(r["source"], r["day"], r["asked"]): (r["choice"], r["use_day"]) for r in select.chosen_issues(requests, issues, ["source"]).collect()}
    assert len(got) == len(asked)
    have = {}
    for r in issues.collect():
        have[r["source"], r["day"]] = have.get((r["source"], r["day"]), 0) + (r["items"] or 0)
    for source, day, was_asked in asked:
        if day is None or source is None:
            continue
        published = (source, day) in have
        choice = select.issue_or_fallback(source, was_asked, published, not have.get((source, day)))
        earlier = [x for s, x in have if s == source and timedelta(0) < day - x < timedelta(7)]
        use = day if choice == "issue" else None if choice == "none" else day if source == "BOC" else max(earlier, default=day if published else None)
        assert got[source, day, was_asked] == (choice, use), (source, day)
    scheduled = select.chosen_issues(requests, issues, ["source"], scheduled=True).where("choice = 'latest' AND use_day != day")
    assert scheduled.count() == 0 and select.chosen_issues(requests.where("false"), issues, ["source"]).count() == 0


def test_messages_are_sent_once(spark, tmp_path):
    """A run that fails midway, its repetition, and messages that come up again."""
    sent, ledger, bad = tmp_path / "sent", str(tmp_path / "ledger"), tmp_path / "bad"
    sent.mkdir()
    bad.touch()
    folder, trouble = str(sent), str(bad)

    def post(payload):
        import uuid

        if payload == "m7" and Path(trouble).exists():
            raise OSError("no line")
        (Path(folder) / f"{payload}-{uuid.uuid4().hex}").touch()

    def names():
        return sorted(p.name.split("-")[0] for p in sent.iterdir())

    messages = spark.range(20).select(F.concat(F.lit("m"), "id").alias("payload"))
    again = messages.unionByName(messages)
    with pytest.raises(Exception, match="no line"):
        outbox.deliver(again, "payload", post, ledger, per_second=1000, tasks=3)
    before = names()
    assert "m7" not in before and len(before) == len(set(before)) < 20
    bad.unlink()
    assert outbox.deliver(again, "payload", post, ledger, per_second=1000, tasks=3) == 20 - len(before)
    assert names() == sorted(f"m{i}" for i in range(20))
    assert outbox.deliver(again, "payload", post, ledger, per_second=1000) == 0
    more = spark.createDataFrame([("m3", "k"), ("new", "k"), ("other", None), (None, "n")], "payload string, id string")
    assert outbox.deliver(more.where("payload = 'new'"), F.col("payload"), post, f"file://{ledger}", "id", 1000) == 1
    assert outbox.deliver(more, "payload", post, ledger, "id", 1000) == 0 and len(names()) == 21
    with pytest.raises(ValueError, match="mounted"):
        outbox.deliver(more, "payload", post, "s3://x/y")


def test_messages_go_out_no_faster_than_asked(spark, tmp_path):
    waits = tmp_path / "waits"
    waits.mkdir()
    where = str(waits)

    def sleep(seconds):
        import uuid

        (Path(where) / f"{seconds:.3f}-{uuid.uuid4().hex}").touch()

    assert outbox.deliver(spark.range(10), F.col("id").cast("string"), lambda p: None, str(tmp_path / "ledger"), per_second=8, tasks=2, sleep=sleep) == 10
    assert [p.name.split("-")[0] for p in waits.iterdir()] == ["0.250"] * 10


def test_a_second_attempt_of_a_task_sends_the_rest(tmp_path, monkeypatch):
    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    sent = []

    def post(payload):
        if payload == "c" and len(sent) < 3:
            sent.append("failed")
            raise OSError
        sent.append(payload)

    writer = outbox.MessageWriter(post, str(tmp_path), "run", 0, lambda s: None)
    rows = [{"key": k, "payload": k} for k in "abc"]
    monkeypatch.setattr(outbox.TaskContext, "get", lambda: Task(1))
    with pytest.raises(OSError):
        writer.write(iter(rows))
    monkeypatch.setattr(outbox.TaskContext, "get", lambda: Task(2))
    assert writer.write(iter(rows)).messages == 1 and sent == ["a", "b", "failed", "c"]


def test_fetches_that_fail_are_reported(spark, folder):
    failed = []
    found = scan(spark, {"SAGULPA": str(HERE / "company_list.html")}, ScanOptions(fetch=lambda url: 1 / 0, failed=lambda df: failed.extend(df.collect())))
    assert found.count() >= 0 and failed and all(r["address"].startswith("http") and "ZeroDivisionError" in r["error"] for r in failed)
    with pytest.warns(UserWarning, match="couldn't be fetched"):
        scan(spark, {"SAGULPA": str(HERE / "company_list.html")}, ScanOptions(fetch=lambda url: 1 / 0))


def test_fetching_several_addresses_at_once(spark):
    import time

    df = spark.range(20).select(F.col("id").cast("string").alias("url"))

    def fetch(url):
        import threading

        time.sleep(0.05)
        return threading.current_thread().name

    rows = fetch_each(df, "url", fetch, at_once=5, tasks=1).collect()
    assert len(rows) == 20 and 1 < len({bytes(r["content"]) for r in rows}) <= 5


def test_verdicts_are_asked_for_once(spark, tmp_path, monkeypatch):
    """A run that breaks off, its repetition, new texts, another prompt, and texts without an answer."""
    from nuntia.operators import classify
    from nuntia.schema import FINDINGS

    calls, store, trouble = tmp_path / "calls", str(tmp_path / "verdicts"), tmp_path / "trouble"
    calls.mkdir()
    trouble.touch()
    where, bad = str(calls), str(trouble)
    monkeypatch.setattr(classify.with_stored_verdicts, "__defaults__", (5,))

    def judge(request):
        import uuid

        jobs = json.loads(request.split(" ", 1)[1])
        if Path(bad).exists() and any(j["text"] == "text 3" for j in jobs):
            raise SystemExit("lost")  # no error that is caught: the task dies
        for j in jobs:
            (Path(where) / f"{j['text']}-{uuid.uuid4().hex}").touch()
        return [{"id": j["id"], "is_tech_job": not j["text"].endswith("1")} for j in jobs if j["text"] != "text silent"]

    def asked():
        return sorted(p.name.rsplit("-", 1)[0] for p in calls.iterdir())

    def rows(*texts):
        return spark.createDataFrame([(f"d{i}", i, 0, "o", f"text {t}", 1, ["k"], "BOC", "") for i, t in enumerate(texts)], FINDINGS)

    found = rows(*range(20), 0, 0)
    with pytest.raises(Exception):
        classify.validate(found, judge, "p {jobs_json}", store=store)
    trouble.unlink()
    before = asked()
    paid = spark.read.parquet(store).count()
    kept = classify.validate(found, judge, "p {jobs_json}", store=store)
    assert kept.count() == kept.count() == 20 and not {r["description"] for r in kept.collect()} & {"text 1", "text 11"}
    assert len(asked()) == len(before) + 20 - paid and 0 < paid < 20
    assert classify.validate(rows(*range(20)), judge, "p {jobs_json}", store=store).count() == 18 and len(asked()) == len(before) + 20 - paid
    n = len(asked())
    for _ in range(2):
        assert classify.validate(rows("silent", 21, 5), judge, "p {jobs_json}", store=store).count() == 2
    assert len(asked()) == n + 3  # the silent text twice, 21 once
    assert classify.validate(rows(5), judge, "q {jobs_json}", store=store).count() == 1 and len(asked()) == n + 4
