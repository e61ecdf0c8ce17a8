"""Scans of a landing zone, where fetched documents lie in folders by source and day: ROOT/SOURCE/YYYY-MM-DD/files.

Printed and published bulletins are read by day, boards and feeds as they lay there last. Folders are listed through
Spark's file systems, so the zone can be in any store.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from nuntia.operators.select import WALK_BACK_DAYS, issue_or_fallback, source_names
from nuntia.operators.stored import MADE, stored, sweep
from nuntia.plans.scan import ScanOptions, pages_of, scan_each
from nuntia.plans.sinks import route
from nuntia.sources.feed import last_days

#: Sources whose documents belong to a day.
BULLETINS = ("BOP", "BOC", "BOE")


def days_of(spark: SparkSession, root: str, source: str) -> list[date]:
    """Days for which a source has a folder, latest first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{source}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in fs.listStatus(path) if fs.exists(path) else []:
        try:
            out.append(date.fromisoformat(status.getPath().getName()))
        except ValueError:
            continue
    return sorted(out, reverse=True)


def folder(root: str, source: str, day: date) -> str:
    return f"{root.rstrip('/')}/{source}/{day}"


def pages_in(spark: SparkSession, root: str, source: str, wanted: date, day_asked: bool, scheduled: bool, options: ScanOptions) -> DataFrame | None:
    """Pages of a source for a day: of the day's issue, of the latest one where the source falls back to it, or none.

    Of the regional feeds, which list the items of several days, those of the wanted day count, and as latest issue
    those of the latest day in the feeds that lay there last. Falling back is for scans without a day; scheduled scans
    don't fall back, as an earlier run has reported that issue.
    """
    days = [d for d in days_of(spark, root, source) if d <= wanted]
    if source not in BULLETINS:
        return pages_of(spark, source, folder(root, source, days[0]), options) if days else None
    published = wanted in days
    pages = pages_of(spark, source, folder(root, source, wanted), replace(options, bulletin_day=wanted)) if published else None
    choice = issue_or_fallback(source, day_asked, published, pages is None or pages.isEmpty())
    if choice == "latest" and not scheduled:
        if source == "BOC":
            return pages_of(spark, source, folder(root, source, days[0]), replace(options, bulletin_day="latest"))
        earlier = [d for d in days if d in last_days(wanted, WALK_BACK_DAYS) and d < wanted]
        if earlier:
            return pages_of(spark, source, folder(root, source, earlier[0]), options)
    return pages


def scan_landing(spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), day: date | None = None, scheduled: bool = False, errors: dict[str, str] | None = None) -> DataFrame:
    """Findings of the wanted sources for a day; closing dates are compared with that day. Without a day bulletins are
    today's, and boards list all openings, closed or not, unless options.as_of is given. errors: see scan_each."""
    wanted = day or date.today()
    options = replace(options, as_of=options.as_of or day)
    pages = {s: partial(pages_in, spark, root, s, wanted, day is not None, scheduled, options) for s in source_names(list(options.sources))}
    return scan_each(spark, pages, options, errors)


def run_scheduled(spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), channels: dict[str, Callable[[DataFrame], int]] | None = None, day: date | None = None) -> dict:
    """A scheduled run: today's findings, past the classifier, go to every channel, if there are any.

    Returns findings (their number), sent (what each channel sent, or its error), errors (of sources) and a status code:
    200, or 500 if every wanted source failed. A source or channel that fails doesn't stop the others.
    """
    errors: dict[str, str] = {}
    wanted, since = source_names(list(options.sources)), len(MADE)
    found = stored(scan_landing(spark, root, replace(options, as_of=options.as_of or day), day, True, errors), "scheduled")
    n = found.count()
    sent = route(found, channels or {}) if n else {}
    sweep(spark, since)
    return {"status": 500 if len(errors) == len(wanted) else 200, "findings": n, "sent": sent, "errors": errors}
