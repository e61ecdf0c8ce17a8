"""python -m nuntia: scan one file, or a landing zone for a day; exit code 0 if anything was found, else 1."""

from __future__ import annotations

import argparse
import importlib
import sys
import time
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from nuntia.operators.lexicon import Lexicon
from nuntia.operators.select import parse_date, source_names
from nuntia.operators.stored import MADE, stored, sweep
from nuntia.plans.landing import scan_landing
from nuntia.plans.outbox import deliver
from nuntia.plans.scan import ScanOptions, scan
from nuntia.plans.sinks import card_messages, console_block, in_order, route, save_html, save_markdown, send, text_messages
from nuntia.sources.common import DROP, FAIL


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="nuntia", description="Find relevant notices.")
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("--file", help="one document; its source is detected")
    what.add_argument("--landing", help="folder with documents by source and day")
    parser.add_argument("--date", type=parse_date, help="day of the bulletins (YYYY-MM-DD), with --landing; by default today, or the latest issue")
    parser.add_argument("-s", "--source", action="append", help="a source, EU, ES or ALL; may be repeated")
    parser.add_argument("--config", help="lexicon file")
    parser.add_argument("--output", default="findings.md", help="report; .html gives HTML")
    parser.add_argument("--format", choices=["markdown", "html"], default="markdown")
    parser.add_argument("--no-ai", action="store_true", help="findings are not put to the classifier")
    parser.add_argument("--classifier", type=named, metavar="MODULE:FUNCTION", help="classifier: request text to a list of dicts with id and is_tech_job")
    parser.add_argument("--prompt", help="file with the classifier's prompt; {jobs_json} in it stands for the findings")
    parser.add_argument("--verdicts", help="folder that keeps the classifier's answers, so that no text is asked twice")
    parser.add_argument("--ledger", help="folder that keeps what has been sent, so that no message is sent twice; they go out from executors")
    parser.add_argument("--fetch", type=named, metavar="MODULE:FUNCTION", help="fetcher of details and documents: address to bytes or text")
    parser.add_argument("--extract-pdf", type=named, metavar="MODULE:FUNCTION", help="reader of PDF files: bytes to a list of the pages' texts")
    parser.add_argument("--notify-cards", type=named, metavar="MODULE:FUNCTION", help="channel that gets findings as JSON for a webhook")
    parser.add_argument("--notify-texts", type=named, metavar="MODULE:FUNCTION", help="channel that gets findings as HTML messages")
    parser.add_argument("--scheduled", action="store_true", help="with --landing: no stand-ins for missing issues, as an earlier run has reported them")
    parser.add_argument("--skip-broken", action="store_true", help="documents that can't be parsed are left out instead of failing their source")
    out = parser.parse_args(argv)
    if out.file and out.date:
        parser.error("--date goes with --landing")
    return out


def named(name: str) -> Callable:
    """The function that MODULE:FUNCTION names."""
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError) as e:
        raise argparse.ArgumentTypeError(f"{name!r} is no MODULE:FUNCTION: {e}") from None


def channels(given: argparse.Namespace) -> dict[str, Callable[[DataFrame], int]]:
    """Where findings are sent, by name."""
    out = {}
    if given.notify_cards and given.ledger:
        out["cards"] = lambda found: deliver(card_messages(found), "payload", given.notify_cards, f"{given.ledger}/cards")
    elif given.notify_cards:
        out["cards"] = lambda found: send(card_messages(found).orderBy("message"), "payload", given.notify_cards, time.sleep)
    if given.notify_texts and given.ledger:
        out["texts"] = lambda found: deliver(text_messages(found), "text", given.notify_texts, f"{given.ledger}/texts")
    elif given.notify_texts:
        out["texts"] = lambda found: send(text_messages(in_order(found)), "text", given.notify_texts, time.sleep)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("nuntia").getOrCreate()
    options = ScanOptions(
        sources=tuple(source_names(given.source)), lexicon=Lexicon.load(given.config), classify=None if given.no_ai else given.classifier, fetch=given.fetch, extract_pdf=given.extract_pdf, broken=DROP if given.skip_broken else FAIL, verdicts=given.verdicts,
        prompt=Path(given.prompt).read_text(encoding="utf-8") if given.prompt else ScanOptions.prompt,
    )
    errors: dict[str, str] = {}
    since = len(MADE)
    found = scan(spark, given.file, options, errors) if given.file else scan_landing(spark, given.landing, options, given.date, given.scheduled, errors)
    found = stored(found, "scan")
    save = save_html if given.format == "html" or given.output.endswith(".html") else save_markdown
    n = save(found, given.output, datetime.now())
    for row in in_order(found).select(console_block().alias("block")).toLocalIterator():
        print(row["block"], end="\n\n")
    print(f"{n} findings, saved to {given.output}")
    for source, error in errors.items():
        print(f"{source}: {error}", file=sys.stderr)
    for channel, sent in (route(found, channels(given)) if n else {}).items():
        print(f"{channel}: {sent}")
    sweep(spark, since)
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main())
