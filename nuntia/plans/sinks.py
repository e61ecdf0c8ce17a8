"""Findings as text for people: console, Markdown, HTML, and messages for chats.

Every row is rendered by column expressions; only reports that are one file pass through the driver, row by row.
"""

from __future__ import annotations

import os
import shutil
import textwrap
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nuntia.functions.text import escape_html, escape_markup, strip, truncated
from nuntia.operators.select import source_rank
from nuntia.operators.windows import numbered_overall

# Sizes of messages and of console lines, pause between messages.
TITLE, BODY, WORDS, LONG_BODY, PER_MESSAGE, COLOUR, PAUSE = 256, 2048, 1024, 3000, 2, 3447003, 0.5
WIDTH, INDENT = 76, "   "
NOTHING = "No IT-related jobs found matching your filters in any source."
ORDER = ["_rank", "doc_id", "ordinal", "para_no"]


def in_order(findings: DataFrame) -> DataFrame:
    return findings.withColumn("_rank", source_rank()).orderBy(*ORDER)


def label() -> Column:
    """Source and place of a finding; only bulletins in print have pages."""
    kind = F.when(F.col("source") == "BOP", "Página").otherwise("Item")
    return F.concat_ws(" ", F.concat("source", F.lit(" - "), kind), F.col("page_number").cast("string"))


def ticked(c: str = "matched_keywords", mark: str = "`", end: str | None = None) -> Column:
    return F.array_join(F.transform(c, lambda k: F.concat(F.lit(mark), k, F.lit(end or mark))), ", ")


@F.pandas_udf(T.StringType())
def wrapped(s: pd.Series) -> pd.Series:
    """Paragraphs filled to lines of WIDTH characters."""
    filler = textwrap.TextWrapper(width=WIDTH, initial_indent=INDENT, subsequent_indent=INDENT)
    return s.map(filler.fill, na_action="ignore")


def console_block() -> Column:
    head = F.concat(F.lit("📌 "), F.upper("organism"), F.lit(" ("), label(), F.lit(")"))
    words = F.concat(F.lit(f"{INDENT}🔑 Keywords matched: "), F.array_join("matched_keywords", ", "))
    link = F.when(F.col("url") != "", F.concat(F.lit(f"{INDENT}🔗 URL: "), "url"))
    return F.concat_ws("\n", head, wrapped(F.col("description")), words, link)


def markdown_block() -> Column:
    head = F.concat(F.lit("## 📌 "), F.upper("organism"), F.lit(" ("), label(), F.lit(")\n\n**Description:**\n"), strip("description"))
    link = F.when(F.col("url") != "", F.concat(F.lit("\n\n**URL:** [Link to announcement]("), "url", F.lit(")"))).otherwise("")
    return F.concat(head, F.lit("\n\n**Keywords:** "), ticked(), link, F.lit("\n\n"))


def html_card() -> Column:
    words = F.array_join(F.transform("matched_keywords", lambda k: F.concat(F.lit('<span class="chip">'), escape_html(k), F.lit("</span>"))), "")
    link = F.when(F.col("url") != "", F.concat(F.lit('<footer><a href="'), escape_html("url"), F.lit('" target="_blank" rel="noopener noreferrer">View Original Bulletin &rarr;</a></footer>'))).otherwise("")
    return F.concat(
        F.lit('<article class="job-card"><div class="source-badge">'), escape_html(label()), F.lit('</div><h2>'), escape_html(F.upper("organism")), F.lit('</h2><p class="description-text">'),
        escape_html(strip("description")), F.lit('</p><div class="keywords-list">'), words, F.lit("</div>"), link, F.lit("</article>\n"),
    )


def save_markdown(findings: DataFrame, path: str | Path, now: datetime) -> int:
    """One Markdown file, overwritten; returns the number of findings. Rows stream through the driver."""
    return _report(findings, path, markdown_block(), lambda n: f"# 🔎 IT Job Findings\n\n**Scan Date:** {now:%Y-%m-%d %H:%M}\n**Total Findings:** {n}\n\n---\n\n", "---\n\n", f"ℹ️ {NOTHING}\n", "")


STYLE = "body{font-family:sans-serif;max-width:60rem;margin:2rem auto;background:#18181b;color:#fafafa}.job-card{border:1px solid #52525b;border-radius:8px;padding:1rem;margin:1rem 0}.chip{border-radius:9px;background:#3f3f46;padding:.1rem .5rem;margin-right:.3rem}.description-text{white-space:pre-wrap}a{color:#93c5fd}"


def save_html(findings: DataFrame, path: str | Path, now: datetime) -> int:
    """One self-contained HTML file, overwritten; returns the number of findings."""
    head = lambda n: f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>IT Job Findings</title><style>{STYLE}</style></head><body>\n<h1>IT Job Findings</h1>\n<p><span>Scan Date: {now:%Y-%m-%d %H:%M}</span> <span>Total Findings: {n}</span></p>\n'
    return _report(findings, path, html_card(), head, "", f'<div class="empty-state"><p>{NOTHING}</p></div>\n', "</body></html>\n")


def _report(findings: DataFrame, path: str | Path, block: Column, head: Callable[[int], str], between: str, empty: str, foot: str) -> int:
    """The head names the number of findings, so the body is written first, beside the report: findings run once."""
    n, body = 0, f"{path}.body"
    with open(body, "w", encoding="utf-8") as f:
        for row in in_order(findings).select(block.alias("block")).toLocalIterator():
            f.write((between if n else "") + row["block"])
            n += 1
    with open(path, "w", encoding="utf-8") as f, open(body, encoding="utf-8") as rows:
        f.write(head(n))
        shutil.copyfileobj(rows, f)
        f.write(foot if n else empty + foot)
    os.remove(body)
    return n


def write_markdown_parts(findings: DataFrame, path: str) -> None:
    """Rendered findings as text files, one per partition and in order, for results too large for one file."""
    in_order(findings).select(markdown_block().alias("value")).write.mode("overwrite").text(path)


def card_messages(findings: DataFrame) -> DataFrame:
    """message (from 0) and payload, JSON for a webhook: PER_MESSAGE findings each, with an announcement in the first."""
    rows = numbered_overall(findings.withColumn("_rank", source_rank()), ORDER, "_n").withColumn("_n", F.col("_n") - 1)
    place = F.concat("source", F.lit(" (Page/Item "), F.col("page_number").cast("string"), F.lit(")"))
    fields = F.array(
        F.struct(F.lit("Source / Location").alias("name"), place.alias("value"), F.lit(True).alias("inline")),
        F.struct(F.lit("Keywords Matched").alias("name"), F.coalesce(F.nullif(F.substring(ticked(), 1, WORDS), F.lit("")), F.lit("None")).alias("value"), F.lit(True).alias("inline")),
    )
    title = F.substring(F.concat(F.lit("📌 "), F.upper("organism")), 1, TITLE)
    embed = F.struct(title.alias("title"), F.substring("description", 1, BODY).alias("description"), F.lit(COLOUR).alias("color"), fields.alias("fields"), F.nullif("url", F.lit("")).alias("url"))
    grouped = rows.select(F.floor(F.col("_n") / PER_MESSAGE).alias("message"), F.struct("_n", embed.alias("e")).alias("x")).groupBy("message").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    content = F.when(F.col("message") == 0, "🚀 **New IT Job Opportunities Found!**").otherwise("")
    return grouped.select("message", F.to_json(F.struct(content.alias("content"), F.transform("xs", lambda x: x["e"]).alias("embeds"))).alias("payload"))


def text_messages(findings: DataFrame) -> DataFrame:
    """Keys of a finding and text, one HTML message each."""
    lines = [
        F.concat(F.lit("📌 <b>"), escape_markup(F.upper("organism")), F.lit("</b>")), F.lit(""), truncated(escape_markup("description"), LONG_BODY, "..."), F.lit(""),
        F.concat(F.lit("🔑 <b>Keywords:</b> "), ticked(mark="<code>", end="</code>")),
        F.concat(F.lit("🌐 <b>Source:</b> "), "source", F.lit(" (Page/Item "), F.col("page_number").cast("string"), F.lit(")")),
        F.when(F.col("url") != "", F.concat(F.lit("🔗 <a href='"), "url", F.lit("'>Link to announcement</a>"))),
    ]
    return findings.select("source", "doc_id", "ordinal", "para_no", F.concat_ws("\n", *lines).alias("text"))


def send(messages: DataFrame, column: str, post: Callable[[str], None], sleep: Callable[[float], None]) -> int:
    """Hand every message to post, with a pause after each; returns how many were sent."""
    n = 0
    for row in messages.toLocalIterator():
        post(row[column])
        sleep(PAUSE)
        n += 1
    return n


def route(findings: DataFrame, channels: dict[str, Callable[[DataFrame], int]]) -> dict[str, int | str]:
    """What each configured channel sent, or its error: a failing channel doesn't keep the others from sending."""
    out: dict[str, int | str] = {}
    for name, channel in channels.items():
        try:
            out[name] = channel(findings)
        except Exception as e:
            out[name] = f"{type(e).__name__}: {e}"
    return out
