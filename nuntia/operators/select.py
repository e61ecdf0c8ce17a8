"""Which documents and dates to use."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nuntia.functions.dates import open_on
from nuntia.operators.windows import carried
from nuntia.schema import SOURCE_GROUPS, SOURCES

#: Fixed value: link to a bulletin in an index page; the file's name repeats its folder's.
BULLETIN = r"(?i)boletines/(\d{4})/(\d+)-(\d+)-(\d+)/\2-\3-\4\.pdf"
WALK_BACK_DAYS = 7


def parse_date(text: str) -> date:
    """yyyy-mm-dd, or a ValueError that says so."""
    try:
        return date.fromisoformat(text)
    except ValueError:
        raise ValueError(f"{text!r} is no date in the form YYYY-MM-DD") from None


def source_names(wanted: list[str] | None = None) -> list[str]:
    """Names of sources, groups (ALL, ES, EU) expanded where they stand, each once, in order."""
    out: dict[str, None] = {}
    for name in wanted or ["ALL"]:
        group = SOURCE_GROUPS.get(name.upper(), (name.upper(),))
        unknown = [s for s in group if s not in SOURCES]
        if unknown:
            raise ValueError(f"unknown source {unknown[0]}")
        out |= dict.fromkeys(group)
    return list(out)


def only_sources(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Rows of these sources; on a table partitioned by source only their folders are read."""
    return df.where(F.col("source").isin(*source_names(wanted)))


def source_rank(source: Column | str = "source", order: tuple[str, ...] = SOURCES) -> Column:
    """Place of a source in reports, from 1; 0 for unknown ones."""
    return F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source) if isinstance(source, str) else source).cast("int")


def latest(df: DataFrame, day: str) -> DataFrame:
    """Rows of the latest day."""
    return df.join(F.broadcast(df.agg(F.max(day).alias("_latest"))), F.col(day) == F.col("_latest")).drop("_latest")


def walk_back(available: DataFrame, day: str, start: Column, days: int = WALK_BACK_DAYS) -> DataFrame:
    """One row: found, the latest of start and the days before it that is available (null if none), and probes, how
    many days a search backwards looks at until then."""
    found = available.where(F.col(day).between(F.date_sub(start, days - 1), start)).agg(F.max(day).alias("found"))
    return found.select("found", F.coalesce(F.datediff(start, F.col("found")) + 1, F.lit(days)).alias("probes"))


def bulletins(index: DataFrame, html: str = "html") -> DataFrame:
    """Bulletins linked from index pages: path and day; links with impossible dates are left out."""
    links = index.select(F.explode(F.regexp_extract_all(html, F.lit(BULLETIN), F.lit(0))).alias("path"))
    part = lambda i: F.regexp_extract("path", BULLETIN, i)
    return links.withColumn("day", F.try_to_date(F.concat_ws("-", part(1), part(3), part(2)), "y-M-d")).where("day IS NOT NULL")


def latest_bulletin(index: DataFrame, html: str = "html") -> DataFrame:
    """path and day of the latest bulletin (one row, nulls if there is none)."""
    return bulletins(index, html).agg(F.max_by("path", "day").alias("path"), F.max("day").alias("day"))


def still_open(df: DataFrame, closing: str, as_of: Column) -> DataFrame:
    """Rows not closed on as_of; those without a closing date stay."""
    return df.where(open_on(closing, as_of))


def stale_fallbacks_dropped(df: DataFrame, day: str, wanted: Column, scheduled: bool) -> DataFrame:
    """In scheduled runs, rows of fallback issues from before the wanted day go: an earlier run has reported them."""
    return df.where(F.coalesce(F.col(day) >= wanted, F.lit(False))) if scheduled else df


def issue_or_fallback(source: str, day_asked: bool, published: bool, empty: bool) -> str:
    """Which issue of a bulletin to use: `issue`, `latest` or `none`.

    The latest issue stands in only if no day was asked for: if the day's issue isn't published (BOP, BOE), or if it
    holds nothing (BOC, BOE).
    """
    lacking = (not published and source in ("BOP", "BOE")) or (published and empty and source in ("BOC", "BOE"))
    if lacking and not day_asked:
        return "latest"
    return "issue" if published else "none"


def issues_asof(requests: DataFrame, issues: DataFrame, by: list[str], day: str, days: int = WALK_BACK_DAYS, before: bool = False) -> DataFrame:
    """walk_back() for many requests at once, as one plan: by, day, found and probes for each different request.

    found is the last day of an issue of the same `by` on the day asked for or in the days before it, `days` in all (with
    `before`, strictly before it), and null if there is none; probes is how many days a search backwards looks at.
    Requests and issues are put in one order and the last issue is carried forward, in groups of any size.
    """
    own = lambda df, kind, issue: df.select(*by, F.col(day).alias("_day"), F.lit(kind).alias("_kind"), issue.alias("_issue")).where("_day IS NOT NULL").distinct()
    both = own(issues, 2 if before else 0, F.col(day)).unionByName(own(requests, 1, F.lit(None).cast("date")))
    held = carried(both, {"_last": "_issue"}, by, ["_day", "_kind"]).where("_kind = 1")
    near = F.datediff("_day", "_last") < days
    return held.select(*by, F.col("_day").alias(day), F.when(near, F.col("_last")).alias("found"), F.when(near, F.datediff("_day", "_last") + 1).otherwise(days).alias("probes"))


def issue_choice(source: Column | str, day_asked: Column, published: Column, empty: Column) -> Column:
    """issue_or_fallback() as a column."""
    source = F.col(source) if isinstance(source, str) else source
    lacking = (~published & source.isin("BOP", "BOE")) | (published & empty & source.isin("BOC", "BOE"))
    return F.when(lacking & ~day_asked, "latest").when(published, "issue").otherwise("none")


def chosen_issues(requests: DataFrame, issues: DataFrame, by: list[str], scheduled: bool = False) -> DataFrame:
    """requests with choice and use_day, for a back-fill of any number of sources and days in one plan.

    requests: by, among them source, day and asked, whether a day was asked for; issues: by, day and items, how many
    relevant ones the issue holds. use_day is the day of the issue to read, null for none. In place of a lacking issue stands
    the latest of the days before, WALK_BACK_DAYS in all, of the regional feeds the same one, whose latest items count; scheduled runs
    have no stand-in.
    """
    own = issues.groupBy(*by, "day").agg((F.coalesce(F.sum("items"), F.lit(0)) == 0).alias("_empty"))
    same = lambda a, b, keys: reduce(and_, [a[k].eqNullSafe(b[k]) for k in keys])
    asked, there = requests.alias("r"), own.alias("i")
    rows = asked.join(there, same(asked, there, [*by, "day"]), "left").select("r.*", F.col("i.day").isNotNull().alias("_published"), F.coalesce("i._empty", F.lit(True)).alias("_empty"))
    rows = rows.withColumn("choice", issue_choice("source", F.col("asked"), F.col("_published"), F.col("_empty")))
    last = issues_asof(requests, issues, by, "day", before=True)
    rows, last = rows.alias("r"), last.alias("l")
    stand_in = F.when(F.col("r.source") == "BOC", F.col("r.day")).otherwise(F.coalesce("l.found", F.when(F.col("_published"), F.col("r.day"))))
    use = F.when(F.col("choice") == "issue", F.col("r.day")).when(F.col("choice") == "latest", F.when(F.col("_published"), F.col("r.day")) if scheduled else stand_in)
    return rows.join(last, same(rows, last, [*by, "day"]), "left").select("r.*", use.alias("use_day")).drop("_published", "_empty")
