"""Dated and undated feeds as a Spark data source: one partition per source and day, each fetched by an executor.

The fetcher is a function (source, day or None) -> bytes, None for what isn't published. Nothing here knows about
networks: in production the function downloads, in tests it looks up a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Days for which a missing issue is still looked for, and addresses that a task fetches at a time.
LATE_DAYS, AT_ONCE = 7, 5
SCHEMA = "source string, day date, content binary, error string"


class FeedPartition(InputPartition):
    def __init__(self, source: str, day: date | None):
        self.source, self.day = source, day


def issue(fetch: Callable[[str, date | None], bytes | None], partition: FeedPartition) -> Iterator[tuple]:
    """The row of a source's issue of a day, none if there is none."""
    try:
        content, error = fetch(partition.source, partition.day), None
    except Exception as e:  # one feed's failure must not stop the others; it is reported in its row
        content, error = None, f"{type(e).__name__}: {e}"
    if content is not None or error:
        yield (partition.source, partition.day, content, error)


class FeedReader(DataSourceReader):
    def __init__(self, sources: list[str], days: list[date | None], fetch: Callable[[str, date | None], bytes | None]):
        self.sources, self.days, self.fetch = sources, days, fetch

    def partitions(self) -> list[InputPartition]:
        return [FeedPartition(s, d) for s in self.sources for d in self.days]

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        return issue(self.fetch, partition)


class FeedStreamReader(DataSourceStreamReader):
    """Issues as they come out. An offset holds, for each source, the day up to which issues have been looked for, and
    which of the last LATE_DAYS days had none: `upto` and `late`. Both follow from the clock and from what is published,
    so a reader needs no memory. Between two offsets lie the days after the first, but for those still late, and days that
    were late in the first and no longer are. So every issue is read once, and those that come out late are, too.
    """

    def __init__(self, sources: list[str], since: date, fetch: Callable, published: Callable[[str, list[date]], list[date]], clock: Callable[[], date]):
        self.sources, self.since, self.fetch, self.published, self.clock = sources, since, fetch, published, clock

    def initialOffset(self) -> dict:
        return {s: {"upto": str(self.since - timedelta(1)), "late": []} for s in self.sources}

    def latestOffset(self) -> dict:
        today, out = self.clock(), {}
        for source in self.sources:
            days = [d for d in reversed(last_days(today, LATE_DAYS)) if d >= self.since]
            there = set(self.published(source, days)) if days else set()
            out[source] = {"upto": str(max(today, self.since - timedelta(1))), "late": [str(d) for d in days if d not in there]}
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for source in self.sources:
            before, after = start.get(source) or self.initialOffset()[source], end[source]
            first, last = date.fromisoformat(before["upto"]), date.fromisoformat(after["upto"])
            days = {date.fromisoformat(d) for d in before["late"]} | {first + timedelta(n) for n in range(1, (last - first).days + 1)}
            out += [FeedPartition(source, d) for d in sorted(days - {date.fromisoformat(d) for d in after["late"]})]
        return out

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        return issue(self.fetch, partition)

    def commit(self, end: dict) -> None:
        """Nothing is held back for issues that have been processed."""


class FeedSource(DataSource):
    """Options: sources and days, comma-separated; fetch, a pickled function as hex. For streams since, a day, and hooks, the
    pickled functions published and clock."""

    @classmethod
    def name(cls) -> str:
        return "nuntia_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        days = [date.fromisoformat(d) for d in self.options.get("days", "").split(",") if d] or [None]
        return FeedReader(self.options["sources"].split(","), days, cloudpickle.loads(bytes.fromhex(self.options["fetch"])))

    def streamReader(self, schema) -> DataSourceStreamReader:
        published, clock = cloudpickle.loads(bytes.fromhex(self.options["hooks"]))
        return FeedStreamReader(self.options["sources"].split(","), date.fromisoformat(self.options["since"]), cloudpickle.loads(bytes.fromhex(self.options["fetch"])), published, clock)


def read_feeds(spark: SparkSession, fetch: Callable[[str, date | None], bytes | None], sources: list[str], days: list[date] | None = None) -> DataFrame:
    """What fetch gives for every source and day: source, day, content, error. Unpublished issues have no row."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("nuntia_feed").option("sources", ",".join(sources)).option("days", ",".join(map(str, days or []))).option("fetch", cloudpickle.dumps(fetch).hex()).load()


def stream_feeds(spark: SparkSession, fetch: Callable[[str, date], bytes | None], published: Callable[[str, list[date]], list[date]], sources: list[str], since: date, clock: Callable[[], date] = date.today) -> DataFrame:
    """A stream of what fetch gives for every source and day from `since` on, as issues come out: source, day, content, error.

    published says which of some days a source has an issue for; it is asked by the driver about the last LATE_DAYS days,
    for each batch. A stream that starts again goes on where it ended, and fetches no issue of a finished batch again.
    """
    spark.dataSource.register(FeedSource)
    stream = spark.readStream.format("nuntia_feed").option("sources", ",".join(sources)).option("since", str(since))
    return stream.option("fetch", cloudpickle.dumps(fetch).hex()).option("hooks", cloudpickle.dumps((published, clock)).hex()).load()


def last_days(day: date, days: int = 7) -> list[date]:
    """A day and those before it, latest first."""
    return [day - timedelta(n) for n in range(days)]


def fetch_each(df: DataFrame, column: str, fetch: Callable[[str], bytes | str | None], at_once: int = AT_ONCE, tasks: int | None = None) -> DataFrame:
    """content and error for every distinct address in a column: detail pages and documents of listings that have been
    filtered. Addresses are spread over executors; one that fails has its message in error and no content. A task fetches
    at_once addresses at a time, and `tasks` of them run at most, so that sites are asked so many times at once at most."""
    import pandas as pd

    def one(address: str) -> tuple:
        try:
            got = fetch(address)
            return address, got.encode() if isinstance(got, str) else got, None
        except Exception as e:
            return address, None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                for i in range(0, len(frame), 10 * at_once):  # few contents are held at a time
                    yield pd.DataFrame(list(pool.map(one, frame[column].iloc[i : i + 10 * at_once])), columns=[column, "content", "error"])

    addresses = df.select(column).where(f"`{column}` IS NOT NULL").distinct()
    return (addresses if tasks is None else addresses.repartition(tasks)).mapInPandas(run, f"`{column}` string, content binary, error string")
