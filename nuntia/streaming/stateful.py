"""Operators on streams that remember: headings carried from page to page, numbers that go on, what has been reported.

State is kept by key in Spark's state store, moves with its partitions and outlives restarts. Every state ends: when a
document is complete, or when nothing has come for its key for a while, by processing time, it is given up and freed.
As timers must be looked at without new rows too, such a query goes on until it is stopped; run_once() runs one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from nuntia.sources import bop

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keep states of streams that are started from now on in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_once(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what has landed since the last batch, and timers that have run out, as one batch, then stop."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(once=True).start()


def milliseconds(time: timedelta) -> int:
    return int(time.total_seconds() * 1000)


class Timed(StatefulProcessor):
    """A state that is given up `patience` ms after the last rows for its key."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def wait_on(self, timerValues) -> None:
        self.forget_timers()
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def close(self) -> None:
        pass


class Carrying(Timed):
    """Rows of a key in the order of their numbers, each with what `step` makes of what was held before and the row.

    Rows that come before those that they follow wait in the state. Once the timer runs out they go on without these.
    """

    def __init__(self, rows: T.StructType, held: T.StructType, order: str, total: str | None, first: int, step: Callable, patience: int):
        super().__init__(patience)
        self.rows, self.fields, self.order, self.total, self.first, self.step = rows, held, order, total, first, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", T.StructType([T.StructField("next", T.LongType()), *self.fields.fields]))
        self.waiting = handle.getMapState("waiting", "place long", self.rows)

    def state(self) -> tuple[int, tuple]:
        if not self.held.exists():
            return self.first, (None,) * len(self.fields)
        next_, *held = self.held.get()
        return next_, tuple(held)

    def out(self, row: tuple, held: tuple) -> Row:
        return Row(*self.rows.names, *self.fields.names)(*row, *held)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        next_, held = self.state()
        ready: dict[int, tuple] = {}
        for row in rows:
            place = row[self.order]
            if place is not None and place >= next_ and place not in ready:  # what has been passed on already came twice
                ready[place] = tuple(row)
        total = max((row[self.rows.names.index(self.total)] or 0 for row in ready.values()), default=0) if self.total else 0
        while True:
            row = ready.pop(next_, None)
            if row is None and self.waiting.containsKey((next_,)):
                row = tuple(self.waiting.getValue((next_,)))
                self.waiting.removeKey((next_,))
            if row is None:
                break
            if self.total:
                total = max(total, row[self.rows.names.index(self.total)] or 0)
            held = self.step(held, Row(*self.rows.names)(*row))
            yield self.out(row, held)
            next_ += 1
        for place, row in ready.items():
            self.waiting.updateValue((place,), row)
        if self.total and next_ > total > 0 and not ready:
            self.forget()
            self.forget_timers()
        else:
            self.held.update((next_, *held))
            self.wait_on(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, held = self.state()
        for place, row in sorted(((k[0], tuple(v)) for k, v in self.waiting.iterator()), key=lambda x: x[0]):
            held = self.step(held, Row(*self.rows.names)(*row))
            yield self.out(row, held)
        self.forget()

    def forget(self) -> None:
        self.held.clear()
        self.waiting.clear()


def transformed(rows: DataFrame, by: list[str], processor: StatefulProcessor, schema: T.StructType) -> DataFrame:
    return rows.groupBy(*by).transformWithState(processor, schema, "Append", "ProcessingTime")


def carried(rows: DataFrame, by: list[str], order: str, held: dict[str, str], step: Callable[[tuple, Row], tuple], patience: timedelta, total: str | None = None, first: int = 1) -> DataFrame:
    """rows with the columns of held (name: type), passed on from row to row of a key by step(held, row) -> held.

    order: whole numbers without gaps from `first` on, each once; rows that repeat one are dropped. total: a column that
    says how many rows the key has in all; when they have come, its state is freed, else after `patience`.
    """
    fields = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in held.items()])
    return transformed(rows, by, Carrying(rows.schema, fields, order, total, first, step, milliseconds(patience)), T.StructType([*rows.schema.fields, *fields.fields]))


def last_known(columns: list[str]) -> Callable[[tuple, Row], tuple]:
    """A step that holds the last value of each column that isn't null."""
    return lambda held, row: tuple(h if row[c] is None else row[c] for h, c in zip(held, columns, strict=True))


def bulletin_pages(raw: DataFrame, patience: timedelta = timedelta(hours=1), total: str | None = None) -> DataFrame:
    """bop.pages() on a stream: pages of a bulletin (doc_id, page_number, raw_text) that come in any number of batches and in
    any order have the headings of the pages before them. Pages without text must come, too, as they keep the count."""
    local = bop.is_local

    def step(held: tuple, row: Row) -> tuple:
        section = held[0] if row["_head"] is None else row["_head"]
        return section, row["_line"] if local(section) and row["_line"] is not None else held[1]

    named = bop.headed(raw, every=True).drop("_lines")
    found = carried(named, ["doc_id"], "page_number", {"_section": "string", "_organism": "string"}, step, patience, total)
    return bop.finished(found.fillna("", ["_section"]).where(bop.local(False)))


class Seen(StatefulProcessor):
    """The first row of a key, and no other until `ttl` ms have gone by."""

    def __init__(self, order: list[str], ttl: int):
        self.order, self.ttl = order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order))

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, by: list[str], order: list[str], ttl: timedelta) -> DataFrame:
    """The first row of each key, by order within a batch; further ones are dropped until ttl after it."""
    return transformed(rows, by, Seen(order, milliseconds(ttl)), rows.schema)


class Numbering(Timed):
    """Rows of a key numbered on from where the last batch ended."""

    def __init__(self, order: list[str], patience: int, names: list[str]):
        super().__init__(patience)
        self.order, self.names = order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        for row in sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order)):
            n += 1
            yield Row(*self.names)(*row, n)
        self.count.update((n,))
        self.wait_on(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.count.clear()
        return iter(())


def numbered(rows: DataFrame, by: list[str], order: list[str], patience: timedelta, name: str = "number") -> DataFrame:
    """rows with 1, 2, 3 … within each key, by order within a batch and on from the batch before."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])
    return transformed(rows, by, Numbering(order, milliseconds(patience), schema.names), schema)
