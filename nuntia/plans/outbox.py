"""Messages sent from executors, once each: a data source to write to, and a ledger of what has been sent.

A message has a key. Its key is in the ledger as soon as it has been sent, so a run that fails midway and is repeated, a task that is
tried again and a message that comes up again later send nothing twice. Only a machine that is lost between sending
and writing a line can cause one message to be sent again.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from nuntia.plans.sinks import PAUSE

LEDGER = "key string, run string"


@dataclass
class Sent(WriterCommitMessage):
    """What a task has sent."""

    messages: int


class MessageWriter(DataSourceWriter):
    def __init__(self, post: Callable[[str], None], ledger: str, run: str, pause: float, sleep: Callable[[float], None]):
        self.post, self.ledger, self.run, self.pause, self.sleep = post, Path(ledger), run, pause, sleep

    def write(self, iterator: Iterator) -> Sent:
        task = TaskContext.get()
        part = f"{self.run}-{task.partitionId()}"
        # what an earlier attempt of this task has sent already
        known = {json.loads(line)["key"] for path in self.ledger.glob(f"{part}-*.json") for line in path.read_text().splitlines()}
        n = 0
        with open(self.ledger / f"{part}-{task.taskAttemptId()}.json", "a") as lines:
            for row in iterator:
                if row["key"] in known:
                    continue
                self.post(row["payload"])
                lines.write(json.dumps({"key": row["key"], "run": self.run}) + "\n")
                lines.flush()
                os.fsync(lines.fileno())
                n += 1
                self.sleep(self.pause)
        return Sent(n)

    def commit(self, messages: list[Sent | None]) -> None:
        """Nothing is left to do: each message was entered when it was sent."""

    def abort(self, messages: list[Sent | None]) -> None:
        """What was sent stays in the ledger, so that the next run doesn't send it again."""


class MessageSink(DataSource):
    """Options: hook, a pickled function and pause as hex; ledger; run; pause."""

    @classmethod
    def name(cls) -> str:
        return "nuntia_messages"

    def writer(self, schema, overwrite: bool) -> MessageWriter:
        post, sleep = cloudpickle.loads(bytes.fromhex(self.options["hook"]))
        return MessageWriter(post, self.options["ledger"], self.options["run"], float(self.options["pause"]), sleep)


def local_path(folder: str) -> str:
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"the ledger is written line by line and needs a folder that all machines have mounted, not {folder}")
    return folder.removeprefix("file://")


def sent(ledger: DataFrame | None, messages: DataFrame) -> DataFrame:
    """Messages (key, payload) whose key isn't in the ledger, each key once."""
    fresh = messages.where(F.col("key").isNotNull() & F.col("payload").isNotNull()).dropDuplicates(["key"])
    return fresh if ledger is None else fresh.join(ledger.select("key"), "key", "left_anti")


def deliver(messages: DataFrame, payload: Column | str, post: Callable[[str], None], ledger: str, key: Column | str | None = None, per_second: float = 1 / PAUSE, tasks: int = 4, sleep: Callable[[float], None] = time.sleep) -> int:
    """Send what hasn't been sent yet, from executors, and return how many messages that were.

    key tells messages apart, by default a hash of the payload. ledger: a folder that all machines have mounted. tasks
    send at a time, each so slowly that together they stay below per_second. A message that fails ends the run with
    its error; what was sent before is in the ledger, and a repeated run sends the rest.
    """
    spark, run, folder = messages.sparkSession, uuid.uuid4().hex, local_path(ledger)
    os.makedirs(folder, exist_ok=True)
    text = F.col(payload) if isinstance(payload, str) else payload
    name = F.sha2(text, 256) if key is None else F.col(key) if isinstance(key, str) else key
    known = spark.read.schema(LEDGER).json(f"file://{folder}")
    open_ = sent(known, messages.select(name.cast("string").alias("key"), text.alias("payload"))).repartition(tasks)
    spark.dataSource.register(MessageSink)
    writer = open_.write.format("nuntia_messages").mode("append").option("hook", cloudpickle.dumps((post, sleep)).hex())
    writer.option("ledger", folder).option("run", run).option("pause", str(tasks / per_second)).save()
    return spark.read.schema(LEDGER).json(f"file://{folder}").where(F.col("run") == run).count()
