"""Per-service state of the detection streams: the newest events, the last check and the last kept alert.

A service's rows of a micro-batch are taken in the order (time, tie-break); an event that comes later than its
neighbours joins the buffer when it arrives, as it would in a queue. The first event starts the service's clock; the
first event at least the interval after the last check (or the start) sets off a check, which sees the newest ``size``
events up to and with its own instant. No check happens without events.

The state of a key is at most ``size`` rows and two times. A task holds one key's part of a micro-batch, which the
trigger bounds (files or offsets a batch). The state store must be RocksDB (``stateful_session``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOCK = "last_check long, last_alert long"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for stateful jobs: times in UTC, state in RocksDB."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


class ServiceChecks(StatefulProcessor):
    """Runs ``answer(service, check in micros, buffer)`` at every check of a service.

    With ``cooldown_s`` an answer is one row with ``is_anomaly``, to which ``kept`` is added: flagged, and at least the
    cooldown after the last one kept.
    """

    def __init__(
        self,
        schema: StructType,
        tiebreak: str,
        interval_s: int,
        size: int,
        answer: Callable[[str, int, pd.DataFrame], pd.DataFrame | None],
        cooldown_s: int | None = None,
    ) -> None:
        self.schema, self.names, self.order = schema, schema.names, ["at_us", tiebreak]
        self.interval, self.size, self.answer = interval_s * 1_000_000, size, answer
        self.cooldown = None if cooldown_s is None else cooldown_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", self.schema)
        self.clock = handle.getValueState("clock", CLOCK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)[self.names].sort_values(self.order, ignore_index=True, kind="stable")
        times = new["at_us"].to_numpy("int64")
        both, held = new, 0
        if self.events.exists():
            old = pd.DataFrame(list(self.events.get()), columns=self.names)
            both, held = pd.concat([old, new], ignore_index=True), len(old)
        clock = self.clock.get() if self.clock.exists() else (int(times[0]), None)
        last_check, last_alert = clock
        done = 0
        while (first := max(done, int(np.searchsorted(times, last_check + self.interval)))) < len(times):
            last_check = int(times[first])
            done = int(np.searchsorted(times, last_check, "right"))
            answer = self.answer(key[0], last_check, both.iloc[max(0, held + done - self.size) : held + done])
            if answer is not None and self.cooldown is not None:
                ready = last_alert is None or last_check - last_alert >= self.cooldown
                kept = bool(answer["is_anomaly"].iloc[0]) and ready
                last_alert = last_check if kept else last_alert
                answer = answer.assign(kept=kept)
            if answer is not None:
                yield answer
        newest = both.iloc[-self.size :].astype(object)
        self.events.put(list(newest.where(newest.notna(), None).itertuples(index=False, name=None)))
        self.clock.update((last_check, last_alert))

    def close(self) -> None:
        pass


def checks(events: DataFrame, columns: list[str], tiebreak: str, output: str, processor: Callable[[StructType], ServiceChecks]) -> DataFrame:
    """Answers of every service's checks; ``events`` is a stream with time, service, the tie-break and ``columns``."""
    slim = events.where(F.col("service").isNotNull() & F.col("time").isNotNull()).select(
        "service", F.unix_micros("time").alias("at_us"), tiebreak, *[c for c in columns if c != tiebreak]
    )
    schema = StructType([f for f in slim.schema.fields if f.name != "service"])
    return slim.groupBy("service").transformWithStateInPandas(processor(schema), output, "append", "None")


def buffer_rows(names: list[str]) -> Callable[[str, int, pd.DataFrame], pd.DataFrame]:
    """An answer of one row per event of the buffer: service, tick_us, age (1 is the newest), and ``names``."""

    def answer(service: str, check: int, window: pd.DataFrame) -> pd.DataFrame:
        out = window[names].copy()
        out.insert(0, "age", np.arange(len(out), 0, -1))
        out.insert(0, "tick_us", check)
        out.insert(0, "service", service)
        return out

    return answer
