"""Keyed state of a stream: when a source was last scraped.

Each source keeps the time of its last scrape. A request is due when there is none, or when it lies more than the
interval back; a due request becomes the last scrape. State leaves by a timer at the interval's end: once the watermark
has passed it, every request that can still come would be due without it, so nothing is decided otherwise.
State and timers live in the state store under the query's checkpoint, and a restart goes on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that holds values and timers by key.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DUE = "source string, ts timestamp, first boolean"


class LastScraped(StatefulProcessor):
    """Of each source's requests, those that are due. Requests of a batch are taken in order of their times; one that is late counts from the scrape known then."""

    def __init__(self, hours: float = 24):
        self.gap = round(hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long")

    def _forget_at(self, micros: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-(micros + self.gap) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = sorted(t for r in rows for t in r["micros"].tolist())  # one source's requests of one batch: numbers alone
        known = self.last.get()[0] if self.last.exists() else None
        due = []
        for t in asked:
            if known is None or t - known > self.gap:
                due.append((t, known is None))
                known = t
        if due:
            self.last.update((known,))
            self._forget_at(known)
            yield pd.DataFrame({"source": key[0], "ts": pd.to_datetime([t for t, _ in due], unit="us", utc=True), "first": [f for _, f in due]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def due_requests(requests: DataFrame, *, hours: float = 24, delay: str = "1 hour") -> DataFrame:
    """(source, ts, first) of the requests (source, ts) of a stream that are due. first: the source had no state.

    Null sources and times ask for nothing. Rows later than ``delay`` behind the newest are dropped by the watermark.
    The session's state store must be ``STORE``.
    """
    asked = requests.where("source is not null and ts is not null").select(F.col("source").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    asked = asked.withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    return asked.groupBy("source").transformWithStateInPandas(LastScraped(hours), outputStructType=DUE, outputMode="Append", timeMode="EventTime")


def run_due(spark: SparkSession, requests: DataFrame, path: str, checkpoint: str, *, hours: float = 24, delay: str = "1 hour") -> None:
    """One polling run: the requests that have arrived since the last, the due ones appended to a table."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        due_requests(requests, hours=hours, delay=delay).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
