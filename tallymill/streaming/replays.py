"""Replayed receipts on a stream: state of our own per receipt, which expires."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state of our own needs; the session's setting is as it was afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class LastRequests(StatefulProcessor):
    """Of a receipt, the last request and the last one other than it, with their times: all that a replay is known by."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long, request string, before_at long, before_request string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["at", "request"])
        at, request, before_at, before_request = self.seen.get() if self.seen.exists() else (None, None, None, None)
        found = []
        for now, this in zip(part["at"].tolist(), part["request"].tolist()):
            if request is not None and this != request:
                before_at, before_request = at, request
            if before_at is not None and now - before_at <= self.span:
                found.append((key[0], this, before_request))
            at, request = now if at is None else max(at, now), this
        self.seen.update((at, request, before_at, before_request))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((at + self.span + 1) * 1000)  # from then on nothing can be a replay of what is known
        yield pd.DataFrame(found, columns=["receipt", "request", "earlier_request"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame({"receipt": [], "request": [], "earlier_request": []}, dtype=str)

    def close(self) -> None:
        pass


def replays(events: DataFrame, ts: str, receipt: str, request: str, span: int = 90 * DAY, late: str = "1 hour") -> DataFrame:
    """receipt, request, earlier_request of rows whose receipt came with another request up to ``span`` seconds before, as ``detection.replays`` has them.

    Rows are taken in the order of their batches and by time within one; a row
    that comes after later ones of its receipt is held against those. Rows
    without a receipt, request or time are left out. State goes ``span`` seconds
    after a receipt's last row, by the watermark. Wants ``rocksdb_state`` when it is started.
    """
    known = F.col(receipt).isNotNull() & F.col(request).isNotNull() & F.col(ts).isNotNull()
    rows = events.filter(known).withWatermark(ts, late)
    rows = rows.select(F.col(receipt).cast("string").alias("receipt"), F.col(request).cast("string").alias("request"), F.unix_seconds(ts).alias("at"), F.col(ts))
    schema = "receipt string, request string, earlier_request string"
    return rows.groupBy("receipt").transformWithStateInPandas(statefulProcessor=LastRequests(span), outputStructType=schema, outputMode="Append", timeMode="EventTime")
