"""Keyed state with timers and lifetimes in a RocksDB store: the rate limiter and the expiring cache as streams.

State is kept by key and variable in RocksDB on the executors and with the checkpoint in shared storage, so it is bounded by
disk, not by memory, and a restarted query goes on where it was. In event time a timer ends what has
become of no use once the watermark has passed it; in processing time Spark ends it by its lifetime.
`kept` reads what a checkpoint holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The session with the state store that these streams need; it holds for streams started after it."""
    spark.conf.set(_PROVIDER, ROCKSDB)
    return spark


def _millis(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


def _in_order(batches: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    return sorted(row for b in batches for row in b[list(columns)].itertuples(index=False, name=None))


class _Processor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass

    def wake(self, at_ms: int, timer_values) -> None:
        """One timer for the key, at this time; not before the watermark, which Spark refuses."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(at_ms, timer_values.getCurrentWatermarkInMs() + 1))


class Limiter(_Processor):
    """At most `most` attempts of a key within any `seconds` go through; rejected ones do not count. A list of the times let through is the state; it ends when the last of them is `seconds` old."""

    def __init__(self, seconds: int, most: int):
        self.micros, self.most = seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.through = handle.getListState("through", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        through = [t for (t,) in self.through.get()] if self.through.exists() else []
        out = []
        for ts, id_ in _in_order(rows, "ts", "id"):
            now = ts.value // 1_000
            while through and now - through[0] >= self.micros:
                through.pop(0)
            ok = len(through) < self.most
            if ok:
                through.append(now)
            out.append((key[0], ts, id_, ok))
        if through:
            self.through.put([(t,) for t in through])
            self.wake(-(-(through[-1] + self.micros) // 1_000), timerValues)
        else:
            self.through.clear()
        yield pd.DataFrame(out, columns=["key", "ts", "id", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.through.clear()
        return iter(())


class Cache(_Processor):
    """A read is a hit until `seconds` after its key's entry was stored, else it stores the entry anew. The state is an entry's end, and goes with it."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.until = handle.getValueState("until", "millis double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else None
        times, hits = [t for (t,) in _in_order(rows, "ts")], []
        for t in times:
            now = t.value / 1_000_000
            hits.append(until is not None and now < until)
            if not hits[-1]:
                until = now + self.seconds * 1_000
        self.until.update((until,))
        self.wake(int(-(-until // 1)), timerValues)
        yield pd.DataFrame({"key": [key[0]] * len(times), "ts": times, "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter(())


class LiveCache(_Processor):
    """The newest value of each key, which Spark lets go `seconds` after it was stored by the clock. A row (key, value, hit): a read (value null) gets what is stored, a write stores."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entry = handle.getValueState("entry", "value string", ttlDurationMs=self.seconds * 1_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.entry.get()[0] if self.entry.exists() else None
        out, stored = [], False
        for _, value in sorted(((i, v) for b in rows for i, v in b[["id", "value"]].itertuples(index=False, name=None)), key=lambda x: x[0]):
            out.append((key[0], now if value is None else value, value is None and now is not None))
            if value is not None:
                now, stored = value, True
        if stored:
            self.entry.update((now,))
        yield pd.DataFrame(out, columns=["key", "value", "hit"])


def limited(attempts: DataFrame, key: str, seconds: int = 60, most: int = 10, late: str = "1 hour") -> DataFrame:
    """key, ts, id, allowed of a stream of attempts (key, ts, id). Attempts of a micro-batch are taken in order of time, then id; one that comes in a later batch meets the state of its arrival. Rows later than `late` are dropped with the watermark."""
    with_rocksdb(attempts.sparkSession)
    rows = attempts.select(F.col(key).cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Limiter(seconds, most), "key long, ts timestamp, id long, allowed boolean", "Append", "EventTime")


def expiring_cache(events: DataFrame, seconds: int, late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """key, ts, hit of a stream of reads. Reads of a batch are taken in order; those of a later batch that are older than what is stored are hits."""
    with_rocksdb(events.sparkSession)
    rows = events.select(F.col(key).cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Cache(seconds), "key long, ts timestamp, hit boolean", "Append", "EventTime")


def live_cache(requests: DataFrame, seconds: int) -> DataFrame:
    """key, value, hit of a stream of requests (key, id: their order, value: null to read, else to store), with entries that live `seconds` by the clock. By the clock there is always another batch to run, so start it with a processingTime trigger, or once=True for a single batch."""
    with_rocksdb(requests.sparkSession)
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("value").cast("string").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(LiveCache(seconds), "key string, value string, hit boolean", "Append", "ProcessingTime")


def kept(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """key and value of a state variable as a checkpoint holds it after its last batch."""
    return with_rocksdb(spark).read.format("statestore").option("stateVarName", variable).load(checkpoint)
