"""Structured Streaming: windows, idempotent ingest, progress. Each has the rows of its batch counterpart once all input is read."""

from __future__ import annotations

import time
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def event_stream(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Events (event_id, ts, user_id, event_type, value, props) as files arrive in a folder; the number of files a trigger takes is the rate limit."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """Count and sum of each event type and window."""
    return _counts(events.withWatermark("ts", late).groupBy("event_type", F.window("ts", size)))


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    return _counts(events.withWatermark("ts", late).groupBy("event_type", F.window("ts", size, step)))


def _counts(g) -> DataFrame:
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return out.select("event_type", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a user: runs of events less than gap apart."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("window")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "30 days", ts: str = "ts") -> DataFrame:
    """The first row of each key; later ones are dropped, in whatever batch, as long as they come within `late` of the first: state older than that is let go."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class Progress(StreamingQueryListener):
    """Collects a row (query, batch, input_rows, rows_per_second, sink) for each batch of the streams of a session, the sums of each query, and how queries ended. Add it with spark.streams.addListener. Of rows it keeps the last `most` as a log; sums are of all batches."""

    def __init__(self, most: int = 1_000):
        self.rows: deque = deque(maxlen=most)
        self.sums: dict[str, list[int]] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.pop(str(event.runId), None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.rows.append((name, p.batchId, p.numInputRows, p.processedRowsPerSecond, p.sink.description))
        total = self.sums.setdefault(name, [0, 0])
        total[0] += 1
        total[1] += p.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)] = event.exception

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "query string, batch long, input_rows long, rows_per_second double, sink string")


    def totals(self, spark: SparkSession) -> DataFrame:
        """query, batches, input_rows of every query heard of."""
        return spark.createDataFrame([(q, *v) for q, v in self.sums.items()], "query string, batches long, input_rows long")


def settled(progress: Progress, seconds: float = 30) -> None:
    """Wait until a listener has heard how a query ended; events reach it some time after the query itself is over."""
    until = time.monotonic() + seconds
    while not progress.ended and time.monotonic() < until:
        time.sleep(0.05)


def _writer(out: str, mode: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch_id}")

    return write


def refresh(stream: DataFrame, out: str, checkpoint: str, mode: str, every: str = "24 hours") -> StreamingQuery:
    """Keep a sink up to date: what has come since is taken in every so often, until the query is stopped; a restart resumes at the checkpoint."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(_writer(out, mode)).start()


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str) -> DataFrame:
    """Run a stream over all that is there (availableNow; a restart resumes at the checkpoint) and return what its sink holds: the last result in complete mode, else all rows written."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(_writer(out, mode)).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
