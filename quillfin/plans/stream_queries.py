"""Streams over the events table, drained, with the batch result as oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfin.adapters import exact_sum, insider_trades, with_inputs
from quillfin.plans.insider_queries import AMENDED_BY_ARRIVAL
from quillfin.plans.registry import query
from quillfin.plans.timeseries_queries import LIMITED
from quillfin.session import scratch
from quillfin.streaming import stateful
from quillfin.streaming import streams as st
from quillfin.streaming.versioned import BucketedTable, amending


def _drained(spark, stream, mode):
    at = scratch(spark, "stream")
    return st.drain(stream, f"{at}/out", f"{at}/checkpoint", mode)


def _events(spark, sf_dir):
    return st.event_stream(spark, sf_dir, "events*.parquet")


def _ntz(df, *cols):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cols else F.col(c) for c in df.columns])


_SUMS = "count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total"


@query("str_tumbling_window", f"SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')::VARCHAR AS start, (time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR)::VARCHAR AS end, {_SUMS} FROM events GROUP BY 1, 2, 3")
def tumbling(spark, sf_dir):
    return _ntz(_drained(spark, st.tumbling(_events(spark, sf_dir), "6 hours"), "complete"), "start", "end")


@query("str_sliding_window", f"WITH w AS (SELECT event_type, value, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - to_hours(6 * k::INTEGER) AS s FROM events, range(0, 2) r(k)) SELECT event_type, s::VARCHAR AS start, (s + INTERVAL 12 HOUR)::VARCHAR AS end, {_SUMS} FROM w GROUP BY 1, 2, 3")
def sliding(spark, sf_dir):
    return _ntz(_drained(spark, st.sliding(_events(spark, sf_dir), "12 hours", "6 hours"), "complete"), "start", "end")


@query("str_session_window", "WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 24 HOUR, TRUE) AS new FROM events), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts)::VARCHAR AS start, (max(ts) + INTERVAL 24 HOUR)::VARCHAR AS end, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    return _ntz(_drained(spark, st.sessions(_events(spark, sf_dir), "24 hours"), "complete"), "start", "end")


@query("str_idempotent_ingest", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def idempotent_ingest(spark, sf_dir):
    d = _drained(spark, st.first_seen(_events(spark, sf_dir), ["event_id"]), "append")
    return d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("str_expiring_cache", """WITH RECURSIVE b AS MATERIALIZED (SELECT user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
e AS (SELECT key, i, ts AS stored, FALSE AS hit FROM b WHERE i = 1
UNION ALL SELECT b.key, b.i, CASE WHEN b.ts < e.stored + INTERVAL 1 DAY THEN e.stored ELSE b.ts END, b.ts < e.stored + INTERVAL 1 DAY FROM e JOIN b ON b.key = e.key AND b.i = e.i + 1)
SELECT key, count(*) AS reads, count(*) FILTER (hit) AS hits FROM e GROUP BY 1""")
def expiring_cache(spark, sf_dir):
    d = _drained(spark, stateful.expiring_cache(_events(spark, sf_dir), 86_400), "append")
    return d.groupBy("key").agg(F.count(F.lit(1)).alias("reads"), F.count_if("hit").alias("hits"))


@query("str_sliding_limiter", LIMITED)
def sliding_limiter(spark, sf_dir):
    attempts = _events(spark, sf_dir).select("user_id", "ts", F.col("event_id").alias("id"))
    return _ntz(_drained(spark, stateful.limited(attempts, "user_id", seconds=3600, most=2), "append"), "ts").drop("batch")


@query("str_amendments", with_inputs("form4", AMENDED_BY_ARRIVAL))
def amendments(spark, sf_dir):
    """Trades come as files in two runs of a stream, by their order of arrival; the stored table after both."""
    at, trades = scratch(spark, "amended"), insider_trades(spark, sf_dir)
    keys = ("issuer", "owner", "period_of_report")
    table = BucketedTable(spark, f"{at}/table", list(keys), buckets=8)
    for part in (trades.filter("seq <= 3"), trades.filter("seq > 3")):
        part.write.mode("append").parquet(f"{at}/filings")
        filings = spark.readStream.schema(part.schema).parquet(f"{at}/filings")
        q = filings.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(table.merging("filings", amending(keys, "seq"))).start()
        q.awaitTermination()
    return table.read().groupBy("issuer").agg(F.count(F.lit(1)).alias("rows"), exact_sum("shares").alias("shares"))


@query("str_progress", "SELECT CAST(count(*) AS BIGINT) AS input_rows FROM events")
def progress(spark, sf_dir):
    """Rows that a listener saw pass through a stream."""
    seen = st.Progress()
    spark.streams.addListener(seen)
    try:
        _drained(spark, st.tumbling(_events(spark, sf_dir), "6 hours"), "complete")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        st.settled(seen)
    finally:
        spark.streams.removeListener(seen)
    return seen.totals(spark).agg(F.sum("input_rows").alias("input_rows"))
