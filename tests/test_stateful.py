"""Keyed state: equal to the batch fold over several micro-batches and a restart, and gone when its time is over."""

import time
from datetime import datetime, timedelta

import pytest

from quillfin.operators import timeseries as ts
from quillfin.streaming import stateful as sf
from quillfin.streaming import streams as st

BEGIN = datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, id long"


def attempts(n=240, users=6, step=37):
    return [(i % users if i % 5 else 0, BEGIN + timedelta(seconds=i * step), i) for i in range(n)]


def write(spark, folder, rows, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={number}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def plain(df):
    return sorted((r["key"], str(r["ts"]), r["id"], r["allowed"]) for r in df.collect())


def test_limiter_over_batches_and_a_restart(spark, tmp_path):
    rows = attempts()
    folder, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for k in range(3):
        write(spark, folder, rows[k * 40 : (k + 1) * 40], k)
    st.drain(sf.limited(stream(spark, folder), "user_id", 600, 3), out, checkpoint, "append")
    for k in range(3, 6):
        write(spark, folder, rows[k * 40 : (k + 1) * 40], k)
    got = st.drain(sf.limited(stream(spark, folder), "user_id", 600, 3), out, checkpoint, "append")
    want = ts.sliding_limiter(spark.createDataFrame(rows, SCHEMA), "user_id", 600, 3)
    assert plain(got) == plain(want) and 0 < got.filter("allowed").count() < len(rows)
    assert got.select("batch").distinct().count() >= 6


def test_limiter_state_ends(spark, tmp_path):
    folder, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    write(spark, folder, [(1, BEGIN, 1), (1, BEGIN + timedelta(seconds=5), 2), (2, BEGIN + timedelta(hours=1), 3)], 0)
    run = lambda: st.drain(sf.limited(stream(spark, folder), "user_id", 60, 1, "10 minutes"), out, checkpoint, "append")
    run()
    assert sorted(r["key"]["key"] for r in sf.kept(spark, checkpoint, "through").select("key").collect()) in ([1, 2], [2])
    write(spark, folder, [(3, BEGIN + timedelta(hours=5), 4)], 1)
    run()
    write(spark, folder, [(3, BEGIN + timedelta(hours=5, seconds=1), 5)], 2)
    got = run()
    assert [r["key"]["key"] for r in sf.kept(spark, checkpoint, "through").select("key").collect()] == [3]
    assert [(r["id"], r["allowed"]) for r in got.orderBy("id").collect()] == [(1, True), (2, False), (3, True), (4, True), (5, False)]


def test_cache_equals_a_fold(spark, tmp_path):
    rows = attempts(200, 4, 200)
    folder = f"{tmp_path}/in"
    for k in range(4):
        write(spark, folder, rows[k * 50 : (k + 1) * 50], k)
    got = st.drain(sf.expiring_cache(stream(spark, folder), 1_000), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "append")
    until, want = {}, []
    for user, at, _ in rows:
        hit = user in until and at < until[user]
        if not hit:
            until[user] = at + timedelta(seconds=1_000)
        want.append((user, str(at), hit))
    assert sorted((r["key"], str(r["ts"]), r["hit"]) for r in got.collect()) == sorted(want)
    left = sf.kept(spark, f"{tmp_path}/checkpoint", "until").count()
    assert 0 < left <= 4


@pytest.mark.parametrize("wait, hit", [(0, True), (8, False)])
def test_live_cache_lets_go(spark, tmp_path, wait, hit):
    schema = "key string, id long, value string"
    put = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")

    def run():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        # By the clock there is always another batch to run: one batch for each run.
        q = sf.live_cache(s, 600 if hit else 6).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(once=True).format("parquet").start(f"{tmp_path}/out")
        assert q.awaitTermination(60)
        return spark.read.schema("key string, value string, hit boolean").parquet(f"{tmp_path}/out")

    put([("a", 1, None), ("a", 2, "x"), ("a", 3, None)], 0)
    assert sorted((str(r["value"]), r["hit"]) for r in run().collect()) == [("None", False), ("x", False), ("x", True)]
    time.sleep(wait)
    put([("a", 4, None)], 1)
    assert sorted((str(r["value"]), r["hit"]) for r in run().collect()) == sorted([("None", False), ("x", False), ("x", True), ("x" if hit else "None", hit)])
