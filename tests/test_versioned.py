"""The bucketed table: only touched buckets are written, repeated batches have no effect, versions stay readable."""

import random

import pytest
from pyspark.sql import functions as F

from quillfin.streaming.versioned import BucketedTable, applying_changes, upserting


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string")


def folders(table, version=None):
    return table.manifest(version)["folders"]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = BucketedTable(spark, f"{tmp_path}/t", ["k"], buckets=16)
    assert t.merge(put(spark, [(i, "a") for i in range(200)]), upserting(["k"]))
    before = folders(t)
    assert len(before) == 16
    assert t.merge(put(spark, [(3, "b")]), upserting(["k"]))
    after = folders(t)
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    assert rows(t.read()) == sorted([(i, "b" if i == 3 else "a") for i in range(200)])
    assert rows(t.read(0)) == [(i, "a") for i in range(200)]
    assert t.merge(put(spark, []), upserting(["k"])) and folders(t) == after


def test_a_repeated_batch_has_no_effect(spark, tmp_path):
    t = BucketedTable(spark, f"{tmp_path}/t", ["k"], buckets=4)
    count = lambda old, new, _: old.unionByName(new)
    assert t.merge(put(spark, [(1, "a")]), count, "s", 0)
    assert not t.merge(put(spark, [(1, "a")]), count, "s", 0)
    # Ids may skip, and another stream has its own.
    assert t.merge(put(spark, [(1, "b")]), count, "s", 7) and t.merge(put(spark, [(1, "c")]), count, "other", 0)
    assert not t.merge(put(spark, [(1, "x")]), count, "s", 5)
    assert rows(t.read()) == [(1, "a"), (1, "b"), (1, "c")] and t.versions() == [0, 1, 2]


@pytest.mark.parametrize("seed", range(2))
def test_change_log_in_batches_equals_one_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    t = BucketedTable(spark, f"{tmp_path}/t", ["k"], buckets=8)
    state, seq = {}, 0
    for batch in range(3):
        log = []
        for _ in range(60):
            k, seq, op = rng.randrange(40), seq + 1, rng.choice(["upsert", "upsert", "delete"])
            log.append((k, f"v{seq}", op, seq))
            state.pop(k, None) if op == "delete" else state.update({k: f"v{seq}"})
        t.merge(spark.createDataFrame(log, "k long, v string, op string, seq long"), applying_changes("k", "seq"), "log", batch)
        assert rows(t.read()) == sorted(state.items())


def test_a_stream_that_fails_between_merge_and_commit(spark, tmp_path):
    t = BucketedTable(spark, f"{tmp_path}/t", ["k"], buckets=4)
    put(spark, [(1, "a"), (2, "b")]).coalesce(1).write.parquet(f"{tmp_path}/in")
    merge = t.merging("s", lambda old, new, _: old.unionByName(new))

    def run(fail):
        def each(batch, batch_id):
            merge(batch, batch_id)
            if fail:
                raise RuntimeError("lost after the merge")

        s = spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in")
        return s.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()

    with pytest.raises(Exception, match="lost after the merge"):
        run(True).awaitTermination()
    run(False).awaitTermination()
    assert rows(t.read()) == [(1, "a"), (2, "b")] and t.versions() == [0]


def test_versions_expire_and_do_not_collide(spark, tmp_path):
    t = BucketedTable(spark, f"{tmp_path}/t", ["k"], buckets=4)
    for i in range(3):
        t.merge(put(spark, [(k, str(i)) for k in range(8)]), upserting(["k"]))
    assert t.expire(1) == 2 and t.versions() == [2] and rows(t.read()) == [(k, "2") for k in range(8)]
    with pytest.raises(RuntimeError):
        t._publish(t.manifest())
    with pytest.raises(ValueError, match="moved rows"):
        t.merge(put(spark, [(1, "x")]), lambda old, new, _: new.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(50).cast("long"))).alias("k"), "v"))
    assert rows(t.read()) == [(k, "2") for k in range(8)]
    with pytest.raises(ValueError):
        BucketedTable(spark, f"{tmp_path}/none", ["k"]).read()
