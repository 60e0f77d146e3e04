"""Percentiles by rank selection against numpy, united sketches against one pass."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfin.operators import quantiles as qt


@pytest.mark.parametrize("share", [0.0, 0.25, 0.85, 0.999, 1.0])
def test_percentiles(spark, share):
    rng = random.Random(int(share * 1000))
    rows = [("hot", rng.choice([rng.gauss(0, 1), 1.5, 1.5])) for _ in range(3_000)] + [("few", 1.0), ("few", 4.0), ("one", 7.0), ("none", None), ("nan", float("nan")), ("nan", 2.0), (None, 3.0), (None, 5.0)]
    rows += [("same", 2.0)] * 500 + [("ends", v) for v in (float("-inf"), 0.0, 1.0)]
    got = {r["k"]: r["p"] for r in qt.exact_percentile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", share, "p", bins=8).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).extend([] if v is None or v != v else [v])
    assert got.keys() == groups.keys() and got["none"] is None
    for k, vs in groups.items():
        if vs and k != "ends":
            assert abs(got[k] - np.quantile(vs, share)) < 1e-12
    if share in (0.0, 1.0):
        assert got["ends"] == (1.0 if share else float("-inf"))


def test_percentile_sorts_only_the_ranges_it_wants(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    plan = qt.exact_percentile(df, ["k"], "v", 0.5, "p")
    assert sorted(r["p"] for r in plan.collect()) == [9999.0, 10000.0]
    assert "percentile(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert qt.exact_percentile(df.limit(0), ["k"], "v", 0.5, "p").collect() == []


def test_sketches_unite(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), datetime(2024, 1, 1) + timedelta(days=rng.randrange(30)), rng.randrange(20_000)) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "k string, day timestamp_ntz, user long")
    daily = qt.distinct_sketches(df, ["k", "day"], "user")
    by_key = {r["k"]: r["distinct"] for r in qt.distinct_counts(qt.united(daily, ["k"])).collect()}
    once = {r["k"]: r["distinct"] for r in qt.distinct_counts(qt.distinct_sketches(df, ["k"], "user")).collect()}
    exact = {k: len({u for kk, _, u in rows if kk == k}) for k in "ab"}
    assert all(abs(by_key[k] - once[k]) <= 0.02 * exact[k] and abs(by_key[k] - exact[k]) <= 0.05 * exact[k] for k in exact)
