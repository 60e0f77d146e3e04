"""Words in rectangles by grid cells, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillfin.operators import layout as lay

RECTS = "page int, rect_id int, rx0 double, ry0 double, rx1 double, ry1 double"


@pytest.mark.parametrize("seed", range(2))
def test_points_in_rects(spark, seed):
    rng = random.Random(seed)
    points = [(rng.randrange(3), rng.choice([rng.uniform(-500, 500), float(rng.randrange(-40, 40) * 16)]), rng.uniform(-500, 500), i) for i in range(600)] + [(None, 1.0, 1.0, 900), (1, None, 1.0, 901), (1, 16.0, 16.0, 902)]
    rects = []
    for i in range(120):
        w, h = rng.choice([0, 3, 16, 40, 900, 1e7]), rng.choice([0, 16, 5, 200, 1200])
        x, y = rng.choice([rng.uniform(-600, 500), float(rng.randrange(-30, 30) * 16)]), rng.uniform(-600, 500)
        rects.append((rng.randrange(3), i, x, y, x + w, y + h))
    inf = float("inf")
    rects += [(1, 200, -inf, -inf, inf, inf), (1, 201, 5.0, 5.0, 4.0, 9.0), (1, 202, None, 0.0, 1.0, 1.0), (None, 203, -9.0, -9.0, 9.0, 9.0), (1, 204, 16.0, 16.0, 16.0, 16.0), (1, 205, -inf, 0.0, 3.0, 50.0), (1, 206, 0.0, 0.0, 1e300, 1e300)]
    got = lay.points_in_rects(spark.createDataFrame(points, "page int, x double, y double, id int"), spark.createDataFrame(rects, RECTS))
    ok = lambda p, r: None not in (p[0], p[1], r[0], r[2]) and p[0] == r[0] and r[2] <= p[1] <= r[4] and r[3] <= p[2] <= r[5]
    assert sorted((r["id"], r["rect_id"]) for r in got.collect()) == sorted((p[3], r[1]) for p in points for r in rects if ok(p, r))


def test_one_page_of_many_words_and_rectangles(spark):
    """200,000 words and 5,000 rectangles of one page: the join makes hardly more rows than it keeps."""
    words = spark.range(200_000).select(F.lit(1).alias("page"), (F.col("id") % 2_000 * 7.0).alias("x"), (F.floor(F.col("id") / 2_000) * 12.0).alias("y"), "id")
    rects = spark.range(5_000).select(F.lit(1).alias("page"), F.col("id").cast("int").alias("rect_id"), (F.col("id") % 700 * 20.0).alias("rx0"), (F.floor(F.col("id") / 700) * 150.0).alias("ry0")).withColumn("rx1", F.col("rx0") + 20).withColumn("ry1", F.col("ry0") + 30)
    found = lay.points_in_rects(words, rects)
    exact = sum(sum(1 for a in range(2_000) if r % 700 * 20 <= a * 7 <= r % 700 * 20 + 20) * sum(1 for b in range(100) if r // 700 * 150 <= b * 12 <= r // 700 * 150 + 30) for r in range(0, 5_000, 50))
    assert found.filter("rect_id % 50 = 0").count() == exact
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    words = spark.createDataFrame([(1, 1.0, 1.0, 2.0, "a", "t")], "page int, x double, y0 double, y1 double, n string, text string")
    rect = spark.createDataFrame([(1, 1, 5.0, 5.0, 9.0, 9.0)], RECTS)
    assert [tuple(r) for r in lay.text_in_rects(words, rect).collect()] == [(1, 1, "")]
    assert lay.text_in_rects(words, rect.limit(0)).collect() == []
    assert [tuple(r) for r in lay.text_in_rects(words.limit(0), rect).collect()] == [(1, 1, "")]
