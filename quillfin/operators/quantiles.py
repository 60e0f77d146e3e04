"""Exact percentiles without a group's values in one buffer, and distinct counts that can be united later.

A percentile is a selection by rank. A group's values are cut into BINS ranges at the points of a mergeable sketch; the sizes of the ranges say which of them
hold the wanted ranks, and only the values of those are sorted, equal ones counted first. The sketch decides how evenly the ranges are cut, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 64
#: Registers of a distinct-count sketch, as a power of two: a relative standard error of about 1.04 / sqrt(2 ** LG_K), 1.6 %.
LG_K = 12


def exact_percentile(df: DataFrame, keys: list[str], value: str | Column, share: float, name: str, bins: int = BINS) -> DataFrame:
    """keys and the percentile of value, linear between neighbours; null for a group without a value. Nulls in keys are a key of their own; NaN is no value."""
    v = F.col(value) if isinstance(value, str) else value
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.struct(F.col(k).alias("k")).alias(n) for k, n in zip(keys, names)], F.nanvl(v.cast("double"), F.lit(None).cast("double")).alias("_v"))
    # Equal values are one row from here on; where a few values make up a group there is hardly anything left to shuffle.
    counted = rows.groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_size"))
    # Sketches and sizes: a row for each group, then one for each range of it.
    points = F.percentile_approx("_v", [i / bins for i in range(1, bins)], 10 * bins)
    groups = counted.groupBy(*names).agg(points.alias("_points"), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_size"))), F.lit(0)).alias("_n"))
    place = F.lit(share) * (F.col("_n") - 1)
    groups = groups.withColumn("_low", F.floor(place)).withColumn("_high", F.ceil(place)).withColumn("_part", place - F.floor(place))
    binned = counted.filter("_v is not null").join(groups.select(*names, "_points"), names).withColumn("_bin", F.size(F.filter("_points", lambda p: p < F.col("_v")))).drop("_points")
    sizes = binned.groupBy(*names, "_bin").agg(F.sum("_size").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*names).orderBy("_bin")) - F.col("_size")
    wanted = sizes.withColumn("_before", before).join(groups.drop("_points"), names)
    overlaps = lambda rank: (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_before") + F.col("_size"))
    wanted = wanted.filter(overlaps("_low") | overlaps("_high")).select(*names, "_bin", "_before", "_low", "_high")
    inside = F.sum("_size").over(Window.partitionBy(*names, "_bin").orderBy("_v")) - F.col("_size")
    ranked = binned.join(wanted.select(*names, "_bin"), [*names, "_bin"], "left_semi").withColumn("_inside", inside).join(wanted, [*names, "_bin"]).withColumn("_before", F.col("_before") + F.col("_inside"))
    at = lambda rank: F.max(F.when(overlaps(rank), F.col("_v")))
    found = ranked.groupBy(*names).agg(at("_low").alias("_a"), at("_high").alias("_b"))
    # Infinite neighbours have no difference.
    result = F.when(F.col("_a") == F.col("_b"), F.col("_a")).when(F.col("_part") == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part"))
    return groups.select(*names, "_part").join(found, names, "left").select(*[F.col(n)["k"].alias(k) for k, n in zip(keys, names)], result.alias(name))


def distinct_sketches(df: DataFrame, keys: list[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """keys and the sketch of the distinct values of each group, a few KB, to be stored and united later."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def united(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: those of one pass over all their rows."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_counts(sketches: DataFrame, name: str = "distinct") -> DataFrame:
    """The sketches' estimates in place of them."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")
