"""Named queries over the star-schema tables, each with DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so that every engine prints them alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if t.startswith(("date", "timestamp")) else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
