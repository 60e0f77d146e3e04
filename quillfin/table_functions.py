"""Operators that SQL calls on a table: what comes out is the table's own columns and one more.

    register_table_functions(spark)
    SELECT * FROM rsi(TABLE(bars) PARTITION BY ticker ORDER BY ts, value => 'close', periods => 14)

The caller says by PARTITION BY and ORDER BY what a series is and how it runs; rows of a series stream through one state. The schema is worked
out when the query is analysed: a column that the table lacks, or of another type, is an error before anything runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DataType, DateType, DoubleType, NumericType, StructField, StructType, TimestampNTZType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _with(table: AnalyzeArgument, column: AnalyzeArgument, kinds: tuple[type, ...], name: str, kind: DataType) -> AnalyzeResult:
    """The table's schema and the new column, once the named column is seen to be there and of a right type."""
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    fields = {f.name: f for f in table.dataType.fields}
    if column.value not in fields:
        raise ValueError(f"the table has no column {column.value!r}")
    if not isinstance(fields[column.value].dataType, kinds):
        raise ValueError(f"column {column.value!r} is of type {fields[column.value].dataType.simpleString()}")
    if name in fields:
        raise ValueError(f"the table has a column {name!r} already")
    return AnalyzeResult(schema=StructType([*table.dataType.fields, StructField(name, kind)]))


def _least(argument: AnalyzeArgument, name: str) -> None:
    if not isinstance(argument.value, int) or argument.value < 1:
        raise ValueError(f"{name} must be a whole number from 1 on")


@udtf
class ExponentialAverage:
    """average: the exponential average of a column over so many periods, seeded by a series' first value; nulls have none and change nothing."""

    def __init__(self) -> None:
        self.now: float | None = None

    @staticmethod
    def analyze(series: AnalyzeArgument, value: AnalyzeArgument, periods: AnalyzeArgument) -> AnalyzeResult:
        _least(periods, "periods")
        return _with(series, value, (NumericType,), "average", DoubleType())

    def eval(self, series: Row, value: str, periods: int) -> Iterator[tuple]:
        x = series[value]
        if x is None:
            yield (*series, None)
            return
        alpha = 2 / (periods + 1)
        self.now = float(x) if self.now is None else (1 - alpha) * self.now + alpha * float(x)
        yield (*series, self.now)


@udtf
class Rsi:
    """rsi: the relative strength index with Wilder's smoothing, from the periods-th change on."""

    def __init__(self) -> None:
        self.last: float | None = None
        self.gain = self.loss = None
        self.changes = 0

    @staticmethod
    def analyze(series: AnalyzeArgument, value: AnalyzeArgument, periods: AnalyzeArgument) -> AnalyzeResult:
        _least(periods, "periods")
        return _with(series, value, (NumericType,), "rsi", DoubleType())

    def eval(self, series: Row, value: str, periods: int) -> Iterator[tuple]:
        x, out = series[value], None
        if x is not None:
            x = float(x)
            if self.last is not None:
                up, down = max(x - self.last, 0.0), max(self.last - x, 0.0)
                mean = lambda now, v: v if now is None else (1 - 1 / periods) * now + (1 / periods) * v
                self.gain, self.loss, self.changes = mean(self.gain, up), mean(self.loss, down), self.changes + 1
                if self.changes >= periods and (self.gain or self.loss):
                    out = 100 - 100 / (1 + self.gain / self.loss) if self.loss else 100.0
            self.last = x
        yield (*series, out)


@udtf
class SlidingLimit:
    """allowed: whether a row goes through, at most `most` of a series within any `seconds`; rows that do not go through do not count, nor do those without a time."""

    def __init__(self) -> None:
        self.through: list = []

    @staticmethod
    def analyze(series: AnalyzeArgument, at: AnalyzeArgument, seconds: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        _least(seconds, "seconds")
        _least(most, "most")
        return _with(series, at, (TimestampType, TimestampNTZType, DateType), "allowed", BooleanType())

    def eval(self, series: Row, at: str, seconds: int, most: int) -> Iterator[tuple]:
        now = series[at]
        if now is None:
            yield (*series, False)
            return
        while self.through and (now - self.through[0]).total_seconds() >= seconds:
            self.through.pop(0)
        ok = len(self.through) < most
        if ok:
            self.through.append(now)
        yield (*series, ok)


def register_table_functions(spark: SparkSession) -> None:
    """Make exponential_average, rsi and sliding_limit callable in SQL."""
    for name, function in (("exponential_average", ExponentialAverage), ("rsi", Rsi), ("sliding_limit", SlidingLimit)):
        spark.udtf.register(name, function)
