"""Table functions from SQL equal the DataFrame operators."""

import random
from datetime import datetime, timedelta

import pytest

from quillfin.operators import timeseries as ts
from quillfin.table_functions import register_table_functions


@pytest.fixture
def series(spark):
    rng = random.Random(4)
    rows = [(t, datetime(2024, 1, 1) + timedelta(minutes=7 * i), i, round(50 + rng.random() * 9, 2)) for t in ("a", "b", "c") for i in range(60)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, id long, close double")
    df.createOrReplaceTempView("series")
    register_table_functions(spark)
    return df


def test_rsi(spark, series):
    got = spark.sql("SELECT ticker, ts, close, rsi FROM rsi(TABLE(series) PARTITION BY ticker ORDER BY ts, value => 'close', periods => 14)")
    want = ts.rsi(series)
    both = sorted((r["ticker"], r["ts"], r["rsi"]) for r in got.collect()), sorted((r["ticker"], r["ts"], r["rsi"]) for r in want.collect())
    assert len(both[0]) == 180 and all(a[:2] == b[:2] and (a[2] is b[2] or abs(a[2] - b[2]) < 1e-9) for a, b in zip(*both, strict=True))


def test_averages_and_limits(spark, series):
    got = spark.sql("SELECT * FROM exponential_average(TABLE(series) PARTITION BY ticker ORDER BY ts, value => 'close', periods => 9)")
    assert got.columns == ["ticker", "ts", "id", "close", "average"]
    now = {}
    for r in sorted(got.collect(), key=lambda r: (r["ticker"], r["ts"])):
        now[r["ticker"]] = r["close"] if r["ticker"] not in now else now[r["ticker"]] * 0.8 + r["close"] * 0.2
        assert abs(r["average"] - now[r["ticker"]]) < 1e-9
    limit = spark.sql("SELECT id, ticker, allowed FROM sliding_limit(TABLE(SELECT * FROM series) PARTITION BY ticker ORDER BY (ts, id), at => 'ts', seconds => 1800, most => 2)")
    want = ts.sliding_limiter(series.selectExpr("ascii(ticker) AS k", "ts", "id"), "k", 1800, 2)
    assert sorted((ord(r["ticker"]), r["id"], r["allowed"]) for r in limit.collect()) == sorted((r["key"], r["id"], r["allowed"]) for r in want.collect())


@pytest.mark.parametrize("call", ["rsi(TABLE(series), value => 'none', periods => 14)", "rsi(TABLE(series), value => 'ticker', periods => 14)", "rsi(TABLE(series), value => 'close', periods => 0)", "sliding_limit(TABLE(series), at => 'close', seconds => 1, most => 1)", "rsi(TABLE(SELECT *, 1 AS rsi FROM series), value => 'close', periods => 2)"])
def test_wrong_calls_fail_when_analysed(spark, series, call):
    with pytest.raises(Exception, match="column|whole number"):
        spark.sql(f"SELECT * FROM {call}")
