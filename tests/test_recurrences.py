"""Averages in blocks equal a plain fold, whatever the blocks."""

import random
from datetime import datetime, timedelta

import pytest

from quillfin.operators import timeseries as ts


def bars(n, tickers=("A", "B"), seed=0, flat=False):
    rng, out = random.Random(seed), []
    for t in tickers:
        price = 100.0
        for i in range(n if t == "A" else max(1, n // 7)):
            price = price if flat else round(max(1.0, price + rng.choice([-1, 1]) * rng.random() * 3), 2)
            out.append((t, datetime(2024, 1, 1) + timedelta(hours=5 * i), price))
    rng.shuffle(out)
    return out


def fold_rsi(rows, n):
    gain = loss = last = None
    out = []
    for i, (_, at, close) in enumerate(rows):
        value = None
        if i:
            up, down = max(close - last, 0.0), max(last - close, 0.0)
            gain, loss = (up, down) if gain is None else ((1 - 1 / n) * gain + up / n, (1 - 1 / n) * loss + down / n)
            if i >= n:
                value = 100 - 100 / (1 + gain / loss) if loss else (100.0 if gain else None)
        last = close
        out.append((at, value))
    return out


def fold_macd(rows, fast, slow, signal):
    f = s = g = None
    out = []
    for i, (_, at, x) in enumerate(rows, 1):
        mean = lambda now, v, k: v if now is None else now + 2 / (k + 1) * (v - now)
        f, s = mean(f, x, fast), mean(s, x, slow)
        line = f - s if i >= slow else None
        g = mean(g, line, signal) if line is not None else g
        out.append((at, line, g if i >= slow + signal - 1 else None))
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-9


@pytest.mark.parametrize("block_rows", [4, 37, 1_000_000])
def test_blocks_equal_a_fold(spark, block_rows):
    rows = bars(400)
    df = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, close double")
    r = {(x["ticker"], x["ts"]): x for x in ts.rsi(df, block_rows=block_rows).collect()}
    m = {(x["ticker"], x["ts"]): x for x in ts.macd(df, block_rows=block_rows).collect()}
    assert len(r) == len(m) == len(rows)
    for t in ("A", "B"):
        mine = sorted(x for x in rows if x[0] == t)
        assert all(close(r[t, at]["rsi"], v) for at, v in fold_rsi(mine, 14))
        assert all(close(m[t, at]["macd"], a) and close(m[t, at]["macd_signal"], b) for at, a, b in fold_macd(mine, 12, 26, 9))


def test_one_ticker_is_many_groups(spark):
    df = spark.createDataFrame(bars(600, ("A",)), "ticker string, ts timestamp_ntz, close double")
    rows = ts._series(df, 50)
    assert rows.select("ticker", "_block").distinct().count() == 12
    # Counted over the blocks: numbers run on, and each row knows the close before it.
    got = rows.orderBy("ts").collect()
    assert [x["_i"] for x in got] == list(range(1, 601)) and [x["_previous"] for x in got[1:]] == [x["close"] for x in got[:-1]]


def test_flat_and_short_series(spark):
    df = spark.createDataFrame(bars(60, flat=True), "ticker string, ts timestamp_ntz, close double")
    assert all(x["rsi"] is None for x in ts.rsi(df, block_rows=8).collect())
    m = [x for x in ts.macd(df, block_rows=8).collect() if x["macd_signal"] is not None]
    assert m and all(abs(x["macd"]) < 1e-9 for x in m)
    assert ts.rsi(df.limit(0)).collect() == [] and ts.macd(df.limit(0)).collect() == []
