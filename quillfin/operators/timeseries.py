"""Technical indicators over bars (ticker, ts, open, high, low, close, volume), all tickers at once.

Windows run within a ticker. An indicator is missing until it has its full
window. Trim to a display range after computing, with `displayed`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfin.adapters import exact_sum
from quillfin.functions.numbers import rnd
from quillfin.operators.recurrences import BLOCK_ROWS, blocked, exponential_averages, gained, numbered, smoothing, wilder


def _bars(first: int, last: int):
    """The frame of a ticker's bars from `first` to `last` rows off."""
    return Window.partitionBy("ticker").orderBy("ts").rowsBetween(first, last)


def _last(n: int):
    return _bars(-(n - 1), 0)


def _gated(x: Column, n: int) -> Column:
    return F.when(F.count(F.lit(1)).over(_last(n)) == n, x)


def _mean(c: str, n: int) -> Column:
    return _gated(F.sum(F.col(c).cast("decimal(18,2)")).over(_last(n)).cast("double") / n, n)


def sma(bars: DataFrame, windows: tuple[int, ...] = (20, 50, 100, 200), column: str = "close") -> DataFrame:
    """Simple moving averages, one column for each distinct window."""
    return bars.select("*", *[_mean(column, n).alias(f"sma_{n}") for n in sorted(set(windows))])


def latest(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """The last row's values of each ticker, rounded."""
    return df.groupBy("ticker").agg(F.max("ts").alias("ts"), *[rnd(F.max_by(c, "ts"), digits).alias(c) for c in columns])


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Moving average and bands of `width` population standard deviations."""
    c = F.col("close").cast("decimal(18,2)")
    s, q = F.sum(c).over(_last(n)).cast("double"), F.sum(c * c).over(_last(n)).cast("double")
    sd = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    return bars.select("*", _gated(s / n, n).alias("bb_middle"), _gated(s / n + width * sd, n).alias("bb_upper"), _gated(s / n - width * sd, n).alias("bb_lower"))


def volume_sma(bars: DataFrame, n: int = 20) -> DataFrame:
    """Average volume and whether the bar's volume is above it."""
    v = _mean("volume", n)
    return bars.select("*", v.alias("volume_sma"), F.when(v.isNotNull(), F.when(F.col("volume") > v, "above").otherwise("below")).alias("volume_status"))


def local_extrema(bars: DataFrame, order: int = 10, last: int = 3) -> DataFrame:
    """Supports (lows that no low within `order` bars undercuts) and resistances (likewise for highs), the last few of each; ends are clipped and ties kept."""
    near = _bars(-order, order)
    wide = bars.select("ticker", "ts", "low", "high", F.min("low").over(near).alias("lo"), F.max("high").over(near).alias("hi"))
    side = lambda kind, level, bound: wide.filter(F.col(level) == F.col(bound)).select("ticker", "ts", F.lit(kind).alias("kind"), F.col(level).alias("level"))
    marked = side("support", "low", "lo").unionByName(side("resistance", "high", "hi"))
    recent = Window.partitionBy("ticker", "kind").orderBy(F.desc("ts"))
    return marked.withColumn("recency", F.row_number().over(recent)).filter(F.col("recency") <= last).select("ticker", "kind", "recency", "ts", "level")


def folded(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """A fold over each key's rows in order. step(state, row) gives an output tuple; start() a key's first state. Rows stream through: a task holds a batch and one state, however many rows a key has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                mine = tuple(getattr(row, k) for k in keys)
                if state is None or mine != key:
                    key, state = mine, start()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    names = [f.split()[0] for f in schema.split(", ")]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _series(bars: DataFrame, block_rows: int) -> DataFrame:
    """ticker, ts, close in blocks, with _i and _previous."""
    rows = bars.select("ticker", F.col("ts").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close"))
    return numbered(blocked(rows, "ticker", "ts", block_rows), "ticker", "ts", "close")


def rsi(bars: DataFrame, n: int = 14, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Relative strength index with Wilder's smoothing of gains and losses, from the n-th change on, and its status. A ticker's bars are worked on in blocks, side by side."""
    move = F.col("close") - F.col("_previous")
    rows = _series(bars, block_rows).withColumn("gain", gained(move)).withColumn("loss", gained(-move))
    r = exponential_averages(rows, "ticker", "ts", {"gains": ("gain", wilder(n)), "losses": ("loss", wilder(n))})
    x = F.when(F.col("_i") > n, F.when(F.col("losses") != 0, 100 - 100 / (1 + F.col("gains") / F.col("losses"))).when(F.col("gains") != 0, 100.0))
    status = F.when(F.col("rsi") > 70, "Overbought").when(F.col("rsi") < 30, "Oversold").when(F.col("rsi").isNotNull(), "Neutral")
    return r.select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", x.alias("rsi")).withColumn("rsi_status", status)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Difference of two exponential averages, its own average, the histogram and the trend. A ticker's bars are worked on in blocks, side by side."""
    r = exponential_averages(_series(bars, block_rows), "ticker", "ts", {"fast": ("close", smoothing(fast)), "slow": ("close", smoothing(slow))})
    r = r.withColumn("macd", F.when(F.col("_i") >= slow, F.col("fast") - F.col("slow")))
    r = exponential_averages(r, "ticker", "ts", {"average": ("macd", smoothing(signal))})
    m, s = F.col("macd"), F.when(F.col("_i") >= slow + signal - 1, F.col("average"))
    r = r.select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", "macd", s.alias("macd_signal"))
    s = F.col("macd_signal")
    return r.select("*", (m - s).alias("macd_hist"), F.when(m > s, "Bullish").when(m <= s, "Bearish").alias("macd_trend"))


def displayed(df: DataFrame, start: str) -> DataFrame:
    """Rows of the display range, taken after indicators saw the bars before it."""
    return df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))


def with_lookback(bars: DataFrame, start: str, days: int) -> DataFrame:
    """Bars from `days` days before start on: a bound that reaches the scan, below the windows."""
    return bars.filter(F.col("ts") >= F.date_sub(F.lit(start).cast("date"), days).cast("timestamp_ntz"))


def candlesticks(bars: DataFrame) -> DataFrame:
    """Bars with their colour."""
    return bars.select("*", F.when(F.col("close") >= F.col("open"), "green").otherwise("red").alias("colour"))


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Bars of a longer interval ('6 hours', '1 day')."""
    g = bars.groupBy("ticker", F.window(F.col("ts").cast("timestamp"), interval).alias("w"))
    out = g.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select("ticker", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def technical_summary(bars: DataFrame, start: str, sma_days: int = 400, order: int = 10, levels: int = 3) -> DataFrame:
    """Each ticker's last RSI, MACD, averages, nearest support and resistance levels and signals. RSI and levels see the display range alone; averages and MACD see the look-back too."""
    shown = displayed(bars, start)
    r = rsi(shown).groupBy("ticker").agg(F.max_by("rsi", "ts").alias("rsi"), F.max_by("rsi_status", "ts").alias("rsi_status"))
    m = displayed(macd(with_lookback(bars, start, 70)), start).groupBy("ticker").agg(F.max_by("macd_trend", "ts").alias("macd_trend"))
    a = displayed(sma(with_lookback(bars, start, sma_days), (50, 200)), start).groupBy("ticker").agg(F.max_by("close", "ts").alias("close"), F.max_by("sma_50", "ts").alias("sma_50"), F.max_by("sma_200", "ts").alias("sma_200"))
    recent = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("recency", "level")))), lambda x: x["level"])
    e = local_extrema(shown, order, levels).groupBy("ticker").agg(recent("support").alias("support"), recent("resistance").alias("resistance"))
    price = F.when(F.col("close") > F.col("sma_200"), "Price above 200-day SMA").when(F.col("close") <= F.col("sma_200"), "Price below 200-day SMA")
    heat = F.when(F.col("rsi") > 70, "RSI Overbought").when(F.col("rsi") < 30, "RSI Oversold")
    trend = F.when(F.col("macd_trend").isNotNull(), F.concat(F.lit("MACD "), F.col("macd_trend")))
    out = a.join(r, "ticker").join(m, "ticker").join(e, "ticker", "left").withColumn("signals", F.array_compact(F.array(heat, trend, price)))
    return out.withColumn("action", action_signal(F.col("close"), F.col("sma_200"), F.col("rsi")))


def action_signal(price: Column, sma_200: Column, rsi_: Column) -> Column:
    """'trend / momentum': price against its 200-bar average, and buy below RSI 30, sell above 70, else hold."""
    trend = F.when(price > sma_200, "uptrend").when(price <= sma_200, "downtrend").otherwise("unknown")
    return F.concat_ws(" / ", trend, F.when(rsi_ < 30, "buy").when(rsi_ > 70, "sell").otherwise("hold"))


def growth(series: DataFrame, years: float, periods: int = 5) -> DataFrame:
    """Compound annual growth of (ticker, ts, value) over a fixed number of years, in percent with two digits, and values projected from the unrounded rate."""
    g = series.groupBy("ticker").agg(F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"))
    rate = F.when((F.col("first") > 0) & (F.col("last") > 0), F.pow(F.col("last") / F.col("first"), F.lit(1.0 / years)) - 1)
    g = g.withColumn("rate", rate).withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return g.select("ticker", "first", "last", rnd(F.col("rate") * 100, 2).alias("cagr_pct"), "year", rnd(F.col("last") * F.pow(1 + F.col("rate"), F.col("year")), 2).alias("projected"))


def trailing(series: DataFrame, key: str, months: int) -> DataFrame:
    """Rows of the last so many months of each key's own series (key, date, value)."""
    end = F.max("date").over(Window.partitionBy(key))
    return series.withColumn("_end", end).filter(F.col("date") >= F.add_months("_end", -months)).drop("_end")


def align(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of series (key, date, value), those of equal key on all dates of either, each carried forward; dates before either has begun are left out."""
    j = a.select(key, "date", F.col("value").alias("a")).join(b.select(key, "date", F.col("value").alias("b")), [key, "date"], "full")
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return j.select(key, "date", F.last("a", True).over(w).alias("a"), F.last("b", True).over(w).alias("b")).dropna()


def budgeted(docs: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Texts of each group in order until their lengths reach the budget, the last one cut to fit."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return docs.withColumn("_before", before).filter(F.col("_before") < budget).withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("_before")).cast("int"))).drop("_before")


def shared_budget(docs: DataFrame, group: str, order: str, text: str, source: str, budget: int) -> DataFrame:
    """Store documents first, as far as the budget goes; web documents share what is left in equal parts."""
    d = docs.withColumn("_web", F.col(source) == "web").withColumn("_len", F.length(text))
    all_ = Window.partitionBy(group)
    store = budgeted(d.filter("not _web"), group, order, text, budget)
    d = d.withColumn("_used", F.sum(F.when(~F.col("_web"), F.col("_len")).otherwise(0)).over(all_)).withColumn("_n", F.count_if("_web").over(all_)).filter("_web")
    part = F.floor(F.greatest(F.lit(budget) - F.col("_used"), F.lit(0)) / F.col("_n")).cast("int")
    web = d.withColumn(text, F.substring(F.col(text), F.lit(1), part)).filter(F.length(text) > 0)
    return store.drop("_web", "_len").unionByName(web.drop("_web", "_len", "_used", "_n"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def sliding_limiter(events: DataFrame, key: str, seconds: int = 60, most: int = 10) -> DataFrame:
    """Whether each attempt (key, ts, id) is let through, at most `most` within any `seconds`; rejected attempts do not count.

    One decision changes the next, so a key's attempts are folded in order; the state is the times of the last `most` that went through.
    """

    def step(kept: list, row) -> tuple:
        while kept and (row.ts - kept[0]).total_seconds() >= seconds:
            kept.pop(0)
        ok = len(kept) < most
        if ok:
            kept.append(row.ts)
        return row.key, row.ts, row.id, ok

    rows = events.select(F.col(key).cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"))
    return folded(rows, ["key"], ["ts", "id"], list, step, "key long, ts timestamp, id long, allowed boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
