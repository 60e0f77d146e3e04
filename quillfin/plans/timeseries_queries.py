"""Indicator queries over hourly bars of the event types."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfin.adapters import bars, load, macro_series, with_inputs
from quillfin.functions.numbers import rnd
from quillfin.operators import timeseries as ts
from quillfin.plans.registry import query
from quillfin.table_functions import register_table_functions

_W = "OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def _mean(c: str, n: int) -> str:
    w = _W.format(n=n - 1)
    return f"CASE WHEN count(*) {w} = {n} THEN CAST(sum(CAST({c} AS DECIMAL(18,2))) {w} AS DOUBLE) / {n} END"


def _rounded(df, cols):
    return df.select(*[rnd(c, 4).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("ts_sma", with_inputs("bars", f"SELECT ticker, ts::VARCHAR AS ts, close, {', '.join(f'round({_mean("close", n)}, 4) AS sma_{n}' for n in (20, 50, 100, 200))} FROM bars"))
def sma(spark, sf_dir):
    return _rounded(ts.sma(bars(spark, sf_dir)), {"sma_20", "sma_50", "sma_100", "sma_200"}).drop("open", "high", "low", "volume")


@query("ts_latest_sma", with_inputs("bars", f", s AS (SELECT ticker, ts, {_mean('close', 20)} AS sma_20, {_mean('close', 50)} AS sma_50 FROM bars) SELECT ticker, max(ts)::VARCHAR AS ts, round(arg_max(sma_20, ts), 2) AS sma_20, round(arg_max(sma_50, ts), 2) AS sma_50 FROM s GROUP BY 1"))
def latest_sma(spark, sf_dir):
    return ts.latest(ts.sma(bars(spark, sf_dir), (20, 50)), ["sma_20", "sma_50"])


_BW = _W.format(n=19)
_BS, _BQ = f"CAST(sum(CAST(close AS DECIMAL(18,2))) {_BW} AS DOUBLE)", f"CAST(sum(CAST(close AS DECIMAL(18,2)) * CAST(close AS DECIMAL(18,2))) {_BW} AS DOUBLE)"


@query("ts_bollinger", with_inputs("bars", f"""
, s AS (SELECT ticker, ts, close, count(*) {_BW} AS n, {_BS} / 20 AS m, sqrt(greatest({_BQ} / 20 - ({_BS} / 20) * ({_BS} / 20), 0)) AS sd FROM bars)
SELECT ticker, ts::VARCHAR AS ts, close, CASE WHEN n = 20 THEN round(m, 4) END AS bb_middle, CASE WHEN n = 20 THEN round(m + 2 * sd, 4) END AS bb_upper, CASE WHEN n = 20 THEN round(m - 2 * sd, 4) END AS bb_lower FROM s"""))
def bollinger(spark, sf_dir):
    return _rounded(ts.bollinger(bars(spark, sf_dir)), {"bb_middle", "bb_upper", "bb_lower"}).drop("open", "high", "low", "volume")


@query("ts_volume_sma", with_inputs("bars", f", s AS (SELECT ticker, ts, volume, {_mean('volume', 20)} AS v FROM bars) SELECT ticker, ts::VARCHAR AS ts, volume, round(v, 4) AS volume_sma, CASE WHEN v IS NOT NULL THEN CASE WHEN volume > v THEN 'above' ELSE 'below' END END AS volume_status FROM s"))
def volume_sma(spark, sf_dir):
    return _rounded(ts.volume_sma(bars(spark, sf_dir)), {"volume_sma"}).drop("open", "high", "low", "close")


@query("ts_local_extrema", with_inputs("bars", """
, w AS (SELECT ticker, ts, low, high, min(low) OVER n AS lo, max(high) OVER n AS hi FROM bars WINDOW n AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
m AS (SELECT ticker, 'support' AS kind, ts, low AS level FROM w WHERE low = lo UNION ALL SELECT ticker, 'resistance', ts, high FROM w WHERE high = hi),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker, kind ORDER BY ts DESC) AS INTEGER) AS recency FROM m)
SELECT ticker, kind, recency, ts::VARCHAR AS ts, level FROM r WHERE recency <= 3"""))
def local_extrema(spark, sf_dir):
    return ts.local_extrema(bars(spark, sf_dir))


def _recursive(body: str) -> str:
    return with_inputs("bars", body).replace("WITH ", "WITH RECURSIVE ", 1)


_B = ", b AS MATERIALIZED (SELECT ticker, ts, close, close - lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS step, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i FROM bars)"


RSI_ROWS = _recursive(f"""{_B},
e AS (SELECT ticker, i, greatest(step, 0) AS g, greatest(-step, 0) AS l FROM b WHERE i = 2
UNION ALL SELECT b.ticker, b.i, (1 - 1 / 14::DOUBLE) * g + (1 / 14::DOUBLE) * greatest(b.step, 0), (1 - 1 / 14::DOUBLE) * l + (1 / 14::DOUBLE) * greatest(-b.step, 0) FROM e JOIN b ON b.ticker = e.ticker AND b.i = e.i + 1),
r AS (SELECT b.ticker, b.ts, b.close, CASE WHEN b.i > 14 THEN CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0::DOUBLE END ELSE 100 - 100 / (1 + g / l) END END AS rsi FROM b LEFT JOIN e USING (ticker, i))
SELECT ticker, ts::VARCHAR AS ts, close, round(rsi, 4) AS rsi, CASE WHEN rsi > 70 THEN 'Overbought' WHEN rsi < 30 THEN 'Oversold' WHEN rsi IS NOT NULL THEN 'Neutral' END AS rsi_status FROM r""")


@query("ts_rsi", RSI_ROWS)
def rsi(spark, sf_dir):
    return _rounded(ts.rsi(bars(spark, sf_dir)), {"rsi"})


def _ema(name: str, source: str, x: str, first: int, span: int) -> str:
    a = f"(2 / {span + 1}::DOUBLE)"
    return f"{name} AS (SELECT ticker, i, {x} AS y FROM {source} WHERE i = {first} UNION ALL SELECT z.ticker, z.i, (1 - {a}) * y + {a} * z.{x} FROM {name} JOIN {source} z ON z.ticker = {name}.ticker AND z.i = {name}.i + 1)"


@query("ts_macd", _recursive(f"""{_B}, {_ema('f', 'b', 'close', 1, 12)}, {_ema('s', 'b', 'close', 1, 26)},
m AS MATERIALIZED (SELECT f.ticker, f.i, f.y - s.y AS line FROM f JOIN s USING (ticker, i) WHERE f.i >= 26), {_ema('g', 'm', 'line', 26, 9)},
r AS (SELECT b.ticker, b.ts, b.close, m.line AS macd, CASE WHEN b.i >= 34 THEN g.y END AS sig FROM b LEFT JOIN m USING (ticker, i) LEFT JOIN g USING (ticker, i))
SELECT ticker, ts::VARCHAR AS ts, close, round(macd, 4) AS macd, round(sig, 4) AS macd_signal, round(macd - sig, 4) AS macd_hist, CASE WHEN macd > sig THEN 'Bullish' WHEN macd <= sig THEN 'Bearish' END AS macd_trend FROM r"""))
def macd(spark, sf_dir):
    return _rounded(ts.macd(bars(spark, sf_dir)), {"macd", "macd_signal", "macd_hist"})


@query("ts_candlesticks", with_inputs("bars", "SELECT ticker, ts::VARCHAR AS ts, open, high, low, close, volume, CASE WHEN close >= open THEN 'green' ELSE 'red' END AS colour FROM bars"))
def candlesticks(spark, sf_dir):
    return ts.candlesticks(bars(spark, sf_dir))


@query("ts_resample_6h", with_inputs("bars", "SELECT ticker, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')::VARCHAR AS ts, arg_min(open, bars.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, bars.ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ticker, time_bucket(INTERVAL '6 hours', bars.ts, TIMESTAMP '1970-01-01')"))
def resample_6h(spark, sf_dir):
    return ts.resample(bars(spark, sf_dir), "6 hours")


def _levels(kind: str, c: str, fn: str) -> str:
    """The last three local extrema of each ticker in the display range, the latest first, as text."""
    near = "OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"
    return f"{kind} AS (SELECT ticker, string_agg(round({c}, 2)::DOUBLE::VARCHAR, ',' ORDER BY ts DESC) AS {kind} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS n FROM (SELECT *, {fn}({c}) {near} AS e FROM shown) WHERE {c} = e) WHERE n <= 3 GROUP BY 1)"


_RSI_ON = """b AS MATERIALIZED (SELECT ticker, ts, close, close - lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS step, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i FROM shown),
e AS (SELECT ticker, i, greatest(step, 0) AS g, greatest(-step, 0) AS l FROM b WHERE i = 2 UNION ALL SELECT b.ticker, b.i, (1 - 1 / 14::DOUBLE) * g + (1 / 14::DOUBLE) * greatest(b.step, 0), (1 - 1 / 14::DOUBLE) * l + (1 / 14::DOUBLE) * greatest(-b.step, 0) FROM e JOIN b ON b.ticker = e.ticker AND b.i = e.i + 1),
r AS (SELECT b.ticker, arg_max(CASE WHEN b.i > 14 THEN CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0::DOUBLE END ELSE 100 - 100 / (1 + g / l) END END, b.ts) AS rsi FROM b LEFT JOIN e USING (ticker, i) GROUP BY 1)"""
_MACD_ON = f"""c AS MATERIALIZED (SELECT ticker, ts, close, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i FROM bars WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 70 DAY), {_ema('f', 'c', 'close', 1, 12)}, {_ema('s', 'c', 'close', 1, 26)},
m AS MATERIALIZED (SELECT f.ticker, f.i, f.y - s.y AS line FROM f JOIN s USING (ticker, i) WHERE f.i >= 26), {_ema('g', 'm', 'line', 26, 9)},
mt AS (SELECT c.ticker, arg_max(CASE WHEN m.line > g.y THEN 'Bullish' WHEN m.line <= g.y THEN 'Bearish' END, c.ts) AS trend FROM c JOIN m USING (ticker, i) JOIN g USING (ticker, i) WHERE c.i >= 34 AND c.ts >= TIMESTAMP '2024-01-15' GROUP BY 1)"""


@query("ts_technical_summary", _recursive(f"""
, shown AS (SELECT * FROM bars WHERE ts >= TIMESTAMP '2024-01-15'), {_RSI_ON}, {_MACD_ON}, {_levels('support', 'low', 'min')}, {_levels('resistance', 'high', 'max')},
w AS (SELECT ticker, ts, close, {_mean('close', 50)} AS sma_50, {_mean('close', 200)} AS sma_200 FROM bars WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 400 DAY),
a AS (SELECT ticker, arg_max(close, ts) AS close, arg_max(sma_50, ts) AS sma_50, arg_max(sma_200, ts) AS sma_200 FROM w WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT ticker, close, round(sma_50, 4) AS sma_50, round(sma_200, 4) AS sma_200, round(rsi, 4) AS rsi, CASE WHEN rsi > 70 THEN 'Overbought' WHEN rsi < 30 THEN 'Oversold' WHEN rsi IS NOT NULL THEN 'Neutral' END AS rsi_status, trend AS macd_trend, support, resistance,
concat_ws(',', CASE WHEN rsi > 70 THEN 'RSI Overbought' WHEN rsi < 30 THEN 'RSI Oversold' END, 'MACD ' || trend, CASE WHEN close > sma_200 THEN 'Price above 200-day SMA' WHEN close <= sma_200 THEN 'Price below 200-day SMA' END) AS signals,
CASE WHEN close > sma_200 THEN 'uptrend' WHEN close <= sma_200 THEN 'downtrend' ELSE 'unknown' END || ' / ' || CASE WHEN rsi < 30 THEN 'buy' WHEN rsi > 70 THEN 'sell' ELSE 'hold' END AS action
FROM a JOIN r USING (ticker) JOIN mt USING (ticker) LEFT JOIN support USING (ticker) LEFT JOIN resistance USING (ticker)"""))
def technical_summary(spark, sf_dir):
    t = _rounded(ts.technical_summary(bars(spark, sf_dir), "2024-01-15"), {"rsi", "sma_50", "sma_200"})
    shown = lambda c: F.array_join(F.transform(c, lambda x: rnd(x, 2).cast("string")), ",")
    return t.withColumn("support", shown("support")).withColumn("resistance", shown("resistance")).withColumn("signals", F.array_join("signals", ","))


@query("ts_growth_projection", with_inputs("macro", """
, g AS (SELECT indicator AS ticker, arg_min(value, date) AS first, arg_max(value, date) AS last FROM macro GROUP BY 1), r AS (SELECT *, pow(last / first, 1 / 5::DOUBLE) - 1 AS rate FROM g)
SELECT ticker, first, last, round(rate * 100, 2) AS cagr_pct, CAST(year AS INTEGER) AS year, round(last * pow(1 + rate, year), 2) AS projected FROM r, range(1, 6) t(year)"""))
def growth_projection(spark, sf_dir):
    m = macro_series(spark, sf_dir).select(F.col("indicator").alias("ticker"), F.col("date").alias("ts"), "value")
    return ts.growth(m, 5.0)


@query("ts_trailing_12_months", with_inputs("macro", "SELECT indicator, date::VARCHAR AS date, value FROM (SELECT *, max(date) OVER (PARTITION BY indicator) AS e FROM macro) WHERE date >= e - INTERVAL 12 MONTH"))
def trailing_12_months(spark, sf_dir):
    return ts.trailing(macro_series(spark, sf_dir), "indicator", 12)


@query("ts_aligned_series", with_inputs("macro", """
, a AS (SELECT date, value FROM macro WHERE indicator = '1-URGENT'), b AS (SELECT date, value FROM macro WHERE indicator = '2-HIGH' AND month(date) % 3 = 1),
j AS (SELECT coalesce(a.date, b.date) AS date, a.value AS a, b.value AS b FROM a FULL JOIN b ON a.date = b.date),
f AS (SELECT date, last_value(a IGNORE NULLS) OVER (ORDER BY date) AS a, last_value(b IGNORE NULLS) OVER (ORDER BY date) AS b FROM j)
SELECT date::VARCHAR AS date, a, b FROM f WHERE a IS NOT NULL AND b IS NOT NULL"""))
def aligned_series(spark, sf_dir):
    m = macro_series(spark, sf_dir).withColumn("pair", F.lit("urgent/high"))
    return ts.align(m.filter("indicator = '1-URGENT'"), m.filter("indicator = '2-HIGH' and month(date) % 3 = 1"), "pair").drop("pair")


@query("ts_context_budget", """WITH b AS (SELECT doc_id, source, substr(text, 1, CAST(20000 - before AS BIGINT)) AS text FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 20000)
SELECT doc_id, source, CAST(length(text) AS INTEGER) AS chars FROM b""")
def context_budget(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return ts.budgeted(d, "source", "doc_id", "text", 20_000).select("doc_id", "source", F.length("text").alias("chars"))


@query("ts_proportional_budget", """WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'web' ELSE 'store' END AS origin, text FROM documents),
s AS (SELECT doc_id, origin, least(length(text), 30000 - before) AS chars FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE origin = 'store') WHERE before < 30000),
w AS (SELECT doc_id, origin, least(length(text), CAST(floor(greatest(30000 - used, 0) / n::DOUBLE) AS BIGINT)) AS chars FROM (SELECT *, sum(CASE WHEN origin = 'store' THEN length(text) ELSE 0 END) OVER (PARTITION BY source) AS used, sum((origin = 'web')::INT) OVER (PARTITION BY source) AS n FROM d) WHERE origin = 'web')
SELECT doc_id, origin, CAST(chars AS INTEGER) AS chars FROM (SELECT * FROM s UNION ALL SELECT * FROM w) WHERE chars > 0""")
def proportional_budget(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "web").otherwise("store").alias("origin"), "text")
    return ts.shared_budget(d, "source", "doc_id", "text", "origin", 30_000).select("doc_id", "origin", F.length("text").alias("chars"))


@query("ts_latest_per_key", "SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return ts.latest_per_key(load(spark, sf_dir, "events"), ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "user_id", "event_id", "value")


@query("ts_keep_last_per_period", with_inputs("macro", "SELECT indicator, CAST(year(date) AS INTEGER) AS year, arg_max(value, date) AS value FROM macro GROUP BY 1, 2"))
def keep_last_per_period(spark, sf_dir):
    return macro_series(spark, sf_dir).groupBy("indicator", F.year("date").alias("year")).agg(F.max_by("value", "date").alias("value"))


#: Two attempts of a user within an hour go through.
LIMITED = """WITH RECURSIVE b AS MATERIALIZED (SELECT user_id AS key, ts, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
e AS (SELECT key, i, [ts] AS kept, TRUE AS allowed FROM b WHERE i = 1
UNION ALL SELECT key, i, CASE WHEN len(live) < 2 THEN list_append(live, ts) ELSE live END, len(live) < 2 FROM (SELECT b.key, b.i, b.ts, list_filter(e.kept, lambda x: b.ts - x < INTERVAL 1 HOUR) AS live FROM e JOIN b ON b.key = e.key AND b.i = e.i + 1))
SELECT key, ts::VARCHAR AS ts, id, allowed FROM b JOIN e USING (key, i)"""


@query("ts_sliding_limiter", LIMITED)
def sliding_limiter(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("id"))
    return ts.sliding_limiter(e, "user_id", seconds=3600, most=2)


@query("ts_rsi_sql", RSI_ROWS.replace(", CASE WHEN rsi > 70 THEN 'Overbought' WHEN rsi < 30 THEN 'Oversold' WHEN rsi IS NOT NULL THEN 'Neutral' END AS rsi_status", ""))
def rsi_sql(spark, sf_dir):
    """The indicator called from SQL on a table."""
    register_table_functions(spark)
    bars(spark, sf_dir).select("ticker", "ts", "close").createOrReplaceTempView("quillfin_bars")
    r = spark.sql("SELECT ticker, ts, close, rsi FROM rsi(TABLE(quillfin_bars) PARTITION BY ticker ORDER BY ts, value => 'close', periods => 14)")
    return _rounded(r, {"rsi"})


@query("ts_limiter_sql", LIMITED)
def limiter_sql(spark, sf_dir):
    """The limiter called from SQL on a table."""
    register_table_functions(spark)
    load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("id")).createOrReplaceTempView("quillfin_attempts")
    return spark.sql("SELECT key, ts, id, allowed FROM sliding_limit(TABLE(quillfin_attempts) PARTITION BY key ORDER BY (ts, id), at => 'ts', seconds => 3600, most => 2)")
