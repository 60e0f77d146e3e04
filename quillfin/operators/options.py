"""Option-chain analytics, many tickers at once.

chain: ticker, option_type ('call'/'put'), expiration, strike, lastPrice, volume,
openInterest, impliedVolatility, inTheMoney, row_id. spot: ticker, price. Amounts
that the single-ticker tool cut to whole numbers stay doubles here. Ties in a
ranking go to the smaller strike, expiration or row_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfin.adapters import exact_sum
from quillfin.functions.numbers import rnd
from quillfin.operators.quantiles import exact_percentile

MIN_IV = 0.01
BULLISH_BELOW = 0.7
BEARISH_ABOVE = 1.3


def normalise_chain(chain: DataFrame) -> DataFrame:
    """Numbers of any type to double, unreadable, missing and NaN ones to 0, and notional = volume x lastPrice x 100."""
    out = chain
    for c in ("strike", "lastPrice", "volume", "openInterest", "impliedVolatility"):
        x = F.col(c).try_cast("double")
        out = out.withColumn(c, F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0)))
    return out.withColumn("notional", rnd(F.col("volume") * F.col("lastPrice") * 100, 2))


def guarded_ratio(put: Column, call: Column, digits: int = 4) -> Column:
    return F.when(call > 0, rnd(put / call, digits))


def sentiment(ratio: Column, bullish: float = BULLISH_BELOW, bearish: float = BEARISH_ABOVE) -> Column:
    return F.when(ratio.isNull(), "UNKNOWN").when(ratio < bullish, "BULLISH").when(ratio > bearish, "BEARISH").otherwise("NEUTRAL")


def _of(kind: str, x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.col("option_type") == kind, x)


def _mean_iv(kind: str) -> Column:
    """Mean implied volatility above noise of one side, in percent with one digit; expiry days are noise."""
    iv = _of(kind, F.when((F.col("dte") > 1) & (F.col("impliedVolatility") > MIN_IV), F.col("impliedVolatility")))
    return rnd(exact_sum(iv, 6) / F.count(iv) * 100, 1)


def _atm(kind: str, window: float) -> Column:
    near = F.col("strike").between(F.col("price") * (1 - window), F.col("price") * (1 + window))
    inside, total = F.coalesce(exact_sum(_of(kind, F.when(near, F.col("volume")))), F.lit(0.0)), exact_sum(_of(kind, "volume"))
    return F.when(F.max("price").isNotNull() & (total > 0), rnd(100 * inside / total, 1))


def _skew(df: DataFrame) -> DataFrame:
    """Put less call volatility; missing where either mean is missing or zero."""
    c, p = F.col("avg_call_iv_pct"), F.col("avg_put_iv_pct")
    return df.withColumn("iv_skew_pct", F.when((c != 0) & (p != 0), rnd(p - c, 1)))


def _side_metrics(atm_window: float) -> list[Column]:
    out = []
    for kind in ("call", "put"):
        zero = F.lit(0.0)
        out += [
            F.coalesce(exact_sum(_of(kind, "volume")), zero).alias(f"{kind}_volume"),
            F.coalesce(exact_sum(_of(kind, "notional")), zero).alias(f"{kind}_notional_usd"),
            _mean_iv(kind).alias(f"avg_{kind}_iv_pct"),
            _atm(kind, atm_window).alias(f"atm_{kind}_pct"),
        ]
    return out


def _prepared(chain: DataFrame, spot: DataFrame, as_of: str) -> DataFrame:
    dte = F.datediff("expiration", F.lit(as_of).cast("date"))
    return normalise_chain(chain).withColumn("dte", dte).join(spot.select("ticker", "price"), "ticker", "left")


def option_expiration_metrics(chain: DataFrame, spot: DataFrame, as_of: str, atm_window: float = 0.02) -> DataFrame:
    """Volume, notional, put/call ratio, sentiment, volatility skew and at-the-money share of each (ticker, expiration)."""
    m = _prepared(chain, spot, as_of).groupBy("ticker", "expiration", "dte").agg(*_side_metrics(atm_window))
    m = _skew(m).withColumn("put_call_ratio", guarded_ratio(F.col("put_volume"), F.col("call_volume")))
    return m.withColumn("sentiment", sentiment(F.col("put_call_ratio")))


def option_summary(chain: DataFrame, spot: DataFrame, as_of: str, atm_window: float = 0.02) -> DataFrame:
    """The same over all expirations of a ticker, and the mean at-the-money share of the sides that have one (0 if none)."""
    m = _skew(_prepared(chain, spot, as_of).groupBy("ticker").agg(*_side_metrics(atm_window), exact_sum("openInterest").alias("open_interest")))
    ratio = guarded_ratio(F.col("put_volume"), F.col("call_volume"))
    c, p = F.col("atm_call_pct"), F.col("atm_put_pct")
    sides = c.isNotNull().cast("int") + p.isNotNull().cast("int")
    atm = rnd((F.coalesce(c, F.lit(0.0)) + F.coalesce(p, F.lit(0.0))) / F.greatest(sides, F.lit(1)), 1)
    return m.withColumn("put_call_ratio", ratio).withColumn("sentiment", sentiment(ratio)).withColumn("atm_concentration_pct", atm)


def select_expirations(chain: DataFrame, as_of: str, near: int = 4, far: int = 2, split: int = 90) -> DataFrame:
    """The first `near` expirations of a ticker within split days and the first `far` beyond; its earliest one if none lies ahead."""
    e = chain.select("ticker", "expiration").distinct().withColumn("dte", F.datediff("expiration", F.lit(as_of).cast("date")))
    bucket = F.when(F.col("dte") < 0, "past").when(F.col("dte") <= split, "near").otherwise("far")
    w = Window.partitionBy("ticker")
    e = e.withColumn("bucket", bucket).withColumn("n", F.row_number().over(Window.partitionBy("ticker", "bucket").orderBy("expiration"))).withColumn("ahead", F.max(F.col("dte") >= 0).over(w)).withColumn("first", F.min("expiration").over(w))
    keep = ((F.col("bucket") == "near") & (F.col("n") <= near)) | ((F.col("bucket") == "far") & (F.col("n") <= far)) | (~F.col("ahead") & (F.col("expiration") == F.col("first")))
    return e.filter(keep).select("ticker", "expiration", "dte")


def expirations_with_dte(chain: DataFrame, as_of: str) -> DataFrame:
    """Each (ticker, expiration) with its days to go and bucket: near_term_le30, mid_term_31_90, long_dated_gt90."""
    dte = F.datediff("expiration", F.lit(as_of).cast("date"))
    name = F.when(dte <= 30, "near_term_le30").when(dte <= 90, "mid_term_31_90").otherwise("long_dated_gt90")
    return chain.select("ticker", "expiration").distinct().select("ticker", "expiration", dte.alias("dte"), name.alias("bucket"))


def _top(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def top_activity_strikes(chain: DataFrame, n: int = 5) -> DataFrame:
    """The (strike, expiration) of most volume of each ticker and side, with its share of the side's total; zero volumes go after the ranking."""
    c = normalise_chain(chain)
    g = c.groupBy("ticker", "option_type", "strike", "expiration").agg(exact_sum("volume").alias("activity"), exact_sum("notional").alias("notional_usd"), F.min_by("openInterest", "row_id").alias("oi"))
    total = F.sum("activity").over(Window.partitionBy("ticker", "option_type"))
    g = g.withColumn("total", total)
    top = _top(g, ["ticker", "option_type"], [F.desc("activity"), "strike", "expiration"], n).filter(F.col("activity") != 0)
    pct = F.when(F.col("total") > 0, rnd(100 * F.col("activity") / F.col("total"), 1)).otherwise(0.0)
    return top.select("ticker", "option_type", "rank", "strike", "expiration", F.when(F.col("oi") > 0, "oi").otherwise("volume").alias("metric_used"), "activity", "notional_usd", pct.alias("pct_of_total"))


def band_or_all(df: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """Rows inside a band, or all rows of a group that has none inside. A key's rows meet in one task: give it aggregates."""
    any_in = F.max(F.coalesce(inside, F.lit(False))).over(Window.partitionBy(*keys))
    return df.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_any", any_in).filter(F.col("_in") | ~F.col("_any")).drop("_in", "_any")


def _iv_pct(c: str = "impliedVolatility") -> Column:
    return F.when(F.col(c) > MIN_IV, rnd(F.col(c) * 100, 1))


def top_notional_strikes(chain: DataFrame, spot: DataFrame, band: float = 0.20, n: int = 5) -> DataFrame:
    """The (strike, expiration) of most dollar flow near the price, with its share of the side's whole flow."""
    side = ["ticker", "option_type"]
    # A band takes whole strikes, so contracts are added up first: what is left is a row for each strike and expiration.
    g = normalise_chain(chain).groupBy(*side, "strike", "expiration").agg(exact_sum("notional").alias("notional_usd"), exact_sum("volume").alias("volume"), F.min_by("lastPrice", "row_id").alias("last_price"), F.min_by("impliedVolatility", "row_id").alias("impliedVolatility"))
    g = g.join(spot.select("ticker", "price"), "ticker", "left").withColumn("total", F.sum(F.col("notional_usd").cast("decimal(18,2)")).over(Window.partitionBy(*side)).cast("double"))
    near = F.col("price").isNull() | F.col("strike").between(F.col("price") * (1 - band), F.col("price") * (1 + band))
    g = band_or_all(g, side, near)
    top = _top(g, side, [F.desc("notional_usd"), "strike", "expiration"], n).filter(F.col("notional_usd") != 0)
    pct = F.when(F.col("total") > 0, rnd(100 * F.col("notional_usd") / F.col("total"), 1)).otherwise(0.0)
    return top.select(*side, "rank", "strike", "expiration", "notional_usd", "volume", rnd("last_price", 2).alias("last_price"), _iv_pct().alias("iv_pct"), pct.alias("pct_of_total_flow"))


def expiration_top_notional(chain: DataFrame, n: int = 3) -> DataFrame:
    """The n contracts of most notional of each ticker, side and expiration."""
    top = _top(normalise_chain(chain), ["ticker", "option_type", "expiration"], [F.desc("notional"), "row_id"], n).filter(F.col("notional") != 0)
    return top.select("ticker", "option_type", "expiration", "rank", "strike", "volume", F.col("notional").alias("notional_usd"), rnd("lastPrice", 2).alias("last_price"), _iv_pct().alias("iv_pct"), F.coalesce("inTheMoney", F.lit(False)).alias("itm"))


def strike_levels(chain: DataFrame, spot: DataFrame, n: int = 3) -> DataFrame:
    """Support: the put strikes below the price of most volume, highest first. Resistance: the call strikes above it, lowest first."""
    c = normalise_chain(chain).join(spot.select("ticker", "price"), "ticker")
    level = F.when((F.col("option_type") == "put") & (F.col("strike") < F.col("price")), "support").when((F.col("option_type") == "call") & (F.col("strike") > F.col("price")), "resistance")
    g = c.withColumn("level", level).filter("level is not null").groupBy("ticker", "level", "strike").agg(exact_sum("volume").alias("activity"))
    top = _top(g, ["ticker", "level"], [F.desc("activity"), "strike"], n)
    outward = F.when(F.col("level") == "support", -F.col("strike")).otherwise(F.col("strike"))
    return top.withColumn("position", F.row_number().over(Window.partitionBy("ticker", "level").orderBy(outward))).select("ticker", "level", "position", "strike", "activity")


def max_pain(chain: DataFrame, convention: str = "reference", weight: str = "openInterest") -> DataFrame:
    """The strike of least total pain of each (ticker, expiration), the lowest on ties.

    'reference' charges calls above the strike and puts below it, 'market' the
    other way round. Running sums over strikes replace the pairing of all strikes.
    """
    above, below = ("call", "put") if convention == "reference" else ("put", "call")
    # Hundredths as whole numbers: sums are exact, and no double's digits are parsed.
    w, s = (F.floor(F.col(c) * 100 + 0.5).cast("decimal(18,0)") for c in (weight, "strike"))
    zero = F.lit(0).cast("decimal(38,0)")
    side = lambda k, x: F.sum(F.when(F.col("option_type") == k, x).otherwise(zero))
    g = normalise_chain(chain).groupBy("ticker", "expiration", "strike").agg(side(above, w).alias("up_w"), side(above, w * s).alias("up_sw"), side(below, w).alias("down_w"), side(below, w * s).alias("down_sw"))
    order = Window.partitionBy("ticker", "expiration").orderBy("strike")
    rest, head = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, frame: F.coalesce(F.sum(c).over(frame), zero).cast("double") / (10_000 if c.endswith("sw") else 100)
    k = F.col("strike")
    pain = (total("up_sw", rest) - k * total("up_w", rest)) + (k * total("down_w", head) - total("down_sw", head))
    p = g.select("ticker", "expiration", "strike", rnd(pain, 2).alias("pain"))
    return p.groupBy("ticker", "expiration").agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain_strike"), F.min("pain").alias("pain"))


def smart_money(chain: DataFrame, as_of: str, dte_min: int = 90, vol_min: float = 50, pct: float = 0.85, band: float = 0.40, within: DataFrame | None = None) -> DataFrame:
    """Long-dated contracts of outstanding volume near the volume-weighted call strike, with the ticker's assessment. within: (ticker, expiration) to look at, else all."""
    c = normalise_chain(chain)
    if within is not None:
        c = c.join(within.select("ticker", "expiration"), ["ticker", "expiration"], "left_semi")
    calls = F.col("option_type") == "call"
    centre = c.groupBy("ticker").agg(F.try_divide(exact_sum(F.when(calls, F.col("strike") * F.col("volume")), 4), exact_sum(F.when(calls, F.col("volume")))).alias("centre"))
    late = c.withColumn("dte", F.datediff("expiration", F.lit(as_of).cast("date"))).filter(F.col("dte") > dte_min)
    bar = exact_percentile(late, ["ticker", "expiration"], F.when(F.col("volume") > 0, F.col("volume")), pct, "threshold").withColumn("threshold", rnd("threshold", 6))
    hit = late.join(bar, ["ticker", "expiration"]).join(centre, "ticker", "left")
    near = F.col("centre").isNull() | (F.col("centre") == 0) | (F.abs(F.col("strike") - F.col("centre")) / F.col("centre") <= band)
    return hit.filter((F.col("volume") >= vol_min) & (F.col("volume") >= F.col("threshold")) & near).select("ticker", "option_type", "expiration", "dte", "strike", "volume", F.col("notional").alias("notional_usd"), _iv_pct().alias("iv_pct"), "row_id")


def smart_money_assessment(signals: DataFrame, tickers: DataFrame, edge: float = 1.5) -> DataFrame:
    """ACCUMULATING, HEDGING, MIXED or INSUFFICIENT_DATA for each ticker, and the strike of the signal of most notional."""
    g = signals.groupBy("ticker").agg(F.coalesce(exact_sum(_of("call", "volume")), F.lit(0.0)).alias("calls"), F.coalesce(exact_sum(_of("put", "volume")), F.lit(0.0)).alias("puts"), F.max_by("strike", F.struct("notional_usd", "row_id")).alias("dominant_strike"), F.count(F.lit(1)).alias("n_signals"))
    verdict = F.when(F.col("calls").isNull(), "INSUFFICIENT_DATA").when(F.col("calls") > F.col("puts") * edge, "ACCUMULATING").when(F.col("puts") > F.col("calls") * edge, "HEDGING").otherwise("MIXED")
    return tickers.select("ticker").distinct().join(g, "ticker", "left").select("ticker", F.coalesce("n_signals", F.lit(0)).alias("n_signals"), verdict.alias("assessment"), "dominant_strike")


def unusual_activity(chain: DataFrame, pct: float = 0.85, vol_min: float = 300, n: int = 15) -> DataFrame:
    """Contracts at or over the pct-quantile of positive volumes of their side and expiration, the n of most notional of each ticker."""
    c = normalise_chain(chain)
    key = ["ticker", "option_type", "expiration"]
    bar = exact_percentile(c, list(key), F.when(F.col("volume") > 0, F.col("volume")), pct, "threshold").withColumn("threshold", rnd("threshold", 6))
    hit = c.join(bar, key).filter((F.col("volume") >= F.col("threshold")) & (F.col("volume") >= vol_min))
    top = _top(hit, ["ticker"], [F.desc("notional"), "row_id"], n)
    return top.select("ticker", "rank", "option_type", "strike", "expiration", "volume", F.col("openInterest").alias("open_interest"), F.col("notional").alias("notional_usd"), rnd("lastPrice", 2).alias("last_price"), _iv_pct().alias("iv_pct"), F.when(F.col("threshold") > 0, rnd(F.col("volume") / F.col("threshold"), 2)).alias("ratio"))


def chart_frame(chain: DataFrame, spot: DataFrame, band: float = 0.10) -> DataFrame:
    """Call and put activity side by side for each strike near the price: a full outer join of contracts on strike, as rows of equal strike multiply."""
    c = normalise_chain(chain).join(spot.select("ticker", "price"), "ticker", "left")
    c = c.filter(F.col("price").isNull() | F.col("strike").between(F.col("price") * (1 - band), F.col("price") * (1 + band)))
    keys = ["ticker", "expiration", "strike"]
    side = lambda k: c.filter(F.col("option_type") == k).select(*keys, F.col("volume").alias(f"{k}_activity"), F.col("notional").alias(f"{k}_notional"))
    m = side("call").join(side("put"), keys, "full").fillna(0.0, [f"{k}_{x}" for k in ("call", "put") for x in ("activity", "notional")])
    m = m.filter((F.col("call_activity") > 0) | (F.col("put_activity") > 0))
    return m.select(*keys, "call_activity", "put_activity", rnd(F.col("call_notional") / 1e6, 3).alias("call_notional_musd"), rnd(F.col("put_notional") / 1e6, 3).alias("put_notional_musd"))


def data_quality(requested: DataFrame, metrics: DataFrame) -> DataFrame:
    """Of each ticker, the expirations asked for and those with data."""
    have = metrics.select("ticker", "expiration").distinct().withColumn("ok", F.lit(1))
    return requested.select("ticker", "expiration").distinct().join(have, ["ticker", "expiration"], "left").groupBy("ticker").agg(F.count(F.lit(1)).alias("requested"), F.count("ok").alias("with_data"))
