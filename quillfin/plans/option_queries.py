"""Option-chain queries. The chain's day is AS_OF."""

from __future__ import annotations

from quillfin.adapters import chain, row_text, spots, with_inputs
from quillfin.operators import options as op
from quillfin.plans.registry import query

AS_OF = "1996-06-15"
_DTE = f"date_diff('day', DATE '{AS_OF}', expiration)"
_S = lambda x, scale=2: f"CAST(sum(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE)"


def _side(kind: str, window: str = "0.02") -> str:
    on = f"option_type = '{kind}'"
    iv = f"CASE WHEN {on} AND dte > 1 AND impliedVolatility > 0.01 THEN impliedVolatility END"
    inside = f"coalesce({_S(f'CASE WHEN {on} AND strike BETWEEN price * (1 - {window}::DOUBLE) AND price * (1 + {window}::DOUBLE) THEN volume END')}, 0)"
    total = _S(f"CASE WHEN {on} THEN volume END")
    return f"""coalesce({total}, 0) AS {kind}_volume, coalesce({_S(f'CASE WHEN {on} THEN notional END')}, 0) AS {kind}_notional_usd,
    round({_S(iv, 6)} / count({iv}) * 100, 1) AS avg_{kind}_iv_pct, CASE WHEN max(price) IS NOT NULL AND {total} > 0 THEN round(100 * {inside} / {total}, 1) END AS atm_{kind}_pct"""


_PC = "CASE WHEN call_volume > 0 THEN round(put_volume / call_volume, 4) END"
_SKEW = "CASE WHEN avg_call_iv_pct <> 0 AND avg_put_iv_pct <> 0 THEN round(avg_put_iv_pct - avg_call_iv_pct, 1) END AS iv_skew_pct"
_MOOD = f"CASE WHEN {_PC} IS NULL THEN 'UNKNOWN' WHEN {_PC} < 0.7::DOUBLE THEN 'BULLISH' WHEN {_PC} > 1.3::DOUBLE THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment"
_IV = "CASE WHEN impliedVolatility > 0.01 THEN round(impliedVolatility * 100, 1) END AS iv_pct"


@query("opt_expiration_metrics", with_inputs("chain spots", f"""
, m AS (SELECT ticker, expiration, {_DTE} AS dte, {_side('call')}, {_side('put')} FROM (SELECT *, {_DTE} AS dte FROM chain LEFT JOIN spots USING (ticker)) GROUP BY ticker, expiration)
SELECT ticker, expiration::VARCHAR AS expiration, CAST(dte AS INTEGER) AS dte, * EXCLUDE (ticker, expiration, dte), {_SKEW}, {_PC} AS put_call_ratio, {_MOOD} FROM m"""))
def expiration_metrics(spark, sf_dir):
    return op.option_expiration_metrics(chain(spark, sf_dir), spots(spark, sf_dir), AS_OF)


@query("opt_summary", with_inputs("chain spots", f"""
, m AS (SELECT ticker, {_side('call')}, {_side('put')}, {_S('openInterest')} AS open_interest FROM (SELECT *, {_DTE} AS dte FROM chain LEFT JOIN spots USING (ticker)) GROUP BY ticker)
SELECT *, {_SKEW}, {_PC} AS put_call_ratio, {_MOOD},
round((coalesce(atm_call_pct, 0) + coalesce(atm_put_pct, 0)) / greatest((atm_call_pct IS NOT NULL)::INT + (atm_put_pct IS NOT NULL)::INT, 1), 1) AS atm_concentration_pct FROM m"""))
def summary(spark, sf_dir):
    return op.option_summary(chain(spark, sf_dir), spots(spark, sf_dir), AS_OF)


_CHOSEN = f"""e AS (SELECT DISTINCT ticker, expiration, {_DTE} AS dte FROM chain),
b AS (SELECT *, CASE WHEN dte < 0 THEN 'past' WHEN dte <= 90 THEN 'near' ELSE 'far' END AS bucket FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, bucket ORDER BY expiration) AS n, max(dte) OVER (PARTITION BY ticker) AS latest, min(expiration) OVER (PARTITION BY ticker) AS first FROM b),
chosen AS (SELECT ticker, expiration, dte FROM r WHERE (bucket = 'near' AND n <= 4) OR (bucket = 'far' AND n <= 2) OR (latest < 0 AND expiration = first))"""


@query("opt_select_expirations", with_inputs("chain", f", {_CHOSEN} SELECT ticker, expiration::VARCHAR AS expiration, CAST(dte AS INTEGER) AS dte FROM chosen"))
def select_expirations(spark, sf_dir):
    return op.select_expirations(chain(spark, sf_dir), AS_OF)


@query("opt_expirations_with_dte", with_inputs("chain", f"""SELECT DISTINCT ticker, expiration::VARCHAR AS expiration, CAST({_DTE} AS INTEGER) AS dte,
CASE WHEN {_DTE} <= 30 THEN 'near_term_le30' WHEN {_DTE} <= 90 THEN 'mid_term_31_90' ELSE 'long_dated_gt90' END AS bucket FROM chain"""))
def expirations_with_dte(spark, sf_dir):
    return op.expirations_with_dte(chain(spark, sf_dir), AS_OF)


@query("opt_top_activity", with_inputs("chain", f"""
, g AS (SELECT ticker, option_type, strike, expiration, {_S('volume')} AS activity, {_S('notional')} AS notional_usd, arg_min(openInterest, row_id) AS oi FROM chain GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, option_type ORDER BY activity DESC, strike, expiration) AS rank, sum(activity) OVER (PARTITION BY ticker, option_type) AS total FROM g)
SELECT ticker, option_type, CAST(rank AS INTEGER) AS rank, strike, expiration::VARCHAR AS expiration, CASE WHEN oi > 0 THEN 'oi' ELSE 'volume' END AS metric_used, activity, notional_usd,
CASE WHEN total > 0 THEN round(100 * activity / total, 1) ELSE 0.0 END AS pct_of_total FROM r WHERE rank <= 5 AND activity <> 0"""))
def top_activity(spark, sf_dir):
    return op.top_activity_strikes(chain(spark, sf_dir))


@query("opt_top_notional", with_inputs("chain spots", f"""
, c AS (SELECT *, {_S('notional')} OVER (PARTITION BY ticker, option_type) AS total, coalesce(strike BETWEEN price * 0.99::DOUBLE AND price * 1.01::DOUBLE, price IS NULL) AS inside FROM chain LEFT JOIN spots USING (ticker)),
f AS (SELECT * FROM (SELECT *, max(inside::INT) OVER (PARTITION BY ticker, option_type) AS has_inside FROM c) WHERE inside OR has_inside = 0),
g AS (SELECT ticker, option_type, strike, expiration, {_S('notional')} AS notional_usd, {_S('volume')} AS volume, arg_min(lastPrice, row_id) AS last_price, arg_min(impliedVolatility, row_id) AS impliedVolatility, max(total) AS total FROM f GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, option_type ORDER BY notional_usd DESC, strike, expiration) AS rank FROM g)
SELECT ticker, option_type, CAST(rank AS INTEGER) AS rank, strike, expiration::VARCHAR AS expiration, notional_usd, volume, round(last_price, 2) AS last_price, {_IV}, CASE WHEN total > 0 THEN round(100 * notional_usd / total, 1) ELSE 0.0 END AS pct_of_total_flow
FROM r WHERE rank <= 5 AND notional_usd <> 0""".replace("AS DOUBLE) OVER (PARTITION BY ticker, option_type)", "AS DOUBLE)").replace("CAST(sum(CAST(notional AS DECIMAL(18,2))) AS DOUBLE) AS total, coalesce", "CAST(sum(CAST(notional AS DECIMAL(18,2))) OVER (PARTITION BY ticker, option_type) AS DOUBLE) AS total, coalesce")))
def top_notional(spark, sf_dir):
    return op.top_notional_strikes(chain(spark, sf_dir), spots(spark, sf_dir), band=0.01)


@query("opt_expiration_top_notional", with_inputs("chain", f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY ticker, option_type, expiration ORDER BY notional DESC, row_id) AS rank FROM chain)
SELECT ticker, option_type, expiration::VARCHAR AS expiration, CAST(rank AS INTEGER) AS rank, strike, volume, notional AS notional_usd, round(lastPrice, 2) AS last_price, {_IV}, inTheMoney AS itm FROM r WHERE rank <= 3 AND notional <> 0"""))
def expiration_top_notional(spark, sf_dir):
    return op.expiration_top_notional(chain(spark, sf_dir))


@query("opt_strike_levels", with_inputs("chain spots", f"""
, c AS (SELECT *, CASE WHEN option_type = 'put' AND strike < price THEN 'support' WHEN option_type = 'call' AND strike > price THEN 'resistance' END AS level FROM chain JOIN spots USING (ticker)),
g AS (SELECT ticker, level, strike, {_S('volume')} AS activity FROM c WHERE level IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, level ORDER BY activity DESC, strike) AS n FROM g)
SELECT ticker, level, CAST(row_number() OVER (PARTITION BY ticker, level ORDER BY CASE WHEN level = 'support' THEN -strike ELSE strike END) AS INTEGER) AS position, strike, activity FROM r WHERE n <= 3"""))
def strike_levels(spark, sf_dir):
    return op.strike_levels(chain(spark, sf_dir), spots(spark, sf_dir))


def _pain(up: str, down: str) -> str:
    x = "DECIMAL(18,2)"
    return with_inputs("chain", f"""
, s AS (SELECT ticker, expiration, CAST(strike AS {x}) AS strike, sum(CASE WHEN option_type = '{up}' THEN CAST(volume AS {x}) ELSE 0 END) AS u, sum(CASE WHEN option_type = '{down}' THEN CAST(volume AS {x}) ELSE 0 END) AS d FROM chain GROUP BY 1, 2, 3),
p AS (SELECT a.ticker, a.expiration, a.strike, round(CAST(sum(greatest(b.strike - a.strike, 0) * b.u + greatest(a.strike - b.strike, 0) * b.d) AS DOUBLE), 2) AS pain FROM s a JOIN s b ON a.ticker = b.ticker AND a.expiration = b.expiration GROUP BY 1, 2, 3)
SELECT ticker, expiration::VARCHAR AS expiration, CAST(arg_min(strike, (pain, strike)) AS DOUBLE) AS max_pain_strike, min(pain) AS pain FROM p GROUP BY 1, 2""")


@query("opt_max_pain", _pain("call", "put"))
def max_pain(spark, sf_dir):
    return op.max_pain(chain(spark, sf_dir), weight="volume")


@query("opt_max_pain_market", _pain("put", "call"))
def max_pain_market(spark, sf_dir):
    return op.max_pain(chain(spark, sf_dir), convention="market", weight="volume")


_SMART = f"""centre AS (SELECT ticker, {_S("CASE WHEN option_type = 'call' THEN strike * volume END", 4)} / {_S("CASE WHEN option_type = 'call' THEN volume END")} AS centre FROM chain GROUP BY 1),
late AS (SELECT *, {_DTE} AS dte FROM chain WHERE {_DTE} > 90),
bar AS (SELECT ticker, expiration, round(quantile_cont(CASE WHEN volume > 0 THEN volume END, 0.85::DOUBLE), 6) AS threshold FROM late GROUP BY 1, 2),
sig AS (SELECT ticker, option_type, expiration, dte, strike, volume, notional AS notional_usd, {_IV}, row_id FROM late JOIN bar USING (ticker, expiration) LEFT JOIN centre USING (ticker)
WHERE volume >= 40 AND volume >= threshold AND (centre IS NULL OR centre = 0 OR abs(strike - centre) / centre <= 0.02::DOUBLE))"""


@query("opt_smart_money", with_inputs("chain", f", {_SMART} SELECT * REPLACE (expiration::VARCHAR AS expiration, CAST(dte AS INTEGER) AS dte) FROM sig"))
def smart_money(spark, sf_dir):
    return op.smart_money(chain(spark, sf_dir), AS_OF, vol_min=40, band=0.02).withColumn("row_id", row_text())


@query("opt_smart_money_assessment", with_inputs("chain", f"""
, {_SMART}, g AS (SELECT ticker, coalesce({_S("CASE WHEN option_type = 'call' THEN volume END")}, 0) AS calls, coalesce({_S("CASE WHEN option_type = 'put' THEN volume END")}, 0) AS puts, arg_max(strike, (notional_usd, row_id)) AS dominant_strike, count(*) AS n FROM sig GROUP BY 1)
SELECT ticker, coalesce(n, 0) AS n_signals, CASE WHEN calls IS NULL THEN 'INSUFFICIENT_DATA' WHEN calls > puts * 1.5 THEN 'ACCUMULATING' WHEN puts > calls * 1.5 THEN 'HEDGING' ELSE 'MIXED' END AS assessment, dominant_strike
FROM (SELECT DISTINCT ticker FROM chain) LEFT JOIN g USING (ticker)"""))
def smart_money_assessment(spark, sf_dir):
    c = chain(spark, sf_dir)
    return op.smart_money_assessment(op.smart_money(c, AS_OF, vol_min=40, band=0.02), c)


@query("opt_unusual_activity", with_inputs("chain", f"""
, bar AS (SELECT ticker, option_type, expiration, round(quantile_cont(CASE WHEN volume > 0 THEN volume END, 0.85::DOUBLE), 6) AS threshold FROM chain GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY notional DESC, row_id) AS rank FROM chain JOIN bar USING (ticker, option_type, expiration) WHERE volume >= threshold AND volume >= 30)
SELECT ticker, CAST(rank AS INTEGER) AS rank, option_type, strike, expiration::VARCHAR AS expiration, volume, openInterest AS open_interest, notional AS notional_usd, round(lastPrice, 2) AS last_price, {_IV}, CASE WHEN threshold > 0 THEN round(volume / threshold, 2) END AS ratio FROM r WHERE rank <= 15"""))
def unusual_activity(spark, sf_dir):
    return op.unusual_activity(chain(spark, sf_dir), vol_min=30)


@query("opt_chart_frame", with_inputs("chain spots", """
, c AS (SELECT * FROM chain LEFT JOIN spots USING (ticker) WHERE price IS NULL OR strike BETWEEN price * (1 - 0.02::DOUBLE) AND price * (1 + 0.02::DOUBLE)),
k AS (SELECT * FROM c WHERE option_type = 'call'), p AS (SELECT * FROM c WHERE option_type = 'put'),
m AS (SELECT coalesce(k.ticker, p.ticker) AS ticker, coalesce(k.expiration, p.expiration)::VARCHAR AS expiration, coalesce(k.strike, p.strike) AS strike, coalesce(k.volume, 0) AS call_activity, coalesce(p.volume, 0) AS put_activity, round(coalesce(k.notional, 0) / 1e6, 3) AS call_notional_musd, round(coalesce(p.notional, 0) / 1e6, 3) AS put_notional_musd
FROM k FULL JOIN p ON k.ticker = p.ticker AND k.expiration = p.expiration AND k.strike = p.strike)
SELECT * FROM m WHERE call_activity > 0 OR put_activity > 0"""))
def chart_frame(spark, sf_dir):
    return op.chart_frame(chain(spark, sf_dir), spots(spark, sf_dir), band=0.02)


@query("opt_data_quality", with_inputs("chain", f", {_CHOSEN} SELECT ticker, count(*) AS requested, count(*) AS with_data FROM chosen GROUP BY 1"))
def data_quality(spark, sf_dir):
    c = chain(spark, sf_dir)
    return op.data_quality(op.select_expirations(c, AS_OF), c)
