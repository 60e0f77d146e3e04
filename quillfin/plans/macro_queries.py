"""Macro queries over mean order values by priority and month."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfin.adapters import load, macro_series, with_inputs
from quillfin.functions import periods as per
from quillfin.functions.numbers import rnd
from quillfin.operators import macro as m
from quillfin.plans.registry import query

_CATALOG = [("1-URGENT", "monthly", "Percent"), ("2-HIGH", "monthly", "Percent"), ("3-MEDIUM", "monthly", "Percent"), ("4-NOT SPECIFIED", "monthly", "Index"), ("5-LOW", "monthly", "Index")]
_MATURITY = [("1-URGENT", 24), ("2-HIGH", 120), ("3-MEDIUM", 360)]
_ASKED = [
    (None, None, "YoY", None), (None, None, "QoQ", "quarterly"), ("Q2 1996", "1995-Q2", "YoY", "quarterly"), ("1995 Q1", "Q1 1996", "YoY", None), ("MAR 1997", None, "MoM", None), ("1997-02", "January 1994", "YoY", "native"),
    ("1996", "1994", "YoY", "annual"), (None, None, "YoY", "annual"), ("2050-01", None, "MoM", None), ("1996-05", "1960-01", "YoY", None), ("soon", None, "YoY", None), ("Q4 2051", "Q4 2050", "QoQ", "quarterly"),
]
_SPECS = [(i * 100 + k, name, *x) for i, name in enumerate([c[0] for c in _CATALOG] + ["9-NONE"]) for k, x in enumerate(_ASKED)]
_lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
_values = lambda name, cols, rows: f"{name}({cols}) AS (VALUES {', '.join('(' + ', '.join(_lit(x) for x in r) + ')' for r in rows)})"


def catalog(spark):
    return spark.createDataFrame(_CATALOG, "indicator string, frequency string, unit string")


def maturities(spark):
    return spark.createDataFrame(_MATURITY, "indicator string, months int")


def specs(spark):
    return spark.createDataFrame(_SPECS, "spec_id int, indicator string, period1 string, period2 string, comparison_type string, granularity string")


_MONTHS = "['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']"
_NAMES = "['January','February','March','April','May','June','July','August','September','October','November','December']"


def _parse(p: str) -> str:
    t = f"upper(trim({p}))"
    y = f"""CASE WHEN regexp_matches({t}, '^Q[1-4][ -]+[0-9]{{4}}$') THEN right({t}, 4) WHEN regexp_matches({t}, '^[0-9]{{4}}') THEN left({t}, 4) WHEN regexp_matches({t}, '^[A-Z]{{3,}}[ -]+[0-9]{{4}}$') THEN right({t}, 4) END::INT"""
    mo = f"""CASE WHEN regexp_matches({t}, 'Q[1-4]') THEN regexp_extract({t}, 'Q([1-4])', 1)::INT * 3 - 2 WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{1,2}}$') THEN regexp_extract({t}, '-([0-9]+)', 1)::INT
    WHEN regexp_matches({t}, '^[A-Z]{{3,}}[ -]+[0-9]{{4}}$') THEN list_position({_MONTHS}, left({t}, 3)) WHEN regexp_matches({t}, '^[0-9]{{4}}$') THEN 1 END"""
    return f"CASE granularity WHEN 'annual' THEN ({y}) WHEN 'quarterly' THEN 4 * ({y}) + ({mo} - 1) // 3 ELSE 12 * ({y}) + {mo} - 1 END"


def _fmt(p: str) -> str:
    return f"CASE granularity WHEN 'annual' THEN {p}::VARCHAR WHEN 'quarterly' THEN 'Q' || ({p} % 4 + 1) || ' ' || ({p} // 4) ELSE {_NAMES}[{p} % 12 + 1] || ' ' || ({p} // 12) END"


_HINT = lambda p: f"coalesce({p} NOT LIKE '%Q%' AND (regexp_matches({p}, '[A-Za-z]') OR regexp_matches({p}, '^[0-9]+-[0-9]+$')), FALSE)"
_COMPARE = f"""{_values('catalog', 'indicator, frequency, unit', _CATALOG)}, {_values('specs', 'spec_id, indicator, period1, period2, comparison_type, asked', _SPECS)},
per AS (SELECT indicator, 'monthly' AS granularity, 12 * year(date) + month(date) - 1 AS o, value, TRUE AS complete FROM macro
UNION ALL SELECT indicator, 'quarterly', 4 * year(date) + quarter(date) - 1, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), count(value) >= 3 FROM macro GROUP BY 1, 3
UNION ALL SELECT indicator, 'annual', year(date), arg_max(value, date), TRUE FROM macro GROUP BY 1, 3),
s0 AS (SELECT s.*, frequency, unit, CASE WHEN asked IS NULL OR asked = 'native' THEN CASE WHEN {_HINT('period1')} OR {_HINT('period2')} THEN 'monthly' ELSE frequency END ELSE asked END AS granularity FROM specs s LEFT JOIN catalog USING (indicator)),
h AS (SELECT indicator, granularity, max(o) AS top, max(o) FILTER (complete) AS last, arg_max(complete, o) AS top_ok, count(*) AS n FROM per GROUP BY 1, 2),
second AS (SELECT p.indicator, p.granularity, max(o) AS o FROM per p JOIN h USING (indicator, granularity) WHERE o < top GROUP BY 1, 2),
s1 AS (SELECT s0.*, last, h.n, CASE WHEN comparison_type = 'YoY' THEN CASE granularity WHEN 'annual' THEN 1 WHEN 'quarterly' THEN 4 ELSE 12 END ELSE 1 END AS step,
  CASE WHEN period1 IS NOT NULL THEN {_parse('period1')} WHEN NOT top_ok AND second.o IS NOT NULL THEN second.o ELSE top END AS p1 FROM s0 LEFT JOIN h USING (indicator, granularity) LEFT JOIN second USING (indicator, granularity)),
s2 AS (SELECT *, CASE WHEN period2 IS NOT NULL THEN {_parse('period2')} ELSE p1 - step END AS p2 FROM s1),
s3 AS (SELECT *, (period1 IS NOT NULL AND p1 IS NULL) OR (period2 IS NOT NULL AND p2 IS NULL) AS unreadable, greatest(p1, p2) AS a, least(p1, p2) AS b0 FROM s2),
s4 AS (SELECT s3.*, coalesce(complete, FALSE) AS ok1, CASE WHEN coalesce(complete, FALSE) THEN a ELSE last END AS q1 FROM s3 LEFT JOIN per ON per.indicator = s3.indicator AND per.granularity = s3.granularity AND per.o = s3.a),
s5 AS (SELECT *, CASE WHEN NOT ok1 AND period2 IS NULL THEN q1 - step ELSE b0 END AS b FROM s4),
s6 AS (SELECT s5.*, coalesce(x.complete, FALSE) AS ok2, coalesce(y.complete, FALSE) AS ok3, (SELECT max(o) FROM per z WHERE z.indicator = s5.indicator AND z.granularity = s5.granularity AND z.complete AND z.o < s5.q1) AS before
  FROM s5 LEFT JOIN per x ON x.indicator = s5.indicator AND x.granularity = s5.granularity AND x.o = s5.b LEFT JOIN per y ON y.indicator = s5.indicator AND y.granularity = s5.granularity AND y.o = s5.q1 - s5.step),
s7 AS (SELECT *, CASE WHEN ok2 THEN b WHEN ok3 THEN q1 - step ELSE before END AS q2 FROM s6),
s8 AS (SELECT s7.*, x.value AS v1, y.value AS v2, CASE WHEN frequency IS NULL THEN 'Unknown indicator: ' || s7.indicator WHEN n IS NULL THEN 'No data available for ' || s7.indicator WHEN unreadable THEN 'Could not parse period'
  WHEN q1 IS NULL THEN 'No complete data available for ' || s7.indicator WHEN q2 IS NULL THEN 'No complete comparison data available for ' || s7.indicator END AS error
  FROM s7 LEFT JOIN per x ON x.indicator = s7.indicator AND x.granularity = s7.granularity AND x.o = q1 LEFT JOIN per y ON y.indicator = s7.indicator AND y.granularity = s7.granularity AND y.o = q2),
compared AS (SELECT spec_id, indicator, granularity, CASE WHEN error IS NULL THEN {_fmt('q1')} END AS period1, CASE WHEN error IS NULL THEN {_fmt('q2')} END AS period2,
  CASE WHEN error IS NULL THEN round(v1, 2) END AS val1, CASE WHEN error IS NULL THEN round(v2, 2) END AS val2, CASE WHEN error IS NULL THEN round((v1 - v2) / v2 * 100, 2) END AS percentage_change,
  CASE WHEN error IS NULL THEN round(v1 - v2, 2) END AS absolute_change, CASE WHEN error IS NULL AND lower(unit) = 'percent' THEN round((v1 - v2) * 100, 1) END AS basis_points_change, CASE WHEN error IS NULL THEN unit END AS unit,
  CASE WHEN error IS NULL THEN CASE WHEN NOT ok1 THEN 'Requested data for ' || {_fmt('a')} || ' is not available. Showing the latest available data for ' || {_fmt('q1')} || '.'
  WHEN NOT ok2 THEN 'Requested comparison data for ' || {_fmt('b')} || ' is not available. Showing comparison with ' || {_fmt('q2')} || '.' END END AS info, error FROM s8)"""


def _compared(spark, sf_dir):
    return m.macro_compare(macro_series(spark, sf_dir), catalog(spark), specs(spark))


@query("macro_compare", with_inputs("macro", f", {_COMPARE} SELECT * FROM compared"))
def compare(spark, sf_dir):
    return _compared(spark, sf_dir)


@query("macro_latest_of_all", with_inputs("macro", f", {_COMPARE} SELECT indicator, period1 || ' vs ' || period2 AS comparison, printf('%+.2f%%', percentage_change) AS change FROM compared WHERE spec_id % 100 = 0 AND error IS NULL"))
def latest_of_all(spark, sf_dir):
    return m.latest_of_all(macro_series(spark, sf_dir), catalog(spark))


_MAT = _values("maturity", "indicator, months", _MATURITY)


@query("macro_yield_spread", with_inputs("macro", f"""
, {_COMPARE}, {_MAT}, r AS (SELECT * FROM compared JOIN maturity USING (indicator) WHERE spec_id % 100 = 0 AND error IS NULL AND unit = 'Percent')
SELECT l.indicator AS long_term_indicator, s.indicator AS short_term_indicator, round(l.val1 - s.val1, 2) AS spread_val1, round((l.val1 - s.val1) * 100, 1) AS spread_bps1, round(l.val2 - s.val2, 2) AS spread_val2, round((l.val2 - s.val2) * 100, 1) AS spread_bps2 FROM r l JOIN r s ON l.months > s.months"""))
def yield_spread(spark, sf_dir):
    return m.yield_spread(_compared(spark, sf_dir).filter("spec_id % 100 = 0"), maturities(spark))


@query("macro_yield_curve", with_inputs("macro", f", {_COMPARE}, {_MAT} SELECT CAST(months AS INTEGER) AS months, indicator, period1, val1, period2, val2 FROM compared JOIN maturity USING (indicator) WHERE spec_id % 100 = 6 AND error IS NULL"))
def yield_curve(spark, sf_dir):
    return m.yield_curve(_compared(spark, sf_dir).filter("spec_id % 100 = 6"), maturities(spark))


@query("macro_source_attribution", with_inputs("macro", f", {_COMPARE}, n AS (SELECT DISTINCT indicator FROM compared WHERE error IS NULL AND spec_id < 300) SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN '' WHEN count(*) > 3 THEN 'All macroeconomic indicators' ELSE string_agg(indicator, '; ' ORDER BY indicator) END AS attribution FROM n"))
def source_attribution(spark, sf_dir):
    return m.source_attribution(_compared(spark, sf_dir).filter("spec_id < 300"))


@query("macro_monthly_to_quarterly", with_inputs("macro", "SELECT indicator, CAST(date_trunc('quarter', date) AS DATE)::VARCHAR AS date, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 4) AS value, count(value) AS count FROM macro GROUP BY 1, 2"))
def monthly_to_quarterly(spark, sf_dir):
    return m.monthly_to_quarterly(macro_series(spark, sf_dir)).withColumn("value", rnd("value", 4))


@query("macro_trend_history", with_inputs("macro", "SELECT indicator, string_agg(strftime(date, '%Y-%m') || '=' || printf('%.2f', value), ',' ORDER BY date) AS history FROM (SELECT *, max(date) OVER (PARTITION BY indicator) AS e FROM macro) WHERE date >= e - INTERVAL 6 MONTH GROUP BY 1"))
def trend_history(spark, sf_dir):
    h = m.trend_history(macro_series(spark, sf_dir), 6)
    return h.select("indicator", F.array_join(F.transform(F.array_sort(F.map_entries("history")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"]))), ",").alias("history"))


@query("macro_spread_trend", with_inputs("macro", """
, a AS (SELECT date, value FROM macro WHERE indicator = '2-HIGH'), b AS (SELECT date, value FROM macro WHERE indicator = '1-URGENT'), j AS (SELECT coalesce(a.date, b.date) AS date, a.value AS a, b.value AS b FROM a FULL JOIN b ON a.date = b.date),
f AS (SELECT date, last_value(a IGNORE NULLS) OVER (ORDER BY date) AS a, last_value(b IGNORE NULLS) OVER (ORDER BY date) AS b FROM j), g AS (SELECT *, max(date) OVER () AS e FROM f WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT date::VARCHAR AS date, a, b, round(a - b, 2) AS spread FROM g WHERE date >= e - INTERVAL 24 MONTH"""))
def spread_trend(spark, sf_dir):
    return m.spread_trend(macro_series(spark, sf_dir), "2-HIGH", "1-URGENT", 24)


@query("fiscal_calendar", """WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, fye FROM orders, (VALUES (3), (6), (9), (12)) f(fye)),
q AS (SELECT d, fye, q, ((fye - (4 - q) * 3 - 1) % 12 + 12) % 12 + 1 AS e FROM o, range(1, 5) t(q)), r AS (SELECT d, fye, arg_min(q, (least(abs(month(d) - e), 12 - abs(month(d) - e)), q)) AS fq FROM q GROUP BY 1, 2)
SELECT d::VARCHAR AS date, fye AS fye_month, CAST(fq AS INTEGER) AS fiscal_quarter, CAST(((fye - (4 - fq) * 3 - 1) % 12 + 12) % 12 + 1 AS INTEGER) AS quarter_end_month,
""" + f"""{_NAMES}[(((fye - (4 - fq) * 3 - 1) % 12 + 12) % 12 + 1 - 3 + 12) % 12 + 1] || '-' || {_NAMES}[((fye - (4 - fq) * 3 - 1) % 12 + 12) % 12 + 1] AS span,
CAST(CASE WHEN month(d) - fye >= 4 THEN year(d) WHEN month(d) - fye + 12 >= 4 THEN year(d) - 1 ELSE year(d) - 2 END AS INTEGER) AS filed_fiscal_year FROM r""")
def fiscal_calendar(spark, sf_dir):
    d = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct().withColumn("fye_month", F.explode(F.array(*[F.lit(x) for x in (3, 6, 9, 12)])))
    fq = per.fiscal_quarter(F.col("date"), F.col("fye_month"))
    return d.withColumn("fiscal_quarter", fq).select("date", "fye_month", "fiscal_quarter", per.quarter_end_month(F.col("fye_month"), F.col("fiscal_quarter")).alias("quarter_end_month"), per.quarter_span(F.col("fye_month"), F.col("fiscal_quarter")).alias("span"), per.filed_fiscal_year(F.col("date"), F.col("fye_month")).alias("filed_fiscal_year"))


@query("fiscal_annual_reports", """WITH y AS (SELECT o_custkey, list_sort(list(DISTINCT year(o_orderdate))) AS s FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(CASE WHEN len(s) < 2 THEN s WHEN s[-1] - s[1] + 1 = 2 THEN [s[-1]] WHEN s[-1] - s[1] + 1 > 2 THEN [s[1], s[-1]] ELSE s END, ',') AS reports FROM y""")
def annual_reports(spark, sf_dir):
    y = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.year("o_orderdate")).alias("years"))
    return y.select("o_custkey", F.array_join(per.collapse_annual(F.col("years")).cast("array<string>"), ",").alias("reports"))


@query("macro_staleness", f"{_values('c', 'indicator, frequency, unit', _CATALOG)}, x AS (SELECT o_orderpriority AS indicator, CAST(max(o_orderdate) AS DATE) AS last_sync FROM orders GROUP BY 1) SELECT indicator, date_diff('day', last_sync, DATE '1998-08-10') > 7 AS stale FROM x JOIN c USING (indicator)".replace("c(", "WITH c(", 1))
def staleness(spark, sf_dir):
    last = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("indicator")).agg(F.max(F.col("o_orderdate").cast("date")).alias("last_sync"))
    return m.stale(catalog(spark).join(last, "indicator"), "last_sync", "1998-08-10").select("indicator", "stale")
