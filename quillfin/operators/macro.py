"""Macro-series comparison, all requests at once.

series: indicator, date, value. catalog: indicator, frequency ('monthly',
'quarterly', 'annual'), unit. specs: spec_id, indicator, period1, period2,
comparison_type, granularity (nulls allowed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfin.adapters import exact_sum
from quillfin.functions.numbers import rnd
from quillfin.functions.periods import format_period, infer_granularity, ordinal_of_date, parse_period, year_step

#: Maturities of rate series in months.
MATURITIES = {"FEDFUNDS": 0, "GS1M": 1, "GS3M": 3, "GS6M": 6, "GS1": 12, "GS2": 24, "GS3": 36, "GS5": 60, "GS7": 84, "GS10": 120, "GS20": 240, "GS30": 360}


def monthly_to_quarterly(series: DataFrame) -> DataFrame:
    """Mean and number of the months of each quarter."""
    return series.groupBy("indicator", F.trunc("date", "quarter").alias("date")).agg((exact_sum("value", 4) / F.count("value")).alias("value"), F.count("value").alias("count"))


def periods(series: DataFrame, catalog: DataFrame) -> DataFrame:
    """indicator, granularity, ordinal, value, complete. A quarter of a monthly series is the mean of its months, complete with three; a year is its last part."""
    s = series.join(catalog.select("indicator", "frequency"), "indicator").withColumn("granularity", F.explode(F.array(F.lit("monthly"), F.lit("quarterly"), F.lit("annual"))))
    s = s.withColumn("ordinal", ordinal_of_date(F.col("date"), F.col("granularity")))
    g = s.groupBy("indicator", "frequency", "granularity", "ordinal").agg(F.max_by("value", "date").alias("last"), (exact_sum("value", 4) / F.count("value")).alias("mean"), F.count("value").alias("n"))
    averaged = (F.col("frequency") == "monthly") & (F.col("granularity") == "quarterly")
    return g.select("indicator", "granularity", "ordinal", F.when(averaged, F.col("mean")).otherwise(F.col("last")).alias("value"), (~averaged | (F.col("n") >= 3)).alias("complete"))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def macro_compare(series: DataFrame, catalog: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, indicator, granularity, period1, period2, val1, val2, percentage_change, absolute_change, basis_points_change, unit, info, error.

    A series' periods (a few hundred) travel as one sorted array; each request
    resolves its two periods in it, with the fallbacks for incomplete ones.
    """
    hist = periods(series, catalog).groupBy("indicator", "granularity").agg(F.array_sort(F.collect_list(F.struct("ordinal", "value", "complete"))).alias("h"))
    s = specs.withColumn("indicator", F.upper("indicator")).join(catalog, "indicator", "left")
    s = s.withColumn("granularity", infer_granularity(F.col("granularity"), F.col("period1"), F.col("period2"), F.col("frequency"))).join(hist, ["indicator", "granularity"], "left")
    g, h = F.col("granularity"), F.col("h")
    step = F.when(F.upper("comparison_type") == "YOY", year_step(g)).otherwise(1)
    asked1, asked2 = F.coalesce(F.trim("period1"), F.lit("")) != "", F.coalesce(F.trim("period2"), F.lit("")) != ""
    own = lambda i: F.element_at(h, i)
    latest = F.when(~own(-1)["complete"] & (F.size(h) >= 2), F.try_element_at(h, F.lit(-2))["ordinal"]).otherwise(own(-1)["ordinal"])
    complete = lambda p: F.exists(h, lambda x: (x["ordinal"] == p) & x["complete"])
    done = F.filter(h, lambda x: x["complete"])
    greatest_of = lambda xs: F.array_max(F.transform(xs, lambda x: x["ordinal"]))
    value = lambda p: F.get(F.filter(h, lambda x: x["ordinal"] == p), F.lit(0))["value"]

    # Each step's results are bound once and named in the next.
    def asked(p1):
        return F.struct(p1.alias("p1"), F.when(asked2, parse_period(F.col("period2"), g)).otherwise(p1 - step).alias("p2"))

    def ordered(v):
        a, b = F.greatest(v["p1"], v["p2"]), F.least(v["p1"], v["p2"])
        return F.struct(a.alias("a"), b.alias("b"), complete(a).alias("ok1"), greatest_of(done).alias("last"), ((asked1 & v["p1"].isNull()) | (asked2 & v["p2"].isNull())).alias("unreadable"))

    def first_settled(v):
        q1 = F.when(v["ok1"], v["a"]).otherwise(v["last"])
        return F.struct(v["unreadable"].alias("unreadable"), v["a"].alias("a"), v["ok1"].alias("ok1"), q1.alias("q1"), F.when(~v["ok1"] & ~asked2, q1 - step).otherwise(v["b"]).alias("b"))

    def second_settled(v):
        ok2, relative = complete(v["b"]), v["q1"] - step
        before = greatest_of(F.filter(done, lambda x: x["ordinal"] < v["q1"]))
        q2 = F.when(ok2, v["b"]).when(complete(relative), relative).otherwise(before)
        return F.struct(*[v[c].alias(c) for c in ("unreadable", "a", "ok1", "q1", "b")], ok2.alias("ok2"), q2.alias("q2"))

    def valued(v):
        return F.struct(*[v[c].alias(c) for c in ("unreadable", "a", "ok1", "q1", "b", "ok2", "q2")], value(v["q1"]).alias("v1"), value(v["q2"]).alias("v2"))

    p1 = F.when(asked1, parse_period(F.col("period1"), g)).otherwise(latest)
    chain = _let(p1, lambda p: _let(asked(p), lambda v: _let(ordered(v), lambda w: _let(first_settled(w), lambda x: _let(second_settled(x), valued)))))
    s = s.select("*", chain.alias("r")).select("*", "r.*")
    error = (
        F.when(F.col("frequency").isNull(), F.concat(F.lit("Unknown indicator: "), "indicator"))
        .when(h.isNull(), F.concat(F.lit("No data available for "), "indicator"))
        .when(F.col("unreadable"), F.lit("Could not parse period"))
        .when(F.col("q1").isNull(), F.concat(F.lit("No complete data available for "), "indicator"))
        .when(F.col("q2").isNull(), F.concat(F.lit("No complete comparison data available for "), "indicator"))
    )
    fmt = lambda c: format_period(F.col(c), g)
    info = F.when(~F.col("ok1"), F.concat(F.lit("Requested data for "), fmt("a"), F.lit(" is not available. Showing the latest available data for "), fmt("q1"), F.lit("."))).when(
        ~F.col("ok2"), F.concat(F.lit("Requested comparison data for "), fmt("b"), F.lit(" is not available. Showing comparison with "), fmt("q2"), F.lit("."))
    )
    good = error.isNull()
    d = F.col("v1") - F.col("v2")
    shown = lambda c: F.when(good, c)
    return s.select(
        "spec_id", "indicator", "granularity", shown(fmt("q1")).alias("period1"), shown(fmt("q2")).alias("period2"), shown(rnd("v1", 2)).alias("val1"), shown(rnd("v2", 2)).alias("val2"),
        shown(rnd(F.try_divide(d, F.col("v2")) * 100, 2)).alias("percentage_change"), shown(rnd(d, 2)).alias("absolute_change"), shown(F.when(F.lower("unit") == "percent", rnd(d * 100, 1))).alias("basis_points_change"),
        shown(F.col("unit")).alias("unit"), shown(info).alias("info"), error.alias("error"),
    )


def latest_of_all(series: DataFrame, catalog: DataFrame, comparison_type: str = "YoY") -> DataFrame:
    """'p1 vs p2' and the signed change of every indicator's latest period."""
    specs = catalog.select(F.col("indicator").alias("spec_id"), "indicator", *[F.lit(None).cast("string").alias(c) for c in ("period1", "period2")], F.lit(comparison_type).alias("comparison_type"), F.lit(None).cast("string").alias("granularity"))
    r = macro_compare(series, catalog, specs).filter("error is null")
    return r.select("indicator", F.concat_ws(" vs ", "period1", "period2").alias("comparison"), F.format_string("%+.2f%%", "percentage_change").alias("change"))


def yield_spread(compared: DataFrame, maturities: DataFrame) -> DataFrame:
    """Long less short value of each pair of rate results (unit Percent) of different maturity (indicator, months)."""
    r = compared.filter("error is null and unit = 'Percent'").join(maturities, "indicator").select("indicator", "months", "val1", "val2")
    long, short = r.alias("l"), r.alias("s")
    d1, d2 = F.col("l.val1") - F.col("s.val1"), F.col("l.val2") - F.col("s.val2")
    return long.join(short, F.col("l.months") > F.col("s.months")).select(F.col("l.indicator").alias("long_term_indicator"), F.col("s.indicator").alias("short_term_indicator"), rnd(d1, 2).alias("spread_val1"), rnd(d1 * 100, 1).alias("spread_bps1"), rnd(d2, 2).alias("spread_val2"), rnd(d2 * 100, 1).alias("spread_bps2"))


def trend_history(series: DataFrame, months: int) -> DataFrame:
    """month -> value of each indicator's trailing months."""
    from quillfin.operators.timeseries import trailing

    t = trailing(series, "indicator", months)
    return t.groupBy("indicator").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.date_format("date", "yyyy-MM"), "value")))).alias("history"))


def spread_trend(series: DataFrame, long: str, short: str, months: int) -> DataFrame:
    """date, a, b, spread of two series carried forward over the trailing months."""
    from quillfin.operators.timeseries import align, trailing

    of = lambda name: series.filter(F.col("indicator") == name).withColumn("pair", F.lit(f"{long}/{short}"))
    return trailing(align(of(long), of(short), "pair"), "pair", months).select("date", "a", "b", rnd(F.col("a") - F.col("b"), 2).alias("spread"))


def yield_curve(compared: DataFrame, maturities: DataFrame) -> DataFrame:
    """Rates of both periods in order of maturity."""
    return compared.filter("error is null").join(maturities, "indicator").select("months", "indicator", "period1", "val1", "period2", "val2")


def stale(catalog: DataFrame, last_sync: str, as_of: str, days: int = 7) -> DataFrame:
    """Whether a catalogue was last updated more than `days` before as_of."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(last_sync))
    return catalog.withColumn("stale", F.coalesce(age > days, F.lit(True)))


def source_attribution(results: DataFrame, most: int = 3) -> DataFrame:
    """One line for each indicator with a result, or one for all if there are more than `most`."""
    names = results.filter("error is null").select("indicator").distinct()
    g = names.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("; ", F.array_sort(F.collect_list("indicator"))).alias("listed"))
    return g.select("n", F.when(F.col("n") == 0, "").when(F.col("n") > most, "All macroeconomic indicators").otherwise(F.col("listed")).alias("attribution"))
