"""Calendar and fiscal periods as integers: 12 y + m - 1 (monthly), 4 y + q - 1 (quarterly), y (annual)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month abbreviations.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _month_number(abbreviation: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), abbreviation).cast("int")


def ordinal_of_date(date: Column, granularity: Column) -> Column:
    y, m = F.year(date), F.month(date)
    return F.when(granularity == "annual", y).when(granularity == "quarterly", 4 * y + F.floor((m - 1) / 3)).otherwise(12 * y + m - 1).cast("int")


def parse_period(text: Column, granularity: Column) -> Column:
    """Ordinal of 'Q1 2025', '2025 Q1', '2025-Q1', '2025-03', 'JAN 2025', 'January 2025' or '2025'; null where unreadable.

    A coarser text than the granularity names its first part, a finer one the period that holds it.
    """
    t = F.upper(F.trim(text))
    q1, q2 = r"^Q([1-4])[ -]+(\d{4})$", r"^(\d{4})[ -]*Q([1-4])$"
    ym, my, yy = r"^(\d{4})-(\d{1,2})(?:-\d{1,2})?$", r"^([A-Z]{3})[A-Z]*[ -]+(\d{4})$", r"^(\d{4})$"
    part = lambda p, i: F.regexp_extract(t, p, i)
    year = F.when(t.rlike(q1), part(q1, 2)).when(t.rlike(q2), part(q2, 1)).when(t.rlike(ym), part(ym, 1)).when(t.rlike(my), part(my, 2)).when(t.rlike(yy), t).cast("int")
    month = (
        F.when(t.rlike(q1), part(q1, 1).try_cast("int") * 3 - 2)
        .when(t.rlike(q2), part(q2, 2).try_cast("int") * 3 - 2)
        .when(t.rlike(ym), part(ym, 2).try_cast("int"))
        .when(t.rlike(my), _month_number(part(my, 1)))
        .when(t.rlike(yy), F.lit(1))
    )
    month = F.when(month.between(1, 12), month)
    return F.when(month.isNull(), F.lit(None).cast("int")).when(granularity == "annual", year).when(granularity == "quarterly", 4 * year + F.floor((month - 1) / 3)).otherwise(12 * year + month - 1).cast("int")


def format_period(ordinal: Column, granularity: Column) -> Column:
    """'2025', 'Q1 2025' or 'March 2025'."""
    name = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), (F.pmod(ordinal, F.lit(12)) + 1).cast("int"))
    return (
        F.when(granularity == "annual", ordinal.cast("string"))
        .when(granularity == "quarterly", F.concat(F.lit("Q"), (F.pmod(ordinal, F.lit(4)) + 1).cast("string"), F.lit(" "), F.floor(ordinal / 4).cast("string")))
        .otherwise(F.concat(name, F.lit(" "), F.floor(ordinal / 12).cast("string")))
    )


def year_step(granularity: Column) -> Column:
    """Periods in a year."""
    return F.when(granularity == "annual", 1).when(granularity == "quarterly", 4).otherwise(12)


def infer_granularity(requested: Column, period1: Column, period2: Column, frequency: Column) -> Column:
    """The granularity asked for; else monthly if a period names a month; else the series' own. A quarterly series is never monthly."""
    monthly = lambda p: F.coalesce(~F.upper(p).contains("Q") & (p.rlike("[A-Za-z]") | F.trim(p).rlike(r"^\d+-\d+$")), F.lit(False))
    own = F.when(monthly(period1) | monthly(period2), "monthly").otherwise(frequency)
    g = F.when(requested.isNull() | (requested == "") | (F.lower(requested) == "native"), own).otherwise(F.lower(requested))
    return F.when((frequency == "quarterly") & (g == "monthly"), "quarterly").otherwise(g)


def quarter_end_month(fye_month: Column, quarter: Column) -> Column:
    """The month in which a fiscal quarter ends."""
    return (F.pmod(fye_month - (4 - quarter) * 3 - 1, F.lit(12)) + 1).cast("int")


def fiscal_quarter(date: Column, fye_month: Column) -> Column:
    """The fiscal quarter that a period-end date belongs to: that of its month, else the nearest quarter end around the year, the lower quarter on ties."""
    m = F.month(date)
    options = []
    for q in range(1, 5):
        gap = F.abs(m - quarter_end_month(fye_month, F.lit(q)))
        options.append(F.struct(F.least(gap, 12 - gap).alias("d"), F.lit(q).alias("q")))
    return F.array_min(F.array(*options))["q"]


def quarter_span(fye_month: Column, quarter: Column) -> Column:
    """'October-December': the calendar months of a fiscal quarter."""
    end = quarter_end_month(fye_month, quarter)
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    first = F.pmod(end - 3, F.lit(12)) + 1
    return F.concat_ws("-", F.element_at(names, first.cast("int")), F.element_at(names, end))


def filed_fiscal_year(as_of: Column, fye_month: Column, lag: int = 4) -> Column:
    """The latest fiscal year whose annual report should be out: that of the last year end at least `lag` months ago."""
    y, m = F.year(as_of), F.month(as_of)
    since = m - fye_month
    return F.when(since >= lag, y).when(since + 12 >= lag, y - 1).otherwise(y - 2)


def collapse_annual(years: Column) -> Column:
    """Annual reports that cover an array of years: the last for a span of two, first and last for a longer one, else all."""
    s = F.array_sort(F.array_distinct(years))
    span = F.element_at(s, -1) - F.element_at(s, 1) + 1
    return F.when(F.size(s) < 2, s).when(span == 2, F.slice(s, -1, 1)).when(span > 2, F.array(F.element_at(s, 1), F.element_at(s, -1))).otherwise(s)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
