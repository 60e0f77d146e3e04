"""Text functions of filings, questions and research notes, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists that decide how a text is read.
FORM_10K = ("10-k", "10k", "annual report", "full year", "full-year", "fiscal year annual", "yearly results", "3-year", "three-year", "comparative financials")
FORM_10Q = ("10-q", "10q", "quarterly", "quarter", "q1", "q2", "q3", "q4", "latest quarter", "most recent quarter", "this quarter", "last quarter", "sequential", "qoq", "quarter-over-quarter")
FORM_8K = (
    "8-k", "8k", "material event", "press release", "announced", "announcement", "departure", "resignation", "appointed", "appointment",
    "acquisition of", "merger agreement", "guidance update", "restructuring announcement", "executive change", "ceo change", "cfo change",
)
QUARTER_WORDS = (("first quarter", 1), ("1st quarter", 1), ("second quarter", 2), ("2nd quarter", 2), ("third quarter", 3), ("3rd quarter", 3), ("fourth quarter", 4), ("4th quarter", 4))
SEGMENT = (
    "segment", "segments", "reportable segment", "operating segment", "business segment", "segment revenue", "segment income", "segment profit",
    "revenue by segment", "income by segment", "segment assets", "segment capital expenditure", "segment depreciation", "segment amortization",
    "capex by segment", "segment performance", "segment results", "segment margin", "segment outlook", "segment trend",
    "product segment", "line of business", "disaggregation of revenue", "segment ebitda", "segment operating income", "segment net sales",
    "codm", "asc 280", "segment disclosure", "segment reporting",
)
GEOGRAPHIC = (
    "geographic", "geography", "by region", "by country", "revenue by geography", "revenue by region", "net sales by geography",
    "geographic revenue", "geographic distribution", "region country", "revenue concentration", "geographic information",
    "foreign operations", "international operations", "domestic vs international", "overseas operations", "global footprint",
    "foreign subsidiaries", "properties by location", "facilities by geography", "manufacturing locations", "data centers", "distribution centers",
    "assets by country", "geographic risk", "country risk", "regional risk", "currency risk", "foreign exchange exposure", "export controls",
    "sanctions", "customers by region", "customer concentration geography", "market concentration regional", "geographic market share",
    "long lived assets by geography", "revenue by country",
)
MACRO = (
    "macro", "gdp", "inflation", "cpi", "pce", "ppi", "eci", "gross domestic product", "consumer price index", "employment cost", "producer price index",
    "economy", "interest rate", "yield curve", "yield spread", "treasury yield", "treasury curve", "bond yield", "fed funds", "federal funds", "fedfunds",
    "maturity", "10-year", "2-year", "30-year", "t-bill", "t-bond",
)
SCENARIO = (
    "bull case", "bear case", "base case", "bull scenario", "bear scenario", "base scenario", "upside case", "downside case", "bull and bear", "bull/bear",
    "bull bear base", "scenarios for", "investment scenario", "price target scenario", "upside downside", "scenario analysis", "three scenarios", "3 scenarios",
)
INSIDER = ("insider trading", "open-market buying", "open market buying", "open-market selling", "open market selling", "promoters", "key management", "form 4", "form4")
REALTIME = ("current stock price", "today's price", "right now", "live price", "current market price", "stock price today", "this morning", "today's news")
RATING_TERMS = (
    ("strong_buy", 5.0, ("strong buy", "outperform", "overweight", "conviction buy", "top pick", "aggressive buy", "accumulate")),
    ("buy", 4.0, ("buy", "positive", "market outperform", "sector outperform", "add", "attractive")),
    ("hold", 3.0, ("hold", "neutral", "market perform", "sector perform", "equal weight", "in-line", "peer perform", "mixed")),
    ("sell", 2.0, ("sell", "underperform", "underweight", "reduce", "negative", "market underperform", "sector underperform")),
    ("strong_sell", 1.0, ("strong sell", "avoid", "conviction sell")),
)
KEYWORDS = {
    "negative": (
        "headwinds", "headwind", "margin pressure", "cost pressure", "cost pressures", "challenges", "challenged", "difficult", "uncertainty", "uncertainties",
        "volatility", "volatile", "decline", "declining", "weakness", "weak", "slowdown", "slowing", "pressure", "pressured", "concern", "concerns",
        "risk", "risks", "deterioration", "deteriorating", "downturn", "competition",
    ),
    "positive": (
        "tailwinds", "tailwind", "momentum", "growth", "growing", "strong", "strength", "strengths", "opportunity", "opportunities", "optimistic",
        "confidence", "confident", "improvement", "improving", "expansion", "expanding", "acceleration", "accelerating", "outperformance", "outperform",
        "favorable", "progress", "robust", "solid", "gains", "winning",
    ),
    "guidance": (
        "guidance", "outlook", "forecast", "forecasts", "expect", "expecting", "expectations", "anticipate", "anticipating", "project", "projecting",
        "projections", "targets", "goals", "objectives", "guidance raised", "guidance lowered", "guidance maintained", "guidance reaffirmed",
    ),
    "margins": (
        "margin", "margins", "margin expansion", "margin compression", "gross margin", "operating margin", "profit margin", "ebitda margin",
        "margin improvement", "margin deterioration", "margin pressure",
    ),
}


def contains_any(text: Column, terms) -> Column:
    """Whether any term is a substring of the text in lower case; a null text holds none."""
    return F.coalesce(F.lower(text).rlike("|".join(re.escape(t) for t in terms)), F.lit(False))


def literal_count(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term in the text in lower case."""
    return lower_count(F.lower(text), term)


def lower_count(low: Column, term: str) -> Column:
    """As `literal_count`, of a text that is in lower case already."""
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("int")


def years_in(text: Column) -> Column:
    """Sorted distinct years 2000 to 2029 that stand as words."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b(20[0-2][0-9])\b"), F.lit(1)), lambda y: y.cast("int"))))


def filing_types_in(text: Column) -> Column:
    """10-K, 10-Q and 8-K as far as named or hinted at, in that order; hints count inside words too."""
    low = F.lower(text)
    hit = lambda n, terms, name: F.when(F.coalesce(low.rlike(rf"\b{n[:-1]}-?{n[-1]}\b"), F.lit(False)) | contains_any(text, terms), F.lit(name))
    return F.array_compact(F.array(hit("10k", FORM_10K, "10-K"), hit("10q", FORM_10Q, "10-Q"), hit("8k", FORM_8K, "8-K")))


def quarters_in(text: Column) -> Column:
    """Sorted distinct fiscal quarters named as q1 to q4 or in words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.transform(F.regexp_extract_all(low, F.lit(r"\bq([1-4])\b"), F.lit(1)), lambda q: q.cast("int"))
    words = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(q)) for p, q in QUARTER_WORDS]))
    return F.array_sort(F.array_distinct(F.concat(named, words)))


def segment_or_geographic(text: Column) -> Column:
    return F.when(contains_any(text, GEOGRAPHIC), "geographic").when(contains_any(text, SEGMENT), "segment").otherwise("none")


def intent(text: Column) -> Column:
    """scenario, then macro, then insider, else document."""
    return F.when(contains_any(text, SCENARIO), "scenario").when(contains_any(text, MACRO), "macro").when(contains_any(text, INSIDER), "insider").otherwise("document")


def route(text: Column) -> Column:
    return F.when(contains_any(text, REALTIME), "web_search").otherwise("vectorstore")


def rating(text: Column) -> Column:
    """struct(rating, score) of a rating in words: the first list with a term inside decides; hold if none, null or empty."""
    low = F.lower(F.trim(F.coalesce(F.nullif(text, F.lit("")), F.lit("hold"))))
    name, score = F.lit("hold"), F.lit(3.0)
    for n, s, terms in reversed(RATING_TERMS):
        hit = contains_any(low, terms)
        name, score = F.when(hit, n).otherwise(name), F.when(hit, s).otherwise(score)
    return F.struct(name.alias("rating"), score.alias("score"))


def tone(positive: Column, negative: Column) -> tuple[Column, Column]:
    """(ratio, name) of keyword totals; the band is chosen before rounding."""
    ratio = (positive + 1) / (negative + 1)
    return ratio, F.when(ratio > 1.5, "bullish").when(ratio > 1.1, "slightly_bullish").when(ratio > 0.9, "neutral").when(ratio > 0.67, "slightly_bearish").otherwise("bearish")


def polarity_band(polarity: Column) -> Column:
    return F.when(polarity > 0.3, "bullish").when(polarity > 0.1, "slightly_bullish").when(polarity > -0.1, "neutral").when(polarity > -0.3, "slightly_bearish").otherwise("bearish")


def direction(polarity: Column) -> Column:
    return F.when(polarity > 0.1, "UP").when(polarity < -0.1, "DOWN").otherwise("STABLE")


#: What file names hold beside the company. Taken out one after the other: years, filing numbers, form names, days and months, a number at the end.
FILE_NOISE = (r"\b(19|20)\d{2}\b", r"\b\d{6,}\b", r"(?i)\b(10[-\s]?[kq]|8[-\s]?k|annual|quarterly|report)\b", r"\b\d{1,2}\b", r"\s+\d+\s*$")
#: Forms as file names have them.
FILE_FORMS = ((r"(?i)\b10\s?k\b", "10-K"), (r"(?i)\b10\s?q\b", "10-Q"), (r"(?i)\b8\s?k\b", "8-K"))


def company_of_file(name: Column) -> Column:
    """Company from a file name: extension, separators and noise removed; the bare name if nothing is left."""
    bare = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    left = F.regexp_replace(bare, r"[-_.]", " ")
    for noise in FILE_NOISE:
        left = F.regexp_replace(left, noise, "")
    left = F.trim(F.regexp_replace(left, r"\s+", " "))
    return F.lower(F.when(left == "", bare).otherwise(left))


def filing_type_of_file(name: Column) -> Column:
    spaced = F.regexp_replace(name, r"[-_.]", " ")
    return F.coalesce(*[F.when(spaced.rlike(p), form) for p, form in FILE_FORMS])


def year_of_file(name: Column, this_year: int) -> Column:
    """A free-standing year, else the year of an eight-digit date, within 1995 and next year; else this year."""
    ok = lambda y: F.when(y.between(1995, this_year + 1), y)
    free = F.regexp_extract(name, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int")
    dates = F.transform(F.regexp_extract_all(name, F.lit(r"((?:19|20)\d{2})\d{4}"), F.lit(1)), lambda y: y.cast("int"))
    first = F.get(F.filter(dates, lambda y: y.between(1995, this_year + 1)), F.lit(0))
    return F.coalesce(ok(free), first, F.lit(this_year))


#: A date in words, the forms of a cover page, and what stands before the end of the period, first the surest.
_DATE = r"([A-Za-z]+\s+\d{1,2},?\s+\d{4})"
COVER_FORMS = ((r"(?i)\bform\s*10[-\s]?k\b", "10-K"), (r"(?i)\bform\s*10[-\s]?q\b", "10-Q"), (r"(?i)\bform\s*8[-\s]?k\b", "8-K"))
COVER_PERIODS = (
    r"for\s+the\s+fiscal\s+year\s+ended\s+", r"for\s+the\s+year\s+ended\s+", r"for\s+the\s+quarterly\s+period\s+ended\s+",
    r"date\s+of\s+report[^:]*:\s*", r"for\s+the\s+transition\s+period\s+from[\s\S]*?to\s+",
)


def cover_page(text: Column) -> Column:
    """struct(filing_type, period_end_date) from a filing's first pages."""
    form = F.coalesce(*[F.when(text.rlike(p), name) for p, name in COVER_FORMS])
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, "(?i)" + p + _DATE, 1), F.lit("")) for p in COVER_PERIODS])
    clean = F.initcap(F.regexp_replace(F.replace(found, F.lit(",")), r"\s+", " "))
    date = F.coalesce(F.try_to_date(clean, "MMMM d yyyy"), F.try_to_date(clean, "MMM d yyyy"))
    return F.struct(form.alias("filing_type"), date.cast("string").alias("period_end_date"))


def filing_metadata(given: Column, cover: Column, name: Column, default: str = "10-K") -> Column:
    """struct(filing_type, period_end_date, year) of a filing: what the caller gives (struct of the same fields, any null), else its cover page, else its file name; the type defaults."""
    page = cover_page(cover)
    end = F.coalesce(given["period_end_date"], page["period_end_date"])
    # Year: given, else that of the period's end, else the file name's.
    year = F.coalesce(given["year"], F.substring(end, 1, 4).try_cast("int"), F.regexp_extract(name, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int"))
    return F.struct(F.coalesce(given["filing_type"], page["filing_type"], filing_type_of_file(name), F.lit(default)).alias("filing_type"), end.alias("period_end_date"), year.alias("year"))


#: Edges of words of ASCII letters and digits, and white space, as RE2 has them: Java's \\b looks at letters of any script, its \\s takes the vertical tab too.
_BEGIN, _END, _SPACE = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])", r"[\t\n\f\r ]?"


def has_numeric_claim(text: Column) -> Column:
    number = rf"{_BEGIN}\d+(?:\.\d+)?{_SPACE}"
    return F.coalesce(text.rlike(rf"(?i)\${_SPACE}[\d,]+(?:\.\d+)?|{number}%|{number}(?:million|billion|trillion){_END}"), F.lit(False))


def numeric_value(text: Column) -> Column:
    """The first number of a text, sign kept, units ignored; null for 'n/a' and the like."""
    low = F.lower(F.trim(text))
    num = F.replace(F.regexp_extract(low, r"(-?[\d,]+\.?\d*)", 1), F.lit(",")).try_cast("double")
    # A dotted capital I counts as an i; by itself it would become an i and a dot.
    plain = F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))
    return F.when(~contains_any(plain, ("not specified", "n/a", "various", "brief summary")), num)


def digits_value(text: Column) -> Column:
    """All digits and dots read as one number: the sign is lost."""
    return F.nullif(F.regexp_replace(text, "[^0-9.]", ""), F.lit("")).try_cast("double")


def table_rows(text: Column) -> Column:
    """array<array<string>> of the cells of a markdown table's lines, separator lines left out."""
    lines = F.filter(F.split(text, "\n"), lambda s: (F.length(s) - F.length(F.replace(s, F.lit("|"))) >= 3) & (F.regexp_replace(s, r"[|\-: ]", "") != ""))
    return F.transform(lines, lambda s: F.filter(F.transform(F.split(s, r"\|"), lambda c: F.trim(c)), lambda c: c != ""))


def metric_rows(text: Column) -> Column:
    """array<struct<metric, company1, company2, company3>> of a comparison table whose header names a metric column, two or three companies wide."""
    rows = F.filter(table_rows(text), lambda r: F.size(r) >= 3)
    head = F.array_position(F.transform(rows, lambda r: F.contains(F.lower(r[0]), F.lit("metric"))), F.lit(True))
    names = F.slice(F.get(rows, head.cast("int") - 1), 2, 100)
    stop = F.array_position(F.transform(names, lambda n: F.contains(F.lower(n), F.lit("comparison")) | F.lower(n).isin("difference", "notes")), F.lit(True))
    n = F.when(stop > 0, stop - 1).otherwise(F.size(names))
    body = F.when(head > 0, F.slice(rows, (head + 1).cast("int"), F.greatest(F.size(rows), F.lit(1))))
    skip = ("risk factors", "profit drivers", "profit/loss contributing factors", "")
    named = F.transform(body, lambda r: F.struct(F.trim(F.replace(r[0], F.lit("**"))).alias("metric"), F.get(r, F.lit(1)).alias("company1"), F.get(r, F.lit(2)).alias("company2"), F.when(n >= 3, F.get(r, F.lit(3))).alias("company3")))
    return F.filter(named, lambda x: ~F.lower(x["metric"]).isin(*skip) & (n >= 2) & ((n == 2) | x["company3"].isNotNull()))


def markdown_table(headers: Column, rows: Column) -> Column:
    """A markdown table; rows are cut or padded to the header's width."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    n = F.size(headers)
    fit = lambda r: F.slice(F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), n)), F.lit(1), n)
    return F.array_join(F.concat(F.array(line(headers), line(F.array_repeat(F.lit("---"), n))), F.transform(rows, lambda r: line(fit(r)))), "\n")


#: How option notes state a ratio, a sentiment, volumes at a strike, and the outlook.
RATIO_CLAIMS = (r"(?i)put[/\-]?call ratio[^\d]*(\d+\.\d+)", r"(?i)ratio\s+(?:slightly\s+)?(?:above|below|of|around|near)\s+(\d+\.\d+)")
STATED_SENTIMENT = r"(?i)(?:overall\s+)?sentiment\s+is\s+(bullish|bearish|neutral|strongly bullish|mildly bullish)"
SEEN_SENTIMENT = (("(?i)strongly bullish", "strongly bullish"), ("(?i)mildly bullish", "mildly bullish"), (r"(?i)\bbullish\b", "bullish"), (r"(?i)\bbearish\b", "bearish"), (r"(?i)\bneutral\b", "neutral"))
LEVEL_CLAIM = r"[^.]*?\$(\d+(?:\.\d+)?)"
VOLUME_CLAIM = r"(?i)\$(\d+(?:\.\d+)?)\s+(?:strike\s+)?(?:call|put)?[^.]*?(\d{1,3}(?:,\d{3})+)\s+contracts"
OUTLOOKS = (("(?i)consolidat|pinning|stuck|range.bound|small move", "consolidation"), ("(?i)breakout|big move|directional", "breakout"))
CLAIM_CONTEXT = 100


def _first_match(text: Column, patterns) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def _first_named(text: Column, names) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), name) for p, name in names])


def volume_claims(text: Column) -> Column:
    """array<struct<strike, volume, type>>: contracts traded at a strike; a put if one is named in the claim or the 100 characters before it, else a call."""
    all_of = lambda g: F.regexp_extract_all(text, F.lit(VOLUME_CLAIM), F.lit(g))
    whole, gaps = all_of(0), F.split(text, VOLUME_CLAIM, -1)
    length = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    # A note has a few claims; where the i-th begins: all gaps up to it and all claims before it.
    start = F.transform(whole, lambda m, i: length(gaps, i + 1) + length(whole, i))
    context = F.zip_with(whole, start, lambda m, at: F.lower(F.substring(text, F.greatest(at - CLAIM_CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CLAIM_CONTEXT)) + F.length(m))))
    kind = F.transform(context, lambda c: F.when(c.contains("put"), "put").otherwise("call"))
    parts = F.arrays_zip(all_of(1).alias("strike"), all_of(2).alias("volume"), kind.alias("type"))
    return F.transform(parts, lambda x: F.struct(x["strike"].cast("double").alias("strike"), F.replace(x["volume"], F.lit(",")).cast("long").alias("volume"), x["type"].alias("type")))


def claims(text: Column) -> Column:
    """struct of what an option note states: pc_ratio, sentiment (as stated, else as it shows), support and resistance levels, volumes, shape (the outlook)."""
    levels = lambda word: F.transform(F.regexp_extract_all(text, F.lit("(?i)" + word + LEVEL_CLAIM), F.lit(1)), lambda x: x.cast("double"))
    return F.struct(
        _first_match(text, RATIO_CLAIMS).cast("double").alias("pc_ratio"), F.coalesce(F.lower(_first_match(text, [STATED_SENTIMENT])), _first_named(text, SEEN_SENTIMENT)).alias("sentiment"),
        levels("support").alias("support"), levels("resistance").alias("resistance"), volume_claims(text).alias("volumes"), _first_named(text, OUTLOOKS).alias("shape"),
    )


def keyword_overlap(query: Column, text: Column) -> Column:
    """Whether any word of the query of over three letters is a substring of the text."""
    low = F.lower(text)
    return F.exists(F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) > 3) & F.contains(low, w))


def masked(secrets: Column) -> Column:
    """A map's values masked but for their last four characters."""
    return F.transform_values(secrets, lambda k, v: F.when(F.length(v) > 4, F.concat(F.lit("****"), F.right(v, F.lit(4)))).otherwise(F.lit("****")))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based identifier: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def first_field(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def filing_label(form: Column, period_end: Column, quarter: Column) -> Column:
    """FY2025 for annual, 2025Q3 for quarterly reports, else empty."""
    return F.when(period_end.isNull(), "").when(form == "10-K", F.concat(F.lit("FY"), F.year(period_end))).when((form == "10-Q") & quarter.isNotNull(), F.concat(F.year(period_end), F.lit("Q"), quarter)).otherwise("")


def accession_of_url(url: Column) -> Column:
    """The accession number of a filing's address, with dashes."""
    d = F.regexp_extract(url, r"(\d{18}|\d{10}-\d{2}-\d{6})", 1)
    return F.when(F.length(d) == 18, F.concat_ws("-", F.substring(d, 1, 10), F.substring(d, 11, 2), F.substring(d, 13, 6))).otherwise(F.nullif(d, F.lit("")))


def is_ticker(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Z]{1,5}$"), F.lit(False))


def image_ref(name: Column) -> Column:
    """struct(xref, page) of an image file name, (0, 1) where it has none."""
    get = lambda p, d: F.coalesce(F.regexp_extract(name, p, 1).try_cast("int"), F.lit(d))
    return F.struct(get(r"xref(\d+)", 0).alias("xref"), get(r"page(\d+)", 1).alias("page"))


def rescaled_probabilities(values: Column) -> Column:
    """Percentages scaled to a sum of 100 where they are off by more than 1; else as they are."""
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.when((total > 0) & (F.abs(total - 100) > 1), F.transform(values, lambda v: F.round(v * (100 / total), 0))).otherwise(values)


def in_order(bull: Column, base: Column, bear: Column) -> Column:
    return (bull >= base) & (base >= bear)


#: Search texts of comparisons, segment and geographic questions. {end} and {balance} name the year's end.
COMPARISON = (
    "{company} total revenues net revenues {end} consolidated statements of operations", "{company} net income loss {end} per share diluted basic", "{company} income from operations operating income {end}",
    "{company} earnings growth increased or decreased from {prior} to {year} compared to {prior} percentage change", "{company} research and development costs and expenses {end}",
    "{company} total assets {balance} consolidated balance sheets", "{company} long-term debt total liabilities {balance} balance sheets",
    "{company} results of operations factors affecting our performance key business drivers {year}", "{company} Item 1A risk factors risks and uncertainties that could affect our business {year}",
)
SEGMENT_SEARCHES = (
    "{company} reportable segments operating segments business segments segment overview segment structure segment description chief operating decision maker CODM {years}",
    "{company} segment revenue segment net sales segment results segment operating income segment profit segment EBITDA revenue by segment income by segment {years}",
    "{company} note segment reporting reportable segments note ASC 280 segment disclosure segment accounting policy segment measurement basis {years}",
    "{company} geographic segments product segments line of business disaggregation of revenue segment categories product line revenue {years}",
    "{company} segment assets segment capital expenditure segment depreciation segment amortization assets by segment capex by segment long lived assets by segment {years}",
    "{company} segment performance discussion MD&A segment results drivers of segment growth segment margins segment trends segment outlook {years}",
)
GEOGRAPHIC_SEARCHES = (
    "{company} revenue by geography revenue by region net sales by geography geographic revenue distribution disaggregated revenue region country revenue concentration {years}",
    "{company} geographic information note segment reporting geography ASC 280 geographic disclosure foreign domestic revenue by country long lived assets by geograph {years}",
    "{company} foreign operations international operations domestic vs international revenue foreign subsidiaries overseas operations global footprint {years}",
    "{company} properties by location facilities by geography manufacturing locations data centers offices distribution centers assets by country {years}",
    "{company} geographic risk country risk regional risk political risk currency risk foreign exchange exposure international regulatory risk sanctions export controls {years}",
    "{company} major customers by region customer concentration geography market concentration regional demand geographic market share {years}",
)


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        if "{" + name + "}" in template:
            out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def comparison_searches(company: Column, year: Column, fye_month: Column) -> Column:
    """The nine searches that compare a company's year; companies whose year ends in another month than December get no date."""
    y = year.cast("string")
    calendar = F.coalesce(fye_month, F.lit(12)) == 12
    end = F.when(calendar, F.concat(F.lit("year ended December 31 "), y)).otherwise(F.concat(F.lit("fiscal year "), y, F.lit(" annual period")))
    balance = F.when(calendar, F.concat(F.lit("as of December 31 "), y)).otherwise(F.concat(F.lit("as of fiscal year end "), y))
    return F.array(*[_filled(t, company=company, end=end, balance=balance, prior=(year - 1).cast("string"), year=y) for t in COMPARISON])


def disclosure_searches(company: Column, years: Column, kind: Column) -> Column:
    """The six searches of a segment or geographic question (kind) over the years asked for; none for other kinds."""
    suffix = F.concat(F.lit("for years "), F.array_join(years.cast("array<string>"), ", "))
    of = lambda templates: F.array(*[_filled(t, company=company, years=suffix) for t in templates])
    return F.when(kind == "segment", of(SEGMENT_SEARCHES)).when(kind == "geographic", of(GEOGRAPHIC_SEARCHES)).otherwise(F.array().cast("array<string>"))


#: Character references that plain conversion decodes, & last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Visible text of a fragment: scripts, styles, comments and tags removed, common references decoded, white space made one space."""
    s = html
    for p in (r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        s = F.regexp_replace(s, p, " ")
    for name, c in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(s, r"[ \t\n\r]+", " "))


def markdown_text(markdown: Column) -> Column:
    """Markdown without its marks: headings, emphasis, code, images and links' addresses."""
    s = F.regexp_replace(markdown, r"!\[[^\]]*\]\([^)]*\)", "")
    s = F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1")
    s = F.regexp_replace(s, r"(?m)^#{1,6} +", "")
    return F.trim(F.regexp_replace(s, r"[*_`]+", ""))


def sanitised_html(html: Column, allowed: tuple[str, ...] = ("p", "b", "i", "em", "strong", "ul", "ol", "li", "br", "h1", "h2", "h3", "table", "tr", "td", "th")) -> Column:
    """The fragment with scripts, styles and comments gone, tags outside the list removed and all attributes dropped."""
    s = html
    for p in (r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>", r"(?s)<!--.*?-->"):
        s = F.regexp_replace(s, p, "")
    s = F.regexp_replace(s, r"(?i)<(/?)(?!/?(?:" + "|".join(allowed) + r")\b)[^>]*>", "")
    return F.regexp_replace(s, r"<(/?[A-Za-z0-9]+)[^>]*>", "<$1>")
