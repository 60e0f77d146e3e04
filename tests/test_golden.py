"""Worked numbers and quirks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillfin.functions import periods as per
from quillfin.functions import text as tx
from quillfin.operators import insider as ins
from quillfin.operators import layout as lay
from quillfin.operators import macro as mac
from quillfin.operators import options as opt
from quillfin.operators import relational as rel
from quillfin.operators import research as res
from quillfin.operators import retrieval as ret
from quillfin.operators import timeseries as ts
from quillfin.sources import readers as rd
from quillfin.sources import sinks

CHAIN = "ticker string, option_type string, expiration date, strike double, lastPrice double, volume double, openInterest double, impliedVolatility double, inTheMoney boolean, row_id string"


def chain(spark, rows):
    return spark.createDataFrame([(*r, False, f"{i:04d}") for i, r in enumerate(rows)], CHAIN)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'date' if isinstance(v, dt.date) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


D = dt.date(2026, 6, 19)


@pytest.mark.parametrize(
    "kind,rows,want",
    [
        ("call", [(300.0, 9.50, 1138), (307.5, 3.30, 2030), (310.0, 1.98, 3123), (305.0, 4.96, 1113), (312.5, 1.11, 4249)], [(300.0, 1081100), (307.5, 669900), (310.0, 618354), (305.0, 552048), (312.5, 471639)]),
        ("put", [(310.0, 2.95, 4359), (307.5, 1.70, 2784), (300.0, 0.38, 6246), (305.0, 0.90, 2356), (302.5, 0.62, 940)], [(310.0, None), (307.5, None), (300.0, None), (305.0, None), (302.5, None)]),
    ],
)
def test_notional_ranks(spark, kind, rows, want):
    c = chain(spark, [("A", kind, D, s, p, float(v), 0.0, 0.3) for s, p, v in rows])
    got = opt.top_notional_strikes(c, spark.createDataFrame([("A", 305.0)], "ticker string, price double")).orderBy("rank").collect()
    assert [r["strike"] for r in got] == [s for s, _ in want]
    assert all(n is None or r["notional_usd"] == n for r, (_, n) in zip(got, want))


def test_expiration_selection(spark):
    days = [dt.date(2026, 5, d) for d in (26, 27, 29)] + [dt.date(2026, 6, 1), dt.date(2026, 6, 3), dt.date(2026, 8, 21), dt.date(2026, 9, 18), dt.date(2026, 10, 16), dt.date(2026, 11, 20)]
    c = chain(spark, [("A", "call", d, 1.0, 1.0, 1.0, 0.0, 0.1) for d in days])
    got = [r["expiration"] for r in opt.select_expirations(c, "2026-05-25").orderBy("expiration").collect()]
    assert got == [*days[:4], dt.date(2026, 9, 18), dt.date(2026, 10, 16)]
    past = opt.select_expirations(c, "2030-01-01").collect()
    assert [r["expiration"] for r in past] == [days[0]]


def test_summary_metrics(spark):
    c = chain(spark, [("A", "call", D, 100.0, 1.0, 367000.0, 28941.0, 0.642), ("A", "put", D, 100.0, 1.0, 145000.0, 0.0, 0.584), ("B", "put", D, 100.0, 1.0, 5.0, 0.0, 0.0)])
    r = {x["ticker"]: x for x in opt.option_summary(c, spark.createDataFrame([("A", 100.0)], "ticker string, price double"), "2026-05-25").collect()}
    assert (r["A"]["put_call_ratio"], r["A"]["sentiment"], r["A"]["iv_skew_pct"], r["A"]["atm_concentration_pct"]) == (0.3951, "BULLISH", -5.8, 100.0)
    assert (r["B"]["put_call_ratio"], r["B"]["sentiment"], r["B"]["iv_skew_pct"], r["B"]["atm_concentration_pct"]) == (None, "UNKNOWN", None, 0.0)


def test_chain_numbers_are_coerced(spark):
    raw = spark.createDataFrame([("x", "2.5", float("nan"), None, 0.1)], "strike string, lastPrice string, volume double, openInterest double, impliedVolatility double")
    r = opt.normalise_chain(raw).first()
    assert (r["strike"], r["lastPrice"], r["volume"], r["openInterest"], r["notional"]) == (0.0, 2.5, 0.0, 0.0, 0.0)


def test_max_pain_conventions(spark):
    c = chain(spark, [("A", "call", D, 90.0, 1.0, 0.0, 10.0, 0.1), ("A", "call", D, 110.0, 1.0, 0.0, 5.0, 0.1), ("A", "put", D, 100.0, 1.0, 0.0, 20.0, 0.1)])

    def brute(up, down):
        rows = [("call", 90, 10), ("call", 110, 5), ("put", 100, 20)]
        return min((sum(max(s - k, 0) * o for t, s, o in rows if t == up) + sum(max(k - s, 0) * o for t, s, o in rows if t == down), k) for k in (90, 100, 110))[1]

    assert opt.max_pain(c).first()["max_pain_strike"] == brute("call", "put")
    assert opt.max_pain(c, "market").first()["max_pain_strike"] == brute("put", "call")


def test_fiscal_calendar(spark):
    q = lambda d, fye: one(spark, per.fiscal_quarter(F.col("d"), F.col("f")), d=d, f=fye)
    assert q(dt.date(2025, 12, 27), 9) == 1
    assert [one(spark, per.quarter_end_month(F.col("f"), F.col("q")), f=9, q=i) for i in (1, 2, 3, 4)] == [12, 3, 6, 9]
    assert one(spark, per.quarter_span(F.col("f"), F.col("q")), f=9, q=1) == "October-December"
    y = lambda d, fye: one(spark, per.filed_fiscal_year(F.col("d"), F.col("f")), d=d, f=fye)
    assert (y(dt.date(2026, 5, 15), 12), y(dt.date(2025, 11, 15), 9), y(dt.date(2026, 2, 15), 9)) == (2025, 2024, 2025)


def test_file_names(spark):
    assert one(spark, tx.filing_type_of_file(F.col("n")), n="AAPL_10Q_2024.pdf") == "10-Q"
    assert one(spark, tx.year_of_file(F.col("n"), 2026), n="aapl-20250628.pdf") == 2025
    assert one(spark, tx.year_of_file(F.col("n"), 2026), n="deck") == 2026
    assert one(spark, tx.company_of_file(F.col("n")), n="Tesla Annual Report 2022.pdf") == "tesla"
    assert spark.createDataFrame([(["Apple ", "MICROSOFT", " "],)], "n array<string>").select(rel.normalise_names(F.col("n")).alias("x")).first()["x"] == ["apple", "microsoft"]


def test_rating_order_quirk(spark):
    got = [one(spark, tx.rating(F.col("t"))["rating"], t=t) for t in ("strong sell", "Conviction Sell", "Market Outperform", "avoid", "", None, "underperform")]
    assert got == ["sell", "sell", "strong_buy", "strong_sell", "hold", "hold", "sell"]


def test_trend_last_branch_is_unreachable(spark):
    rows = [(c, s) for c in range(-4, 5) for s in range(-4, 5)]
    d = spark.createDataFrame(rows, "c int, s int").select(res.trend(F.col("c"), F.col("s")).alias("t"))
    assert "significantly_more_negative" not in {r["t"] for r in d.collect()}


def test_substring_keywords(spark):
    d = spark.createDataFrame([(1, "Headwinds and a headwind")], "doc_id int, text string")
    assert res.keyword_counts(d, {"negative": ("headwinds", "headwind")}).first()["total"] == 3


def test_sign_is_lost_in_digits(spark):
    assert one(spark, tx.digits_value(F.col("t")), t="-12.5%") == 12.5
    assert one(spark, tx.numeric_value(F.col("t")), t="-52.69%") == -52.69
    assert one(spark, tx.numeric_value(F.col("t")), t="N/A") is None


def test_markdown_tables(spark):
    text = "| Metric | A | B | Comparison |\n|---|---|---|---|\n| **Revenue** | $1,000 | 32% | up |\n| Risk Factors | x | y | z |"
    rows = one(spark, tx.metric_rows(F.col("t")), t=text)
    assert [(r["metric"], r["company1"], r["company2"], r["company3"]) for r in rows] == [("Revenue", "$1,000", "32%", None)]
    c = res.comparison_chart(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [(r["metric"], r["v1"], r["v2"], r["v3"]) for r in c] == [("Revenue", 1000.0, 32.0, 0.0)]
    m = spark.createDataFrame([(["a", "b"], [["1"], ["2", "3", "4"]])], "h array<string>, r array<array<string>>").select(tx.markdown_table(F.col("h"), F.col("r")).alias("m")).first()["m"]
    assert m == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"


def test_cover_page(spark):
    c = one(spark, tx.cover_page(F.col("t")), t="FORM 10-Q\nFor the quarterly period ended June 28, 2025\n")
    assert (c["filing_type"], c["period_end_date"]) == ("10-Q", "2025-06-28")


def test_uuid5(spark):
    import uuid

    ns = uuid.NAMESPACE_DNS
    for name in ("a", "été", "3141"):
        assert one(spark, tx.uuid5(ns.hex, F.col("t")), t=name) == str(uuid.uuid5(ns, name))


def test_option_note_claims(spark):
    c = one(spark, tx.claims(F.col("t")), t="Put/call ratio of 0.54. Sentiment is bullish. Support at $300. Resistance at $312.50. $310 strike call with 3,123 contracts.")
    assert (c["pc_ratio"], c["sentiment"], c["support"], c["resistance"]) == (0.54, "bullish", [300.0], [312.5])
    assert [(v["strike"], v["volume"]) for v in c["volumes"]] == [(310.0, 3123)]


def test_probabilities(spark):
    d = spark.createDataFrame([([50.0, 30.0, 40.0],), ([25.0, 50.0, 25.0],)], "p array<double>").select(tx.rescaled_probabilities(F.col("p")).alias("x"))
    assert [r["x"] for r in d.collect()] == [[42.0, 25.0, 33.0], [25.0, 50.0, 25.0]]


def bars(spark, closes):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, t0 + dt.timedelta(days=i), c, c, c, c, 1) for k, cs in closes.items() for i, c in enumerate(cs)], "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume long")


def test_indicator_warm_up(spark):
    b = bars(spark, {"A": [float(i) for i in range(1, 40)], "B": [5.0] * 20, "C": [1.0]})
    sma = {(r["ticker"], r["ts"].day): r["sma_3"] for r in ts.sma(b, (3,)).filter("ts < '2024-01-10'").collect()}
    assert sma["A", 2] is None and sma["A", 3] == 2.0 and sma["C", 1] is None
    r = ts.rsi(b).orderBy("ticker", "ts").collect()
    a = [x["rsi"] for x in r if x["ticker"] == "A"]
    assert a[:14] == [None] * 14 and a[14] == 100.0
    assert all(x["rsi"] is None for x in r if x["ticker"] != "A")
    m = [x for x in ts.macd(b).orderBy("ts").collect() if x["ticker"] == "A"]
    assert m[24]["macd"] is None and m[25]["macd"] is not None and m[32]["macd_signal"] is None and m[33]["macd_signal"] is not None


def test_extrema_keep_ties_and_edges(spark):
    b = bars(spark, {"A": [1.0, 1.0, 2.0, 3.0, 2.0, 2.0]})
    got = {(r["kind"], r["ts"].day) for r in ts.local_extrema(b, order=1, last=9).collect()}
    assert {("support", 1), ("support", 2), ("resistance", 4), ("support", 6)} <= got


def test_limiter_ignores_rejected(spark):
    t0 = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, t0 + dt.timedelta(seconds=s), i) for i, s in enumerate((0, 10, 20, 61, 65))], "k long, ts timestamp_ntz, id long")
    got = [r["allowed"] for r in ts.sliding_limiter(e, "k", 60, 2).orderBy("id").collect()]
    assert got == [True, True, False, True, False]


def test_macro_edge_cases(spark):
    months = [dt.date(2024, m, 1) for m in range(1, 12)]  # the last quarter is incomplete
    s = spark.createDataFrame([("GDP", d, 100.0 + i) for i, d in enumerate(months)], "indicator string, date date, value double")
    cat = spark.createDataFrame([("GDP", "monthly", "Percent")], "indicator string, frequency string, unit string")
    ask = spark.createDataFrame([(1, "gdp", None, None, "QoQ", "quarterly"), (2, "GDP", "2024-01", "2024-05", "MoM", None), (3, "GDP", "Q4 2024", None, "QoQ", "quarterly"), (4, "NONE", None, None, "YoY", None), (5, "GDP", "x y z", None, "YoY", "monthly"), (6, "GDP", "2024-03", None, "YoY", None)], "spec_id int, indicator string, period1 string, period2 string, comparison_type string, granularity string")
    r = {x["spec_id"]: x for x in mac.macro_compare(s, cat, ask).collect()}
    assert (r[1]["period1"], r[1]["period2"], r[1]["absolute_change"]) == ("Q3 2024", "Q2 2024", 3.0)
    assert (r[2]["period1"], r[2]["period2"]) == ("May 2024", "January 2024")
    assert r[3]["period1"] == "Q3 2024" and "Q4 2024 is not available" in r[3]["info"]
    assert r[4]["error"] == "Unknown indicator: NONE" and r[5]["error"] == "Could not parse period"
    assert (r[6]["period1"], r[6]["period2"], r[6]["basis_points_change"]) == ("March 2024", "February 2024", 100.0)


TRADES = "accession long, document_type string, period_of_report date, issuer string, owner string, is_officer boolean, is_director boolean, is_ten_percent_owner boolean, transaction_date date, code string, acquired_disposed string, shares double, price double, seq int"


def test_owner_variants_and_roles(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, "4", d, "X", "HENNESSY JOHN L", True, False, False, d, "P", "A", 10.0, 2.0, 1), (2, "4", d, "X", "Hennessy John L.", False, True, True, d + dt.timedelta(1), "S", "D", 4.0, None, 2), (2, "4", d, "X", "Hennessy John L.", False, True, True, d + dt.timedelta(1), "S", "D", 4.0, None, 3)]
    x = ins.insider_dedup(spark.createDataFrame(rows, TRADES)).collect()
    assert len(x) == 2 and {(r["person"], r["role"]) for r in x} == {("Hennessy John L.", "Director, 10% Owner")}
    s = ins.signals(spark.createDataFrame(x)).orderBy("code").collect()
    assert [(r["bought"], r["sold"], r["signal"], r["role_weight"]) for r in s] == [(20.0, 0.0, 20.0, 1.2), (0.0, 0.0, 0.0, 1.2)]
    assert ins.insider_rollup(ins.signals(spark.createDataFrame(x))).first()["recommendation"] == "BUY"


def test_amendments(spark):
    d = dt.date(2024, 1, 1)
    row = lambda kind, shares, seq: (seq, kind, d, "X", "O", True, False, False, d, "P", "A", shares, 1.0, seq)
    t = spark.createDataFrame([row("4/A", 2.0, 1), row("4", 1.0, 2)], TRADES)
    assert [r["shares"] for r in ins.amended(t).collect()] == [2.0]
    assert sorted(r["shares"] for r in ins.amended(t, order="seq").collect()) == [1.0, 2.0]  # the amendment came first
    later = spark.createDataFrame([row("4", 1.0, 1), row("4/A", 2.0, 2), row("4/A", 3.0, 3)], TRADES)
    assert [r["shares"] for r in ins.amended(later, order="seq").collect()] == [3.0]


def test_common_stock_titles(spark):
    titles = {"Common Stock": True, "Class A Common Stock": True, "Series B Preferred": False, "Common Stock Warrant": False, "Ordinary Shares": True, "Capital Stock": True, "Units": False, "": False, None: False}
    d = spark.createDataFrame([(t,) for t in titles], "t string").select("t", ins.is_common_stock(F.col("t"), F.lit(False)).alias("ok"), ins.is_common_stock(F.col("t"), F.lit(True)).alias("derivative"))
    assert {r["t"]: r["ok"] for r in d.collect()} == titles and not any(r["derivative"] for r in d.collect())


def test_form4_dummy_row(spark):
    xml = "<ownershipDocument><issuer><issuerTradingSymbol>X</issuerTradingSymbol><issuerName>Xco</issuerName></issuer><periodOfReport>2024-01-02</periodOfReport><reportingOwner><reportingOwnerId><rptOwnerName>A</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>1</isOfficer></reportingOwnerRelationship></reportingOwner><reportingOwner><reportingOwnerId><rptOwnerName>B</rptOwnerName></reportingOwnerId></reportingOwner><derivativeTable><derivativeTransaction><securityTitle><value>Stock Option</value></securityTitle></derivativeTransaction></derivativeTable></ownershipDocument>"
    f = spark.createDataFrame([("a1", xml), ("a2", "no xml")], "accession string, xml string")
    t = rd.form4_transactions(f).collect()
    assert [(r["owner"], r["is_officer"], r["is_derivative"], r["shares"], r["document_type"]) for r in t] == [("A", True, True, 0.0, "4")]
    d = rd.ingest_form4(f, spark.createDataFrame([], "accession string")).collect()
    assert [(r["accession"], r["has_common_stock"], r["security_title"]) for r in d] == [("a1", False, None)]


def test_read_only_sql(spark):
    spark.range(300).createOrReplaceTempView("many")
    spark.range(5).write.mode("overwrite").saveAsTable("kept")
    assert sinks.read_only_sql(spark, "select * from many where id in (select id from many limit 250)").count() == 100
    assert sinks.read_only_sql(spark, "with t as (select 'insert into kept' as s) select s, count(*) over () as n from t union all values ('x', 2)").count() == 2
    for bad in (
        "drop view many", "create table x as select 1", "insert into kept select 1", "set a=b", "truncate table kept", "alter table kept rename to gone", "alter table kept add columns (z int)", "replace table kept as select 1", "delete from kept",
        "update kept set id = 1", "merge into kept using many on kept.id = many.id when matched then delete", "load data inpath '/x' into table kept", "cache table kept", "uncache table kept", "refresh table kept", "analyze table kept compute statistics",
        "with t as (select 1 as id) insert into kept select * from t", "from many insert into kept select id insert into kept select id", "create temporary view v as select 1", "create function f as 'x'", "add jar 'x'", "use default", "show tables", "describe kept",
        "msck repair table kept", "begin insert into kept select 1; end", "select transform(id) using 'cat' from many", "select reflect('java.lang.Runtime', 'getRuntime')", "select * from many where id = (select java_method('java.lang.System', 'exit', 1))", "explain select 1", "reset",
    ):
        with pytest.raises(PermissionError):
            sinks.read_only_sql(spark, bad)
    assert spark.table("kept").count() == 5 and spark.table("kept").columns == ["id"]
    spark.sql("drop table kept")


def test_sql_table_functions(spark):
    from quillfin.session import register_functions

    register_functions(spark)
    assert [tuple(r) for r in spark.sql("select * from table_cells('| a | b |\n|---|---|\n| 1 | 2 |') order by row, col").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2")]
    assert {(r["term"], r["hits"]) for r in spark.sql("select * from keyword_hits('Headwinds and a headwind') where category = 'negative'").collect()} == {("headwinds", 1), ("headwind", 2)}


def test_wide_statements_are_refused(spark, monkeypatch):
    monkeypatch.setattr(rd, "MOST_ITEMS", 3)
    wide = spark.createDataFrame([(f"item{i}", float(i)) for i in range(4)], "item string, d2024 double")
    with pytest.raises(ValueError):
        rd.statement(wide, "item")
    assert rd.statement(wide.limit(3), "item").count() == 1


def test_tickers_of_questions(spark):
    companies = spark.createDataFrame([(0, "meta", "meta"), (1, "msft", "microsoft"), (2, "brk.b", "berkshire (b)")], "ordinal int, ticker string, company string")
    asked = {1: "Give me a case for MSFT!", 2: "Is Microsoft stock good, or meta?", 3: "the metadata of a file", 4: "", 5: "1234 extraordinarily", 6: None, 7: "what of berkshire (b) now"}
    got = rel.ticker_in_text(spark.createDataFrame(list(asked.items()), "question_id int, question string"), companies).collect()
    assert {r["question_id"]: r["ticker"] for r in got} == {1: "MSFT", 2: "META", 3: "THE", 4: None, 5: None, 6: None, 7: "WHAT"}


def test_types_of_volume_claims(spark):
    c = one(spark, tx.volume_claims(F.col("t")), t="Heavy puts: the $95 strike saw 12,000 contracts. " + "x" * 120 + " Then $100 strike call reached 1,500 contracts; $105 put with 2,250 contracts")
    assert [(x["strike"], x["volume"], x["type"]) for x in c] == [(95.0, 12000, "put"), (100.0, 1500, "call"), (105.0, 2250, "put")]


def test_levels_see_the_display_range_alone(spark):
    closes = [5.0, 9.0, 1.0, 9.0] + [4.0 + (i % 7) / 10 for i in range(40)]
    r = ts.technical_summary(bars(spark, {"A": closes}), "2024-01-05").first()
    assert 1.0 not in r["support"] and 9.0 not in r["resistance"] and r["support"] and r["sma_200"] is None


def test_folds_stream_through_batches(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    b = bars(spark, {k: [float((i * 7) % 13 + 1) for i in range(90)] for k in ("A", "B")})
    try:
        whole = [tuple(r) for f in (ts.rsi, ts.macd) for r in f(b).orderBy("ticker", "ts").collect()]
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert [tuple(r) for f in (ts.rsi, ts.macd) for r in f(b).orderBy("ticker", "ts").collect()] == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "GDP.csv").write_text("date,value\n2024-01-01,1.5\n")
    assert rd.csv_series(spark, str(tmp_path), "GDP").collect()[0]["value"] == 1.5
    assert rd.csv_series(spark, str(tmp_path), "NONE").count() == 0
    assert rd.json_metadata(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(b"x")
    assert rd.files_under(spark, str(tmp_path)).count() == 1 and rd.expired(rd.files_under(spark, str(tmp_path)), "2200-01-01", 30).count() == 1
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "session_id int, turn int, role string, content string")
    sinks.export_text(m, str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["[user] hi", "[assistant] yo"]
    sinks.export_json(m, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    s = spark.createDataFrame([("GDP", "2024-01-01", 1.0)], "indicator string, date string, value double")
    sinks.write_series(s, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1


def test_lines_keep_the_first_x(spark):
    lines = spark.createDataFrame([(1, 10.0, 0.0, 50.0), (1, 12.0, 5.0, 60.0), (1, 14.0, 0.0, 9.0), (1, 30.0, 1.0, 2.0)], "page int, x double, y0 double, y1 double")
    assert sorted((r["x"], r["y0"], r["y1"]) for r in lay.merge_lines(lines).collect()) == [(10.0, 0.0, 60.0), (14.0, 0.0, 9.0), (30.0, 1.0, 2.0)]


def test_table_grid(spark):
    xs = spark.createDataFrame([(1, x) for x in (0.0, 100.0, 200.0)], "page int, x double")
    ys = spark.createDataFrame([(1, y) for y in (0.0, 20.0, 40.0, 60.0)], "page int, y double")
    words = spark.createDataFrame([(1, 10.0, 5.0, 15.0, "1", "Name"), (1, 110.0, 5.0, 15.0, "2", "Value"), (1, 10.0, 25.0, 35.0, "3", "a "), (1, 110.0, 25.0, 35.0, "4", "7")], "page int, x double, y0 double, y1 double, n string, text string")
    assert [r["cells"] for r in lay.table_grid(xs, ys, words).orderBy("row").collect()] == [["Name", "Value"], ["a", "7"]]


def test_retrieval_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "doc_id int, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, query array<double>")
    assert [(r["doc_id"], r["rank"]) for r in ret.knn(v, q, 5).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 8, 1)], "query_id int, doc_id int, rank int")
    assert [r["doc_id"] for r in ret.rrf([a, b]).orderBy("rank").collect()] == [8, 7]
    docs = spark.createDataFrame([(1, "Élan vital"), (2, "elan")], "doc_id int, text string")
    assert [r["doc_id"] for r in ret.bm25(docs, spark.createDataFrame([(1, "élan")], "query_id int, query string"), 5).collect()] == [1]


def test_a_search_without_hits_leaves_the_others(spark):
    docs = spark.createDataFrame([(1, "acme risk factors"), (2, "other words")], "doc_id int, text string")
    plan = (("a", "{ticker} risk", 2, 1), ("b", "nothing {year1}", 3, None), ("c", "words of {next}", 1, None))
    got = ret.run_plan(docs, ret.plan_searches(spark.createDataFrame([("acme", 2024)], "ticker string, year int"), plan), chars=4).collect()
    assert {(r["bucket"], r["doc_id"], r["rank"], r["n"], r["content"]) for r in got} == {("a", 1, 1, 1, "acme"), ("c", 2, 1, 1, "othe")}


def test_stream_amendments(spark, tmp_path):
    from quillfin.streaming.versioned import BucketedTable, amending

    d = dt.date(2024, 1, 1)
    row = lambda kind, shares, seq, owner="O": (seq, kind, d, "X", owner, True, False, False, d, "P", "A", shares, 1.0, seq)
    keys = ("issuer", "owner", "period_of_report")
    table = BucketedTable(spark, str(tmp_path), list(keys), 4)
    apply = table.merging("filings", amending(keys, "seq"))
    for batch, rows in enumerate(([row("4", 1.0, 1), row("4", 7.0, 1, "P")], [row("4/A", 2.0, 1)], [row("4", 3.0, 1)])):
        apply(spark.createDataFrame(rows, TRADES), batch)
        apply(spark.createDataFrame(rows, TRADES), batch)
    assert sorted((r["owner"], r["shares"]) for r in table.read().collect()) == [("O", 2.0), ("O", 3.0), ("P", 7.0)]


def test_refresh_takes_in_new_files_and_resumes(spark, tmp_path):
    from quillfin.streaming import streams as st

    def arrive(n):
        t = dt.datetime(2024, 1, 1, n)
        spark.createDataFrame([(n, t, 1, "click", 1.0, "{}")], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    seen = []
    for n in range(3):
        arrive(n)
        q = st.refresh(st.event_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", "append", "1 second")
        q.processAllAvailable()
        q.stop()
        seen.append(sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert seen == [[0], [0, 1], [0, 1, 2]]


def test_filings_come_latest_first(spark):
    import json

    recent = {"form": ["10-K", "10-Q", "S-1", "8-K"], "filingDate": ["2023-01-05", "2024-02-01", "2024-03-01", "2023-06-01"], "reportDate": ["", "2023-12-31", "", ""], "accessionNumber": list("abcd"), "primaryDocument": list("wxyz")}
    d = rd.submissions(spark.createDataFrame([(7, json.dumps({"filings": {"recent": recent}}))], "cik long, json string"))
    assert [r["accession"] for r in d.collect()] == ["b", "d", "a"]


def test_html_and_markdown(spark):
    assert one(spark, tx.markdown_text(F.col("t")), t="# Head\n**bold** [link](http://x) ![i](y) `c`") == "Head\nbold link  c"
    assert one(spark, tx.sanitised_html(F.col("t")), t='<div><p class="a">x<script>1</script><a href="y">z</a></p></div>') == "<p>xz</p>"
    assert one(spark, tx.html_text(F.col("t")), t="<p>a &amp;lt; b</p><style>x</style>") == "a &lt; b"


def test_sentiment_with_negations_and_degrees(spark):
    from quillfin.operators import research as rs

    texts = ["A good year", "not a good year", "not in any way a good year", "very good", "not very good", "extremely excellent", "good. weak", "nothing here", "", None, "very not good", "never"]
    got = {r["doc_id"]: (r["polarity"], r["sentiment"]) for r in rs.sentiment(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    want = [0.6, -0.3, 0.6, 0.78, -0.39, 1.0, 0.0, 0.0, 0.0, 0.0, -0.3, 0.0]
    assert [got[i][0] for i in range(len(texts))] == want and got[0][1] == "bullish" and got[4][1] == "bearish"
    plan = rs.sentiment(spark.createDataFrame([(1, "x")], "doc_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Exchange" not in plan


def test_read_only_sql_keeps_to_the_catalogue(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/secret")
    spark.range(3).write.mode("overwrite").saveAsTable("open_table")
    assert sinks.read_only_sql(spark, "SELECT * FROM default.open_table").count() == 3 and sinks.read_only_sql(spark, "SELECT * FROM spark_catalog.default.open_table").count() == 3
    for bad in (f"SELECT * FROM parquet.`{tmp_path}/secret`", f"SELECT * FROM open_table WHERE id IN (SELECT id FROM parquet.`file://{tmp_path}/secret`)", f"WITH t AS (SELECT * FROM text.`{tmp_path}/secret`) SELECT * FROM t"):
        with pytest.raises(PermissionError):
            sinks.read_only_sql(spark, bad)
    spark.sql("DROP TABLE open_table")


def test_numeric_claims_beside_letters_of_other_scripts(spark):
    """Word edges, white space and capitals as RE2 and DuckDB have them."""
    claims = {"é5%": True, "٣7%": True, "5 millionär": True, "a5%": False, "5 millions": False, "$\x0b5": False, "9\x0b%": False, "$\t5": True, "3 MILLION": True}
    for text, want in claims.items():
        assert one(spark, tx.has_numeric_claim(F.col("t")), t=text) is want, text
    assert one(spark, tx.numeric_value(F.col("t")), t="4 not specİfied") is None


def test_image_context_keeps_no_list_of_a_page(spark):
    """Of a page of 3,000 blocks a few of each kind reach the lists; images without blocks or page have no context."""
    blocks = spark.range(3000).select(F.lit(1).alias("page"), F.format_string("%05d", F.col("id")).alias("n"), (F.col("id") % 600).cast("double").alias("y0"), ((F.col("id") % 600) + 10).cast("double").alias("y1"), F.format_string("Block number %d", F.col("id")).alias("text"))
    images = spark.createDataFrame([(1, 1, 300.0, 400.0), (2, 1, 300.0, 400.0), (None, 1, 0.0, 1.0)], "page int, image_id int, y0 double, y1 double")
    df = lay.image_context(images, blocks)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    got = {r["page"]: r["context"] for r in df.collect()}
    names = [f"Block number {i}" for i in (294, 894, 345, 945, 1545, 2145, 2745, 344)]
    assert got == {1: " ".join(names), 2: "", None: ""}


def test_persons_are_summed_up_where_their_rows_are(spark):
    """Rows are dealt out once, by issuer and merged owner: neither persons, their totals nor distinct rows are shuffled again."""
    import re

    day = dt.date(2024, 1, 2)
    rows = [("a", "4", day, "I", o, True, False, False, day, "P", "A", 10.0, 2.0, 1) for o in ("Ann  Lee", "ANN LEE.", "Bob")]
    trades = spark.createDataFrame(rows + rows[:1], "accession string, document_type string, period_of_report date, issuer string, owner string, is_officer boolean, is_director boolean, is_ten_percent_owner boolean, transaction_date date, code string, acquired_disposed string, shares double, price double, seq int")
    df = ins.insider_by_person(ins.signals(ins.insider_dedup(trades, keyed=True)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", plan))) == {"issuer, owner_key"}
    assert sorted((r["person"], r["p_value"], r["p_shares"]) for r in df.collect()) == [("Ann  Lee", 40.0, 20), ("Bob", 20.0, 10)]


def test_keyword_counts_lower_a_text_once(spark):
    docs = spark.createDataFrame([(1, "Headwinds and HEADWIND; growth"), (2, None), (3, "")], "doc_id int, text string")
    df = res.keyword_counts(docs, {"negative": ("headwinds", "headwind"), "positive": ("growth",)})
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert {(r["doc_id"], r["category"], r["total"]) for r in df.collect()} == {(1, "negative", 3), (1, "positive", 1), (2, "negative", None), (2, "positive", None), (3, "negative", 0), (3, "positive", 0)}
