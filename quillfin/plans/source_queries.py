"""Readers and page layout, fed with payloads made from the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfin.adapters import bars, chain, insider_trades, load, macro_series, row_text, with_inputs
from quillfin.operators import insider as ins
from quillfin.operators import layout as lay
from quillfin.plans.registry import query
from quillfin.session import scratch
from quillfin.sources import readers as rd
from quillfin.sources import sinks


@query("src_observations", with_inputs("macro", "SELECT indicator, date::VARCHAR AS date, value FROM macro WHERE month(date) <> 6 AND date >= DATE '1998-08-01' - INTERVAL 60 MONTH"))
def observations(spark, sf_dir):
    m = macro_series(spark, sf_dir)
    value = F.when(F.month("date") == 6, ".").otherwise(F.format_string("%.2f", "value"))
    p = m.groupBy("indicator").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), value.alias("value"))).alias("observations"))).alias("json"))
    return rd.observations(p.withColumn("frequency", F.lit("monthly")), "1998-08-01")


@query("src_price_range", with_inputs("bars", "SELECT ts::VARCHAR AS ts, open, high, low, close, volume FROM bars WHERE ticker = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'"))
def price_range(spark, sf_dir):
    return rd.price_history(bars(spark, sf_dir), "CLICK", "2024-01-05", "2024-01-12").drop("ticker")


@query("src_option_chain", with_inputs("chain", "SELECT strike, lastPrice, volume, row_id FROM chain WHERE ticker = 'Brand#3' AND expiration = DATE '1996-12-31' AND option_type = 'call'"))
def option_chain(spark, sf_dir):
    return rd.option_chain(chain(spark, sf_dir), "brand#3", "1996-12-31", "calls").select("strike", "lastPrice", "volume", row_text().alias("row_id"))


@query("src_statement_transpose", "WITH w AS (SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (year(o_orderdate) = 1995) AS DOUBLE) AS a, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (year(o_orderdate) = 1996) AS DOUBLE) AS b FROM orders GROUP BY 1) SELECT '1995' AS date, max(a) FILTER (o_orderstatus = 'F') AS \"F\", max(a) FILTER (o_orderstatus = 'O') AS \"O\", max(a) FILTER (o_orderstatus = 'P') AS \"P\" FROM w UNION ALL SELECT '1996', max(b) FILTER (o_orderstatus = 'F'), max(b) FILTER (o_orderstatus = 'O'), max(b) FILTER (o_orderstatus = 'P') FROM w")
def statement_transpose(spark, sf_dir):
    from quillfin.adapters import exact_sum

    o = load(spark, sf_dir, "orders")
    y = lambda n: exact_sum(F.when(F.year("o_orderdate") == n, F.col("o_totalprice"))).alias(str(n))
    return rd.statement(o.groupBy("o_orderstatus").agg(y(1995), y(1996)), "o_orderstatus")


@query("src_news_stories", "SELECT 'T' || page_id AS title, 'S' AS summary, '2024' AS published, url FROM pages WHERE page_id % 3 <> 0")
def news_stories(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "VIDEO").otherwise("STORY")
    c = F.struct(kind.alias("contentType"), F.concat(F.lit("T"), "page_id").alias("title"), F.lit("S").alias("summary"), F.lit("2024").alias("pubDate"), F.struct("url").alias("canonicalUrl"))
    return rd.news(p.select(F.to_json(F.struct(c.alias("content"))).alias("json")))


@query("src_submissions", "SELECT o_custkey AS cik, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' END AS form, CAST(o_orderdate AS DATE)::VARCHAR AS filing_date, o_orderkey::VARCHAR AS accession FROM orders WHERE o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def submissions(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    row = F.struct(F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("S-1").alias("form"), day.alias("day"), F.col("o_orderkey").cast("string").alias("acc"))
    g = o.groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(row).alias("r"))
    pick = lambda f: F.transform("r", lambda x: x[f])
    recent = F.struct(pick("form").alias("form"), pick("day").alias("filingDate"), pick("day").alias("reportDate"), pick("acc").alias("accessionNumber"), pick("acc").alias("primaryDocument"))
    p = g.select("cik", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return rd.submissions(p, start="1995-01-01", end="1996-12-31").select("cik", "form", "filing_date", "accession")


@query("src_filing_history", "SELECT o_custkey % 20 AS cik, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' END AS form, CAST(o_orderdate AS DATE)::VARCHAR AS filing_date, o_orderkey::VARCHAR AS accession FROM orders WHERE o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-06-01' AND DATE '1998-03-31'")
def filing_history(spark, sf_dir):
    """Orders as filing lists of twenty companies: those since 1997 in the list itself, older ones in a page for each year."""
    o = load(spark, sf_dir, "orders").withColumn("cik", F.col("o_custkey") % 20).withColumn("y", F.year("o_orderdate"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    row = F.struct(F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("S-1").alias("form"), day.alias("day"), F.col("o_orderkey").cast("string").alias("acc"))
    pick = lambda f: F.transform("r", lambda x: x[f])
    block = F.struct(pick("form").alias("form"), pick("day").alias("filingDate"), pick("day").alias("reportDate"), pick("acc").alias("accessionNumber"), pick("acc").alias("primaryDocument"))
    name = F.format_string("CIK%010d-submissions-%d.json", F.col("cik").cast("long"), F.col("y"))
    pages = o.filter("y < 1997").groupBy("cik", "y").agg(F.collect_list(row).alias("r"), F.min(day).alias("a"), F.max(day).alias("b")).withColumn("name", name)
    at = scratch(spark, "history")
    pages.select("name", F.to_json(block).alias("value")).write.partitionBy("name").text(at)
    files = pages.groupBy("cik").agg(F.collect_list(F.struct("name", F.col("a").alias("filingFrom"), F.col("b").alias("filingTo"))).alias("files"))
    lists = o.filter("y >= 1997").groupBy("cik").agg(F.collect_list(row).alias("r")).join(files, "cik", "full").withColumn("r", F.coalesce("r", F.array().cast("array<struct<form:string,day:string,acc:string>>")))
    payloads = lists.select("cik", F.to_json(F.struct(F.struct(block.alias("recent"), "files").alias("filings"))).alias("json"))
    return rd.filing_history(payloads, at, start="1995-06-01", end="1998-03-31", pattern="{folder}/name={name}").select("cik", "form", "filing_date", "accession")


def _number(accession):
    return F.element_at(F.split(accession, ":"), 1).cast("long")


def _xml(spark, sf_dir):
    t = insider_trades(spark, sf_dir)
    el = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    val = lambda name, c: el(name, el("value", c))
    title = F.when(F.col("seq") % 3 == 0, "Preferred Stock").otherwise("Common Stock")
    amounts = el("transactionAmounts", F.concat(val("transactionShares", F.col("shares").cast("string")), val("transactionPricePerShare", F.format_string("%.2f", "price")), val("transactionAcquiredDisposedCode", F.col("acquired_disposed"))))
    txn = el("nonDerivativeTransaction", F.concat(val("securityTitle", title), val("transactionDate", F.col("transaction_date").cast("string")), el("transactionCoding", el("transactionCode", F.col("code"))), amounts))
    keys = ["accession", "issuer", "owner", "period_of_report"]
    g = t.groupBy(*keys).agg(F.concat_ws("", F.collect_list(txn)).alias("x"), F.when(F.max(F.col("document_type") == "4/A"), "4/A").otherwise("4").alias("kind"))
    owner = el("reportingOwner", F.concat(el("reportingOwnerId", el("rptOwnerName", F.col("owner"))), F.lit("<reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>0</isOfficer></reportingOwnerRelationship>")))
    doc = F.concat(el("issuer", F.concat(el("issuerTradingSymbol", F.col("issuer")), el("issuerName", F.col("issuer")))), el("documentType", F.col("kind")), el("periodOfReport", F.col("period_of_report").cast("string")), owner, el("nonDerivativeTable", F.col("x")))
    return g.select(F.concat_ws(":", "accession", "issuer").alias("accession"), el("ownershipDocument", doc).alias("xml"))


@query("src_form4_xml", with_inputs("form4", "SELECT accession, issuer, owner, period_of_report::VARCHAR AS period_of_report, TRUE AS is_director, FALSE AS is_officer, transaction_date::VARCHAR AS transaction_date, code, acquired_disposed, shares, price FROM form4"))
def form4_xml(spark, sf_dir):
    return rd.form4_transactions(_xml(spark, sf_dir)).withColumn("accession", _number("accession")).select("accession", "issuer", "owner", "period_of_report", "is_director", "is_officer", "transaction_date", "code", "acquired_disposed", "shares", "price")


@query("ins_ingest_pipeline", with_inputs("form4", """
, t AS (SELECT *, seq % 3 <> 0 AS common, max((document_type = '4/A')::INT) OVER (PARTITION BY accession, issuer, owner, period_of_report) AS amends FROM form4 WHERE accession % 2 = 1),
s AS (SELECT * FROM t QUALIFY amends = 1 OR max(amends) OVER (PARTITION BY issuer, owner, period_of_report) = 0), f AS (SELECT accession, issuer, CASE WHEN amends = 1 THEN '4/A' ELSE '4' END AS document_type, common, shares, price FROM s)
SELECT accession, issuer, document_type, TRUE AS has_common_stock, shares, price, shares * price AS transaction_value FROM f WHERE common
UNION ALL SELECT accession, issuer, document_type, FALSE, NULL, NULL, NULL FROM f GROUP BY 1, 2, 3 HAVING count(*) FILTER (common) = 0"""))
def ingest_pipeline(spark, sf_dir):
    """Filings of even accession are stored already; one with line 7 is an amendment; every third line is no common stock."""
    filings = _xml(spark, sf_dir)
    r = rd.ingest_form4(filings, filings.filter(_number("accession") % 2 == 0))
    return r.select(_number("accession").alias("accession"), "issuer", "document_type", "has_common_stock", "shares", "price", "transaction_value")


@query("flt_common_stock", "SELECT p_partkey, contains(lower(p_name), 'a') AND NOT contains(lower(p_type), 'note') AND contains(lower(p_type || ' common'), 'common') AND NOT regexp_matches(lower(p_type), 'preferred|warrant|option|convertible|debenture') AS ok FROM part")
def common_stock(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", ins.is_common_stock(F.concat("p_type", F.lit(" common")), ~F.lower("p_name").contains("a")).alias("ok"))


@query("src_cik_lookup", "SELECT n_name AS ticker, CASE WHEN n_nationkey < 20 THEN lpad(n_nationkey::VARCHAR, 10, '0') END AS cik FROM nation")
def cik_lookup(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    return rd.with_cik(n.select(F.col("n_name").alias("ticker")), n.filter("n_nationkey < 20").select(F.lower("n_name").alias("ticker"), F.col("n_nationkey").alias("cik")))


@query("src_read_only_sql", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 LIMIT 100")
def read_only_sql(spark, sf_dir):
    for t in ("nation", "region"):
        load(spark, sf_dir, t).createOrReplaceTempView(f"quillfin_{t}")
    return sinks.read_only_sql(spark, "WITH j AS (SELECT * FROM quillfin_nation JOIN quillfin_region ON n_regionkey = r_regionkey) SELECT r_name, count(*) AS n FROM j GROUP BY r_name")


@query("src_table_schema", "SELECT CAST(0 AS INTEGER) AS place, 'r_regionkey' AS column, 'int' AS type UNION ALL SELECT 1, 'r_name', 'string'")
def table_schema(spark, sf_dir):
    return sinks.table_schema(load(spark, sf_dir, "region"))


_KEYS = (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"))


@query("src_described", """WITH k(t, c, r, rc) AS (VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey')), d AS (SELECT 'region' AS t, 0 AS place, 'r_regionkey' AS c, 'int' AS type, (SELECT count(DISTINCT r_regionkey) FROM region) AS n UNION ALL SELECT 'region', 1, 'r_name', 'string', (SELECT count(r_name) FROM region)
UNION ALL SELECT 'nation', 0, 'n_nationkey', 'int', 5 UNION ALL SELECT 'nation', 1, 'n_name', 'string', 5 UNION ALL SELECT 'nation', 2, 'n_regionkey', 'int', 5) SELECT d.t AS "table", d.c AS "column", CAST(place AS INTEGER) AS place, type, CAST(n AS INTEGER) AS sampled, r AS refers_to, rc AS refers_column FROM d LEFT JOIN k ON k.t = d.t AND k.c = d.c""")
def described(spark, sf_dir):
    keys = spark.createDataFrame(list(_KEYS), "table string, column string, refers_to string, refers_column string")
    d = sinks.described({t: load(spark, sf_dir, t) for t in ("region", "nation")}, keys)
    return d.withColumn("sampled", F.json_array_length("sample")).drop("sample")


def _words(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 50).alias("page"), (F.col("l_quantity") * 10).alias("x"), F.floor(F.col("l_extendedprice") % 700).cast("double").alias("y0"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("n"), F.concat(F.lit("w"), "l_partkey").alias("text")).withColumn("y1", F.col("y0") + 10)


@query("lay_text_in_rects", "WITH w AS (SELECT l_orderkey % 50 AS page, l_quantity * 10 AS x, floor(l_extendedprice % 700) + 5 AS mid, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n, 'w' || l_partkey AS t FROM lineitem), r AS (SELECT p AS page, c AS rect_id, c * 100.0 AS x0, c * 100.0 + 60 AS x1, 100 AS y0, 160 AS y1 FROM range(0, 50) a(p), range(0, 5) b(c)) SELECT CAST(r.page AS BIGINT) AS page, CAST(rect_id AS INTEGER) AS rect_id, coalesce(string_agg(t, chr(10) ORDER BY n, t), '') AS text FROM r LEFT JOIN w ON w.page = r.page AND x BETWEEN x0 AND x1 AND mid BETWEEN y0 AND y1 GROUP BY 1, 2")
def text_in_rects(spark, sf_dir):
    r = spark.range(50).select(F.col("id").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rect_id"))
    r = r.select("page", "rect_id", (F.col("rect_id") * 100.0).alias("rx0"), F.lit(100).alias("ry0"), (F.col("rect_id") * 100.0 + 60).alias("rx1"), F.lit(160).alias("ry1"))
    return lay.text_in_rects(_words(spark, sf_dir), r)


_W = "w AS (SELECT l_orderkey % 50 AS page, l_quantity * 10 AS x, floor(l_extendedprice % 700)::DOUBLE AS y0, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n, 'w' || l_partkey AS t FROM lineitem)"


@query("lay_merge_lines", f"""WITH RECURSIVE {_W}, b AS MATERIALIZED (SELECT page, x + y0 % 7 AS x, y0, y0 + 10 AS y1, row_number() OVER (PARTITION BY page ORDER BY x + y0 % 7, y0) AS i FROM w),
e AS (SELECT page, i, x AS k, 1 AS g FROM b WHERE i = 1 UNION ALL SELECT b.page, b.i, CASE WHEN b.x - k >= 3 THEN b.x ELSE k END, CASE WHEN b.x - k >= 3 THEN g + 1 ELSE g END FROM e JOIN b ON b.page = e.page AND b.i = e.i + 1)
SELECT page, min(k) AS x, min(y0) AS y0, max(y1) AS y1 FROM b JOIN e USING (page, i) GROUP BY page, g""")
def merge_lines(spark, sf_dir):
    return lay.merge_lines(_words(spark, sf_dir).select("page", (F.col("x") + F.col("y0") % 7).alias("x"), "y0", "y1"))


@query("lay_table_grid", f"""WITH {_W}, cells AS (SELECT p AS page, r, c, c * 100.0 - 1 AS x0, c * 100.0 + 101 AS x1, r * 40.0 - 1 AS y0, r * 40.0 + 41 AS y1 FROM range(0, 50) a(p), range(0, 4) b(r), range(0, 3) d(c)),
t AS (SELECT cells.page, r, c, coalesce(string_agg(t, chr(10) ORDER BY n, t), '') AS t FROM cells LEFT JOIN w ON w.page = cells.page AND x BETWEEN x0 AND x1 AND w.y0 + 5 BETWEEN cells.y0 AND cells.y1 GROUP BY 1, 2, 3)
SELECT CAST(page AS BIGINT) AS page, CAST(r + 1 AS INTEGER) AS row, string_agg(t, '|' ORDER BY c) AS cells FROM t GROUP BY 1, 2 HAVING max(length(t)) > 0""")
def table_grid(spark, sf_dir):
    p = spark.range(50).withColumnRenamed("id", "page")
    xs = p.select("page", F.explode(F.array(*[F.lit(float(x)) for x in (0, 100, 200, 300)])).alias("x"))
    ys = p.select("page", F.explode(F.array(*[F.lit(float(y)) for y in range(0, 200, 40)])).alias("y"))
    return lay.table_grid(xs, ys, _words(spark, sf_dir)).select("page", "row", F.array_join("cells", "|").alias("cells"))


@query("lay_image_context", f"""WITH {_W}, b AS (SELECT page, n, y0 + 5 AS c, 'Block ' || t AS t, abs(350 - (y0 + 5)) AS d FROM w),
g AS (SELECT page, list(t ORDER BY d, n, t) FILTER (c < 300 AND d < 150)[1:2] AS h, list(t ORDER BY d, n, t) FILTER (d <= 400)[1:6] AS m, list(t ORDER BY n, t)[1:10] AS a FROM b GROUP BY 1),
p AS (SELECT page, list_concat(coalesce(h, []), list_filter(coalesce(m, []), lambda x: length(x) > 10)) AS l, list_filter(a, lambda x: length(x) > 20)[1:3] AS rest FROM g),
s AS (SELECT p.page, array_to_string(CASE WHEN len(l) > 0 THEN list_filter(l, lambda x, i: list_position(l, x) = i) ELSE rest END, ' ') AS s FROM p)
SELECT CAST(i AS BIGINT) AS page, CAST(1 AS INTEGER) AS image_id, coalesce(CASE WHEN length(s) > 1000 THEN array_to_string(string_split(s, ' ')[1:150], ' ') ELSE s END, '') AS context FROM range(0, 50) r(i) LEFT JOIN s ON page = i""")
def image_context(spark, sf_dir):
    i = spark.range(50).select(F.col("id").alias("page"), F.lit(1).alias("image_id"), F.lit(300.0).alias("y0"), F.lit(400.0).alias("y1"))
    return lay.image_context(i, _words(spark, sf_dir).select("page", "n", "y0", "y1", F.concat(F.lit("Block "), "text").alias("text")))


@query("lay_image_size", "WITH s AS (SELECT p_partkey, p_size * 45 AS w, CAST(floor(p_retailprice) AS INTEGER) * 3 AS h FROM part), k AS (SELECT *, CASE WHEN least(w, h) < 512 THEN 512 / least(w, h)::DOUBLE WHEN greatest(w, h) > 2048 THEN 2048 / greatest(w, h)::DOUBLE ELSE 1.0 END AS k FROM s) SELECT p_partkey, CASE WHEN least(w, h) >= 50 THEN CAST(floor(w * k) AS INTEGER) END AS width, CASE WHEN least(w, h) >= 50 THEN CAST(floor(h * k) AS INTEGER) END AS height FROM k")
def image_size(spark, sf_dir):
    s = lay.image_size(F.col("p_size") * 45, F.floor("p_retailprice").cast("int") * 3)
    return load(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.width", "s.height")
