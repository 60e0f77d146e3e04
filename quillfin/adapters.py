"""Inputs of the operators, read from the star-schema tables: bars, option chains, macro series, insider trades, chunks, chats, reports, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfin.functions.numbers import rnd


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(c: str | Column, scale: int = 2) -> Column:
    """Sum of a double that holds decimals of that scale, in whatever order rows come. Whole units are added up; making a decimal of each double would parse its digits."""
    c = F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double"))
    units = F.floor(c * 10**scale + 0.5).cast("decimal(18,0)")
    return F.sum(units).cast("double") / 10**scale


def bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """ticker, ts, open, high, low, close, volume: events by type and hour."""
    e = load(spark, sf_dir, "events")
    return (
        e.groupBy(F.col("event_type").alias("ticker"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts"))
        .agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).alias("volume"))
    )


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contract traded: ticker, option_type, expiration, strike, lastPrice, volume, openInterest, impliedVolatility, inTheMoney, row_id."""
    li, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    # Numbers side by side, ordered as the text of `row_text` is, and shuffled in a third of its size.
    row_id = F.struct(*[F.col(c).cast("long").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_shipdate").cast("date").alias("l_shipdate"), F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("cents"))
    return li.join(part.select("p_partkey", "p_brand", "p_retailprice"), li.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("ticker"),
        F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("option_type"),
        F.last_day(F.col("l_shipdate").cast("date")).alias("expiration"),
        F.col("p_retailprice").alias("strike"),
        rnd(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("lastPrice"),
        F.col("l_quantity").alias("volume"),
        F.lit(0.0).alias("openInterest"),
        F.col("l_discount").alias("impliedVolatility"),
        F.lit(False).alias("inTheMoney"),
        row_id.alias("row_id"),
    )


def row_text(c: str = "row_id") -> Column:
    """A contract's row_id as text."""
    r, padded = F.col(c), lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat_ws("-", padded(r["l_orderkey"], 12), r["l_linenumber"], padded(r["l_partkey"], 12), padded(r["l_suppkey"], 12), F.date_format(r["l_shipdate"], "yyyy-MM-dd"), padded(r["cents"], 14))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, price: the mean list price of a brand's parts."""
    return load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker")).agg(rnd(exact_sum("p_retailprice") / F.count(F.lit(1)), 2).alias("price"))


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """indicator, date, value: mean order value of each priority and month."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("indicator"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date")).agg(rnd(exact_sum("o_totalprice") / F.count(F.lit(1)), 2).alias("value"))


def insider_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows like a transaction filing's, with seq, their order of arrival."""
    li, o, c, s = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    # Orders get their customers first: line items are then dealt out by order once, and not again by customer.
    named = o.join(c.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    j = li.join(named, F.col("l_orderkey") == F.col("o_orderkey")).join(s.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    price = rnd(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    return j.select(
        F.col("o_orderkey").alias("accession"),
        F.when(F.col("l_linenumber") == 7, "4/A").otherwise("4").alias("document_type"),
        F.col("o_orderdate").cast("date").alias("period_of_report"),
        F.col("s_name").alias("issuer"),
        F.col("c_name").alias("owner"),
        (F.col("o_orderstatus") == "F").alias("is_officer"),
        (F.col("o_orderstatus") == "O").alias("is_director"),
        (F.col("o_orderstatus") == "P").alias("is_ten_percent_owner"),
        F.col("l_shipdate").cast("date").alias("transaction_date"),
        F.when(F.col("l_returnflag") == "N", "P").when(F.col("l_returnflag") == "R", "S").otherwise("F").alias("code"),
        F.when(F.col("l_returnflag") == "N", "A").otherwise("D").alias("acquired_disposed"),
        F.col("l_quantity").alias("shares"),
        price.alias("price"),
        F.col("l_linenumber").alias("seq"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval chunks: doc_id, page_content, source_file, company, content_type, year, filing_type, fiscal_quarter."""
    d = load(spark, sf_dir, "documents")
    kind = F.element_at(F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select("doc_id", F.col("text").alias("page_content"), F.col("source").alias("source_file"), F.col("source").alias("company"), F.lit("text").alias("content_type"), (F.col("doc_id") % 5 + 2020).cast("int").alias("year"), kind.alias("filing_type"), F.when(F.col("doc_id") % 3 == 1, (F.col("doc_id") % 4 + 1).cast("int")).alias("fiscal_quarter"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, turn, role, content, token_count, agent_type."""
    c = load(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"), F.size(F.split("text", " ")).alias("token_count"), F.when(F.col("conv_id") % 2 == 0, "rag").otherwise("quant").alias("agent_type"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, company_name, status, content, created_at of the labelled documents."""
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    hours = F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("user_id"), F.col("source").alias("company_name"), F.when(F.col("quality") == 1, "published").otherwise("draft").alias("status"), F.col("text").alias("content"), (F.lit("2024-01-01").cast("timestamp_ntz") + hours).alias("created_at"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """firm, symbol, ts, rating (free text), target_price."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.element_at(F.array(*[F.lit(x) for x in ("Strong Buy", "Buy", "Hold", "Sell", "Avoid")]), (F.floor(k / 20) + 1).cast("int"))
    return e.select(F.col("user_id").alias("firm"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), name.alias("rating"), F.col("value").alias("target_price"), "event_id")


#: What a note of a customer's market segment is about.
TOPICS = {"AUTOMOBILE": "the bull case and the bear case", "BUILDING": "revenue by geography", "FURNITURE": "reportable segment margins", "HOUSEHOLD": "how inflation moves the 10-year treasury yield", "MACHINERY": "insider trading by key management"}
_ORDINALS = ("first", "2nd", "third", "4th")
_STANDING = {"F": "strong buy, solid growth", "O": "sell, weak outlook and headwinds", "P": "underweight, risk and pressure"}


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    day = F.col("o_orderdate").cast("date")
    j = o.join(c.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.col("o_orderkey").alias("id"), F.initcap("n_name").alias("name"), F.concat(F.lit("n"), "n_nationkey").alias("ticker"), "c_mktsegment", "o_orderstatus", F.year(day).alias("y"), F.quarter(day).alias("q"), F.date_format(day, "yyyyMMdd").alias("ymd"), F.floor("o_totalprice").cast("long").alias("whole"), F.dayofmonth(day).alias("d"))


def _by_value(c: str, of: dict, other: str = "revenue right now") -> Column:
    out = F.lit(other)
    for k, v in of.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: a sentence for each order, in four wordings, with its nation, year, quarter, status, segment and price."""
    f, kind = _order_facts(spark, sf_dir), F.col("id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("What did "), "name", F.lit(" report in its 10-K for "), "y", F.lit(" and "), F.col("y") - 1, F.lit("? Tell me about "), _by_value("c_mktsegment", TOPICS)))
        .when(kind == 1, F.concat(F.lit("Q"), "q", F.lit(" orders of "), "name", F.lit(" were $"), "whole", F.lit(".5, up "), "d", F.lit("% on the "), F.element_at(F.array(*map(F.lit, _ORDINALS)), F.col("q")), F.lit(" quarter of "), "y"))
        .when(kind == 2, F.concat(F.lit("-"), "whole", F.lit(" million, "), _by_value("o_orderstatus", _STANDING), F.lit(" for ("), F.upper("ticker"), F.lit("), press release")))
        .otherwise(F.concat(_by_value("c_mktsegment", TOPICS), F.lit(" of "), "name", F.lit(", various")))
    )
    return f.select("id", text.alias("text"))


def option_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text: what a note says of the options of each line item, from its columns."""
    li = load(spark, sf_dir, "lineitem")
    part = lambda c, least, n: (F.lit(least) + F.col(c) % n).cast("string")
    volume = F.concat(F.floor("l_quantity").cast("int").cast("string"), F.lit(","), F.lpad((F.col("l_orderkey") % 1000).cast("string"), 3, "0"))
    one = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("The $"), part("l_suppkey", 90, 20), F.lit(" strike call saw "), volume, F.lit(" contracts"))).otherwise(F.concat(F.lit("Heavy puts: the $"), part("l_suppkey", 90, 20), F.lit(" put with "), volume, F.lit(" contracts")))
    mood = F.when(F.col("l_returnflag") == "A", "overall sentiment is bullish").when(F.col("l_returnflag") == "R", "a bearish day").otherwise("small move expected")
    text = F.concat(F.lit("Put/call ratio of 0."), "l_linenumber", F.lit("; "), mood, F.lit(". Support near $"), part("l_suppkey", 60, 30), F.lit(" and resistance at $"), part("l_partkey", 120, 50), F.lit(".5. "), one)
    return li.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), text.alias("text"))


def filing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name: a file name for each order, in five forms."""
    f, kind = _order_facts(spark, sf_dir), F.col("id") % 5
    name = (
        F.when(kind == 0, F.concat(F.upper("ticker"), F.lit("_10K_"), "y", F.lit(".pdf")))
        .when(kind == 1, F.concat("ticker", F.lit("-"), "ymd", F.lit(".pdf")))
        .when(kind == 2, F.concat("ticker", F.lit("_10-Q_"), "ymd", F.lit("_"), F.lpad(F.col("id").cast("string"), 10, "0"), F.lit(".pdf")))
        .when(kind == 3, F.concat("name", F.lit(" Annual Report "), "y", F.lit(".pdf")))
        .otherwise(F.concat(F.lit("8-K "), F.lower("name")))
    )
    return f.select("id", name.alias("name"))


def nation_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, ticker, company: nations as a dictionary of companies."""
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.concat(F.lit("n"), "n_nationkey").alias("ticker"), F.lower("n_name").alias("company"))


def _sql_cases(c: str, of: dict, other: str = "revenue right now") -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items()) + f" ELSE '{other}' END"


_FACTS = "SELECT o_orderkey AS id, upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS name, 'n' || n_nationkey AS ticker, c_mktsegment, o_orderstatus, year(o_orderdate) AS y, quarter(o_orderdate) AS q, strftime(o_orderdate, '%Y%m%d') AS ymd, CAST(floor(o_totalprice) AS BIGINT) AS whole, day(o_orderdate) AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

#: The same inputs as DuckDB common table expressions.
SQL = {
    "notes": f"""notes AS (SELECT id, CASE id % 4 WHEN 0 THEN 'What did ' || name || ' report in its 10-K for ' || y || ' and ' || (y - 1) || '? Tell me about ' || {_sql_cases('c_mktsegment', TOPICS)}
        WHEN 1 THEN 'Q' || q || ' orders of ' || name || ' were $' || whole || '.5, up ' || d || '% on the ' || {list(_ORDINALS)}[q] || ' quarter of ' || y
        WHEN 2 THEN '-' || whole || ' million, ' || {_sql_cases('o_orderstatus', _STANDING)} || ' for (' || upper(ticker) || '), press release'
        ELSE {_sql_cases('c_mktsegment', TOPICS)} || ' of ' || name || ', various' END AS text FROM ({_FACTS}))""",
    "option_notes": """option_notes AS (SELECT l_orderkey || '/' || l_linenumber AS id, 'Put/call ratio of 0.' || l_linenumber || '; ' || CASE l_returnflag WHEN 'A' THEN 'overall sentiment is bullish' WHEN 'R' THEN 'a bearish day' ELSE 'small move expected' END
        || '. Support near $' || (60 + l_suppkey % 30) || ' and resistance at $' || (120 + l_partkey % 50) || '.5. ' || CASE l_linestatus WHEN 'O' THEN 'The $' || (90 + l_suppkey % 20) || ' strike call saw ' ELSE 'Heavy puts: the $' || (90 + l_suppkey % 20) || ' put with ' END
        || CAST(floor(l_quantity) AS INTEGER) || ',' || lpad((l_orderkey % 1000)::VARCHAR, 3, '0') || ' contracts' AS text FROM lineitem)""",
    "filing_names": f"""filing_names AS (SELECT id, CASE id % 5 WHEN 0 THEN upper(ticker) || '_10K_' || y || '.pdf' WHEN 1 THEN ticker || '-' || ymd || '.pdf' WHEN 2 THEN ticker || '_10-Q_' || ymd || '_' || lpad(id::VARCHAR, 10, '0') || '.pdf'
        WHEN 3 THEN name || ' Annual Report ' || y || '.pdf' ELSE '8-K ' || lower(name) END AS name FROM ({_FACTS}))""",
    "nation_companies": "nation_companies AS (SELECT n_nationkey AS ordinal, 'n' || n_nationkey AS ticker, lower(n_name) AS company FROM nation)",
    "bars": "bars AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2)",
    "chain": """chain AS (SELECT p_brand AS ticker, CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'put' END AS option_type, last_day(CAST(l_shipdate AS DATE)) AS expiration, p_retailprice AS strike,
        round(l_extendedprice / l_quantity, 2) AS lastPrice, l_quantity AS volume, 0.0::DOUBLE AS openInterest, l_discount AS impliedVolatility, FALSE AS inTheMoney,
        concat_ws('-', lpad(l_orderkey::VARCHAR, 12, '0'), l_linenumber::VARCHAR, lpad(l_partkey::VARCHAR, 12, '0'), lpad(l_suppkey::VARCHAR, 12, '0'), strftime(l_shipdate, '%Y-%m-%d'), lpad(CAST(round(l_extendedprice * 100) AS BIGINT)::VARCHAR, 14, '0')) AS row_id,
        round(l_quantity * round(l_extendedprice / l_quantity, 2) * 100, 2) AS notional
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "spots": "spots AS (SELECT p_brand AS ticker, round(CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS price FROM part GROUP BY 1)",
    "macro": "macro AS (SELECT o_orderpriority AS indicator, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS value FROM orders GROUP BY 1, 2)",
    "form4": """form4 AS (SELECT o_orderkey AS accession, CASE WHEN l_linenumber = 7 THEN '4/A' ELSE '4' END AS document_type, CAST(o_orderdate AS DATE) AS period_of_report, s_name AS issuer, c_name AS owner,
        o_orderstatus = 'F' AS is_officer, o_orderstatus = 'O' AS is_director, o_orderstatus = 'P' AS is_ten_percent_owner, CAST(l_shipdate AS DATE) AS transaction_date,
        CASE l_returnflag WHEN 'N' THEN 'P' WHEN 'R' THEN 'S' ELSE 'F' END AS code, CASE WHEN l_returnflag = 'N' THEN 'A' ELSE 'D' END AS acquired_disposed, l_quantity AS shares,
        round(l_extendedprice / l_quantity, 2) AS price, l_linenumber AS seq
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)""",
    "chunks": "chunks AS (SELECT doc_id, text AS page_content, source AS source_file, source AS company, 'text' AS content_type, CAST(doc_id % 5 + 2020 AS INTEGER) AS year, ['10-K', '10-Q', '8-K'][doc_id % 3 + 1] AS filing_type, CASE WHEN doc_id % 3 = 1 THEN CAST(doc_id % 4 + 1 AS INTEGER) END AS fiscal_quarter FROM documents)",
    "chat": "chat AS (SELECT conv_id AS session_id, turn, role, text AS content, len(string_split(text, ' ')) AS token_count, CASE WHEN conv_id % 2 = 0 THEN 'rag' ELSE 'quant' END AS agent_type FROM conversations)",
    "reports": "reports AS (SELECT doc_id AS id, lang AS user_id, source AS company_name, CASE WHEN quality = 1 THEN 'published' ELSE 'draft' END AS status, text AS content, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS created_at FROM documents JOIN labels USING (doc_id))",
    "ratings": "ratings AS (SELECT user_id AS firm, event_type AS symbol, ts, ['Strong Buy', 'Buy', 'Hold', 'Sell', 'Avoid'][CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 20) AS INTEGER) + 1] AS rating, value AS target_price, event_id FROM events)",
}


def with_inputs(names: str, body: str) -> str:
    """A DuckDB query whose body may name the inputs."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body.strip()
