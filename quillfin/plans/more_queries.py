"""Snapshots, metadata and compositions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.adapters import chunks, insider_trades, load, ratings, with_inputs
from quillfin.functions import text as tx
from quillfin.operators import relational as rel
from quillfin.operators import research as rs
from quillfin.plans.registry import query
from quillfin.plans.text_queries import AGGREGATED, LEX, POLARITY
from quillfin.sources import readers as rd


@query("src_snapshot", "SELECT p_name AS ticker, CASE WHEN p_size > 0 THEN round(p_retailprice / p_size, 2) END AS trailing_pe, p_retailprice AS price, CAST(p_size AS DOUBLE) AS trailing_eps, CASE WHEN p_size > 25 THEN round(p_retailprice / (p_size - 25), 2) END AS forward_pe, CAST(p_size - 25 AS DOUBLE) AS forward_eps FROM part")
def snapshot(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_name").alias("ticker"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("trailing_eps"), (F.col("p_size") - 25).cast("double").alias("forward_eps"))
    return rd.snapshot(p)


@query("src_corporate_actions", "SELECT l_partkey AS ticker, CAST(l_shipdate AS DATE)::VARCHAR AS date, kind, amount FROM (SELECT *, 'dividend' AS kind, l_tax AS amount FROM lineitem UNION ALL SELECT *, 'split', CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0::DOUBLE END FROM lineitem) WHERE amount <> 0")
def corporate_actions(spark, sf_dir):
    splits = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    return rd.corporate_actions(load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ticker"), F.col("l_shipdate").alias("ts"), F.col("l_tax").alias("dividends"), splits.alias("splits")))


_HOLDERS = dict(zip(rd.HOLDER_TYPES, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", None)))


@query("src_holders", "SELECT t.k AS holder_type, c_name AS holder, c_acctbal AS value FROM (VALUES " + ", ".join(f"('{k}', {repr(v) if v else 'NULL'})" for k, v in _HOLDERS.items()) + ") t(k, s) JOIN customer ON s IS NULL OR c_mktsegment = s")
def holders(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_name").alias("holder"), F.col("c_acctbal").alias("value"), "c_mktsegment")
    tables = {k: rel.optional_filters(c, {"c_mktsegment": v}).drop("c_mktsegment") for k, v in _HOLDERS.items()}
    return reduce(DataFrame.unionByName, [rd.holders(tables, k).withColumn("holder_type", F.lit(k)) for k in rd.HOLDER_TYPES])


@query("jn_exists_by_hash_or_file", "WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN sha256(text) END AS content_hash, source || doc_id % 10 AS source_file FROM documents), o AS (SELECT sha256(text) AS h, source || doc_id % 10 AS f FROM documents WHERE doc_id % 5 = 0) SELECT doc_id, coalesce(content_hash IN (SELECT h FROM o), FALSE) OR (content_hash IS NULL AND source_file IN (SELECT f FROM o)) AS known FROM n")
def exists_by_hash_or_file(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.concat("source", (F.col("doc_id") % 10).cast("string")).alias("file"))
    # The hash decides where there is one, else the file name: one key column for both.
    key = lambda h: F.when(h.isNotNull(), F.concat(F.lit("h:"), h)).otherwise(F.concat(F.lit("f:"), "file"))
    new = d.withColumn("key", key(F.when(F.col("doc_id") % 3 > 0, F.col("hash"))))
    old = d.filter("doc_id % 5 = 0").select(F.explode(F.array(F.concat(F.lit("h:"), "hash"), F.concat(F.lit("f:"), "file"))).alias("key")).distinct().withColumn("hit", F.lit(True))
    return new.join(old, "key", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("known"))


@query("agg_batch_counters", "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS added, count(*) - count(DISTINCT l_orderkey) AS skipped FROM lineitem GROUP BY 1")
def batch_counters(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("added"), (F.count(F.lit(1)) - F.countDistinct("l_orderkey")).alias("skipped"))


@query("txt_headline_direction", f"WITH {POLARITY}, g AS (SELECT source, count(*) AS headlines, CAST(sum(CAST(coalesce(round(p, 3), 0) AS DECIMAL(9,4))) AS DOUBLE) / count(*) AS p FROM documents LEFT JOIN pol USING (doc_id) GROUP BY 1) SELECT source, headlines, round(p, 4) AS polarity, CASE WHEN p > 0.1::DOUBLE THEN 'UP' WHEN p < -0.1::DOUBLE THEN 'DOWN' ELSE 'STABLE' END AS direction FROM g")
def headline_direction(spark, sf_dir):
    return rs.headline_direction(load(spark, sf_dir, "documents").select("source", "text"), "source", **LEX)


@query("txt_metadata_precedence", """WITH f AS (SELECT o_orderkey, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 = 0 AS given, o_orderkey % 3 = 0 AS cover FROM orders)
SELECT o_orderkey, CASE WHEN given THEN '8-K' WHEN cover THEN '10-K' WHEN s = 'O' THEN '10-Q' WHEN s = 'F' THEN '10-K' ELSE '10-K' END AS filing_type, CASE WHEN cover THEN d::VARCHAR END AS period_end_date, CAST(CASE WHEN cover THEN year(d) ELSE year(d) - 1 END AS INTEGER) AS year FROM f""")
def metadata_precedence(spark, sf_dir):
    """Filings made of orders: some with a given type, some with a cover page, all with a file name that tells the year before."""
    o = load(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("date")
    given = F.struct(F.when(F.col("o_orderkey") % 4 == 0, "8-K").alias("filing_type"), F.lit(None).cast("string").alias("period_end_date"), F.lit(None).cast("int").alias("year"))
    cover = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("FORM 10-K\nFor the fiscal year ended "), F.date_format(d, "MMMM d, yyyy"))).otherwise("no cover")
    kind = F.when(F.col("o_orderstatus") == "O", "10Q").when(F.col("o_orderstatus") == "F", "10-K").otherwise("deck")
    name = F.concat(F.lit("co_"), kind, F.lit("_"), (F.year(d) - 1).cast("string"), F.lit(".pdf"))
    return o.select("o_orderkey", tx.filing_metadata(given, cover, name).alias("m")).select("o_orderkey", "m.*")


@query("txt_filing_labels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FY' || year(o_orderdate) WHEN 'O' THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) ELSE '' END AS label FROM orders")
def filing_labels(spark, sf_dir):
    from quillfin.functions.periods import fiscal_quarter

    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    d = F.col("o_orderdate").cast("date")
    # With a calendar fiscal year the quarter is the calendar's, except that the nearest quarter end decides: month ends are given here.
    return load(spark, sf_dir, "orders").select("o_orderkey", tx.filing_label(form, d, F.least(fiscal_quarter(F.last_day(F.add_months(F.trunc(d, "quarter"), 2)), F.lit(12)), F.lit(4))).alias("label"))


@query("txt_identifiers", "WITH i AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 18, '0') AS d FROM orders) SELECT o_orderkey, left(d, 10) || '-' || substr(d, 11, 2) || '-' || substr(d, 13, 6) AS accession, CAST(o_orderkey % 7 AS INTEGER) AS xref, CAST(o_orderkey % 9 AS INTEGER) AS page, '****.xml' AS masked, FALSE AS ticker FROM i")
def identifiers(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("https://x/"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0"), F.lit("/a.xml")).alias("url"), F.concat(F.lit("page"), F.col("o_orderkey") % 9, F.lit("_xref"), F.col("o_orderkey") % 7, F.lit(".png")).alias("img"))
    secret = tx.masked(F.create_map(F.lit("k"), F.col("url")))["k"]
    return o.select("o_orderkey", tx.accession_of_url(F.col("url")).alias("accession"), tx.image_ref(F.col("img")).alias("r"), secret.alias("masked"), tx.is_ticker(F.col("img")).alias("ticker")).select("o_orderkey", "accession", "r.xref", "r.page", "masked", "ticker")


@query("dt_fiscal_mismatch", "SELECT c_nationkey, count(DISTINCT coalesce(fye, 12)) > 1 AS mismatch FROM customer LEFT JOIN (SELECT o_custkey, month(max(o_orderdate)) AS fye FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def fiscal_mismatch(spark, sf_dir):
    fye = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.month(F.max("o_orderdate")).alias("fye"))
    return rel.calendars_differ(load(spark, sf_dir, "customer").join(fye, "c_custkey", "left"), "c_nationkey", "fye")


@query("arr_draft_sections", "SELECT o_custkey, string_agg(CASE WHEN o_orderstatus <> 'O' THEN o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey) AS sections, string_agg(CASE WHEN o_orderstatus = 'O' THEN o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey) AS images FROM orders GROUP BY 1")
def draft_sections(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    g = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(items.alias("i"))
    show = lambda keep: F.nullif(F.array_join(F.transform(F.filter("i", keep), lambda x: x["o_orderkey"].cast("string")), ","), F.lit(""))
    return g.select("o_custkey", show(lambda x: x["o_orderstatus"] != "O").alias("sections"), show(lambda x: x["o_orderstatus"] == "O").alias("images"))


@query("res_cached_lookup", "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stored DESC, value) AS n FROM (SELECT user_id AS key, value, ts AS stored FROM events WHERE ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-15' AND ts <= TIMESTAMP '2024-02-15')) WHERE n = 1")
def cached_lookup(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "value", F.col("ts").cast("timestamp_ntz").alias("at"))
    now = F.lit("2024-02-15").cast("timestamp_ntz")
    live = e.filter((F.col("at") + F.expr("interval 30 days") > now) & (F.col("at") <= now))
    return rel.dedup_first(live, [F.col("key")], [F.desc("at"), F.col("value")]).select("key", "value")


@query("res_comprehensive", with_inputs("ratings", f"""
, {POLARITY}, res AS (SELECT event_type AS symbol, doc_id, split_part(url, '/', 3) AS url, value AS score, text FROM events JOIN pages ON page_id = event_id JOIN documents ON doc_id = page_id),
once AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY symbol, url ORDER BY score DESC, doc_id) = 1), u AS (SELECT symbol, count(*) AS sources FROM once GROUP BY 1), best AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, doc_id) <= 5),
g AS (SELECT symbol, round(CAST(sum(CAST(coalesce(round(p, 3), 0) AS DECIMAL(9,4))) AS DOUBLE) / count(*), 3) AS polarity FROM best LEFT JOIN pol USING (doc_id) GROUP BY 1), agg AS ({AGGREGATED})
SELECT agg.*, polarity, sources FROM agg LEFT JOIN g USING (symbol) LEFT JOIN u USING (symbol)"""))
def comprehensive(spark, sf_dir):
    """Results: pages of the event of equal id, with that document's text; a host counts once."""
    e, p, d = (load(spark, sf_dir, t) for t in ("events", "pages", "documents"))
    r = e.join(p, e.event_id == p.page_id).join(d, d.doc_id == p.page_id)
    r = r.select(F.col("event_type").alias("symbol"), "doc_id", F.coalesce(F.get(F.split("url", "/"), F.lit(2)), F.lit("")).alias("url"), F.col("value").alias("score"), "text")
    return rs.comprehensive(ratings(spark, sf_dir), r, **LEX)


@query("vec_subquery_stats", with_inputs("chunks", "SELECT filing_type, count(*) > 0 AS found, count(*) AS doc_count, count(DISTINCT source_file) AS sources FROM chunks WHERE fiscal_quarter IS NULL OR fiscal_quarter < 3 GROUP BY 1"))
def subquery_stats(spark, sf_dir):
    c = chunks(spark, sf_dir).filter("fiscal_quarter is null or fiscal_quarter < 3")
    return c.groupBy("filing_type").agg((F.count(F.lit(1)) > 0).alias("found"), F.count(F.lit(1)).alias("doc_count"), F.countDistinct("source_file").alias("sources"))


@query("ins_owner_names", with_inputs("form4", "SELECT DISTINCT owner, replace(rtrim(trim(upper(owner)), '.'), '  ', ' ') AS name FROM form4"))
def owner_names(spark, sf_dir):
    from quillfin.operators.insider import normalise_owner

    return insider_trades(spark, sf_dir).select("owner").distinct().select("owner", normalise_owner(F.col("owner")).alias("name"))


def _sql_html() -> str:
    s = "html"
    for p, o in ((r"<script\b[^>]*>.*?</script>", "gis"), (r"<style\b[^>]*>.*?</style>", "gis"), ("<!--.*?-->", "gs"), ("<[^>]*>", "g")):
        s = f"regexp_replace({s}, '{p}', ' ', '{o}')"
    for name, c in tx.ENTITIES:
        s = f"replace({s}, '{name}', {_sql(c)})"
    return rf"trim(regexp_replace({s}, '[ \t\n\r]+', ' ', 'g'))"


def _sql(c: str) -> str:
    return "'" + c.replace("'", "''") + "'"


@query("txt_html_text", f"SELECT page_id, {_sql_html()} AS text FROM pages")
def html_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))
