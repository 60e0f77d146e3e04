"""Round trips through files and payloads: readers, writers, pages, tables in texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillfin.adapters import chat_messages, load, macro_series, with_inputs
from quillfin.functions import text as tx
from quillfin.operators import research as rs
from quillfin.plans.more_queries import _sql_html
from quillfin.plans.registry import query
from quillfin.session import register_functions, scratch
from quillfin.sources import readers as rd
from quillfin.sources import sinks
from quillfin.sources.feed import read_feed

TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query("src_csv_series", with_inputs("macro", "SELECT indicator, date::VARCHAR AS date, value FROM macro WHERE indicator = '1-URGENT'"))
def csv_series(spark, sf_dir):
    at = scratch(spark, "csv")
    macro_series(spark, sf_dir).filter("indicator = '1-URGENT'").select("date", "value").write.option("header", True).csv(f"{at}/1-URGENT.csv")
    return rd.csv_series(spark, at, "1-URGENT").unionByName(rd.csv_series(spark, at, "absent"))


@query("src_json_metadata", "SELECT DISTINCT '2024-01-02' AS last_updated, o_orderpriority AS indicator, 'monthly' AS frequency FROM orders")
def json_metadata(spark, sf_dir):
    at = scratch(spark, "metadata")
    series = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("indicator"), F.lit("monthly").alias("frequency")).distinct()
    doc = series.agg(F.collect_list(F.struct("indicator", "frequency")).alias("series")).withColumn("last_updated", F.lit("2024-01-02"))
    doc.select(F.to_json(F.struct("last_updated", "series"), {"pretty": "true"})).write.text(at)
    m = rd.json_metadata(spark, at, "last_updated string, series array<struct<indicator:string,frequency:string>>")
    return m.select("last_updated", F.explode("series").alias("s")).select("last_updated", "s.*")


@query("src_manifest", "SELECT n_name || '.pdf' AS path, n_name AS ticker FROM nation WHERE n_nationkey % 3 <> 0")
def manifest(spark, sf_dir):
    at = scratch(spark, "manifest")
    path = F.when(F.col("n_nationkey") % 6 == 0, F.lit(None).cast("string")).when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat("n_name", F.lit(".pdf")))
    entries = load(spark, sf_dir, "nation").select(path.alias("path"), F.col("n_name").alias("ticker"))
    entries.agg(F.to_json(F.collect_list(F.struct("path", "ticker")))).write.text(at)
    return rd.manifest(spark, at).select("path", "ticker")


@query("src_atom_entries", "SELECT o_orderkey, title, updated::VARCHAR AS updated FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '4 - F' ELSE '4/A - P' END AS title, CAST(o_orderdate AS DATE) AS updated FROM orders WHERE o_orderstatus <> 'O') WHERE updated >= DATE '1996-01-01' ORDER BY updated DESC, lpad(o_orderkey::VARCHAR, 12, '0') LIMIT 40 OFFSET 40")
def atom_entries(spark, sf_dir):
    """The second page of 40: other forms are gone before entries are counted."""
    title = F.when(F.col("o_orderstatus") == "F", "4 - F").when(F.col("o_orderstatus") == "O", "424B2 - O").otherwise("4/A - P")
    e = load(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"), F.col("o_orderdate").cast("date").alias("updated"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("link"))
    return rd.atom_entries(e, "1996-01-01", 40, page=2).drop("link")


_FEED_PAGE = 500


@query("src_paged_feed", "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS filed, count(*) AS n, min(CASE o_orderstatus WHEN 'F' THEN '4 - F' WHEN 'O' THEN '424B2 - O' ELSE '4/A - P' END) AS title, min(o_orderkey::VARCHAR) AS link FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01' GROUP BY 1")
def paged_feed(spark, sf_dir):
    """Orders as the pages of a feed, the latest first, read back by the data source with a pushed first day."""
    title = F.when(F.col("o_orderstatus") == "F", "4 - F").when(F.col("o_orderstatus") == "O", "424B2 - O").otherwise("4/A - P")
    e = load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").cast("string").alias("link"), title.alias("title"))
    entry = F.concat(F.lit("<entry><title>"), "title", F.lit("</title><updated>"), F.col("day").cast("string"), F.lit('T12:00:00-05:00</updated><link href="'), "link", F.lit('"/></entry>'))
    # Places in the feed: those of a month follow on the later months', of which there are few.
    month = F.trunc("day", "month")
    later = e.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n")).withColumn("after", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = e.withColumn("month", month).join(later.select("month", "after"), "month").withColumn("place", F.col("after") + F.row_number().over(Window.partitionBy("month").orderBy(F.desc("day"), "link")) - 1)
    pages = placed.groupBy((F.floor(F.col("place") / _FEED_PAGE) * _FEED_PAGE).alias("start")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", entry.alias("x")))), lambda p: p["x"]), "").alias("entries"))
    at = scratch(spark, "feed")
    pages.select("start", F.concat(F.lit("<feed>"), "entries", F.lit("</feed>")).alias("value")).write.partitionBy("start").text(at)
    url = at if "://" in at or at.startswith("file:") else f"file://{at}"
    found = read_feed(spark, url + "/start={start}", count=_FEED_PAGE).filter("filed >= DATE '1997-01-01'")
    return found.groupBy("filed").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("title"), F.min("link").alias("link"))


@query("src_history_pages", "SELECT o_custkey, a::VARCHAR AS filing_from, b::VARCHAR AS filing_to FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1) WHERE b >= DATE '1993-01-01' AND a <= DATE '1994-12-31'")
def history_pages(spark, sf_dir):
    g = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("filing_from"), F.max(F.col("o_orderdate").cast("date")).alias("filing_to"))
    return rd.history_pages(g, "1993-01-01", "1994-12-31")


@query("src_files_under", "SELECT name, expired FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") t(name), (VALUES (TRUE), (FALSE)) e(expired)")
def files_under(spark, sf_dir):
    """Files below a folder, and those past their keeping: all or none, by the day asked for."""
    files = rd.files_under(spark, sf_dir, "*.parquet")
    # A table may be one file or a folder of them.
    name = lambda df: df.select(F.regexp_extract("path", r"/([a-z]+)\.parquet", 1).alias("name")).distinct()
    old = name(rd.expired(files, "2200-01-01", 30)).withColumn("expired", F.lit(True))
    return old.unionByName(name(files.join(rd.expired(files, "2000-01-01", 30), "path", "left_anti")).withColumn("expired", F.lit(False)))


@query("src_page_chunks", f"SELECT page_id, page_content, sha256(page_content) AS content_hash FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN t || chr(10) || chr(10) || '[TABLES]' || chr(10) || '| id |' || chr(10) || '| --- |' || chr(10) || '| ' || page_id || ' |' ELSE t END AS page_content FROM (SELECT page_id, {_sql_html()} AS t FROM pages)) WHERE trim(page_content) <> ''")
def page_chunks(spark, sf_dir):
    tables = F.when(F.col("page_id") % 2 == 0, F.array(tx.markdown_table(F.array(F.lit("id")), F.array(F.array(F.col("page_id").cast("string")))))).otherwise(F.array().cast("array<string>"))
    return rd.page_chunks(load(spark, sf_dir, "pages"), tx.html_text(F.col("html")), tables).select("page_id", "page_content", "content_hash")


@query("src_table_list", "SELECT 'quillfin_nation' AS table_name, TRUE AS isTemporary UNION ALL SELECT 'quillfin_region', TRUE")
def table_list(spark, sf_dir):
    for t in ("nation", "region"):
        load(spark, sf_dir, t).createOrReplaceTempView(f"quillfin_{t}")
    return sinks.table_list(spark).filter("table_name in ('quillfin_nation', 'quillfin_region')")


@query("snk_write_series", with_inputs("macro", "SELECT indicator, date::VARCHAR AS date, value FROM macro"))
def write_series(spark, sf_dir):
    at = scratch(spark, "series")
    m = macro_series(spark, sf_dir)
    sinks.write_series(m, at)
    # A second write replaces the partitions that it brings and leaves the others.
    sinks.write_series(m.filter("indicator = '2-HIGH'"), at)
    return spark.read.parquet(at).select("indicator", "date", "value")


@query("snk_export_json", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation")
def export_json(spark, sf_dir):
    at = scratch(spark, "json")
    sinks.export_json(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


@query("snk_export_text", with_inputs("chat", "SELECT '[' || role || ']' || coalesce(' ' || regexp_replace(content, '\\s+', ' ', 'g'), '') AS line FROM chat"))
def export_text(spark, sf_dir):
    at = scratch(spark, "text")
    sinks.export_text(chat_messages(spark, sf_dir).withColumn("content", F.regexp_replace("content", r"\s+", " ")), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


@query("txt_cover_page", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS filing_type, CAST(o_orderdate AS DATE)::VARCHAR AS period_end_date FROM orders")
def cover_page(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    page = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("UNITED STATES\nForm 10-K\n\nFor the fiscal  year ended "), F.date_format(d, "MMMM d, yyyy")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("FORM 10Q for the QUARTERLY period ended\n"), F.upper(F.date_format(d, "MMMM dd yyyy"))))
        .otherwise(F.concat(F.lit("form 8-K\nDate of Report (earliest event): "), F.date_format(d, "MMM d, yyyy")))
    )
    return load(spark, sf_dir, "orders").select("o_orderkey", tx.cover_page(page).alias("c")).select("o_orderkey", "c.*")


def _comparison(spark, sf_dir):
    """A comparison table in markdown for each region: its nations as metrics."""
    n = load(spark, sf_dir, "nation")
    line = F.format_string("| %s | $%d,000 | %s |", "n_name", "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "n/a").otherwise(F.concat((-F.col("n_nationkey")).cast("string"), F.lit("%"))))
    g = n.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return g.select("doc_id", F.concat(F.lit("As asked:\n| Metric | A | B | Comparison |\n|---|---|---|---|\n"), "body").alias("text"))


@query("res_comparison_chart", "SELECT n_regionkey AS doc_id, CAST(n AS INTEGER) AS n, n_name AS metric, n_nationkey * 1000.0::DOUBLE AS v1, CASE WHEN n_nationkey % 2 = 0 THEN 0.0 ELSE -n_nationkey END::DOUBLE AS v2, 0.0::DOUBLE AS v3 FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation) WHERE n <= 4")
def comparison_chart(spark, sf_dir):
    return rs.comparison_chart(_comparison(spark, sf_dir), most=4)


@query("txt_table_rows", "SELECT n_regionkey AS doc_id, n_name AS metric, '$' || n_nationkey || ',000' AS company1 FROM nation")
def table_rows(spark, sf_dir):
    return _comparison(spark, sf_dir).select("doc_id", F.explode(tx.metric_rows(F.col("text"))).alias("r")).select("doc_id", "r.metric", "r.company1")


@query("txt_table_cells_sql", "SELECT n_regionkey AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS row, n_name AS cell FROM nation UNION ALL SELECT r_regionkey, 0, 'Metric' FROM region")
def table_cells_sql(spark, sf_dir):
    """The table function in SQL: first cells of the table's rows."""
    register_functions(spark)
    _comparison(spark, sf_dir).createOrReplaceTempView("quillfin_comparison")
    return spark.sql("SELECT doc_id, row, cell FROM quillfin_comparison, LATERAL table_cells(text) WHERE col = 0")


@query("txt_markdown_table", "SELECT n_regionkey, '| n_name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE '' END || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1")
def markdown_table(spark, sf_dir):
    cells = F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name", F.col("n_nationkey").cast("string"), F.lit("cut"))).otherwise(F.array("n_name"))
    g = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    return g.select("n_regionkey", tx.markdown_table(F.array(F.lit("n_name"), F.lit("key")), F.col("rows")).alias("markdown"))


@query("txt_markdown_text", "SELECT p_partkey, p_name || chr(10) || p_brand || ' ' || p_type AS text FROM part")
def markdown_text(spark, sf_dir):
    md = F.concat(F.lit("## "), "p_name", F.lit("\n**"), "p_brand", F.lit("** ["), "p_type", F.lit("](http://x/"), "p_partkey", F.lit(")![i](y)"))
    return load(spark, sf_dir, "part").select("p_partkey", tx.markdown_text(md).alias("text"))


@query("txt_sanitised_html", "SELECT p_partkey, '<p>' || p_name || '<b>' || p_brand || '</b></p>' AS html FROM part")
def sanitised_html(spark, sf_dir):
    html = F.concat(F.lit('<div onclick="x()"><p class="a">'), "p_name", F.lit("<script>alert(1)</script><!-- c --><b id='1'>"), "p_brand", F.lit('</b></p><iframe src="y"></iframe></div>'))
    return load(spark, sf_dir, "part").select("p_partkey", tx.sanitised_html(html).alias("html"))


@query("txt_probabilities", "WITH v AS (SELECT p_partkey, p_size AS a, p_size % 7 * 10 AS b, p_partkey % 50 AS c FROM part), s AS (SELECT *, a + b + c AS t FROM v) SELECT p_partkey, list_aggregate(list_transform([a, b, c], lambda x: CASE WHEN t > 0 AND abs(t - 100) > 1 THEN round(x * (100 / t::DOUBLE)) ELSE x END::INTEGER::VARCHAR), 'string_agg', ',') AS probabilities, a >= b AND b >= c AS ordered FROM s")
def probabilities(spark, sf_dir):
    a, b, c = F.col("p_size"), F.col("p_size") % 7 * 10, F.col("p_partkey") % 50
    p = tx.rescaled_probabilities(F.array(*[x.cast("double") for x in (a, b, c)]))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(p, lambda x: x.cast("int").cast("string")), ",").alias("probabilities"), tx.in_order(a, b, c).alias("ordered"))
