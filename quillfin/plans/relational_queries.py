"""Relational queries over reports, chats, filings and the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfin.adapters import chain, chat_messages, chunks, exact_sum, load, reports, with_inputs
from quillfin.operators import options as opt
from quillfin.operators import quantiles
from quillfin.operators import relational as rel
from quillfin.operators.quantiles import exact_percentile
from quillfin.plans.registry import query

_S = lambda x, scale=2: f"CAST(sum(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE)"


@query("flt_optional_filters", with_inputs("reports", "SELECT id, user_id, company_name, status, created_at::VARCHAR AS created_at FROM reports WHERE status = 'published' AND company_name ILIKE '%SRC1%' AND created_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-02-01'"))
def optional_filters(spark, sf_dir):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    r = rel.optional_filters(reports(spark, sf_dir), {"status": "published", "user_id": None}, {"company_name": "SRC1"}, {"created_at": (ts("2024-01-02"), ts("2024-02-01"))})
    return r.select("id", "user_id", "company_name", "status", "created_at")


@query("flt_null_and_flag", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment IS NOT NULL AND c_acctbal > 0")
def null_and_flag(spark, sf_dir):
    return load(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isNotNull() & (F.col("c_acctbal") > 0)).select("c_custkey", "c_acctbal")


@query("flt_payload_filter", with_inputs("chunks", "SELECT doc_id, company, year, filing_type, fiscal_quarter FROM chunks WHERE content_type = 'text' AND company IN ('src1', 'src2') AND year IN (2021, 2023) AND filing_type = '10-Q' AND fiscal_quarter = 2"))
def payload_filter(spark, sf_dir):
    f = rel.optional_filters(chunks(spark, sf_dir), {"content_type": "text", "company": ["src1", "src2"], "year": [2021, 2023], "filing_type": "10-Q", "fiscal_quarter": 2})
    return f.select("doc_id", "company", "year", "filing_type", "fiscal_quarter")


@query("flt_fallback_when_empty", with_inputs("chunks", "SELECT doc_id, year, fiscal_quarter FROM chunks WHERE filing_type = '10-Q' AND (fiscal_quarter = 9 OR NOT EXISTS (SELECT 1 FROM chunks WHERE filing_type = '10-Q' AND fiscal_quarter = 9))"))
def fallback_when_empty(spark, sf_dir):
    return rel.filter_or_all(chunks(spark, sf_dir).filter("filing_type = '10-Q'"), F.coalesce(F.col("fiscal_quarter") == 9, F.lit(False))).select("doc_id", "year", "fiscal_quarter")


@query("flt_relative_band", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 * (1 - 0.02::DOUBLE) AND 950 * (1 + 0.02::DOUBLE)")
def relative_band(spark, sf_dir):
    return load(spark, sf_dir, "part").filter(F.col("p_retailprice").between(950 * (1 - 0.02), 950 * (1 + 0.02))).select("p_partkey", "p_retailprice")


@query("flt_recent_cutoff", "SELECT event_id, ts::VARCHAR AS ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def recent_cutoff(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last") - F.expr("interval 2 days")).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("flt_headline_relevance", "SELECT doc_id FROM documents WHERE contains(lower(text), 'trash') OR contains(lower(text), 'worthless idiot') OR contains(lower(text), 'worthless')")
def headline_relevance(spark, sf_dir):
    t = F.lower("text")
    return load(spark, sf_dir, "documents").filter(t.contains("trash") | t.contains("worthless idiot") | t.contains("worthless")).select("doc_id")


@query("flt_row_selection", "WITH r AS (SELECT r_name, n_name, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS INTEGER) AS row FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT * FROM r WHERE row BETWEEN 2 AND 3 OR row = 5 OR lower(n_name) = 'algeria'")
def row_selection(spark, sf_dir):
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    return rel.select_rows(n, "r_name", [F.col("n_name")], "n_name", "2-3, 5, ALGERIA")


@query("flt_normalise_names", "SELECT n_regionkey, array_to_string(list_sort(list_filter(list_transform(list(' ' || n_name || ' '), lambda x: lower(trim(x))), lambda x: x <> '')), ',') AS names FROM nation GROUP BY 1")
def normalise_names(spark, sf_dir):
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.concat(F.lit(" "), "n_name", F.lit(" "))).alias("names")).select("n_regionkey", F.array_join(F.array_sort(rel.normalise_names(F.col("names"))), ",").alias("names"))


@query("jn_full_outer_zero", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL JOIN b ON a.k = b.k")
def full_outer_zero(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    side = lambda s, c: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(c))
    return rel.outer_zero(side("F", "n"), side("O", "m"), ["k"])


@query("jn_inner_count", "SELECT c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def inner_count(spark, sf_dir):
    return load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"))


@query("jn_eager_children", with_inputs("chat", "SELECT session_id, count(*) AS n, string_agg(role || ':' || turn, ',' ORDER BY turn) AS turns FROM chat GROUP BY 1"))
def eager_children(spark, sf_dir):
    m = chat_messages(spark, sf_dir)
    s = rel.with_children(m.select("session_id").distinct(), m.select("session_id", "turn", "role"), "session_id", "turn", "messages")
    return s.select("session_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["turn"])), ",").alias("turns"))


@query("jn_lookup_name", "WITH u AS (SELECT s_suppkey AS id, s_name AS username, CASE WHEN s_suppkey % 2 = 0 THEN 'Full ' || s_name END AS full_name FROM supplier), r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 150)::VARCHAR WHEN 1 THEN 'Supplier#' || lpad((o_orderkey % 120)::VARCHAR, 9, '0') ELSE 'someone' END AS author FROM orders) SELECT o_orderkey, author, coalesce(a.full_name, a.username, b.full_name, b.username, author) AS display_name FROM r LEFT JOIN u a ON a.id::VARCHAR = author LEFT JOIN u b ON b.username = author")
def lookup_name(spark, sf_dir):
    k = F.col("o_orderkey")
    author = F.when(k % 3 == 0, (k % 150).cast("string")).when(k % 3 == 1, F.concat(F.lit("Supplier#"), F.lpad((k % 120).cast("string"), 9, "0"))).otherwise("someone")
    users = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Full "), "s_name")).alias("full_name"))
    return rel.lookup_name(load(spark, sf_dir, "orders").select("o_orderkey", author.alias("author")), users, "author")


@query("jn_resolve_ticker", "WITH c AS (SELECT n_nationkey AS ordinal, lower(left(n_name, 3)) || '_alias' AS ticker, lower(n_name) AS company FROM nation), n AS (SELECT DISTINCT s_name AS name FROM (SELECT n_name AS s_name FROM nation UNION ALL SELECT 'united' UNION ALL SELECT 'Kingdom of Jordan' UNION ALL SELECT 'nowhere' UNION ALL SELECT '')), j AS (SELECT name, arg_min(ticker, (CAST(company <> lower(trim(name)) AS INT), ordinal)) AS t FROM n LEFT JOIN c ON lower(trim(name)) <> '' AND (contains(company, lower(trim(name))) OR contains(lower(trim(name)), company)) GROUP BY 1) SELECT name, coalesce(split_part(t, '_', 1), '') AS ticker FROM j")
def resolve_ticker(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    companies = n.select(F.col("n_nationkey").alias("ordinal"), F.concat(F.lower(F.substring("n_name", 1, 3)), F.lit("_alias")).alias("ticker"), F.col("n_name").alias("company"))
    names = n.select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("united",), ("Kingdom of Jordan",), ("nowhere",), ("",)], "name string"))
    return rel.resolve_ticker(names, companies)


_NAMED = (("the", "aerofoil works"), ("zz", "stupid"), ("zz", "worthless inc"), ("q", "garden thereand"))


@query("jn_mentions", f"WITH c(ticker, company) AS (VALUES {', '.join(map(str, _NAMED))}), q AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents) SELECT DISTINCT doc_id AS question_id, ticker FROM q, c WHERE list_contains(w, ticker) OR contains(t, company) OR len(list_filter(string_split(company, ' '), lambda x: length(x) > 3 AND x <> 'inc' AND list_contains(w, x))) > 0")
def mentions(spark, sf_dir):
    c = spark.createDataFrame(_NAMED, "ticker string, company string")
    return rel.mentions(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question")), c)


@query("jn_search_passes", "WITH t AS (SELECT DISTINCT p_brand AS ticker FROM part), y(year) AS (VALUES (2023), (2024)), f(filing_type) AS (VALUES ('10-K'), ('10-Q')), q(fiscal_quarter) AS (VALUES (1), (3)) SELECT ticker, year, filing_type, fiscal_quarter FROM t, y, f LEFT JOIN q ON filing_type = '10-Q'")
def search_passes(spark, sf_dir):
    one = lambda c, v: spark.createDataFrame([(x,) for x in v], c)
    return rel.search_passes(load(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct(), one("year int", (2023, 2024)), one("filing_type string", ("10-K", "10-Q")), one("fiscal_quarter int", (1, 3)))


@query("jn_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(spark, sf_dir):
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders").filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("jn_anti_unseen", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unseen(spark, sf_dir):
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("jn_resume_ledger", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN max(l_returnflag) = 'R' THEN 'success' ELSE 'failed' END AS status FROM lineitem WHERE l_linenumber < 4 GROUP BY 1) l ON l_orderkey = o_orderkey WHERE status IS NULL OR status <> 'success'")
def resume_ledger(spark, sf_dir):
    ledger = load(spark, sf_dir, "lineitem").filter("l_linenumber < 4").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.max("l_returnflag") == "R", "success").otherwise("failed").alias("status"))
    return rel.pending(load(spark, sf_dir, "orders").select("o_orderkey"), ledger, "o_orderkey", retry_failed=True)


@query("agg_count_subquery", with_inputs("reports", "SELECT count(*) AS total FROM (SELECT id FROM reports WHERE status = 'published')"))
def count_subquery(spark, sf_dir):
    return reports(spark, sf_dir).filter("status = 'published'").agg(F.count(F.lit(1)).alias("total"))


@query("agg_top_companies", with_inputs("reports", "SELECT company_name, count(*) AS n FROM reports WHERE status = 'published' GROUP BY 1 ORDER BY n DESC, company_name LIMIT 10"))
def top_companies(spark, sf_dir):
    return rel.top_counts(reports(spark, sf_dir).filter("status = 'published'"), "company_name")


@query("agg_chat_totals", with_inputs("chat", "SELECT agent_type, coalesce(sum(token_count), 0)::BIGINT AS tokens, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role <> 'user') AS other_messages, count(DISTINCT session_id) AS sessions FROM chat GROUP BY 1"))
def chat_totals(spark, sf_dir):
    user = F.col("role") == "user"
    return chat_messages(spark, sf_dir).groupBy("agent_type").agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.count_if(user).alias("user_messages"), F.count_if(~user).alias("other_messages"), F.countDistinct("session_id").alias("sessions"))


@query("agg_group_as_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, year(l_shipdate)::INTEGER AS y FROM lineitem")
def group_as_distinct(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.year("l_shipdate").alias("y")).dropDuplicates()


@query("agg_bare_columns", "SELECT o_custkey, o_orderstatus, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1, 2")
def bare_columns(spark, sf_dir):
    return rel.distinct_by(load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("agg_conditional_sums", f"SELECT l_linestatus, {_S("CASE WHEN l_returnflag = 'N' THEN l_extendedprice END")} AS bought, {_S("CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END")} AS sold, count(*) FILTER (l_returnflag = 'N') AS n_bought FROM lineitem GROUP BY 1")
def conditional_sums(spark, sf_dir):
    n = F.col("l_returnflag") == "N"
    return load(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(exact_sum(F.when(n, F.col("l_extendedprice"))).alias("bought"), exact_sum(F.when(~n, F.col("l_extendedprice"))).alias("sold"), F.count_if(n).alias("n_bought"))


@query("agg_weighted_mean_strike", with_inputs("chain", f"SELECT ticker, round({_S('strike * volume', 4)} / {_S('volume')}, 4) AS centre FROM chain GROUP BY 1"))
def weighted_mean_strike(spark, sf_dir):
    from quillfin.functions.numbers import rnd

    return opt.normalise_chain(chain(spark, sf_dir)).groupBy("ticker").agg(rnd(exact_sum(F.col("strike") * F.col("volume"), 4) / exact_sum("volume"), 4).alias("centre"))


@query("agg_percentile", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.85::DOUBLE), 6) AS p85 FROM part GROUP BY 1")
def percentile(spark, sf_dir):
    from quillfin.functions.numbers import rnd

    return exact_percentile(load(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 0.85, "p85").withColumn("p85", rnd("p85", 6))


@query("agg_distinct_sketches", "SELECT event_type, count(DISTINCT user_id) AS users, TRUE AS near FROM events GROUP BY 1")
def distinct_sketches(spark, sf_dir):
    """Distinct users of each type and day as sketches, united: within five standard errors of the exact count."""
    e = load(spark, sf_dir, "events")
    daily = quantiles.distinct_sketches(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id")
    users = quantiles.distinct_counts(quantiles.united(daily, ["event_type"]), "estimate")
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(users, "event_type").select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.08)).alias("near"))


@query("agg_majority_vote", "WITH g AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT user_id, arg_max(event_type, (n, -seen)) AS event_type FROM g GROUP BY 1")
def majority_vote(spark, sf_dir):
    return rel.majority(load(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("agg_by_content_type", with_inputs("chunks", "SELECT filing_type, count(*) AS n, count(DISTINCT company) AS companies FROM chunks GROUP BY 1"))
def by_content_type(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("filing_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("company").alias("companies"))


@query("agg_status_summary", "SELECT count(*) FILTER (o_orderstatus = 'F') AS ingested, count(*) FILTER (o_orderstatus = 'O') AS downloaded, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders")
def status_summary(spark, sf_dir):
    s = F.col("o_orderstatus")
    return load(spark, sf_dir, "orders").agg(*[F.count_if(s == k).alias(n) for k, n in (("F", "ingested"), ("O", "downloaded"), ("P", "failed"))])


@query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))


@query("agg_rollup", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup(spark, sf_dir):
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("srt_page", with_inputs("reports", "SELECT id, company_name FROM reports ORDER BY created_at DESC, id LIMIT 20 OFFSET 20"))
def page(spark, sf_dir):
    return rel.page(reports(spark, sf_dir), [F.desc("created_at"), F.col("id")], 2, 20).select("id", "company_name")


@query("srt_top_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_n(spark, sf_dir):
    return load(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "p_retailprice")


@query("srt_top_per_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark, sf_dir):
    return rel.top_per_group(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")


@query("srt_tail_messages", with_inputs("chat", "SELECT session_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM chat) WHERE n <= 3"))
def tail_messages(spark, sf_dir):
    return rel.tail(chat_messages(spark, sf_dir), ["session_id"], "turn", 3).select("session_id", "turn", "role")


@query("srt_in_list_order", "SELECT n_nationkey, n_name, list_position([7, 3, 12, 0], n_nationkey) - 1 AS place FROM nation WHERE n_nationkey IN (7, 3, 12, 0)")
def in_list_order(spark, sf_dir):
    return rel.in_list_order(load(spark, sf_dir, "nation"), "n_nationkey", [7, 3, 12, 0]).select("n_nationkey", "n_name", F.col("place").cast("int").alias("place"))


@query("srt_dedup_then_top", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) SELECT user_id, event_id, value FROM r WHERE n = 1 ORDER BY value DESC, event_id LIMIT 15")
def dedup_then_top(spark, sf_dir):
    d = rel.dedup_first(load(spark, sf_dir, "events"), [F.col("user_id")], [F.desc("value"), F.col("event_id")])
    return d.orderBy(F.desc("value"), "event_id").limit(15).select("user_id", "event_id", "value")


@query("set_union_all", "SELECT 'store' AS origin, doc_id AS id FROM documents UNION ALL SELECT 'web', page_id FROM pages")
def union_all(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.lit("store").alias("origin"), F.col("doc_id").alias("id")).unionByName(load(spark, sf_dir, "pages").select(F.lit("web").alias("origin"), F.col("page_id").alias("id")))


@query("set_union_distinct", with_inputs("chain", "SELECT ticker, strike FROM chain WHERE option_type = 'call' UNION SELECT ticker, strike FROM chain WHERE option_type = 'put'"))
def union_distinct(spark, sf_dir):
    c = chain(spark, sf_dir)
    return c.filter("option_type = 'call'").select("ticker", "strike").union(c.filter("option_type = 'put'").select("ticker", "strike")).distinct()


@query("set_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def difference(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'O'").select("o_custkey").subtract(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("set_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersect(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'O'").select("o_custkey").intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("set_array_ops", "WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS x FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS y FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT k, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS fresh, array_to_string(list_sort(list_filter(y, lambda v: NOT list_contains(x, v))), ',') AS resolved, array_to_string(list_sort(list_distinct(list_concat(x, y))), ',') AS both FROM a JOIN b USING (k)")
def array_ops(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    side = lambda s, c: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias(c))
    show = lambda a: F.array_join(F.array_sort(a), ",")
    return side("O", "x").join(side("F", "y"), "k").select("k", show(F.array_except("x", "y")).alias("fresh"), show(F.array_except("y", "x")).alias("resolved"), show(F.array_union("x", "y")).alias("both"))


@query("set_first_seen_order", "SELECT user_id, string_agg(event_type, ',' ORDER BY seen) AS types FROM (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY 1, 2) GROUP BY 1")
def first_seen_order(spark, sf_dir):
    # A user has a row for each type here, not for each event.
    first = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("seen"))
    g = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seen", "event_type"))).alias("e"))
    return g.select("user_id", F.array_join(F.transform("e", lambda x: x["event_type"]), ",").alias("types"))


@query("set_dedup_composite_key", with_inputs("chunks", "SELECT company, min(doc_id) AS doc_id, left(page_content, 50) AS head FROM chunks GROUP BY company, source_file, head"))
def dedup_composite_key(spark, sf_dir):
    head = F.substring("page_content", 1, 50)
    return rel.dedup_first(chunks(spark, sf_dir), [F.col("company"), F.col("source_file"), head], [F.col("doc_id")]).select("company", "doc_id", head.alias("head"))


@query("set_dedup_url_or_head", "WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE regexp_replace(url, '[?].*', '') END AS url, html FROM pages) SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY coalesce(nullif(url, ''), left(html, 100)) ORDER BY page_id) AS n FROM p) WHERE n = 1")
def dedup_url_or_head(spark, sf_dir):
    p = load(spark, sf_dir, "pages").withColumn("url", F.when(F.col("page_id") % 4 == 0, "").otherwise(F.regexp_replace("url", "[?].*", "")))
    return rel.dedup_first(p, [F.coalesce(F.nullif(F.col("url"), F.lit("")), F.substring("html", 1, 100))], [F.col("page_id")]).select("page_id")


@query("set_distinct_union_of_arrays", "SELECT DISTINCT c_nationkey, upper(c_mktsegment) AS ticker FROM customer")
def distinct_union_of_arrays(spark, sf_dir):
    g = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list("c_mktsegment").alias("names"))
    return g.select("c_nationkey", F.explode("names").alias("t")).select("c_nationkey", F.upper("t").alias("ticker")).distinct()


@query("set_routed_union", with_inputs("chat", "SELECT session_id, 'session' AS origin, agent_type AS bucket FROM (SELECT DISTINCT session_id, agent_type FROM chat) UNION ALL SELECT session_id, 'consolidated', CASE WHEN sum(token_count) > 400 THEN 'long' ELSE agent_type END FROM chat GROUP BY session_id, agent_type"))
def routed_union(spark, sf_dir):
    m = chat_messages(spark, sf_dir)
    a = m.select("session_id", F.lit("session").alias("origin"), F.col("agent_type").alias("bucket")).distinct()
    b = m.groupBy("session_id", "agent_type").agg(F.sum("token_count").alias("t")).select("session_id", F.lit("consolidated").alias("origin"), F.when(F.col("t") > 400, "long").otherwise(F.col("agent_type")).alias("bucket"))
    return a.unionByName(b)


@query("crud_apply_changes", "WITH c AS (SELECT user_id % 200 AS c_custkey, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'upsert' END AS op, value AS c_acctbal FROM events), l AS (SELECT c_custkey, arg_max(op, seq) AS op, arg_max(c_acctbal, seq) AS c_acctbal FROM c GROUP BY 1), b AS (SELECT c_custkey, c_acctbal FROM customer) SELECT coalesce(l.c_custkey, b.c_custkey) AS c_custkey, coalesce(l.c_acctbal, b.c_acctbal) AS c_acctbal FROM b FULL JOIN l ON b.c_custkey = l.c_custkey WHERE coalesce(op, 'upsert') <> 'delete'")
def apply_changes(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    changes = e.select((F.col("user_id") % 200).alias("c_custkey"), F.col("value").alias("c_acctbal"), F.when(F.col("event_type") == "purchase", "delete").otherwise("upsert").alias("op"), F.col("event_id").alias("seq"))
    return rel.apply_changes(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), changes, "c_custkey", "seq")


@query("win_rank_functions", "SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS q FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE))")
def rank_functions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_orderdate").cast("date"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")).alias("q"))
