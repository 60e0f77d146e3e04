"""Text queries: over whole documents, conversations, and notes and file names made of the columns of orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfin.adapters import SQL, filing_names, load, nation_companies, notes, option_notes, ratings, with_inputs
from quillfin.functions import text as tx
from quillfin.functions.numbers import rnd
from quillfin.operators import research as rs
from quillfin.plans.registry import query
from quillfin.session import register_functions

_q = lambda s: "'" + s.replace("'", "''") + "'"


def texts(spark, sf_dir):
    """id, text: notes on orders, turns of conversations and documents."""
    n = notes(spark, sf_dir).select(F.concat(F.lit("o"), "id").alias("id"), "text")
    c = load(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), "text")
    d = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return n.unionByName(c).unionByName(d).filter("text is not null")


_T = f"{SQL['notes']}, t AS (SELECT * FROM (SELECT 'o' || id AS id, text FROM notes UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations UNION ALL SELECT 'd' || doc_id, text FROM documents) WHERE text IS NOT NULL)"


def _any(terms, c: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(t)})" for t in terms) + ")"


@query("txt_years", f"WITH {_T} SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(20[0-2][0-9])\\b', 1))), ',') AS years FROM t")
def years(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.array_join(tx.years_in(F.col("text")).cast("array<string>"), ",").alias("years"))


@query("txt_filing_types", f"WITH {_T} SELECT id, concat_ws(',', CASE WHEN regexp_matches(lower(text), '\\b10-?k\\b') OR {_any(tx.FORM_10K)} THEN '10-K' END, CASE WHEN regexp_matches(lower(text), '\\b10-?q\\b') OR {_any(tx.FORM_10Q)} THEN '10-Q' END, CASE WHEN regexp_matches(lower(text), '\\b8-?k\\b') OR {_any(tx.FORM_8K)} THEN '8-K' END) AS types FROM t")
def filing_types(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.array_join(tx.filing_types_in(F.col("text")), ",").alias("types"))


_WORDS = ", ".join(f"CASE WHEN contains(lower(text), '{p}') THEN '{q}' END" for p, q in tx.QUARTER_WORDS)


@query("txt_quarters", f"WITH {_T} SELECT id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(lower(text), '\\bq([1-4])\\b', 1), list_filter([{_WORDS}], lambda x: x IS NOT NULL)))), ',') AS quarters FROM t")
def quarters(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.array_join(tx.quarters_in(F.col("text")).cast("array<string>"), ",").alias("quarters"))


@query("txt_intents", f"WITH {_T} SELECT id, CASE WHEN {_any(tx.GEOGRAPHIC)} THEN 'geographic' WHEN {_any(tx.SEGMENT)} THEN 'segment' ELSE 'none' END AS part, CASE WHEN {_any(tx.SCENARIO)} THEN 'scenario' WHEN {_any(tx.MACRO)} THEN 'macro' WHEN {_any(tx.INSIDER)} THEN 'insider' ELSE 'document' END AS intent, CASE WHEN {_any(tx.REALTIME)} THEN 'web_search' ELSE 'vectorstore' END AS route FROM t")
def intents(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir).select("id", tx.segment_or_geographic(t).alias("part"), tx.intent(t).alias("intent"), tx.route(t).alias("route"))


def _rating(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(terms, c)} THEN '{n}'" for n, _, terms in tx.RATING_TERMS) + " ELSE 'hold' END"


_SCORE = "CASE {x} WHEN 'strong_buy' THEN 5.0 WHEN 'buy' THEN 4.0 WHEN 'hold' THEN 3.0 WHEN 'sell' THEN 2.0 ELSE 1.0 END::DOUBLE"


@query("txt_rating", f"WITH {_T}, r AS (SELECT id, {_rating('lower(trim(text))')} AS rating FROM t) SELECT id, rating, {_SCORE.format(x='rating')} AS score FROM r")
def rating(spark, sf_dir):
    return texts(spark, sf_dir).select("id", tx.rating(F.col("text")).alias("r")).select("id", "r.rating", "r.score")


def _count(terms, c: str = "lower(text)") -> str:
    return "(" + " + ".join(f"(length({c}) - length(replace({c}, {_q(t)}, ''))) // {len(t)}" for t in terms) + ")"


_TONE = "CASE WHEN r > 1.5::DOUBLE THEN 'bullish' WHEN r > 1.1::DOUBLE THEN 'slightly_bullish' WHEN r > 0.9::DOUBLE THEN 'neutral' WHEN r > 0.67::DOUBLE THEN 'slightly_bearish' ELSE 'bearish' END"


@query("txt_keyword_counts", f"WITH {_T} SELECT id AS doc_id, category, CAST(total AS INTEGER) AS total FROM (" + " UNION ALL ".join(f"SELECT id, '{c}' AS category, {_count(terms)} AS total FROM t" for c, terms in tx.KEYWORDS.items()) + ")")
def keyword_counts(spark, sf_dir):
    return rs.keyword_counts(texts(spark, sf_dir).withColumnRenamed("id", "doc_id"))


@query("txt_keyword_hits_sql", f"WITH {_T} SELECT category, term, CAST(sum(hits) AS BIGINT) AS hits FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS category, {_q(w)} AS term, {_count([w])} AS hits FROM t" for c, terms in tx.KEYWORDS.items() for w in terms) + ") GROUP BY 1, 2 HAVING sum(hits) > 0")
def keyword_hits_sql(spark, sf_dir):
    """The table function on each text, from SQL."""
    register_functions(spark)
    texts(spark, sf_dir).createOrReplaceTempView("quillfin_texts")
    return spark.sql("SELECT category, term, sum(hits) AS hits FROM quillfin_texts, LATERAL keyword_hits(text) GROUP BY category, term")


_DATA_WORDS = {"negative": ("idiot", "trash", "worthless", "er th"), "positive": ("the", "ion", "on th", "avec")}


@query("txt_document_tone", f"WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS w, {_count(_DATA_WORDS['negative'])} AS n, {_count(_DATA_WORDS['positive'])} AS p FROM documents), r AS (SELECT *, (p + 1) / (n + 1)::DOUBLE AS r FROM d) SELECT doc_id, CAST(w AS INTEGER) AS word_count, CAST(n AS INTEGER) AS negative, CAST(p AS INTEGER) AS positive, CAST(p - n AS INTEGER) AS net, round(r, 3) AS ratio, {_TONE} AS tone FROM r")
def document_tone(spark, sf_dir):
    return rs.document_tone(load(spark, sf_dir, "documents"), _DATA_WORDS)


#: The default lexicon with words of the data, and words of the data that stand for negations and degrees.
LEX = {"words": rs.WORDS | {"the": (0.5, 0.2), "of": (-0.25, 0.4), "idiot": (-1.0, 1.0), "que": (0.75, 0.5), "der": (-0.5, 0.1)}, "negations": (*rs.NEGATIONS, "pour", "by"), "degrees": rs.DEGREES | {"avec": 1.4, "with": 0.3, "las": 1.2}}
_UNITS = "CAST(floor(least(greatest({}, -1::DOUBLE), 1::DOUBLE) * 10000 + 0.5::DOUBLE) AS BIGINT)"
#: pol: mean polarity p and subjectivity s of documents that have assessed words.
POLARITY = f"""lw(word, polarity, subjectivity) AS (VALUES {', '.join(f"('{w}', {p}::DOUBLE, {s}::DOUBLE)" for w, (p, s) in LEX['words'].items())}), dw(word, factor) AS (VALUES {', '.join(f"('{w}', {x}::DOUBLE)" for w, x in LEX['degrees'].items())}), nw(word) AS (VALUES {', '.join(f"('{w}')" for w in LEX['negations'])}),
tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\w+') AS w FROM documents)),
k AS (SELECT doc_id, i, polarity, subjectivity, factor, nw.word IS NOT NULL AS negates FROM tok LEFT JOIN lw USING (word) LEFT JOIN dw USING (word) LEFT JOIN nw USING (word) WHERE polarity IS NOT NULL OR factor IS NOT NULL OR nw.word IS NOT NULL),
z AS (SELECT *, CASE WHEN lag(i) OVER v = i - 1 THEN coalesce(CASE WHEN NOT lag(negates) OVER v THEN lag(factor) OVER v END, 1) ELSE 1 END AS near, CASE WHEN i - max(CASE WHEN negates THEN i END) OVER v <= {rs.NEGATION_REACH} THEN {rs.NEGATION_FACTOR} ELSE 1 END::DOUBLE AS sign FROM k WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
pol AS (SELECT doc_id, sum({_UNITS.format('polarity * near * sign')}) / 10000::DOUBLE / count(*) AS p, sum({_UNITS.format('subjectivity * near')}) / 10000::DOUBLE / count(*) AS s FROM z WHERE polarity IS NOT NULL AND factor IS NULL AND NOT negates GROUP BY 1)"""
_P = "coalesce(p, 0)"


@query("txt_sentiment", f"WITH {POLARITY} SELECT doc_id, round({_P}, 3) AS polarity, round(coalesce(s, 0), 3) AS subjectivity, CASE WHEN {_P} > 0.3::DOUBLE THEN 'bullish' WHEN {_P} > 0.1::DOUBLE THEN 'slightly_bullish' WHEN {_P} > -0.1::DOUBLE THEN 'neutral' WHEN {_P} > -0.3::DOUBLE THEN 'slightly_bearish' ELSE 'bearish' END AS sentiment, round(1 - coalesce(s, 0) * 0.5::DOUBLE, 3) AS confidence FROM documents LEFT JOIN pol USING (doc_id)")
def sentiment(spark, sf_dir):
    return rs.sentiment(load(spark, sf_dir, "documents"), **LEX)


@query("txt_file_metadata", f"""WITH {SQL['filing_names']}, {SQL['nation_companies']}, c AS (SELECT ticker, min(company) AS company FROM nation_companies GROUP BY 1), b AS (SELECT id, name, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS bare FROM filing_names),
s AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '[-_.]', ' ', 'g'), '\\b(19|20)\\d{{2}}\\b', '', 'g'), '\\b\\d{{6,}}\\b', '', 'g'), '\\b(10[-\\s]?[kq]|8[-\\s]?k|annual|quarterly|report)\\b', '', 'gi'), '\\b\\d{{1,2}}\\b', '', 'g'), '\\s+\\d+\\s*$', '', 'g'), '\\s+', ' ', 'g')) AS company, regexp_replace(name, '[-_.]', ' ', 'g') AS spaced FROM b),
l AS (SELECT id, spaced, lower(CASE WHEN company = '' THEN bare ELSE company END) AS own FROM s)
SELECT id, CASE WHEN c.company IS NOT NULL THEN c.company || substr(own, length(split_part(own, ' ', 1)) + 1) ELSE own END AS company, CASE WHEN regexp_matches(spaced, '\\b10\\s?k\\b', 'i') THEN '10-K' WHEN regexp_matches(spaced, '\\b10\\s?q\\b', 'i') THEN '10-Q' WHEN regexp_matches(spaced, '\\b8\\s?k\\b', 'i') THEN '8-K' END AS filing_type FROM l LEFT JOIN c ON c.ticker = split_part(own, ' ', 1)""")
def file_metadata(spark, sf_dir):
    from quillfin.operators.relational import company_of_files

    return company_of_files(filing_names(spark, sf_dir), nation_companies(spark, sf_dir)).select("id", "company", tx.filing_type_of_file(F.col("name")).alias("filing_type"))


@query("txt_ticker_in_text", f"""WITH {_T}, {SQL['nation_companies']}, c AS (SELECT * FROM nation_companies), q AS (SELECT id AS question_id, text AS question FROM t WHERE id[1] <> 'd'), w AS (SELECT question_id, lower(question) AS low, list_transform(string_split(trim(regexp_replace(question, '\\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[,.?!"'']+|[,.?!"'']+$', '', 'g')) AS w FROM q),
one AS (SELECT question_id, upper(arg_min(x, i)) AS t FROM (SELECT question_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w) WHERE lower(x) IN (SELECT ticker FROM c) GROUP BY 1),
two AS (SELECT question_id, upper(arg_min(ticker, ordinal)) AS t FROM w JOIN c ON regexp_matches(low, '\\b' || company || '\\b') GROUP BY 1)
SELECT question_id, coalesce(one.t, two.t, upper(list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}{{2,5}}'))[1])) AS ticker FROM w LEFT JOIN one USING (question_id) LEFT JOIN two USING (question_id)""")
def ticker_in_text(spark, sf_dir):
    from quillfin.operators.relational import ticker_in_text as find

    asked = texts(spark, sf_dir).filter("not startswith(id, 'd')").select(F.col("id").alias("question_id"), F.col("text").alias("question"))
    return find(asked, nation_companies(spark, sf_dir))


@query("txt_numbers", f"""WITH {_T} SELECT id, regexp_matches(text, '\\$\\s?[\\d,]+(?:\\.\\d+)?|\\b\\d+(?:\\.\\d+)?\\s?%|\\b\\d+(?:\\.\\d+)?\\s?(?:million|billion|trillion)\\b', 'i') AS claim,
CASE WHEN NOT {_any(('not specified', 'n/a', 'various', 'brief summary'))} THEN TRY_CAST(replace(regexp_extract(lower(trim(text)), '(-?[\\d,]+\\.?\\d*)', 1), ',', '') AS DOUBLE) END AS value, TRY_CAST(nullif(regexp_replace(text, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS digits FROM t""")
def numbers(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir).select("id", tx.has_numeric_claim(t).alias("claim"), tx.numeric_value(t).alias("value"), tx.digits_value(t).alias("digits"))


def _sql_claims() -> str:
    q = lambda p: _q(p.replace("(?i)", ""))
    first = lambda ps: "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {q(p)}, 1, 'i'), '')" for p in ps) + ")"
    named = lambda ns: "CASE " + " ".join(f"WHEN regexp_matches(text, {q(p)}, 'i') THEN '{n}'" for p, n in ns) + " END"
    levels = lambda word: f"array_to_string(list_transform(regexp_extract_all(text, {q(word + tx.LEVEL_CLAIM)}, 1, 'i'), lambda x: (x::DOUBLE)::VARCHAR), ',')"
    find = lambda g: f"regexp_extract_all(text, {q(tx.VOLUME_CLAIM)}, {g}, 'i')"
    # Where the i-th claim begins: what lies before it, found by taking the claims before it away one by one.
    starts = "list_transform(w, lambda x, i: CAST(list_sum(list_transform(range(1, i + 1), lambda k: length(split_at[k]))) + coalesce(list_sum(list_transform(range(1, i), lambda k: length(w[k]))), 0) AS BIGINT))"
    kind = "CASE WHEN contains(lower(substr(text, greatest(pos[i] - 100, 0) + 1, least(pos[i], 100) + length(x))), 'put') THEN 'put' ELSE 'call' END"
    one = f"(st[i]::DOUBLE)::VARCHAR || ':' || replace(vo[i], ',', '') || ':' || {kind}"
    gaps = f"regexp_split_to_array(text, {_q(tx.VOLUME_CLAIM)})"
    return f"""WITH {SQL['option_notes']}, t AS (SELECT * FROM option_notes), m AS (SELECT id, text, {find(0)} AS w, {find(1)} AS st, {find(2)} AS vo, {gaps} AS split_at FROM t), s AS (SELECT *, {starts} AS pos FROM m)
SELECT id, {first(tx.RATIO_CLAIMS)}::DOUBLE AS pc_ratio, coalesce(lower({first([tx.STATED_SENTIMENT])}), {named(tx.SEEN_SENTIMENT)}) AS sentiment, {levels('support')} AS support, {levels('resistance')} AS resistance,
array_to_string(list_transform(w, lambda x, i: {one}), ',') AS volumes, {named(tx.OUTLOOKS)} AS shape FROM s"""


@query("txt_option_claims", _sql_claims())
def option_claims(spark, sf_dir):
    c = option_notes(spark, sf_dir).select("id", tx.claims(F.col("text")).alias("c"))
    volumes = F.array_join(F.transform("c.volumes", lambda v: F.concat_ws(":", v["strike"].cast("string"), v["volume"].cast("string"), v["type"])), ",")
    return c.select("id", "c.pc_ratio", "c.sentiment", F.array_join(F.col("c.support").cast("array<string>"), ",").alias("support"), F.array_join(F.col("c.resistance").cast("array<string>"), ",").alias("resistance"), volumes.alias("volumes"), "c.shape")


@query("txt_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, sha256(source || ':' || doc_id) AS key FROM documents")
def hashes(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"), F.sha2(F.concat_ws(":", "source", "doc_id"), 256).alias("key"))


@query("txt_uuid5", "WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id::VARCHAR)) AS h FROM documents) SELECT doc_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h")
def uuid5(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tx.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.col("doc_id").cast("string")).alias("point_id"))


@query("txt_keyword_overlap", "WITH q(qid, query) AS (VALUES (1, 'the worthless clown'), (2, 'an of que'), (3, 'pour avec dans')) SELECT qid, doc_id FROM documents, q WHERE len(list_filter(string_split(lower(query), ' '), lambda w: length(w) > 3 AND contains(lower(text), w))) > 0")
def keyword_overlap(spark, sf_dir):
    q = spark.createDataFrame([(1, "the worthless clown"), (2, "an of que"), (3, "pour avec dans")], "qid int, query string")
    return load(spark, sf_dir, "documents").crossJoin(F.broadcast(q)).filter(tx.keyword_overlap(F.col("query"), F.col("text"))).select("qid", "doc_id")


def _sql_filled(templates, kind: str | None = None) -> str:
    text = "t"
    for name, value in (("company", "s_name"), ("end", "e"), ("balance", "b"), ("prior", "(y - 1)::VARCHAR"), ("years", "ys"), ("year", "y::VARCHAR")):
        text = f"replace({text}, '{{{name}}}', {value})"
    rows = ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(templates))
    return f"SELECT s_suppkey, CAST(i AS INTEGER) AS place, {text} AS q FROM s, (VALUES {rows}) d(i, t)" + (f" WHERE kind = '{kind}'" if kind else "")


@query("txt_subqueries", f"WITH s AS (SELECT s_suppkey, s_name, 2024 AS y, CASE WHEN s_nationkey % 4 = 0 THEN 'fiscal year 2024 annual period' ELSE 'year ended December 31 2024' END AS e, CASE WHEN s_nationkey % 4 = 0 THEN 'as of fiscal year end 2024' ELSE 'as of December 31 2024' END AS b, '' AS ys FROM supplier) {_sql_filled(tx.COMPARISON)}")
def subqueries(spark, sf_dir):
    fye = F.when(F.col("s_nationkey") % 4 == 0, 9)
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(tx.comparison_searches(F.col("s_name"), F.lit(2024), fye)).alias("place", "q"))


@query("txt_disclosure_searches", f"WITH s AS (SELECT s_suppkey, s_name, 2024 AS y, '' AS e, '' AS b, 'for years 2022, ' || (2022 + s_suppkey % 3 + 1) AS ys, CASE s_suppkey % 3 WHEN 0 THEN 'segment' WHEN 1 THEN 'geographic' ELSE 'none' END AS kind FROM supplier) {_sql_filled(tx.SEGMENT_SEARCHES, 'segment')} UNION ALL {_sql_filled(tx.GEOGRAPHIC_SEARCHES, 'geographic')}")
def disclosure_searches(spark, sf_dir):
    years = F.array(F.lit(2022), (F.lit(2023) + F.col("s_suppkey") % 3).cast("int"))
    kind = tx.segment_or_geographic(F.when(F.col("s_suppkey") % 3 == 0, "reportable segment margins").when(F.col("s_suppkey") % 3 == 1, "revenue by region").otherwise("revenue"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(tx.disclosure_searches(F.col("s_name"), years, kind)).alias("place", "q"))


@query("txt_field_coalesce", "SELECT page_id, coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN '' ELSE url END, ''), nullif(left(html, 20), '')) AS content FROM pages")
def field_coalesce(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "").otherwise(F.col("url")).alias("a"), F.substring("html", 1, 20).alias("b"))
    return p.select("page_id", tx.first_field("a", "b").alias("content"))


@query("txt_truncated_sources", "SELECT doc_id, coalesce(source, 'unknown') || ': ' || left(text, 500) AS line FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 20")
def truncated_sources(spark, sf_dir):
    from quillfin.operators.relational import top_per_group

    d = top_per_group(load(spark, sf_dir, "documents"), ["lang"], [F.col("doc_id")], 20)
    return d.select("doc_id", F.concat_ws(": ", F.coalesce("source", F.lit("unknown")), F.substring("text", 1, 500)).alias("line"))


@query("txt_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("txt_records_to_json", "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS j FROM nation")
def records_to_json(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("j"))


#: Ratings of each symbol as a select over the input `ratings`.
AGGREGATED = f"""WITH r AS (SELECT symbol, {_rating('lower(trim(rating))')} AS r, target_price AS t FROM ratings), s AS (SELECT *, {_SCORE.format(x='r')} AS score FROM r),
g AS (SELECT symbol, count(*) AS n, sum(score) / count(*) AS s, round(CAST(sum(CASE WHEN t <> 0 THEN CAST(t AS DECIMAL(18,2)) END) AS DOUBLE) / count(CASE WHEN t <> 0 THEN 1 END), 4) AS avg_target, {', '.join(f"count(*) FILTER (r = '{x}') AS {x}" for x in ('strong_buy', 'buy', 'hold', 'sell', 'strong_sell'))} FROM s GROUP BY 1)
SELECT symbol, n, round(s, 4) AS avg_score, CASE WHEN s >= 4.5 THEN 'Strong Buy' WHEN s >= 3.5 THEN 'Buy' WHEN s >= 2.5 THEN 'Hold' WHEN s >= 1.5 THEN 'Sell' ELSE 'Strong Sell' END AS consensus, avg_target, strong_buy, buy, hold, sell, strong_sell FROM g"""


@query("res_aggregate_ratings", with_inputs("ratings", f"SELECT * FROM ({AGGREGATED})"))
def aggregate_ratings(spark, sf_dir):
    return rs.aggregate_ratings(ratings(spark, sf_dir))


@query("res_rating_actions", with_inputs("ratings", f"""
, s AS (SELECT event_id, firm, symbol, ts, {_SCORE.format(x=_rating('lower(trim(rating))'))} AS score FROM ratings), l AS (SELECT *, lag(score) OVER (PARTITION BY firm, symbol ORDER BY ts, event_id) AS b FROM s)
SELECT event_id, firm, symbol, score, CASE WHEN b IS NULL THEN 'initiate' WHEN score > b THEN 'upgrade' WHEN score < b THEN 'downgrade' ELSE 'maintain' END AS action FROM l"""))
def rating_actions(spark, sf_dir):
    return rs.rating_actions(ratings(spark, sf_dir))


@query("res_latest_per_firm", with_inputs("ratings", "SELECT firm, symbol, ts::VARCHAR AS ts, rating, target_price FROM (SELECT *, row_number() OVER (PARTITION BY firm, symbol ORDER BY ts DESC, event_id DESC) AS n FROM ratings WHERE ts >= DATE '2024-03-20' - INTERVAL 2 MONTH) WHERE n = 1"))
def latest_per_firm(spark, sf_dir):
    return rs.latest_per_firm(ratings(spark, sf_dir), "2024-03-20", 2)


@query("res_quarter_over_quarter", """WITH s AS (SELECT event_type AS k, strftime(ts, '%Y-%m-%d') AS d, CAST(count(*) % 7 AS INTEGER) AS confidence, CAST(count(*) % 5 AS INTEGER) AS sentiment FROM events GROUP BY 1, 2),
c AS (SELECT k, d, confidence - lag(confidence) OVER w AS confidence_change, sentiment - lag(sentiment) OVER w AS sentiment_change FROM s WINDOW w AS (PARTITION BY k ORDER BY d))
SELECT *, CASE WHEN confidence_change >= 2 AND sentiment_change >= 1 THEN 'significantly_more_positive' WHEN confidence_change >= 1 OR sentiment_change >= 1 THEN 'more_positive' WHEN abs(confidence_change) < 1 AND abs(sentiment_change) < 1 THEN 'stable' WHEN confidence_change <= -1 OR sentiment_change <= -1 THEN 'more_negative' ELSE 'significantly_more_negative' END AS trend FROM c WHERE confidence_change IS NOT NULL""")
def quarter_over_quarter(spark, sf_dir):
    n = F.count(F.lit(1))
    s = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("d")).agg((n % 7).cast("int").alias("confidence"), (n % 5).cast("int").alias("sentiment"))
    return rs.quarter_over_quarter(s, "k", "d")


@query("res_target_message", with_inputs("ratings", "SELECT symbol, printf('Target price: low %.2f, mean %.2f, high %.2f', min(target_price), round(CAST(sum(CAST(target_price AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2), max(target_price)) AS message FROM ratings GROUP BY 1"))
def target_message(spark, sf_dir):
    return rs.target_message(ratings(spark, sf_dir))


@query("res_last_reply", with_inputs("chat", "SELECT session_id, max(turn) AS turn, arg_max(content, turn) AS content FROM chat WHERE role = 'assistant' AND NOT regexp_matches(content, '^transferring', 'i') GROUP BY 1"))
def last_reply(spark, sf_dir):
    from quillfin.adapters import chat_messages

    return rs.last_reply(chat_messages(spark, sf_dir))
