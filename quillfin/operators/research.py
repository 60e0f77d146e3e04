"""Ratings, sentiment and comparison of research texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfin.functions.numbers import rnd
from quillfin.functions.text import KEYWORDS, direction, literal_count, lower_count, metric_rows, numeric_value, polarity_band, rating, tone

#: The default sentiment lexicon: words by polarity and subjectivity.
LEXICON = {
    (1.0, 1.0): "excellent outstanding superb exceptional best perfect stellar",
    (0.8, 0.8): "great strong stronger impressive remarkable record bullish upbeat thriving soaring surging",
    (0.6, 0.6): "good solid robust healthy favorable favourable positive optimistic confident attractive winning outperform outperforms beat beats win wins upgrade upgraded buy",
    (0.4, 0.5): "growth growing gain gains improve improved improves improving improvement better rise rises rising rally recovery recover momentum opportunity opportunities expand expanding expansion accelerate accelerating success successful efficient innovative",
    (0.2, 0.3): "stable steady resilient progress support supported benefit benefits higher up new profitable",
    (-0.2, 0.3): "slow slower lower down flat cautious uncertain uncertainty mixed volatile volatility pressure",
    (-0.4, 0.5): "decline declines declining fall falls falling drop drops dropping risk risks risky concern concerns headwind headwinds challenge challenges challenging delay delays shortfall slowdown downgrade downgraded miss misses missed sell",
    (-0.6, 0.6): "bad weak weaker weakness poor negative pessimistic unfavorable unfavourable loss losses losing worse underperform underperforms disappointing disappointed lawsuit probe warning debt-laden",
    (-0.8, 0.8): "terrible bearish plunge plunges plunging crash slump crisis fraud scandal bankrupt bankruptcy default collapse",
    (-1.0, 1.0): "worst awful horrible disastrous catastrophic worthless",
}


#: word: (polarity, subjectivity). Replace it by a larger one at will.
WORDS = {w: score for score, words in LEXICON.items() for w in words.split()}
#: Words that turn the next assessed word within NEGATION_REACH words: its polarity counts half, with the other sign.
NEGATIONS = tuple("not no never neither nor cannot without hardly scarcely isn aren wasn weren don doesn didn won wouldn couldn shouldn hasn haven hadn".split())
NEGATION_REACH, NEGATION_FACTOR = 3, -0.5
#: Factors of the assessed word right after.
DEGREES = {"very": 1.3, "extremely": 1.5, "highly": 1.4, "really": 1.2, "particularly": 1.2, "significantly": 1.4, "substantially": 1.4, "strongly": 1.4, "quite": 1.1, "too": 1.2, "fairly": 0.9, "somewhat": 0.7, "slightly": 0.6, "modestly": 0.7, "marginally": 0.5, "barely": 0.5}


def _valued(word: Column, values: dict) -> Column:
    """The value of a word, a number or a tuple of numbers, null for others. A lexicon has few distinct values: each is a set, looked up by hash."""
    sets: dict = {}
    for w, v in values.items():
        sets.setdefault(v, []).append(w)
    out = F.lit(None)
    for v, ws in sets.items():
        one = F.struct(*[F.lit(float(x)).alias(f"v{i}") for i, x in enumerate(v)]) if isinstance(v, tuple) else F.lit(float(v))
        out = F.when(word.isin(*ws), one).otherwise(out)
    return out


def scored(text: Column, words: dict[str, tuple[float, float]] = WORDS, negations: tuple[str, ...] = NEGATIONS, degrees: dict[str, float] = DEGREES) -> Column:
    """struct<p, s, n> of a text: polarity and subjectivity of its assessed words summed up in ten-thousandths, and their number.

    The text's words stay where they are: those of the lists are filtered from its word array with their places, and one fold over these
    carries the last negation and degree. Nothing is exploded or joined.
    """
    placed = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    kept = F.filter(placed, lambda x: x["w"].isin(*words, *negations, *degrees))
    # Looked up once each; null where a word is no such word.
    known = F.transform(kept, lambda x: F.struct(x["i"].alias("i"), (x["w"].isin(*negations) if negations else F.lit(False)).alias("negates"), (_valued(x["w"], degrees) if degrees else F.lit(None).cast("double")).alias("factor"), _valued(x["w"], words).alias("of")))
    units = lambda x: F.floor(F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 10_000 + 0.5)
    far = -NEGATION_REACH - 2

    def step(acc: Column, x: Column) -> Column:
        assessed = ~x["negates"] & x["factor"].isNull()
        near = F.when(acc["degree_at"] == x["i"] - 1, acc["factor"]).otherwise(1.0)
        sign = F.when(x["i"] - acc["negation_at"] <= NEGATION_REACH, NEGATION_FACTOR).otherwise(1.0)
        return F.struct(
            F.when(x["negates"], x["i"]).otherwise(acc["negation_at"]).alias("negation_at"),
            F.when(x["factor"].isNotNull(), x["i"]).otherwise(acc["degree_at"]).alias("degree_at"),
            F.coalesce(x["factor"], acc["factor"]).alias("factor"),
            (acc["p"] + F.when(assessed, units(x["of"]["v0"] * near * sign)).otherwise(0)).alias("p"),
            (acc["s"] + F.when(assessed, units(x["of"]["v1"] * near)).otherwise(0)).alias("s"),
            (acc["n"] + assessed.cast("int")).alias("n"),
        )

    start = F.struct(F.lit(far).alias("negation_at"), F.lit(far).alias("degree_at"), F.lit(1.0).alias("factor"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"))
    return F.aggregate(known, start, step, lambda a: F.struct(a["p"].alias("p"), a["s"].alias("s"), a["n"].alias("n")))


def sentiment(docs: DataFrame, words: dict[str, tuple[float, float]] = WORDS, negations: tuple[str, ...] = NEGATIONS, degrees: dict[str, float] = DEGREES) -> DataFrame:
    """Mean polarity and subjectivity of a document's assessed words, with negations and degrees, band and confidence; neutral without any."""
    d = docs.select("doc_id", scored(F.col("text"), words, negations, degrees).alias("x"))
    mean = lambda c: F.coalesce(F.when(F.col("x.n") > 0, F.col(c) / 10_000.0 / F.col("x.n")), F.lit(0.0))
    p, s = mean("x.p"), mean("x.s")
    return d.select("doc_id", rnd(p, 3).alias("polarity"), rnd(s, 3).alias("subjectivity"), polarity_band(p).alias("sentiment"), rnd(1 - s * 0.5, 3).alias("confidence"))


def keyword_counts(docs: DataFrame, dictionary: dict[str, tuple[str, ...]] = KEYWORDS) -> DataFrame:
    """doc_id, category, total: substring occurrences, so a word also counts inside a longer one."""
    # The text is put in lower case once, and only terms that it holds are counted.
    low = docs.select("doc_id", F.lower("text").alias("low"))
    count = lambda t: F.when(F.contains("low", F.lit(t)), lower_count(F.col("low"), t)).otherwise(F.when(F.col("low").isNotNull(), 0))
    totals = low.select("doc_id", *[sum((count(t) for t in terms), F.lit(0)).alias(c) for c, terms in dictionary.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("total")) for c in dictionary])
    return totals.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.category", "x.total")


def document_tone(docs: DataFrame, dictionary: dict[str, tuple[str, ...]] = KEYWORDS) -> DataFrame:
    """doc_id, word_count, totals, net score, ratio and tone."""
    total = lambda c: sum((literal_count(F.col("text"), t) for t in dictionary[c]), F.lit(0))
    d = docs.select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_count"), total("negative").alias("negative"), total("positive").alias("positive"))
    ratio, name = tone(F.col("positive"), F.col("negative"))
    return d.select("*", (F.col("positive") - F.col("negative")).alias("net"), rnd(ratio, 3).alias("ratio"), name.alias("tone"))


def headline_direction(headlines: DataFrame, key: str, **lexicon) -> DataFrame:
    """key, headlines, polarity (mean over its headlines) and the direction it points to. headlines: key, text; lexicon: as of `sentiment`."""
    p = sentiment(headlines.withColumn("doc_id", F.col(key)), **lexicon).select(F.col("doc_id").alias(key), "polarity")
    g = p.groupBy(key).agg(F.count(F.lit(1)).alias("headlines"), (F.sum(F.col("polarity").cast("decimal(9,4)")).cast("double") / F.count(F.lit(1))).alias("p"))
    return g.select(key, "headlines", rnd("p", 4).alias("polarity"), direction(F.col("p")).alias("direction"))


def comprehensive(ratings: DataFrame, results: DataFrame, most: int = 5, **lexicon) -> DataFrame:
    """Consensus of each symbol, the mean polarity of its `most` best results, and how many distinct addresses its results have, of which the first counts.

    results: symbol, doc_id, url, score, text.
    """
    w = Window.partitionBy("symbol", "url").orderBy(F.desc("score"), "doc_id")
    once = results.withColumn("n", F.row_number().over(w)).filter("n = 1")
    urls = once.groupBy("symbol").agg(F.count(F.lit(1)).alias("sources"))
    best = once.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "doc_id"))).filter(F.col("n") <= most)
    s = sentiment(best.select(F.col("symbol").alias("doc_id"), "text"), **lexicon)
    g = s.groupBy(F.col("doc_id").alias("symbol")).agg(rnd(F.sum(F.col("polarity").cast("decimal(9,4)")).cast("double") / F.count(F.lit(1)), 3).alias("polarity"))
    return aggregate_ratings(ratings).join(g, "symbol", "left").join(urls, "symbol", "left")


def aggregate_ratings(ratings: DataFrame, key: str = "symbol") -> DataFrame:
    """Mean score, consensus, mean target and distribution of each symbol."""
    r = ratings.withColumn("r", rating(F.col("rating")))
    n = lambda name: F.count_if(F.col("r.rating") == name).alias(name)
    target = F.when(F.col("target_price") != 0, F.col("target_price")).cast("decimal(18,2)")
    g = r.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("r.score").cast("decimal(9,2)")).cast("double") / F.count(F.lit(1))).alias("s"), rnd(F.sum(target).cast("double") / F.count(target), 4).alias("avg_target"), *[n(x) for x in ("strong_buy", "buy", "hold", "sell", "strong_sell")])
    consensus = F.when(F.col("s") >= 4.5, "Strong Buy").when(F.col("s") >= 3.5, "Buy").when(F.col("s") >= 2.5, "Hold").when(F.col("s") >= 1.5, "Sell").otherwise("Strong Sell")
    return g.select(key, "n", rnd("s", 4).alias("avg_score"), consensus.alias("consensus"), "avg_target", "strong_buy", "buy", "hold", "sell", "strong_sell")


def rating_actions(ratings: DataFrame) -> DataFrame:
    """initiate, upgrade, downgrade or maintain against the firm's previous rating of the symbol."""
    r = ratings.withColumn("score", rating(F.col("rating"))["score"])
    before = F.lag("score").over(Window.partitionBy("firm", "symbol").orderBy("ts", "event_id"))
    action = F.when(before.isNull(), "initiate").when(F.col("score") > before, "upgrade").when(F.col("score") < before, "downgrade").otherwise("maintain")
    return r.select("event_id", "firm", "symbol", "score", action.alias("action"))


def latest_per_firm(ratings: DataFrame, as_of: str, months: int) -> DataFrame:
    """The latest rating of each firm and symbol within so many months before as_of."""
    cut = F.add_months(F.lit(as_of).cast("date"), -months).cast("timestamp_ntz")
    w = Window.partitionBy("firm", "symbol").orderBy(F.desc("ts"), F.desc("event_id"))
    return ratings.filter(F.col("ts") >= cut).withColumn("n", F.row_number().over(w)).filter("n = 1").select("firm", "symbol", "ts", "rating", "target_price")


def trend(confidence: Column, sentiment_change: Column) -> Column:
    """Quarter-over-quarter trend. The last name cannot be reached; it stays for completeness."""
    return (
        F.when((confidence >= 2) & (sentiment_change >= 1), "significantly_more_positive")
        .when((confidence >= 1) | (sentiment_change >= 1), "more_positive")
        .when((F.abs(confidence) < 1) & (F.abs(sentiment_change) < 1), "stable")
        .when((confidence <= -1) | (sentiment_change <= -1), "more_negative")
        .otherwise("significantly_more_negative")
    )


def quarter_over_quarter(scores: DataFrame, key: str, order: str) -> DataFrame:
    """Change of confidence and sentiment against the key's previous row, and the trend."""
    w = Window.partitionBy(key).orderBy(order)
    d = scores.withColumn("confidence_change", F.col("confidence") - F.lag("confidence").over(w)).withColumn("sentiment_change", F.col("sentiment") - F.lag("sentiment").over(w))
    return d.filter("confidence_change is not null").select(key, order, "confidence_change", "sentiment_change", trend(F.col("confidence_change"), F.col("sentiment_change")).alias("trend"))


def comparison_chart(answers: DataFrame, most: int = 8) -> DataFrame:
    """The first metrics of a comparison table with a number for any company; missing ones are 0."""
    rows = answers.select("doc_id", F.posexplode(metric_rows(F.col("text"))).alias("place", "r")).select("doc_id", "place", "r.metric", *[numeric_value(F.col(f"r.company{i}")).alias(f"v{i}") for i in (1, 2, 3)])
    rows = rows.filter("coalesce(v1, v2, v3) is not null").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))).filter(F.col("n") <= most)
    return rows.select("doc_id", "n", "metric", *[F.coalesce(f"v{i}", F.lit(0.0)).alias(f"v{i}") for i in (1, 2, 3)])


def target_message(ratings: DataFrame, key: str = "symbol") -> DataFrame:
    """'low - mean - high' of target prices in words."""
    t = F.col("target_price").cast("decimal(18,2)")
    g = ratings.groupBy(key).agg(F.min(t).alias("lo"), (F.sum(t).cast("double") / F.count(t)).alias("mid"), F.max(t).alias("hi"))
    show = lambda c: F.format_string("%.2f", rnd(c, 2))
    return g.select(key, F.concat(F.lit("Target price: low "), show(F.col("lo").cast("double")), F.lit(", mean "), show("mid"), F.lit(", high "), show(F.col("hi").cast("double"))).alias("message"))


def last_reply(messages: DataFrame, hand_off: str = r"^(?i)transferring") -> DataFrame:
    """Each session's last assistant message that is no hand-off."""
    m = messages.filter((F.col("role") == "assistant") & ~F.col("content").rlike(hand_off))
    return m.groupBy("session_id").agg(F.max("turn").alias("turn"), F.max_by("content", "turn").alias("content"))
