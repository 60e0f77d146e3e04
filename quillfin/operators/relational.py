"""Filters, joins, aggregates, sorts and set operations of reports, chats and filings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfin.operators.containment import containing, phrased

# ---- filters ----


def optional_filters(df: DataFrame, equal: dict | None = None, like: dict | None = None, within: dict | None = None) -> DataFrame:
    """AND of the filters whose argument is given: equality, substring in any case (wildcards of the argument count), inclusive ranges."""
    for c, v in (equal or {}).items():
        if v not in (None, "", []):
            df = df.filter(F.col(c).isin(v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    for c, v in (like or {}).items():
        if v:
            df = df.filter(F.col(c).ilike(f"%{v}%"))
    for c, (lo, hi) in (within or {}).items():
        if lo is not None:
            df = df.filter(F.col(c) >= F.lit(lo))
        if hi is not None:
            df = df.filter(F.col(c) <= F.lit(hi))
    return df


def filter_or_all(df: DataFrame, keep: Column) -> DataFrame:
    """Rows that pass, or all rows if none does; one plan, decided by a scalar the optimizer broadcasts."""
    passed = df.agg(F.coalesce(F.max(keep), F.lit(False)).alias("_some"))
    return df.crossJoin(F.broadcast(passed)).filter(keep | ~F.col("_some")).drop("_some")


def normalise_names(names: Column) -> Column:
    """Trimmed lower-case names, blank ones dropped."""
    return F.filter(F.transform(names, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def select_rows(df: DataFrame, key: str, order: list[Column], label: str, selection: str) -> DataFrame:
    """Rows by a selection such as '1-4,fy2024,2025q1' or 'all': places in a company's (key's) list in the given order, ranges of them, or labels."""
    raw = selection.strip().lower()
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("row", F.row_number().over(w))
    if raw in ("all", "*"):
        return rows
    parts = [p.strip() for p in raw.split(",") if p.strip()]
    hits = []
    for p in parts:
        hits.append(F.coalesce(F.lower(label) == p, F.lit(False)))
        lo, dash, hi = p.partition("-")
        if p.isdigit():
            hits.append(F.col("row") == int(p))
        elif dash and lo.isdigit() and hi.isdigit():
            hits.append(F.col("row").between(int(lo), int(hi)))
    return rows.filter(reduce(lambda a, b: a | b, hits, F.lit(False)))


# ---- joins ----


def outer_zero(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer equi-join with missing numbers as 0."""
    return a.join(b, keys, "full").fillna(0)


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Parents with the array of their children in order (empty if none)."""
    cols = [c for c in children.columns if c != key]
    first = [order] + [c for c in cols if c != order]
    g = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*first))).alias(name))
    return parents.join(g, key, "left").withColumn(name, F.coalesce(name, F.array().cast(g.schema[name].dataType)))


def lookup_name(df: DataFrame, users: DataFrame, ref: str) -> DataFrame:
    """display_name: the user whose id, else whose username, the reference is (full name before username), else the reference itself."""
    by_id = users.select(F.col("id").cast("string").alias(ref), F.coalesce("full_name", "username").alias("_by_id"))
    by_name = users.select(F.col("username").alias(ref), F.coalesce("full_name", "username").alias("_by_name"))
    return df.join(by_id, ref, "left").join(by_name, ref, "left").withColumn("display_name", F.coalesce("_by_id", "_by_name", ref)).drop("_by_id", "_by_name")


def resolve_ticker(names: DataFrame, companies: DataFrame) -> DataFrame:
    """name -> ticker: exact company name, else the first company (by ordinal) that contains the name or is contained in it, else ''. Both containments are joins on shared character grams.

    companies: ordinal (unique), ticker, company.
    """
    n = names.select("name").distinct().withColumn("key", F.lower(F.trim("name")))
    keys = n.select("key").filter("key <> ''").distinct()
    c = companies.select("ordinal", "ticker", F.lower("company").alias("company"))
    inside = containing(c.select(F.col("ordinal").alias("text_id"), F.col("company").alias("text")), keys.select(F.col("key").alias("name_id"), F.col("key").alias("name"))).select(F.col("name_id").alias("key"), F.col("text_id").alias("ordinal"))
    around = containing(keys.select(F.col("key").alias("text_id"), F.col("key").alias("text")), c.select(F.col("ordinal").alias("name_id"), F.col("company").alias("name"))).select(F.col("text_id").alias("key"), F.col("name_id").alias("ordinal"))
    hits = inside.unionByName(around).join(c, "ordinal")
    best = hits.groupBy("key").agg(F.min_by("ticker", F.struct(F.col("company") != F.col("key"), F.col("ordinal"))).alias("ticker"))
    return n.join(best, "key", "left").select("name", F.coalesce(F.element_at(F.split("ticker", "_"), 1), F.lit("")).alias("ticker"))


#: Words of a company's name that do not stand for it.
COMMON_NAME_WORDS = ("corporation", "company", "group", "inc")


def mentions(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(question_id, ticker) of the companies that a question names: the ticker as a word, one of the company's names within, or a word of over three letters of a name as a word.

    questions: question_id (unique), question; companies: ticker, company (a ticker may have several names).
    """
    q = questions.select(F.col("question_id").alias("text_id"), F.lower("question").alias("text"))
    c = companies.select("ticker", F.lower("company").alias("company"))
    tickers = c.select("ticker", F.lower("ticker").alias("phrase"))
    words = c.select("ticker", F.explode(F.split("company", r"\s+")).alias("phrase")).filter((F.length("phrase") > 3) & ~F.col("phrase").isin(*COMMON_NAME_WORDS))
    phrases = tickers.unionByName(words).distinct()
    by_phrase = phrased(q, phrases.select(F.col("phrase").alias("name_id"), F.col("phrase").alias("name")).distinct()).join(phrases, F.col("name_id") == F.col("phrase"))
    by_name = containing(q, c.select(F.col("company").alias("name_id"), F.col("company").alias("name")).distinct()).join(c, F.col("name_id") == F.col("company"))
    return by_phrase.select("text_id", "ticker").unionByName(by_name.select("text_id", "ticker")).distinct().select(F.col("text_id").alias("question_id"), "ticker")


def ticker_in_text(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """question_id, ticker: the first word that is a known ticker, else the first company (by ordinal) whose name stands in the text as a whole phrase, else the first word of two to five letters; null without any.

    questions: question_id (unique), question; companies: ordinal (unique), ticker, company.
    """
    edge = r"^[,.?!\"']+|[,.?!\"']+$"
    words = F.transform(F.split(F.trim(F.regexp_replace("question", r"\s+", " ")), " "), lambda w: F.regexp_replace(w, edge, ""))
    q = questions.select("question_id", F.lower("question").alias("low"), words.alias("words"))
    known = companies.select(F.lower("ticker").alias("word")).distinct()
    placed = q.select("question_id", F.posexplode("words").alias("place", "word")).withColumn("word", F.lower("word"))
    first = placed.join(known, "word").groupBy("question_id").agg(F.min_by(F.upper("word"), "place").alias("by_ticker"))
    stands = phrased(q.select(F.col("question_id").alias("text_id"), F.col("low").alias("text")), companies.select(F.col("ordinal").alias("name_id"), F.lower("company").alias("name")))
    named = stands.join(companies.select(F.col("ordinal").alias("name_id"), "ticker"), "name_id").groupBy(F.col("text_id").alias("question_id")).agg(F.min_by(F.upper("ticker"), "name_id").alias("by_name"))
    short = F.upper(F.get(F.filter("words", lambda w: w.rlike(r"^\p{L}{2,5}$")), F.lit(0)))
    out = q.select("question_id", short.alias("by_length")).join(first, "question_id", "left").join(named, "question_id", "left")
    return out.select("question_id", F.coalesce("by_ticker", "by_name", "by_length").alias("ticker"))


def company_of_files(files: DataFrame, companies: DataFrame) -> DataFrame:
    """files (name) with company: from the file name; where its first word is a known ticker, the ticker's company takes its place. companies: ticker, company."""
    from quillfin.functions.text import company_of_file

    f = files.withColumn("_company", company_of_file(F.col("name"))).withColumn("_word", F.element_at(F.split("_company", " "), 1))
    known = companies.groupBy(F.lower("ticker").alias("_word")).agg(F.min("company").alias("_mapped"))
    rest = F.substring(F.col("_company"), F.length("_word") + 1, F.length("_company"))
    return f.join(known, "_word", "left").withColumn("company", F.when(F.col("_mapped").isNotNull(), F.concat("_mapped", rest)).otherwise(F.col("_company"))).drop("_word", "_mapped", "_company")


def calendars_differ(tickers: DataFrame, group: str, fye: str) -> DataFrame:
    """Whether the companies of each group end their fiscal years in different months, so that one quarter's number names different months."""
    return tickers.groupBy(group).agg((F.countDistinct(F.coalesce(fye, F.lit(12))) > 1).alias("mismatch"))


def search_passes(tickers: DataFrame, years: DataFrame, types: DataFrame, quarters: DataFrame) -> DataFrame:
    """ticker x year x filing type, with each quarter for 10-Q alone; no types or quarters leave the field null."""
    p = tickers.crossJoin(years).crossJoin(types)
    return p.join(quarters, F.col("filing_type") == "10-Q", "left")


def pending(files: DataFrame, ledger: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """Files that a resumed run still has to take: not yet succeeded, nor failed unless those are retried."""
    j = files.join(ledger.select(key, "status"), key, "left")
    done = ["success"] if retry_failed else ["success", "failed"]
    return j.filter(F.col("status").isNull() | ~F.col("status").isin(done)).drop("status")


# ---- aggregates ----


def top_counts(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def majority(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The commonest value of each group, the first seen on ties."""
    g = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return g.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("seen"))).alias(value))


def distinct_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in order for every other column alike."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")


# ---- sorts, pages ----


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of the ordered rows, counted from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def tail(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group, to be read in ascending order."""
    return top_per_group(df, keys, [F.desc(order)], n).drop("rank")


def in_list_order(df: DataFrame, key: str, ids: Column | list) -> DataFrame:
    """Rows of the listed ids with their place in the list."""
    return df.withColumn("place", F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(key)) - 1).filter("place >= 0")


def dedup_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


# ---- changes ----


def apply_changes(base: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """State after a change log: the last change of each key wins, 'delete' removes it; base rows come first."""
    cols = [c for c in changes.columns if c not in ("op", seq)]
    log = base.select(*cols).withColumn("op", F.lit("upsert")).withColumn(seq, F.lit(-1).cast("long")).unionByName(changes.select(*cols, "op", F.col(seq).cast("long").alias(seq)))
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in cols if c != key], "op"), seq).alias("r"))
    return last.filter("r.op <> 'delete'").select(key, *[f"r.{c}" for c in cols if c != key])
