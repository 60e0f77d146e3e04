"""Readers: files and payloads of the upstream services as DataFrames. All take paths that Spark reads or frames of raw payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfin.functions.numbers import rnd


#: A statement has some dozens of items, each a column of the result.
MOST_ITEMS = 10_000


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def csv_series(spark: SparkSession, folder: str, indicator: str) -> DataFrame:
    """indicator, date, value of <indicator>.csv; no rows if there is no such file."""
    path = f"{folder}/{indicator}.csv"
    schema = "date date, value double"
    df = spark.read.schema(schema).option("header", True).csv(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    return df.select(F.lit(indicator).alias("indicator"), "date", "value")


def json_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document; no rows if there is no such file."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def observations(payloads: DataFrame, as_of: str, years: int = 5, annual_years: int = 20) -> DataFrame:
    """indicator, date, value from payloads (indicator, frequency, json) of observations; '.' is missing, only the latest years are kept."""
    rows = payloads.select("indicator", "frequency", F.explode(F.from_json("json", "struct<observations:array<struct<date:string,value:string>>>")["observations"]).alias("o"))
    r = rows.filter(F.col("o.value") != ".").select("indicator", "frequency", F.col("o.date").cast("date").alias("date"), F.col("o.value").try_cast("double").alias("value"))
    span = F.when(F.col("frequency") == "annual", annual_years).otherwise(years)
    return r.filter(F.col("date") >= F.add_months(F.lit(as_of).cast("date"), -12 * span)).select("indicator", "date", "value")


def price_history(bars: DataFrame, ticker: str, start: str, end: str) -> DataFrame:
    """A ticker's bars from start (inclusive) to end (exclusive)."""
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    return bars.filter((F.upper("ticker") == ticker.upper()) & (F.col("ts") >= ts(start)) & (F.col("ts") < ts(end)))


def statement(wide: DataFrame, item: str) -> DataFrame:
    """A financial statement with a column for each date as one row for each date: (date, then a column for each item), NaN as null."""
    dates = [c for c in wide.columns if c != item]
    long = wide.unpivot([item], dates, "date", "value")
    names = [r[0] for r in wide.select(item).distinct().orderBy(item).limit(MOST_ITEMS + 1).collect()]
    if len(names) > MOST_ITEMS:
        raise ValueError(f"a statement of over {MOST_ITEMS} items makes too wide a table: use its long form (unpivot)")
    return long.groupBy("date").pivot(item, names).agg(F.first(F.nanvl("value", F.lit(None).cast("double")), ignorenulls=True))


#: Fields of a valuation snapshot by kind of ratio.
RATIOS = {"trailing": ("trailing_pe", "price", "trailing_eps"), "forward": ("forward_pe", "forward_eps")}


def snapshot(info: DataFrame, kind: str = "both") -> DataFrame:
    """ticker and its ratios of price to earnings, trailing, forward or both, with price and earnings beside them. info: ticker, price, trailing_eps, forward_eps. No ratio without positive earnings."""
    if kind not in (*RATIOS, "both"):
        raise ValueError("kind is trailing, forward or both")
    ratio = lambda eps: F.when(F.col(eps) > 0, rnd(F.col("price") / F.col(eps), 2))
    full = info.withColumn("trailing_pe", ratio("trailing_eps")).withColumn("forward_pe", ratio("forward_eps"))
    return full.select("ticker", *[c for k, fields in RATIOS.items() if kind in (k, "both") for c in fields])


def corporate_actions(actions: DataFrame, ticker: str | None = None) -> DataFrame:
    """ticker, date, kind ('dividend' or 'split'), amount: a row for each non-zero figure of actions (ticker, ts, dividends, splits)."""
    a = actions if ticker is None else actions.filter(F.upper("ticker") == ticker.upper())
    pairs = F.array(F.struct(F.lit("dividend").alias("kind"), F.col("dividends").alias("amount")), F.struct(F.lit("split").alias("kind"), F.col("splits").alias("amount")))
    return a.select("ticker", F.col("ts").cast("date").alias("date"), F.explode(pairs).alias("x")).filter("x.amount <> 0").select("ticker", "date", "x.kind", "x.amount")


#: The kinds of holder tables.
HOLDER_TYPES = ("major_holders", "institutional_holders", "mutualfund_holders", "insider_transactions", "insider_purchases", "insider_roster_holders")


def holders(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """The table of one kind of holders."""
    if kind not in HOLDER_TYPES:
        raise ValueError(f"kind is one of {', '.join(HOLDER_TYPES)}")
    return tables[kind]


def option_chain(chain: DataFrame, ticker: str, expiration: str, side: str) -> DataFrame:
    """One side ('calls' or 'puts') of a ticker's chain on a date."""
    if side not in ("calls", "puts"):
        raise ValueError("side is calls or puts")
    return chain.filter((F.upper("ticker") == ticker.upper()) & (F.col("expiration") == F.lit(expiration).cast("date")) & (F.col("option_type") == side[:-1]))


def news(items: DataFrame) -> DataFrame:
    """title, summary, published, url of the stories among news payloads (json)."""
    c = F.from_json("json", "struct<content:struct<contentType:string,title:string,summary:string,pubDate:string,canonicalUrl:struct<url:string>>>")["content"]
    return items.select(c.alias("c")).filter("c.contentType = 'STORY'").select("c.title", "c.summary", F.col("c.pubDate").alias("published"), F.col("c.canonicalUrl.url").alias("url"))


_VALUE = "struct<value:string>"
_TXN = f"struct<securityTitle:{_VALUE},transactionDate:{_VALUE},transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:{_VALUE},transactionPricePerShare:{_VALUE},transactionAcquiredDisposedCode:{_VALUE}>>"
_FORM4 = (
    "struct<issuer:struct<issuerTradingSymbol:string,issuerName:string>,documentType:string,periodOfReport:string,"
    "reportingOwner:array<struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<officerTitle:string,isDirector:string,isOfficer:string,isTenPercentOwner:string>>>,"
    f"nonDerivativeTable:struct<nonDerivativeTransaction:array<{_TXN}>>,derivativeTable:struct<derivativeTransaction:array<{_TXN}>>>"
)


def form4_transactions(filings: DataFrame) -> DataFrame:
    """A row for each transaction of ownership filings (accession, xml), both tables; the first owner counts, absent amounts are 0. Filings without issuer or owner, or that are not XML, give none."""
    schema = T._parse_datatype_string(_FORM4)
    f = filings.select("accession", F.from_xml("xml", schema.simpleString(), {"mode": "PERMISSIVE"}).alias("f")).filter("f.issuer is not null and size(f.reportingOwner) > 0")
    tag = lambda path, derivative: F.coalesce(F.transform(F.col(path), lambda t: F.struct(t.alias("t"), F.lit(derivative).alias("derivative"))), F.array().cast(f"array<struct<t:{_TXN},derivative:boolean>>"))
    both = F.concat(tag("f.nonDerivativeTable.nonDerivativeTransaction", False), tag("f.derivativeTable.derivativeTransaction", True))
    r = f.withColumn("own", F.col("f.reportingOwner")[0]).select("accession", "f", "own", F.explode(both).alias("x"))
    rel = "own.reportingOwnerRelationship."
    num = lambda p: F.coalesce(F.col(f"x.t.transactionAmounts.{p}.value").try_cast("double"), F.lit(0.0))
    flag = lambda p: F.coalesce(F.col(rel + p) == "1", F.lit(False)).alias(_snake(p))
    return r.select(
        "accession", F.coalesce("f.documentType", F.lit("4")).alias("document_type"), F.col("f.periodOfReport").try_cast("date").alias("period_of_report"), F.col("f.issuer.issuerTradingSymbol").alias("issuer_symbol"),
        F.col("f.issuer.issuerName").alias("issuer"), F.col("own.reportingOwnerId.rptOwnerName").alias("owner"), F.col(rel + "officerTitle").alias("owner_title"), flag("isDirector"), flag("isOfficer"), flag("isTenPercentOwner"),
        F.col("x.derivative").alias("is_derivative"), F.col("x.t.securityTitle.value").alias("security_title"), F.col("x.t.transactionDate.value").try_cast("date").alias("transaction_date"), F.col("x.t.transactionCoding.transactionCode").alias("code"),
        num("transactionShares").alias("shares"), num("transactionPricePerShare").alias("price"), F.col("x.t.transactionAmounts.transactionAcquiredDisposedCode.value").alias("acquired_disposed"),
    )


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def ingest_form4(filings: DataFrame, stored: DataFrame) -> DataFrame:
    """New filings parsed, amendments applied, common stock kept with its value; a filing without any gives one row without transaction (has_common_stock false)."""
    from quillfin.operators.insider import amended, is_common_stock, unseen

    new = form4_transactions(unseen(filings, stored, ["accession"]))
    standing = amended(new, ("issuer_symbol", "owner", "period_of_report"))
    common = standing.filter(is_common_stock(F.col("security_title"), F.col("is_derivative"))).withColumn("transaction_value", F.col("shares") * F.col("price")).withColumn("has_common_stock", F.lit(True))
    head = standing.select("accession", "document_type", "period_of_report", "issuer_symbol", "issuer", "owner").distinct()
    return common.unionByName(head.join(common.select("accession").distinct(), "accession", "left_anti").withColumn("has_common_stock", F.lit(False)), allowMissingColumns=True)


_FILING = ("form", "filingDate", "reportDate", "accessionNumber", "primaryDocument")
_ARRAYS = "struct<" + ",".join(f"{f}:array<string>" for f in _FILING) + ">"


def _filings(blocks: DataFrame, forms: tuple[str, ...], start: str | None, end: str | None) -> DataFrame:
    """The filings of blocks (cik, r: parallel arrays) of these forms and days."""
    x = blocks.select("cik", F.explode(F.arrays_zip(*[F.col(f"r.{f}").alias(f) for f in _FILING])).alias("x"))
    d = x.select("cik", F.col("x.form").alias("form"), F.col("x.filingDate").cast("date").alias("filing_date"), F.col("x.reportDate").try_cast("date").alias("period_end_date"), F.col("x.accessionNumber").alias("accession"), F.col("x.primaryDocument").alias("document"))
    d = d.filter(F.col("form").isin(*forms))
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            d = d.filter(getattr(F.col("filing_date"), op)(F.lit(bound).cast("date")))
    return d


def submissions(payloads: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q", "8-K"), start: str | None = None, end: str | None = None) -> DataFrame:
    """cik, form, filing_date, period_end_date, accession, document of filing lists (cik, json), kept in parallel arrays; latest first within a company."""
    r = F.from_json("json", f"struct<filings:struct<recent:{_ARRAYS}>>")["filings"]["recent"]
    return _filings(payloads.select("cik", r.alias("r")), forms, start, end).repartition("cik").sortWithinPartitions("cik", F.desc("filing_date"), "accession")


def filing_history(payloads: DataFrame, folder: str, forms: tuple[str, ...] = ("10-K", "10-Q", "8-K"), start: str | None = None, end: str | None = None, pattern: str = "{folder}/{name}") -> DataFrame:
    """As `submissions`, with the older pages that filing lists (cik, json) name in filings.files, each a file of its own with the days it spans.

    Pages that miss the days asked for are left out by those days before any is read; the others are parsed and united with the recent filings in one plan. pattern: where the page of a name (it ends in .json) is found.
    The driver holds the names of the pages that are read, as it does for any list of files. A filing of both lists counts once.
    """
    spark = payloads.sparkSession
    listed = F.from_json("json", "struct<filings:struct<files:array<struct<name:string,filingFrom:string,filingTo:string>>>>")["filings"]["files"]
    pages = payloads.select("cik", F.explode(listed).alias("f")).select("cik", "f.name", F.col("f.filingFrom").cast("date").alias("filing_from"), F.col("f.filingTo").cast("date").alias("filing_to"))
    wanted = history_pages(pages, start, end).select("cik", "name").distinct()
    paths = sorted(pattern.replace("{folder}", folder.rstrip("/")).replace("{name}", r["name"]) for r in wanted.select("name").distinct().collect())
    recent = payloads.select("cik", F.from_json("json", f"struct<filings:struct<recent:{_ARRAYS}>>")["filings"]["recent"].alias("r"))
    found = _filings(recent, forms, start, end)
    if paths:
        texts = spark.read.option("wholetext", True).text(paths).select(F.regexp_extract("_metadata.file_path", r"([^/=]+\.json)(?:/[^/]*)?$", 1).alias("name"), "value")
        older = texts.join(wanted, "name").select("cik", F.from_json("value", _ARRAYS).alias("r"))
        found = found.unionByName(_filings(older, forms, start, end))
    return found.dropDuplicates(["cik", "accession"]).repartition("cik").sortWithinPartitions("cik", F.desc("filing_date"), "accession")


def history_pages(pages: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Older pages of a filing list (name, filing_from, filing_to) that overlap the dates asked for."""
    if start is not None:
        pages = pages.filter(F.col("filing_to") >= F.lit(start).cast("date"))
    return pages if end is None else pages.filter(F.col("filing_from") <= F.lit(end).cast("date"))


def atom_entries(entries: DataFrame, start: str, limit: int, page: int | None = None) -> DataFrame:
    """Ownership filings ('4 ' and '4/A ') of a feed (title, updated, link) since start, the latest first: after the filter the first `limit`, or the page of that size (from 1)."""
    e = entries.filter((F.col("title").startswith("4 ") | F.col("title").startswith("4/A ")) & (F.col("updated") >= F.lit(start).cast("date")))
    e = e.orderBy(F.desc("updated"), "link")
    return e.limit(limit) if page is None else e.offset((page - 1) * limit).limit(limit)


def with_cik(rows: DataFrame, ciks: DataFrame) -> DataFrame:
    """rows (ticker) with the ten-digit cik of the ticker."""
    return rows.join(ciks.select(F.upper("ticker").alias("ticker"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik")), "ticker", "left")


def files_under(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, size, modified of the files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON manifest that name a path."""
    return spark.read.schema("path string, ticker string, company string, year int").option("multiLine", True).json(path).filter("path is not null and path <> ''")


def expired(files: DataFrame, as_of: str, days: int) -> DataFrame:
    """Files last modified more than so many days before as_of."""
    return files.filter(F.col("modified") < F.date_sub(F.lit(as_of).cast("date"), days))


def page_chunks(pages: DataFrame, text: Column, tables: Column | None = None) -> DataFrame:
    """Pages with their text, the tables on them (array of markdown tables) appended under [TABLES], blank ones left out, and the hash of their content."""
    content = text
    if tables is not None:
        content = F.when(F.size(tables) > 0, F.concat(text, F.lit("\n\n[TABLES]\n"), F.array_join(tables, "\n\n"))).otherwise(text)
    return pages.withColumn("page_content", content).filter(F.trim("page_content") != "").withColumn("content_hash", F.sha2("page_content", 256))
