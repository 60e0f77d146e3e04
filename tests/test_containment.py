"""Containment joins against brute force, and their plans."""

import random
import re

import pytest

from quillfin.operators import containment as con
from quillfin.operators import relational as rel
from quillfin.plans import QUERIES

SF = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_containing(spark, seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abc .é漢\n") for _ in range(n))
    texts = [(i, piece(rng.randrange(0, 60))) for i in range(150)] + [(900, None), (901, "")]
    names = [(i, piece(rng.randrange(0, 7))) for i in range(80)] + [(800, None), (801, ""), (802, "abc" * 9), (803, "zzz"), (804, texts[0][1])]
    got = pairs(con.containing(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(names, "name_id int, name string")))
    assert got == sorted((i, j) for i, t in texts for j, n in names if t and n and n in t)


def test_containing_without_names(spark):
    texts = spark.createDataFrame([(1, "a")], "text_id int, text string")
    assert con.containing(texts, spark.createDataFrame([(1, "")], "name_id int, name string")).collect() == []
    assert con.containing(texts.limit(0), spark.createDataFrame([(1, "a")], "name_id int, name string")).collect() == []


def test_phrased(spark):
    rng = random.Random(7)
    words = ["ab", "a.b", "b", "c++", "d e", "a_b", "x9", "(q)"]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", "", ", ", "-", "\n"]) for _ in range(rng.randrange(9)))) for i in range(200)]
    names = list(enumerate([*words, "ab b", "d e ab", "b, b", "++", "", "a"]))
    got = pairs(con.phrased(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(names, "name_id int, name string")))
    assert got == sorted((i, j) for i, t in texts for j, n in names if re.search(r"\w", n) and re.search(r"\b" + re.escape(n) + r"\b", t, re.A))


def test_mentions(spark):
    c = spark.createDataFrame([("GOOGL", "google"), ("GOOGL", "alphabet inc"), ("BRK.B", "berkshire hathaway"), ("KO", "coca-cola company"), ("F", "ford motor company")], "ticker string, company string")
    asked = ["Alphabet's margins", "googlers", "is BRK.B cheap?", "a company of that group, inc", "coca-cola companys", "motor", "take f as given", "fords", "hathaways"]
    got = pairs(rel.mentions(spark.createDataFrame(list(enumerate(asked)), "question_id int, question string"), c))
    assert got == [(0, "GOOGL"), (1, "GOOGL"), (2, "BRK.B"), (4, "KO"), (5, "F"), (6, "F")]


def test_resolve_ticker_against_brute_force(spark):
    rng = random.Random(1)
    name = lambda n: "".join(rng.choice("abAB ") for _ in range(n))
    companies = [(i, f"t{i}_x", name(rng.randrange(1, 9)) + "c") for i in range(60)]
    names = [name(rng.randrange(0, 12)) + rng.choice(["", "c"]) for _ in range(150)] + [companies[3][2].upper()]
    got = dict(tuple(r) for r in rel.resolve_ticker(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(companies, "ordinal int, ticker string, company string")).collect())

    def brute(n):
        key = n.strip(" ").lower()
        hits = [(c.lower() != key, i) for i, _, c in companies if key and (key in c.lower() or c.lower() in key)]
        return f"t{min(hits)[1]}" if hits else ""

    assert got == {n: brute(n) for n in names}


@pytest.mark.parametrize("name", ["jn_resolve_ticker", "jn_mentions", "txt_ticker_in_text"])
def test_no_pairing_of_all_rows(spark, name):
    plan = executed(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_many_names_in_many_names(spark):
    """20,000 x 20,000 names; all pairs would be 400 million checks of a predicate."""
    from pyspark.sql import functions as F

    ids = spark.range(20_000)
    texts = ids.select(F.col("id").alias("text_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" holdings")).alias("text"))
    names = ids.select(F.col("id").alias("name_id"), F.substring(F.sha2(F.col("id").cast("string"), 256), 11, 12).alias("name"))
    found = con.containing(texts, names)
    assert found.filter("text_id = name_id").count() == 20_000
    assert "NestedLoop" not in executed(found.groupBy().count())
