"""Joins of texts with the names that stand in them, by keys that both sides share and a check of the predicate.

A name inside a text brings all its character grams along, a whole phrase all its words. Each
name is looked up by one of them, the one that the fewest texts have; texts come with those grams or words
that some name has. So a join on equal keys gives the candidates, the predicate is checked on them
alone, and no plan pairs all texts with all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: A character of a word, for the edges of phrases: ASCII letters, digits and the low line.
WORD = r"\w+"
_META = r"([\\.\[\]{}()*+?^$|])"


def _grams(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of these numbers of characters. A look-ahead takes them in one pass, overlapping."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]))


def _candidates(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text_id, name_id of texts that hold the rarest key of a name. texts: text_id, keys; names: name_id, keys."""
    of_name = names.select("name_id", F.explode("keys").alias("key"))
    of_text = texts.select("text_id", F.explode("keys").alias("key")).join(of_name.select("key").distinct(), "key", "left_semi")
    frequency = of_text.groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    # A key that no text has rules its name out: it is the rarest, and meets nothing.
    rarest = of_name.join(frequency, "key", "left").groupBy("name_id").agg(F.min_by("key", F.struct(F.coalesce("texts", F.lit(0)), "key")).alias("key"))
    return of_text.join(rarest, "key").select("text_id", "name_id")


def containing(texts: DataFrame, names: DataFrame, gram: int = GRAM) -> DataFrame:
    """text_id, name_id of every text that holds a name as a part. texts: text_id, text; names: name_id, name; ids are unique. Empty and null names are in no text."""
    named = names.select("name_id", "name").filter("name <> ''")
    # Names shorter than a gram are keys themselves.
    sizes = sorted(r["n"] for r in named.select(F.least(F.length("name"), F.lit(gram)).alias("n")).distinct().collect())
    if not sizes:
        return texts.select("text_id").crossJoin(names.select("name_id")).limit(0)
    size = F.least(F.length("name"), F.lit(gram))
    keys = F.element_at(F.create_map(*[x for n in sizes for x in (F.lit(n), _grams(F.col("name"), [n]))]), size)
    found = _candidates(texts.select("text_id", _grams(F.col("text"), sizes).alias("keys")), named.select("name_id", keys.alias("keys")))
    checked = found.join(texts.select("text_id", "text"), "text_id").join(named, "name_id").filter(F.contains("text", F.col("name")))
    return checked.select("text_id", "name_id")


def phrased(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    r"""text_id, name_id of every text in which a phrase stands between word boundaries (\b). texts: text_id, text; phrases: name_id, name; ids are unique. Phrases without a letter or digit are in no text."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)))
    named = phrases.select("name_id", "name").filter(F.col("name").rlike(WORD))
    found = _candidates(texts.select("text_id", words(F.col("text")).alias("keys")), named.select("name_id", words(F.col("name")).alias("keys")))
    pattern = F.concat(F.lit(r"\b"), F.regexp_replace("name", _META, r"\\$1"), F.lit(r"\b"))
    # A phrase of one word is its key, which was met as a whole word.
    one = F.col("name").rlike(r"^\w+$")
    many = named.withColumn("pattern", F.when(~one, pattern))
    checked = found.join(many, "name_id").join(texts.select("text_id", "text"), "text_id").filter("pattern is null or text rlike pattern")
    return checked.select("text_id", "name_id")
