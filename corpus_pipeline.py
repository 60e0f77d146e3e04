"""Training-corpus pipeline: each stage works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet in the shared folder and reads it again. All stages but
the last return the columns of documents (doc_id, text, lang, source, n_chars)
and keep rows with null texts, which nothing is found in. Rows are known by doc_id
and text together, so rows of one doc_id or of none are judged each on its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfin.llm.decontamination import contaminated
from quillfin.llm.line_dedup import line_dedup
from quillfin.llm.near_dedup import near_duplicates
from quillfin.llm.sentencepiece_codec import encode_and_check
from quillfin.llm.shared import KEY, WORD, shared_dir, stage_scope, table, tuned, with_row_key
from quillfin.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of docs whose key (of doc_id and text, never null) is not in bad (KEY)."""
    return with_row_key(docs, "lang", "source", "n_chars").join(bad.select(*KEY).distinct(), list(KEY), "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go."""
    return _without(docs, toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 1"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of two lines and more go from the texts. A document all of whose words are gone goes: each of its lines stands in a document that stays. Empty and null texts stay."""
    rows = line_dedup(docs, keep_text=True, windows=True, carry=("lang", "source", "n_chars")).filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD))
    n_chars = F.when(F.col("n_removed") == 0, F.col("carried.n_chars")).otherwise(F.length("kept_text").cast("long"))
    return rows.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", n_chars.alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one of least doc_id (nulls last) and, of several rows of that doc_id, of least key. Of rows that repeat a doc_id and text one stays."""
    kept = _without(docs, near_duplicates(docs).filter("not first"))
    return with_row_key(kept, "lang", "source", "n_chars").dropDuplicates(list(KEY)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every document left."""
    tuned(spark)
    return encode_and_check(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_tokens),
]

#: Content-defined chunks, probability Jaccard, nearest examples and Viterbi paths are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written and read again; tables that a stage made on its way are removed with it."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/quillfin/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with stage_scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(f"{at}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{name}")
    return docs
