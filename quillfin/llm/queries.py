"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfin.llm.decontamination import contaminated
from quillfin.llm.exact_topk import exact_top_k
from quillfin.llm.hard_negatives import hard_negatives
from quillfin.llm.hilbert_ann import nearest
from quillfin.llm.hmm_lm import language_model_scores
from quillfin.llm.html_extraction import main_text
from quillfin.llm.line_dedup import line_dedup
from quillfin.llm.near_dedup import near_duplicates
from quillfin.llm.oracles import ORACLES as ORACLES
from quillfin.llm.secret_scan import BASE, listed, secret_spans
from quillfin.llm.sentencepiece_codec import encode_and_check
from quillfin.llm.shared import KEY, table
from quillfin.llm.substring_dedup import substring_dedup
from quillfin.llm.token_alignment import aligned
from quillfin.llm.toxicity import toxicity


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(*KEY)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), keep_text=False, windows=True).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["order"] < BASE)
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop(*KEY)


def op7_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_hmm_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), held_out_fold=1)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("kept_text")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_minhash_near_dedup,
        op3_sentencepiece,
        op4_line_dedup,
        op5_secret_scan,
        op6_toxicity,
        op7_hilbert_ann,
        op8_hmm_lm_scoring,
        op9_substring_dedup,
        op10_html_extraction,
        op11_exact_top_k,
        op12_hard_negatives,
        op13_token_alignment,
        pipeline,
    )
}
