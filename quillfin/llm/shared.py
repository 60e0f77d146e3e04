"""Tables in the cluster's shared folder, and the few constants the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
SIMILARITY = 0.8
ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Paths of the tables staged so far, in order.
_staged: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary folder of its own, and a cluster an error, as its machines share none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-quillfin-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def tuned(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of ROWS rows where it has Spark's default of 10,000: texts are kilobytes long, and each running task holds a batch on either side of its pipe."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(ROWS))
    return spark


def staged(df: DataFrame, label: str, compression: str = "zstd", folder: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs only its own tasks. A table below a folder of the caller's own is the caller's to remove."""
    spark = tuned(df.sparkSession)
    path = f"{folder or shared_dir(spark) + '/quillfin'}/{label}-{uuid.uuid4().hex}"
    # Nothing reads this write's shuffles again, so Spark may drop them with it.
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    if folder is None:
        _staged.append(path)
    return read_staged(spark, path, df.schema)


def read_staged(spark: SparkSession, path: str, schema) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out._quillfin_path = path
    return out


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end. Results are lazy and read them: write what is wanted before the scope closes. Without a scope they stay in the shared folder, for whoever owns it to clear."""
    mark = len(_staged)
    try:
        yield
    finally:
        for path in _staged[mark:]:
            _remove(spark, path)
        del _staged[mark:]


def discard(df: DataFrame) -> None:
    """Remove a staged table that no later plan reads."""
    path = getattr(df, "_quillfin_path", None)
    if path:
        _remove(df.sparkSession, path)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    fs, p = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: The columns of a row's key.
KEY = ("doc_key", "doc_key2")


def with_row_key(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, text, the carried columns and a row's key of two non-null longs: a hash of doc_id and text, and doc_id itself (of rows without id a second hash of the text). Identical rows share it, which every user of the key allows for."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    return docs.withColumn("doc_key", F.xxhash64("doc_id", "text")).withColumn("doc_key2", F.coalesce("doc_id", F.xxhash64(F.lit("row without id"), "text", F.reverse("text"))))


def crc_fold(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
