"""Session settings that the operators assume."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "quillfin", **settings: str) -> SparkSession:
    """A session with the library's settings, then the caller's (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). A local session without one (tests) gets a temporary folder; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-quillfin-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quillfin/{label}-{uuid.uuid4().hex}"


@F.udtf(returnType="row int, col int, cell string")
class TableCells:
    """The cells of a markdown table, separator lines left out."""

    def eval(self, markdown: str) -> Iterator[tuple[int, int, str]]:
        lines = [x for x in (markdown or "").split("\n") if x.count("|") >= 3 and x.strip("|-: ") != ""]
        for i, line in enumerate(lines):
            for j, cell in enumerate(c for c in (x.strip() for x in line.split("|")) if c):
                yield i, j, cell


@F.udtf(returnType="category string, term string, hits int")
class KeywordHits:
    """How often each keyword of the tone dictionary stands in a text, those that do."""

    def eval(self, text: str) -> Iterator[tuple[str, str, int]]:
        from quillfin.functions.text import KEYWORDS

        low = (text or "").lower()
        for category, terms in KEYWORDS.items():
            for term in terms:
                if n := low.count(term):
                    yield category, term, n


def register_functions(spark: SparkSession) -> None:
    """Make table_cells(markdown) and keyword_hits(text) callable as table functions in SQL (also with LATERAL)."""
    spark.udtf.register("table_cells", TableCells)
    spark.udtf.register("keyword_hits", KeywordHits)
