"""Exact top-k by integer inner product: rows in descending length, rotated partial sums, Cauchy-Schwarz bounds.

Rows are cut into slices by descending length. Queries meet the slices in waves, the
longest rows first and GROWTH times as many rows in each wave as before. After a wave a query has a kth score;
it is done when its own length times the greatest length that is left falls below that (Cauchy-Schwarz), and goes
only to those slices whose longest row may still reach it.

Inside a cell (a block of queries and a slice, `vector_cells.meet`) both sides are turned by
the right singular vectors of a sample of rows (at most SAMPLE), so that the leading coordinates hold most of the
lengths. The product over the leading eighth, quarter and half, plus the product of the lengths
of the rests, bounds the whole one; rows that no query of the block can want are dropped. What is left is multiplied exactly
in whole numbers. Equal scores are never dropped by a bound (only what is strictly below), so ties go to the smaller id, as stated.

A vector takes no part if it is null or has null or non-finite components; nor does a row without id. Zero and empty vectors
take part. Of rows of one id the least takes part. Vectors of different dimensions have no inner product:
each dimension is searched by itself. With k candidates or fewer, all are returned; an empty table has
no result. Scores beyond the range of a long count as its ends. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfin.llm.shared import staged, tuned
from quillfin.llm.vector_cells import NONE, SLICE_ROWS, TOGETHER, Best, above, block_count, dimensions, in_cells, lengths, matrix, meet, products, squares, strongest, unit_vectors

SAMPLE = 65_536
GROWTH = 8
#: Parts of the rotated coordinates after which bounds are looked at.
LEVELS = (0.125, 0.25, 0.5)
#: Share of a product of lengths that bounds may be wrong by, as they are computed in double precision.
SLACK = 1e-9
FOUND = "query_id long, vec_id long, score long"


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The d rows of the sum of outer products of a task's vectors."""
    total = None
    for b in batches:
        x = matrix(b.column("units"))
        with np.errstate(over="ignore", invalid="ignore"):
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None and total.size:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])


def rotation(rows: DataFrame, n: int, d: int, sample: int = SAMPLE) -> np.ndarray:
    """(d, d) right singular vectors, of greatest singular value first, of a sample of rows (by hash of the id). Any rotation gives right results; one that can't be computed is the identity."""
    some = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // sample))) == 0)
    total = np.zeros((d, d))
    for r in some.select("units").coalesce(8).mapInArrow(_moments, "i int, row array<double>").collect():
        total[r["i"]] += np.array(r["row"])
    if not np.isfinite(total).all():
        return np.eye(d)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _rests(x: np.ndarray, levels: list[int]) -> np.ndarray:
    """Lengths of what stands behind each level."""
    with np.errstate(over="ignore"):
        return np.stack([lengths(x[:, cut:]) for cut in levels], 1)


def reached(length: np.ndarray, most: float, least: np.ndarray) -> np.ndarray:
    """Whether queries of these lengths may reach their kth scores with a row no longer than `most`."""
    with np.errstate(over="ignore", invalid="ignore"):
        return ~(length * most * (1 + SLACK) < above(least))


def _search(turn_, k: int):
    def run(queries: pa.RecordBatch, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = turn_.value
        levels = sorted({int(np.ceil(len(turn) * f)) for f in LEVELS}) if len(turn) else []
        q, qid, least = matrix(queries.column("units")), queries.column("vec_id").to_numpy(), queries.column("least").to_numpy()
        q_long, q_turned = lengths(q), q @ turn
        q_rest = _rests(q_turned, levels) if levels else None
        best = Best(len(q), k)
        for b in rows:
            x, ids = matrix(b.column("units")), b.column("vec_id").to_numpy()
            x_long, x_turned = lengths(x), x @ turn
            x_rest = _rests(x_turned, levels) if levels else None
            kth = np.maximum(least, best.kth())
            for a in range(0, len(q), TOGETHER):
                mine = np.arange(a, min(len(q), a + TOGETHER))
                mine = mine[reached(q_long[mine], x_long.max(), kth[mine])]
                if not len(mine):
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    floor = above(kth[mine])[:, None] - SLACK * q_long[mine][:, None] * x_long
                alive, part, done = np.ones((len(mine), len(x)), bool), np.zeros((len(mine), len(x))), 0
                for level, cut in enumerate(levels):
                    with np.errstate(over="ignore", invalid="ignore"):
                        part += q_turned[mine, done:cut] @ x_turned[:, done:cut].T
                        alive &= ~(part + q_rest[mine, level][:, None] * x_rest[:, level] < floor)
                    done = cut
                    if not alive.any():
                        break
                left = np.flatnonzero(alive.any(0))
                if not len(left):
                    continue
                s = products(q[mine], x[left])
                at, column = strongest(s, alive[:, left] & (ids[left] != qid[mine][:, None]), kth[mine], k)
                best.add(mine[at], s[at, column], ids[left][column])
        at, score, id_ = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(id_), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def _sent(longest: np.ndarray, first: int, blocks: int):
    """Queries of a wave, once for each slice (first and on, of these greatest lengths, descending) that may hold a row they want."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, least = b.column("length").to_numpy(), b.column("least").to_numpy()
            for s, most in enumerate(longest.tolist()):
                wanted = np.flatnonzero(reached(length, most, least))
                if not len(wanted):
                    break
                part = b.take(pa.array(wanted))
                cell = (first + s) * blocks + part.column("block").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(cell), part.column("vec_id"), part.column("units"), part.column("least")], ["cell", "vec_id", "units", "least"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, slice_rows: int = SLICE_ROWS, growth: int = GROWTH) -> DataFrame:
    """For each row whose vec_id is divisible by every: query_id, rank, vec_id, score of its k greatest inner products of floor(256 * x). vectors: vec_id, embedding."""
    tuned(vectors.sparkSession)
    rows = staged(unit_vectors(vectors).withColumn("length", F.sqrt(squares())), "units")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = dimensions(rows)
    for d in dims:
        part = _of_dimension(rows.filter(F.size("units") == d), d, k, every, slice_rows, growth)
        out = part if len(dims) == 1 else out.unionByName(part)
    return out


def _of_dimension(rows: DataFrame, d: int, k: int, every: int, slice_rows: int, growth: int) -> DataFrame:
    spark = rows.sparkSession
    n = rows.count()
    kind = rows.schema["units"].dataType.simpleString()
    turn = spark.sparkContext.broadcast(rotation(rows, n, d))
    cut = rows.repartitionByRange(max(1, -(-n // slice_rows)), F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    cut = staged(cut.withColumn("slice", F.spark_partition_id()), "slices")
    # One row for each slice: numbers and lengths only.
    facts = cut.groupBy("slice").agg(F.max("length").alias("most"), F.count(F.lit(1)).alias("n")).orderBy("slice").collect()
    queries = rows.filter(F.col("vec_id") % every == 0)
    found = None
    begin, size = 0, 1
    while begin < len(facts):
        wave = facts[begin : begin + size]
        asked = queries.withColumn("least", F.lit(NONE)) if found is None else queries.join(found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least")), F.col("vec_id") == F.col("query_id"), "left").drop("query_id").withColumn("least", F.coalesce("least", F.lit(NONE)))
        asked = asked.filter(~(F.col("length") * (wave[0]["most"] * (1 + SLACK)) < F.col("least") - 0.5))
        blocks = block_count(asked.count(), d)
        asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        sent = asked.mapInArrow(_sent(np.array([f["most"] for f in wave]), begin, blocks), f"cell long, vec_id long, units {kind}, least long")
        first, last = wave[0]["slice"], wave[-1]["slice"]
        number = {f["slice"]: begin + i for i, f in enumerate(wave)}
        slices = cut.filter(F.col("slice").between(first, last)).select("vec_id", "units", (-F.col("length")).alias("place"), "slice")
        # Slice numbers have gaps only where a range is empty.
        if any(s - first != i - begin for s, i in number.items()):
            named = spark.createDataFrame(list(number.items()), "slice int, number int")
            slices = slices.join(F.broadcast(named), "slice")
        else:
            slices = slices.withColumn("number", F.col("slice") - first + begin)
        met = meet(sent, in_cells(slices, "number", blocks), len(wave) * blocks, _search(turn, k), FOUND)
        found = staged(_top(met if found is None else met.unionByName(found), k).drop("rank"), "found")
        begin, size = begin + size, size * growth
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
