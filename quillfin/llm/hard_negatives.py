"""Hard negatives from k-means inverted lists with stored radii, exactly.

Rows are put in the list of their nearest centroid; a list keeps its size and its radius, the
greatest distance of a row from the centroid c. For a query q any row of the list scores
between q.c - |q| radius and q.c + |q| radius (Cauchy-Schwarz). A query visits lists by
falling upper bound, in waves: the first FIRST_LISTS, then the others. A list is skipped if its
interval misses the query's window, or if its upper bound is strictly below the kth score
that the query has; the search ends where the next bound is. So results are exact whatever the
centroids; these only decide how much is skipped.

First every anchor's positives are searched (rows of its label, no window), then
for each of their scores the negatives: rows of another label whose score is in the window of that score.
Visits and rows meet in cells (`vector_cells.meet`): lists are cut into slices of about SLICE_ROWS
rows, so a list with a third of all rows is many tasks.

Centroids come from MLlib's k-means on at most SAMPLE rows (by hash of the id), as many as the root of
the number of rows, at most MOST_LISTS; every row is indexed.

Rows with a null label, a null vector or null or non-finite components take no part; nor do rows without id. Of rows of one
id the least (label, then components) takes part. Vectors of different dimensions are searched apart. An anchor without
another row of its label has no positives and no result, nor does a pair without a row in its window. An empty table has no result. Scores beyond the
range of a long count as its ends. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfin.llm.shared import staged, tuned
from quillfin.llm.vector_cells import NONE, SLICE_ROWS, TOGETHER, Best, above, block_count, dimensions, in_cells, lengths, matrix, meet, products, strongest, unit_vectors

MOST_LISTS = 4_096
SAMPLE = 16_384
ITERATIONS = 5
FIRST_LISTS = 8
SLACK = 1e-9
SEED = 20_240_229
FOUND = "anchor_id long, goal long, vec_id long, score long"


def centroids(rows: DataFrame, n: int, d: int, most: int = MOST_LISTS, sample: int = SAMPLE) -> np.ndarray:
    """(k, d) centres of a k-means on a sample; the zero vector alone where there are fewer than two (no components, equal or too large vectors)."""
    some = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // sample))) == 0)
    # Equal vectors would give equal first centres.
    some = some.filter(F.forall("units", lambda v: F.abs(v) < 1e100)).select("units").distinct()
    k = int(min(most, np.ceil(np.sqrt(n)), some.count()))
    if d == 0 or k < 2:
        return np.zeros((1, d))
    model = KMeans(k=k, maxIter=ITERATIONS, seed=SEED, initMode="random").fit(some.select(array_to_vector(F.col("units").cast("array<double>")).alias("features")))
    return np.array(model.clusterCenters())


def _assigned(centres_):
    """Each row with its list and its distance from that list's centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres_.value
        half = np.einsum("ij,ij->i", c, c) / 2
        for b in batches:
            x = matrix(b.column("units"))
            with np.errstate(over="ignore", invalid="ignore"):
                near = np.nan_to_num(x @ c.T - half).argmax(1) if len(x) else np.zeros(0, np.int64)
                away = np.nan_to_num(lengths(x - c[near]), nan=np.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(away)], [*b.schema.names, "list", "away"])

    return run


def windows(goal: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole score n with least * goal <= 100 * n <= most * goal."""
    lo = np.array([max(NONE, -(-least * int(g) // 100)) for g in goal], np.int64)
    hi = np.array([min(-NONE - 1, most * int(g) // 100) for g in goal], np.int64)
    return lo, hi


def _bounds(goal: np.ndarray, least: np.ndarray, window: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """What a score must reach and must not exceed."""
    if window is None:
        return least, np.full(len(goal), -NONE - 1)
    lo, hi = windows(goal, *window)
    return np.maximum(lo, least), hi


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The query, goal and kth score of every search of a batch of queries."""
    goals, kths = b.column("goals"), b.column("kths")
    size = np.diff(goals.offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), size), goals.flatten().to_numpy(), kths.flatten().to_numpy()


def _visits(index_, blocks: int, wave: tuple[int, int | None], window: tuple[int, int] | None):
    """Queries, once for each slice of each list that they visit in this wave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, radius, first, slices = index_.value
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column("units"))
            with np.errstate(over="ignore", invalid="ignore"):
                at, reach = q @ c.T, lengths(q)[:, None] * radius
                slack = SLACK * (reach + lengths(q)[:, None] * lengths(c)) + 0.5
                up, down = np.nan_to_num(at + reach + slack, nan=np.inf), np.nan_to_num(at - reach - slack, nan=-np.inf)
            of, goal, kth = _flat(b)
            need, most = _bounds(goal, kth, window)
            open_, need = need <= most, above(need)
            top = np.where(most == -NONE - 1, np.inf, most)
            wanted = np.zeros(up.shape, bool)
            for k in np.flatnonzero(open_).tolist():
                wanted[of[k]] |= (up[of[k]] >= need[k]) & (down[of[k]] <= top[k])
            # Lists outside every window are no visits; the others are visited by falling bound.
            order = np.argsort(np.where(wanted, -up, np.inf), axis=1, kind="stable")[:, wave[0] : wave[1]]
            who, place = np.nonzero(np.take_along_axis(wanted, order, 1))
            list_ = order[who, place]
            who, list_ = np.repeat(who, slices[list_]), np.repeat(list_, slices[list_])
            turn = np.concatenate([[True], (np.diff(who) != 0) | (np.diff(list_) != 0)]) if len(who) else np.zeros(0, bool)
            begin = np.flatnonzero(turn)
            part = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
            for lo in range(0, len(who), 4_096):
                some = who[lo : lo + 4_096]
                sent = b.take(pa.array(some))
                cell = (first[list_[lo : lo + 4_096]] + part[lo : lo + 4_096]) * blocks + sent.column("block").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(cell), *(sent.column(x) for x in ("vec_id", "units", "label", "goals", "kths"))], ["cell", "vec_id", "units", "label", "goals", "kths"])

    return run


def _search(k: int, window: tuple[int, int] | None):
    """The k best rows of each search of a cell: of the query's label without a window, of another label with one."""

    def run(queries: pa.RecordBatch, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qid, qlabel = matrix(queries.column("units")), queries.column("vec_id").to_numpy(), queries.column("label").to_numpy()
        of, goal, kth = _flat(queries)
        need, most = _bounds(goal, kth, window)
        best = Best(len(of), k)
        # Searches of TOGETHER queries at a time, with those of their first query and of the next ones'.
        edge = np.searchsorted(of, np.arange(0, len(q) + TOGETHER, TOGETHER))
        for b in rows:
            x, ids, label = matrix(b.column("units")), b.column("vec_id").to_numpy(), b.column("label").to_numpy()
            now = np.maximum(need, best.kth())
            for t, a in enumerate(range(0, len(q), TOGETHER)):
                s = products(q[a : a + TOGETHER], x)
                other = ids != qid[a : a + TOGETHER, None]
                other &= (label == qlabel[a : a + TOGETHER, None]) == (window is None)
                for lo in range(edge[t], edge[t + 1], TOGETHER):
                    mine = np.arange(lo, min(edge[t + 1], lo + TOGETHER))
                    scores = s[of[mine] - a]
                    allowed = other[of[mine] - a] & (scores >= now[mine, None]) & (scores <= most[mine, None])
                    at, column = strongest(scores, allowed, now[mine], k)
                    best.add(mine[at], scores[at, column], ids[column])
        at, score, id_ = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(qid[of[at]]), pa.array(goal[at]), pa.array(id_), pa.array(score)], ["anchor_id", "goal", "vec_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "goal").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(queries: DataFrame, rows: DataFrame, index, d: int, k: int, window: tuple[int, int] | None, first_lists: int) -> DataFrame:
    """anchor_id, goal, vec_id, score, rank. queries: vec_id, units, label, goals."""
    kind = rows.schema["units"].dataType.simpleString()
    blocks = block_count(queries.count(), d)
    cells = int(index.value[3].sum()) * blocks
    kept = in_cells(rows.select("vec_id", "units", "label", "slice", F.col("away").alias("place")), "slice", blocks)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = None
    for wave in ((0, first_lists), (first_lists, None)):
        none = F.lit(NONE)
        if found is None:
            asked = queries.withColumn("kths", F.transform("goals", lambda _: none))
        else:
            kth = found.groupBy("anchor_id", "goal").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
            # A query has a search for each of its positives at most.
            kth = kth.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("goal", "kth"))).alias("kth_of"))
            asked = queries.join(kth, "vec_id", "left").withColumn("kths", F.transform("goals", lambda g: F.coalesce(F.col("kth_of")[g], none))).drop("kth_of")
        sent = asked.mapInArrow(_visits(index, blocks, wave, window), f"cell long, vec_id long, units {kind}, label long, goals array<long>, kths array<long>")
        met = meet(sent, kept, cells, _search(k, window), FOUND)
        found = staged(_top(met if found is None else met.unionByName(found), k).drop("rank"), "found")
    return _top(found, k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), first_lists: int = FIRST_LISTS, most_lists: int = MOST_LISTS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, embedding, label; anchors: a condition on vec_id and label. Scores are inner products of floor(256 * x).

    An anchor's positives are its first rows of equal label by score; of each, the negatives are the first rows of another label with window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score.
    """
    spark = tuned(vectors.sparkSession)
    labelled = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).filter("label is not null")
    rows = staged(unit_vectors(labelled, "label"), "units")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims = dimensions(rows)
    for d in dims:
        part = _of_dimension(rows.filter(F.size("units") == d), d, anchors, positives, negatives, window, first_lists, most_lists, slice_rows)
        out = part if len(dims) == 1 else out.unionByName(part)
    return out


def _of_dimension(rows: DataFrame, d: int, anchors: Column, positives: int, negatives: int, window: tuple[int, int], first_lists: int, most_lists: int, slice_rows: int) -> DataFrame:
    spark = rows.sparkSession
    centres = centroids(rows, rows.count(), d, most_lists)
    kind = rows.schema["units"].dataType.simpleString()
    lists = staged(rows.mapInArrow(_assigned(spark.sparkContext.broadcast(centres)), f"vec_id long, label long, units {kind}, list int, away double"), "lists")
    # One row for each list.
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in lists.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect():
        size[r["list"]], radius[r["list"]] = r["n"], r["radius"]
    slices = -(-size // slice_rows)
    first = np.cumsum(slices) - slices
    index = spark.sparkContext.broadcast((centres, radius, first, slices))
    of_list = lambda values: F.element_at(F.lit([int(v) for v in values]), F.col("list") + 1)
    rows = lists.withColumn("slice", of_list(first) + F.pmod(F.xxhash64("vec_id"), of_list(np.maximum(1, slices))))
    asked = lists.filter(anchors).select("vec_id", "units", "label")
    near = staged(_searched(asked.withColumn("goals", F.array(F.lit(0).cast("long"))), rows, index, d, positives, None, first_lists), "positives")
    # An anchor's positives are few, as asked.
    goals = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("score").alias("goals"))
    far = _searched(asked.join(goals, "vec_id"), rows, index, d, negatives, window, first_lists)
    pairs = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal"))
    return pairs.join(far, ["anchor_id", "goal"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("goal").alias("positive_score"), F.col("score").alias("negative_score"))
