"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Each of CURVES curves projects the vectors on AXES random orthonormal axes,
shifts them and orders them by Hilbert key. On each curve a query meets the rows
that stand within half a window of it in that order, scored exactly in double
precision on the original vectors; the best of all curves merge.

The window is fitted: SAMPLE query vectors (of least hash) are compared with all
rows, and the places of their true neighbours on the curves tell how wide a
window must be for a recall of RECALL; it has WINDOW_ROWS rows at least. On data
with structure it stays at that, however large the table. On isotropic vectors
no order brings neighbours together and the window grows with the table (README).

A curve is cut in ranges of about RANGE_ROWS rows, each one task's work, and a
range also gets the halo of half a window of rows beyond either end, so windows
go on across its ends. A task holds one range at a time, sorted by key. Curves are taken
ROUND at a time, which bounds the copies of the vectors that are on disk at once.

Copies: of rows with equal vectors only the k + 1 of least id can be among any
k nearest, ties going to the smaller id, so no more of them enter the curves, and
one search answers for all queries of equal vector.

A vector takes no part if it is null, zero or has null or non-finite components;
nor does a row without id. Vectors of different dimensions have no inner product:
each dimension is searched by itself. Repeated rows count
once. With k candidates or fewer, all are returned. An empty table has no result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quillfin.llm.shared import staged

CURVES = 32
ROUND = 8
AXES = 8
BITS = 7
WINDOW_ROWS = 1_024
RANGE_ROWS = 32_768
SAMPLE = 64
RECALL = 0.95
#: Queries that stand side by side on a curve are multiplied with the rows of their windows at once.
TOGETHER = 32
SEED = 20_240_229
U = np.uint64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (n, d), coordinates below 2**bits, on a d-dimensional Hilbert curve.

    The transform works on whole columns: undo the rotations of each level from
    the top bit down, Gray-decode, and interleave the bits.
    """
    x = [c.astype(U) for c in cells.T]
    for level in range(bits - 1, 0, -1):
        bit, low = U(1 << level), U((1 << level) - 1)
        for i in range(len(x)):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, U(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    parity = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        parity = np.where((x[-1] & U(1 << level)) != 0, parity ^ U((1 << level) - 1), parity)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = (key << U(1)) | (((c ^ parity) >> U(level)) & U(1))
    return key


def _axes(curve: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The projection (dimension, axes) and shift of a curve."""
    rng = np.random.default_rng([SEED, curve])
    q, _ = np.linalg.qr(rng.normal(size=(dimension, dimension)))
    return q[:, : min(AXES, dimension)], rng.random(min(AXES, dimension))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _keys_of(x: np.ndarray, curve: int, scale: float) -> np.ndarray:
    axes, shift = _axes(curve, x.shape[1])
    unit = np.clip((x @ axes) / (6 * scale) + 0.5, 0, 1)
    cell = np.minimum(((unit + 0.3 * shift) / 1.3 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_keys(cell, BITS).astype(np.int64)


def best(queries: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k greatest inner products of each query, ties to smaller ids."""
    s = queries @ rows.T
    few = min(k, s.shape[1])
    cut = -np.partition(-s, few - 1, axis=1)[:, few - 1]
    # The matrix product rounds in its own way: keep what may tie with the last, and score it again.
    i, j = np.nonzero(s >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None])
    score = np.add.reduce(queries[i] * rows[j], axis=1)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return query_ids[i[keep]], ids[j[keep]], score[keep]


# ---- the window: places of true neighbours on the curves ----


def _exact(sample_, k: int):
    """Rows (query_id, vec_id, score, embedding): of each batch the k best of each sampled query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_ids = sample_.value
        for b in batches:
            if b.num_rows:
                ids = b.column("vec_id").to_numpy()
                q, i, score = best(queries, _matrix(b.column("embedding")), query_ids, ids, k)
                at = np.argsort(ids, kind="stable")
                at = at[np.searchsorted(ids[at], i)]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(score), b.column("embedding").take(pa.array(at))], ["query_id", "vec_id", "score", "embedding"])

    return run


def _ranks(points_, scale: float):
    """Rows (curve, slot, n): how many of a task's rows stand between two neighbouring points of a curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = points_.value
        n = np.zeros((len(points), points.shape[1] + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("embedding"))
                for c, mine in enumerate(points):
                    n[c] += np.bincount(np.searchsorted(mine, _keys_of(x, c, scale), side="right"), minlength=n.shape[1])
        c, slot = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(n[c, slot])], ["curve", "slot", "n"])

    return run


def fitted_half(use: DataFrame, asked: DataFrame, k: int, curves: int, scale: float, recall: float, least: int) -> int:
    """Rows on either side of a query that its window must have on each curve."""
    spark = use.sparkSession
    sample = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return least
    q, ids = np.array([r["embedding"] for r in sample], float), np.array([r["vec_id"] for r in sample])
    schema = f"query_id long, vec_id long, score double, embedding {use.schema['embedding'].dataType.simpleString()}"
    found = use.mapInArrow(_exact(spark.sparkContext.broadcast((q, ids)), k + 1), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1).filter("vec_id <> query_id").collect()
    if not true:
        return least
    place = {v: i for i, v in enumerate(ids.tolist())}
    x = np.concatenate([q, np.array([r["embedding"] for r in true], float)])
    keys = np.stack([_keys_of(x, c, scale) for c in range(curves)])
    points = np.sort(keys, axis=1)
    counts = np.zeros((curves, points.shape[1] + 1), np.int64)
    for r in use.mapInArrow(_ranks(spark.sparkContext.broadcast(points), scale), "curve int, slot int, n long").groupBy("curve", "slot").agg(F.sum("n").alias("n")).collect():
        counts[r["curve"], r["slot"]] = r["n"]
    below = np.cumsum(counts, axis=1)
    rank = np.stack([below[c][np.searchsorted(points[c], keys[c], side="left")] for c in range(curves)])
    own = rank[:, [place[r["query_id"]] for r in true]]
    apart = np.sort(np.abs(rank[:, len(q) :] - own).min(axis=0))
    return max(least, int(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) + 1)


# ---- ranges, halos, search ----


def _keys(curves: range, scale: float):
    """Rows (curve, key, vec_id) of each vector on each curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("embedding"))
                for c in curves:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(_keys_of(x, c, scale)), b.column("vec_id")], ["curve", "key", "vec_id"])

    return run


def _marks(half: int):
    """Of each curve's rows in a sorted partition: how many, the first, the one after the first half and the one that begins the last half (key and id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            curve, key, ids = (b.column(c).to_numpy() for c in ("curve", "key", "vec_id"))
            for c in np.unique(curve).tolist():
                held.setdefault(c, []).append((key[curve == c], ids[curve == c]))
        rows = []
        for c, parts in held.items():
            key, ids = (np.concatenate(x) for x in zip(*parts))
            at = [0, min(half, len(key) - 1), max(0, len(key) - half)]
            rows.append((c, len(key), key[at].tolist(), ids[at].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["curve", "n", "keys", "ids"])

    return run


def halos(sizes: list[int], half: int) -> tuple[list[list[int]], list[list[int]], list[list[int]]]:
    """Of each range of a curve: the ranges that get all of its rows, its first half window and its last one, so that each has half a window beyond its ends."""
    whole, head, last = ([[] for _ in sizes] for _ in range(3))
    for r in range(len(sizes)):
        for step, edge in ((-1, last), (1, head)):
            have, j = 0, r + step
            while 0 <= j < len(sizes) and have < half:
                (whole if sizes[j] <= half else edge)[j].append(r)
                have += sizes[j]
                j += step
    return whole, head, last


def _place(keys: np.ndarray, ids: np.ndarray, at: np.ndarray, at_ids: np.ndarray) -> np.ndarray:
    """Of each (key, id), the number of the last of the ascending (at, at_ids) that is not greater, -1 if none."""
    pairs = np.rec.fromarrays([at, at_ids], names="k,i")
    return np.searchsorted(pairs, np.rec.fromarrays([keys, ids], dtype=pairs.dtype), side="right") - 1


def _send(cuts_, scale: float):
    """Rows (target, asked, key, vec_id, embedding): each vector to its range of each curve, and to those whose halo it is in. cuts: of each curve (keys and ids of the ranges' marks, first target, halos), a row for RANGE_ROWS vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = cuts_.value
        for b in batches:
            if not b.num_rows:
                continue
            x, ids, asked = _matrix(b.column("embedding")), b.column("vec_id").to_numpy(), b.column("asked").to_numpy(zero_copy_only=False)
            for c, (marks, mark_ids, given, sent) in cuts.items():
                key = _keys_of(x, c, scale)
                own = np.maximum(0, _place(key, ids, marks[:, 0], mark_ids[:, 0]))
                before = (key < marks[own, 1]) | ((key == marks[own, 1]) & (ids < mark_ids[own, 1]))
                after = (key > marks[own, 2]) | ((key == marks[own, 2]) & (ids >= mark_ids[own, 2]))
                rows, targets, flags = [np.arange(len(x))], [own], [asked]
                for in_halo, to in zip((np.ones(len(x), bool), before, after), sent):
                    for r in np.unique(own[in_halo]).tolist():
                        for t in to[r]:
                            at = np.flatnonzero(in_halo & (own == r))
                            rows.append(at)
                            targets.append(np.full(len(at), t))
                            flags.append(np.zeros(len(at), bool))
                at = np.concatenate(rows)
                columns = [pa.array((given + np.concatenate(targets)).astype(np.int32)), pa.array(np.concatenate(flags).astype(bool)), pa.array(key[at]), b.column("vec_id").take(pa.array(at)), b.column("embedding").take(pa.array(at))]
                yield pa.RecordBatch.from_arrays(columns, ["target", "asked", "key", "vec_id", "embedding"])

    return run


def _search(k: int, half: int):
    """Rows come by target, key and id."""

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        x, ids = _matrix(t.column("embedding").combine_chunks()), t.column("vec_id").to_numpy()
        asked = np.flatnonzero(t.column("asked").to_numpy())
        for a in range(0, len(asked), TOGETHER):
            mine = asked[a : a + TOGETHER]
            lo, hi = max(0, mine[0] - half), mine[-1] + half + 1
            q, i, score = best(x[mine], x[lo:hi], ids[mine], ids[lo:hi], k)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(score)], ["rep", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        target = None
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column("target").to_numpy()
            turn = (np.flatnonzero(np.diff(t)) + 1).tolist()
            for lo, hi in zip([0, *turn], [*turn, len(t)]):
                if held and t[lo] != target:
                    yield from found(held)
                    held = []
                target = t[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from found(held)

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) that take part, repeated rows once. Components stay float if they are, else double."""
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return rows.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & good).distinct()


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, curves: int = CURVES, window_rows: int = WINDOW_ROWS, recall: float = RECALL) -> DataFrame:
    """For each row whose vec_id is divisible by every: query_id, rank, vec_id, score of its k nearest. vectors: vec_id, embedding."""
    rows = valid_vectors(vectors)
    dimensions = sorted(r["d"] for r in rows.select(F.size("embedding").alias("d")).distinct().collect())
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in dimensions:
        part = _nearest_of(rows.filter(F.size("embedding") == d), d, k, every, curves, window_rows, recall)
        out = part if len(dimensions) == 1 else out.unionByName(part)
    return out


def _nearest_of(rows: DataFrame, d: int, k: int, every: int, curves: int, window_rows: int, recall: float) -> DataFrame:
    spark = rows.sparkSession
    copy = Window.partitionBy("embedding").orderBy("vec_id")
    few = staged(rows.withColumn("copy", F.row_number().over(copy)).filter(F.col("copy") <= k + 1), "few")
    # All queries of one vector are answered by the search for its copy of least id.
    heads = few.filter("copy = 1").select("embedding", F.col("vec_id").alias("rep"))
    queries = staged(rows.filter(F.col("vec_id") % every == 0).join(heads, "embedding").select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    reps = queries.select(F.col("rep").alias("vec_id"), F.lit(True).alias("asked")).distinct()
    use = staged(few.join(reps, "vec_id", "left").select("vec_id", "embedding", F.coalesce("asked", F.lit(False)).alias("asked")), "vectors")
    facts = use.agg(F.count(F.lit(1)).alias("n"), F.avg(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)).alias("norm")).first()
    scale = float(np.sqrt(facts["norm"] / d))
    half = min(facts["n"], fitted_half(use, use.filter("asked"), k, curves, scale, recall, -(-window_rows // 2)))
    kind = use.schema["embedding"].dataType.simpleString()
    found = None
    for a in range(0, curves, ROUND):
        now = range(a, min(curves, a + ROUND))
        parts = max(len(now), -(-facts["n"] * len(now) // max(RANGE_ROWS, 4 * half)))
        keys = use.mapInArrow(_keys(now, scale), "curve int, key long, vec_id long").repartitionByRange(parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
        made = keys.mapInArrow(_marks(half), "curve int, n long, keys array<long>, ids array<long>").collect()
        cuts, given = {}, 0
        for c in now:
            mine = sorted((r for r in made if r["curve"] == c), key=lambda r: (r["keys"][0], r["ids"][0]))
            cuts[c] = (np.array([r["keys"] for r in mine]), np.array([r["ids"] for r in mine]), given, halos([r["n"] for r in mine], half))
            given += len(mine)
        sent = use.mapInArrow(_send(spark.sparkContext.broadcast(cuts), scale), f"target int, asked boolean, key long, vec_id long, embedding {kind}")
        best_of = sent.repartition(max(1, given), "target").sortWithinPartitions("target", "key", "vec_id").mapInArrow(_search(k + 1, half), "rep long, vec_id long, score double")
        round_ = staged(best_of.distinct(), "neighbours")
        found = round_ if found is None else found.unionByName(round_)
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    top = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1).select("rep", "vec_id", "score")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return queries.join(top, "rep").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
