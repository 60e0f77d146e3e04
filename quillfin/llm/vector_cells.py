"""Integer vectors, and queries that meet rows cell by cell.

A cell is a block of queries and a slice of rows; it is one group of a shuffle. Its
queries come first and are held, at most about QUERY_BYTES of them; its rows are read past
them in Arrow batches, so a task's memory does not grow with the slice or with the table.

Components are floor(256 * x), which a double (or a float, if x is one) holds exactly. Products are exact: by matrix
in double precision while no sum can leave 2**53, else by Python's whole numbers; a product
beyond a long's range counts as its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

QUERY_BYTES = 32_000_000
SLICE_ROWS = 16_384
#: Partitions of a shuffle; beyond it a task has several cells, one after the other.
MOST_TASKS = 50_000
#: Queries whose products with a batch are looked at together.
TOGETHER = 512
LIMIT = 2**63 - 1
NONE = -(2**63)


def unit_vectors(vectors: DataFrame, *carried: str) -> DataFrame:
    """(vec_id, units, carried): floor(256 * x) of the rows that take part: those with an id and a vector that has no null or non-finite component. Of rows of one id the least (carried columns, then components) takes part."""
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"), *carried)
    good = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    # 256 * x may leave the range of a float or double; then so does the product, and it is kept as the largest finite value.
    most = float(np.finfo(np.float32 if kind == "float" else np.float64).max)
    exact = lambda v: F.least(F.greatest(v.cast("double") * 256, F.lit(-most)), F.lit(most))
    # floor() of a double gives a long; below 2**52 that is exact, and from there on every double is whole.
    unit = lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v).cast(kind)
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & good).select("vec_id", F.struct(*carried, F.transform("e", lambda v: unit(exact(v))).alias("units")).alias("row"))
    return kept.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def dimensions(units: DataFrame) -> list[int]:
    return sorted(r["d"] for r in units.select(F.size("units").alias("d")).distinct().collect())


def squares(units: str = "units") -> Column:
    return F.aggregate(units, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one dimension as (n, d) doubles."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


def lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", x, x))


def above(least: np.ndarray) -> np.ndarray:
    """Doubles that every score of at least `least` exceeds; minus infinity for the least long, as which lower products count."""
    return np.where(least == NONE, -np.inf, least - 0.5)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) exact inner products as longs."""
    most = float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0))
    if most[0] * most[1] * max(1, a.shape[1]) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m.tolist()], object).reshape(m.shape)
    x, y = whole(a), whole(b)
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(len(a)):
        for j in range(len(b)):
            out[i, j] = max(NONE, min(LIMIT, sum((x[i] * y[j]).tolist())))
    return out


def block_count(n: int, d: int) -> int:
    """Blocks for n queries of d components."""
    return max(1, -(-n * 8 * max(1, d) // QUERY_BYTES))


def in_cells(rows: DataFrame, slice_: str, blocks: int) -> DataFrame:
    """rows once for each block of queries, with the cell of their slice and block."""
    each = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.withColumn("cell", F.col(slice_).cast("long") * blocks + F.col("block")).drop("block", slice_)


class Best:
    """The k best (score, id) of each of m searches so far: higher scores first, ties to the smaller id."""

    def __init__(self, m: int, k: int):
        self.score, self.id = np.full((m, k), NONE, np.int64), np.zeros((m, k), np.int64)
        self.count, self.k = np.zeros(m, np.int64), k

    def kth(self) -> np.ndarray:
        """The kth score of each search, the least long while it has fewer."""
        return np.where(self.count == self.k, self.score[:, -1], NONE)

    def add(self, search: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Take in pairs of a search and a row; a row comes to a search once."""
        if not len(search):
            return
        mine = np.unique(search)
        old = np.repeat(mine, self.count[mine])
        place = np.arange(len(old)) - np.repeat(np.cumsum(self.count[mine]) - self.count[mine], self.count[mine])
        s, v, i = np.concatenate([old, search]), np.concatenate([self.score[old, place], score]), np.concatenate([self.id[old, place], id_])
        order = np.lexsort((i, ~v, s))
        s, v, i = s[order], v[order], i[order]
        begin = np.searchsorted(s, mine)
        rank = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
        top = rank < self.k
        self.score[s[top], rank[top]], self.id[s[top], rank[top]] = v[top], i[top]
        self.count[mine] = np.minimum(self.k, np.diff(np.append(begin, len(s))))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, score, id) of all that was found."""
        at = np.repeat(np.arange(len(self.count)), self.count)
        place = np.arange(len(at)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        return at, self.score[at, place], self.id[at, place]


def strongest(s: np.ndarray, allowed: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the allowed scores that can be among the k best of their row: at least `least`, and at least the kth best allowed score of the row."""
    s = np.where(allowed, s, NONE)
    if s.shape[1] > k:
        least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    return np.nonzero(allowed & (s >= least[:, None]))


def meet(queries: DataFrame, rows: DataFrame, cells: int, search: Callable, schema: str) -> DataFrame:
    """Rows of `schema` that search(queries, batches of rows) yields for each cell. Both tables have cell, vec_id and units; rows have place, by which a cell's rows come. Queries and rows come as Arrow batches of all columns of both."""
    both = queries.withColumn("side", F.lit(0).cast("byte")).unionByName(rows.withColumn("side", F.lit(1).cast("byte")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _runs(batches)
        cell, side, part = next(parts, (None, None, None))
        while part is not None:
            now, held = cell, []
            while part is not None and cell == now and side == 0:
                held.append(part)
                cell, side, part = next(parts, (None, None, None))
            ahead = [(cell, side, part)]

            def rows_of() -> Iterator[pa.RecordBatch]:
                while ahead[0][2] is not None and ahead[0][0] == now:
                    yield ahead[0][2]
                    ahead[0] = next(parts, (None, None, None))

            if held:
                yield from search(pa.Table.from_batches(held).combine_chunks().to_batches()[0], rows_of())
            for _ in rows_of():  # what a search left unread, and cells without queries
                pass
            cell, side, part = ahead[0]

    return both.repartition(max(1, min(cells, MOST_TASKS)), "cell").sortWithinPartitions("cell", "side", "place").mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(cell, side, rows) of neighbouring rows of one cell and side."""
    for b in batches:
        if not b.num_rows:
            continue
        cell, side = b.column("cell").to_numpy(), b.column("side").to_numpy()
        turn = (np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1).tolist()
        for lo, hi in zip([0, *turn], [*turn, b.num_rows]):
            yield int(cell[lo]), int(side[lo]), b.slice(lo, hi - lo)
