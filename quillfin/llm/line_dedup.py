"""Line dedup by content-defined chunks of lines.

A text's lines (split at \\n) are hashed, and a hash rolling over the last two
lines ends a chunk where it is 0 modulo DIVISOR; an insertion moves no boundary
but its own. Chunks of two lines and more that occur more than once anywhere
are repeated. The occurrence of least (doc_id, row key, place) stays; each other
one is removed if its bytes equal those of the one that stays.

Passages seldom begin and end at chunk boundaries. With `windows`, each run of
min_lines lines is looked up as well, by the same rule: a line goes if it lies in
such a run that stands earlier too, so no repeated passage of min_lines lines or
more is left but its first occurrence. Runs inside a repeated chunk need no
bytes of their own.

Null texts stay null and empty ones empty. Of repeated rows the first one read
is the first occurrence, and the others lose all their chunks (with windows: all
lines, if there are min_lines). Rows are told apart by their place in the input, so
docs must give the same rows in the same partitions whenever it is read, as files
do. A null doc_id comes first. The columns named in `carry` come along as the fields of
one struct, whatever their names; others are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfin.llm.shared import KEY, staged, with_row_key
from quillfin.llm.words import U, digests, mix64, pieces, slice_digests

DIVISOR = 4
MIN_LINES = 2


def _lines(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(buffer, row, first byte, end byte) of every line."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1]
    buf = np.frombuffer(joined.buffers()[2], np.uint8)[: offsets[-1]]
    end = np.flatnonzero(buf == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    return buf, np.searchsorted(offsets, start, side="right") - 1, start, end


def _cuts(buf: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, divisor: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every chunk."""
    h = np.ascontiguousarray(digests(buf, buf != 10, end - start)[:, 0])
    before = np.concatenate([[U(0)], h[:-1]])
    before[np.flatnonzero(np.diff(row, prepend=-1))] = 0
    last_of_row = np.append(np.diff(row) != 0, True)
    stop = np.flatnonzero((mix64(h ^ (before * U(0x9E3779B97F4A7C15))) % U(divisor) == 0) | last_of_row)
    return np.concatenate([[0], stop[:-1] + 1]), stop


def _line_chunks(texts: pa.Array, divisor: int) -> tuple[np.ndarray, ...]:
    """(buffer, row, first byte, end byte, lines, number in its row) of every chunk."""
    buf, row, start, end = _lines(texts)
    begin, stop = _cuts(buf, row, start, end, divisor)
    chunk_row = row[begin]
    number = np.arange(len(begin)) - np.searchsorted(chunk_row, chunk_row)
    return buf, chunk_row, start[begin], end[stop], stop - begin + 1, number


def _units(lines: tuple[np.ndarray, ...], divisor: int, min_lines: int, windows: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every chunk of min_lines and more and, with windows, of every run of min_lines in a row."""
    buf, row, start, end = lines
    begin, stop = _cuts(buf, row, start, end, divisor)
    use = (stop - begin + 1 >= min_lines + windows) & (end[stop] > start[begin])
    begin, stop = begin[use], stop[use]
    if windows:
        at = np.arange(max(0, len(row) - min_lines + 1))
        at = at[(row[at] == row[at + min_lines - 1]) & (end[at + min_lines - 1] > start[at])]
        begin, stop = np.concatenate([begin, at]), np.concatenate([stop, at + min_lines - 1])
    return begin, stop


def _hash_units(divisor: int, min_lines: int, windows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            buf, row, start, end = lines = _lines(b.column("text"))
            begin, stop = _units(lines, divisor, min_lines, windows)
            h = slice_digests(buf, start[begin], end[stop]).view(np.int64)
            mine = row[begin]
            line = begin - np.searchsorted(row, mine)
            at = pa.array(mine)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), *(b.column(c).take(at) for c in ("doc_id", *KEY, "rid")), pa.array(line.astype(np.int32)), pa.array((stop - begin + 1).astype(np.int32))], ["h1", "h2", "doc_id", *KEY, "rid", "line", "n"])

    return run


def _take_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        buf, row, start, end = _lines(b.column("text"))
        first = np.searchsorted(row, np.arange(b.num_rows))
        h1, h2, data = [], [], []
        for r, wanted in enumerate(b.column("wanted").to_pylist()):
            for x in wanted:
                i = first[r] + x["line"]
                h1.append(x["h1"])
                h2.append(x["h2"])
                data.append(buf[start[i] : end[i + x["n"] - 1]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(data, pa.binary())], ["h1", "h2", "bytes"])


def _own_lines(text: str, divisor: int, min_lines: int, windows: bool) -> set[int]:
    """The lines of all units of a text."""
    begin, stop = _units(_lines(pa.array([text])), divisor, min_lines, windows)
    return {i for a, z in zip(begin.tolist(), stop.tolist()) for i in range(a, z + 1)}


def _drop_units(divisor: int, min_lines: int, windows: bool, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            kept, n_lines, n_removed, sha = [], [], [], []
            for text, drop, later in zip(*(b.column(c).to_pylist() for c in ("text", "drops", "later"))):
                n_lines.append(0 if text is None else text.count("\n") + 1)
                gone: set[int] = set()
                if later:
                    gone = _own_lines(text, divisor, min_lines, windows)
                elif drop:
                    mine = text.encode().split(b"\n")
                    for x in drop:
                        at = range(x["line"], x["line"] + x["n"])
                        if b"\n".join(mine[at.start : at.stop]) == x["bytes"]:
                            gone.update(at)
                if gone:
                    text = "\n".join(m for i, m in enumerate(text.split("\n")) if i not in gone)
                n_removed.append(len(gone))
                sha.append(hashlib.sha256((text or "").encode()).hexdigest())
                kept.append(text if keep_text else None)
            made = {"n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if c not in ("text", "drops", "later")} | made)

    return run


def line_dedup(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES, keep_text: bool = True, windows: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, the row's key (KEY), n_lines, n_removed, kept_sha256, kept_text (null unless keep_text), and carried if columns are carried. windows: look up every run of min_lines lines too."""
    key = list(KEY)
    if carry:
        docs = docs.select("doc_id", "text", F.struct(*carry).alias("carried"))
    docs = with_row_key(docs, *(["carried"] if carry else [])).withColumn("rid", F.monotonically_increasing_id())
    hashed = docs.drop("carried").mapInArrow(_hash_units(divisor, min_lines, windows), "h1 long, h2 long, doc_id long, doc_key long, doc_key2 long, rid long, line int, n int")
    units = staged(hashed, "chunks")
    place = F.struct("doc_id", *KEY, "line", "n")
    owners = units.groupBy("h1", "h2").agg(F.min(place).alias("own"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    owners = staged(owners.select("h1", "h2", *(F.col(f"own.{c}").alias(f"own_{c}") for c in (*KEY, "line", "n"))), "owners")
    # Rows that repeat: all but the first read.
    first = units.groupBy(*KEY).agg(F.min("rid").alias("first_rid"), F.max("rid").alias("last_rid")).filter("first_rid < last_rid").drop("last_rid")

    other = (F.col("doc_key") != F.col("own_doc_key")) | (F.col("doc_key2") != F.col("own_doc_key2")) | (F.col("line") != F.col("own_line"))
    copies = units.join(owners, ["h1", "h2"]).filter(other).select("h1", "h2", *KEY, "line", "n").dropDuplicates([*KEY, "line", "n"])
    # Chunks of a text do not overlap: the last one that began holds a window or none does.
    ends = F.max(F.when(F.col("n") > min_lines, F.col("line") + F.col("n"))).over(Window.partitionBy(*KEY).orderBy("line", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    if windows:
        copies = copies.withColumn("ends", ends).filter((F.col("n") > min_lines) | F.col("ends").isNull() | (F.col("ends") < F.col("line") + F.col("n"))).drop("ends")
    copies = staged(copies, "copies")
    needed = owners.join(copies.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    wanted = needed.groupBy(*(F.col(f"own_{c}").alias(c) for c in KEY)).agg(F.collect_list(F.struct("h1", "h2", F.col("own_line").alias("line"), F.col("own_n").alias("n"))).alias("wanted"))
    originals = docs.drop("rid", "carried").join(wanted, key).dropDuplicates(key).select("text", "wanted").mapInArrow(_take_units, "h1 long, h2 long, bytes binary")
    drops = copies.join(originals, ["h1", "h2"]).groupBy(*KEY).agg(F.collect_list(F.struct("line", "n", "bytes")).alias("drops"))
    rows = docs.join(drops, key, "left").join(first, key, "left").withColumn("later", F.coalesce(F.col("rid") > F.col("first_rid"), F.lit(False))).drop("rid", "first_rid")
    kept = rows.drop("text", "drops", "later")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "n_lines long, n_removed long, kept_sha256 string, kept_text string"])
    names = ["doc_id", *KEY, "n_lines", "n_removed", "kept_sha256", "kept_text"] + ["carried"] * bool(carry)
    return rows.mapInArrow(_drop_units(divisor, min_lines, windows, keep_text), schema).select(*names)
