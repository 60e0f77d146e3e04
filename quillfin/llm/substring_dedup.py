"""Substring dedup over a log-structured fingerprint index.

A window is a run of `width` consecutive words. Its fingerprint is the least
hash among the word grams inside it, so equal windows have equal fingerprints
and neighbouring windows mostly share one: about 7 % as many fingerprints as
words. The index keeps immutable runs of (fp, n) sorted by fp. A new batch is
aggregated, sorted and merge-joined with each run; fingerprints met before, or
twice in the batch, are matches; runs are then compacted into one sorted run.

Only windows with a matched fingerprint can repeat. Neighbouring windows with
one fingerprint form a segment. Segments of equal fingerprint and equal words
settle all their windows at once; where a segment's words stand alone, each of
its windows is compared with those of every other kind of segment of the
fingerprint. Words are compared by 128-bit BLAKE2b digests of their bytes, in
which no two different texts are known to agree.
The words that a repeated window covers are removed. Windows are judged on the
input: every occurrence goes, in whichever batch.

Nulls and empty texts have no words. Repeated rows count as occurrences of
their own, so their windows repeat. Rows keep doc_id as it is, null included.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfin.llm.shared import KEY, child_names, discard, exists, read_staged, staged, with_row_key
from quillfin.llm.words import U, Words, pieces, ranges, sliding, split_words

WIDTH = 35
GRAM = 8
BATCHES = 3
MAX_RUNS = 2
CONTEXT = ("context", "context2")


def _window_fps(w: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, fingerprint of each window, window lies in one row)."""
    g, _ = w.grams(w.hashes(), gram)
    g = g | U(1)
    fp = sliding(g, width - gram + 1, np.minimum)
    n = len(fp)
    inside = w.row[:n] == w.row[width - 1 : width - 1 + n] if n else np.zeros(0, bool)
    return g, fp, inside


def _spread(w: Words, g: np.ndarray, fp: np.ndarray, inside: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Segments, the runs of neighbouring windows of one row with one fingerprint: (first window, windows, occurrences of the fingerprint's gram)."""
    n = len(fp)
    row = w.row[:n]
    new = np.ones(n, bool)
    new[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
    new[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    use = inside[first]
    first, size = first[use], size[use]
    # A gram is chosen where some window that holds it has it as its least; those equal to a segment's fingerprint are its occurrences.
    pad = np.zeros(span - 1, U)
    most = sliding(np.concatenate([pad, np.where(inside, fp, U(0)), pad]), span, np.maximum)
    chosen = np.flatnonzero(most[: len(g)] == g)
    values, which = np.unique(g[chosen], return_inverse=True)
    spot = np.sort(which.astype(np.int64) * (len(g) + 1) + chosen)
    base = np.searchsorted(values, fp[first]).astype(np.int64) * (len(g) + 1)
    count = np.searchsorted(spot, base + first + size + span - 1) - np.searchsorted(spot, base + first)
    return first, size, count


def _segments(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = split_words(b.column("text"))
            g, fp, inside = _window_fps(w, width, gram)
            if not len(fp):
                continue
            first, size, count = _spread(w, g, fp, inside, width - gram + 1)
            context = w.sequence_digests(first, first + size + width - 1).view(np.int64)
            rows = w.row[first]
            at = first - w.first[rows]
            keys = [b.column(c).take(pa.array(rows)) for c in KEY]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(fp[first].view(np.int64)), pa.array(context[:, 0].copy()), pa.array(context[:, 1].copy()), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.minimum(count, 2).astype(np.int8))],
                [*KEY, "fp", *CONTEXT, "at", "size", "n"],
            )

    return run


def segments(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The windows of docs (KEY, text), by segments: fp, CONTEXT (digest of all the segment's words), at (first window), size (windows), n (occurrences of the gram; 2: more than one)."""
    return docs.select(*KEY, "text").mapInArrow(_segments(width, gram), "doc_key long, doc_key2 long, fp long, context long, context2 long, at int, size int, n byte")


class FingerprintIndex:
    """Sorted immutable runs of (fp, n), n being 1 or 2 (two and more).

    With a folder, runs are written below it, and after each change a manifest (a
    small table, numbered) that names them: `FingerprintIndex.open` goes on where the
    last whole manifest left off, and a later batch is joined with all history.
    """

    def __init__(self, max_runs: int = MAX_RUNS, folder: str | None = None):
        self.runs: list[DataFrame] = []
        self.max_runs, self.folder, self.version = max_runs, folder, 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, max_runs: int = MAX_RUNS) -> FingerprintIndex:
        """The index kept below a folder; an empty one where there is none yet."""
        index = cls(max_runs, folder)
        manifests = [n for n in child_names(spark, f"{folder}/manifest") if exists(spark, f"{folder}/manifest/{n}/_SUCCESS")]
        if manifests:
            index.version = max(map(int, manifests))
            names = [r["run"] for r in spark.read.schema("place int, run string").parquet(f"{folder}/manifest/{index.version}").orderBy("place").collect()]
            index.runs = [read_staged(spark, f"{folder}/{n}", "fp long, n byte") for n in names]
        return index

    def _run(self, df: DataFrame) -> DataFrame:
        return staged(df.sortWithinPartitions("fp"), "fp-run", folder=self.folder)

    def _commit(self, spark: SparkSession) -> None:
        if self.folder:
            self.version += 1
            rows = [(i, run._quillfin_path.rsplit("/", 1)[-1]) for i, run in enumerate(self.runs)]
            spark.createDataFrame(rows, "place int, run string").coalesce(1).write.parquet(f"{self.folder}/manifest/{self.version}")

    def add(self, fps: DataFrame) -> DataFrame:
        """Merge-join a batch's fingerprints with the runs, add them as a run, and return the matched fp."""
        batch = fps.groupBy("fp").agg(F.sum("n").alias("n")).select("fp", F.least("n", F.lit(2)).cast("byte").alias("n"))
        new = self._run(batch)
        found = new.filter("n > 1").select("fp")
        for run in self.runs:
            found = found.unionByName(new.select("fp").join(run.hint("merge").select("fp"), "fp", "left_semi"))
        found = staged(found, "fp-match")
        self.runs.append(new)
        old = self.compact() if len(self.runs) > self.max_runs else []
        self._commit(fps.sparkSession)
        # Only when no manifest names them any more.
        for run in old:
            discard(run)
        return found

    def compact(self) -> list[DataFrame]:
        """Merge all runs into one sorted run; the runs that it replaces are returned."""
        merged = self.runs[0]
        for run in self.runs[1:]:
            merged = merged.unionByName(run)
        merged = merged.groupBy("fp").agg(F.least(F.sum("n"), F.lit(2)).cast("byte").alias("n"))
        old, self.runs = self.runs, [self._run(merged)]
        return old


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = split_words(b.column("text"))
            work = b.column("work")
            flat = work.flatten()
            doc = np.repeat(np.arange(b.num_rows), np.diff(work.offsets.to_numpy()))
            at, size, known = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
            begin = w.first[doc] + at
            start, of = ranges(begin, begin + size)
            d = w.sequence_digests(start, start + width).view(np.int64)
            # A window of a repeated context counts twice and needs no answer; of the others, the row and place come along.
            mine = pa.array(doc[of], mask=known[of].astype(bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), *(b.column(c).take(mine) for c in KEY), pa.array((start - w.first[doc[of]]).astype(np.int32))],
                ["d1", "d2", *KEY, "at"],
            )

    return run


def _remove(width: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            n_words, n_removed, sha, kept_text = [], [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if spans:
                    change = np.zeros(len(words) + 1, np.int32)
                    at = np.array([(x["at"], x["at"] + x["size"] + width - 1) for x in spans])
                    np.add.at(change, at[:, 0], 1)
                    np.add.at(change, at[:, 1], -1)
                    words = [x for x, c in zip(words, np.cumsum(change)[:-1].tolist()) if c == 0]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode() if keep_text else None)
            columns = {"doc_id": b.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept_text, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless keep_text). docs: doc_id long, text string."""
    docs = with_row_key(docs)
    found_in = staged(segments(docs, width, gram), "segments")
    index = FingerprintIndex()
    found = None
    for k in range(batches):
        hit = index.add(found_in.filter(F.pmod("doc_key", F.lit(batches)) == k).select("fp", "n"))
        found = hit if found is None else found.unionByName(hit)
    matched = staged(found_in.join(found.distinct(), "fp", "left_semi"), "matched")

    # Segments of equal words are alike in all windows: met twice, all their windows repeat.
    contexts = matched.groupBy("fp", *CONTEXT).agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.min(F.struct(*KEY, "at", "size")).alias("one"))
    contexts = staged(contexts, "contexts")
    whole = matched.join(contexts.filter("copies > 1").select("fp", *CONTEXT), ["fp", *CONTEXT], "left_semi").select(*KEY, "at", "size")
    # Where a context stands alone, its windows meet those of every other context of the fingerprint, one copy of each.
    unsure = contexts.groupBy("fp").agg(F.min("copies").alias("least"), F.count(F.lit(1)).alias("kinds"), F.max("n").alias("n")).filter("least = 1 and (kinds > 1 or n > 1)").select("fp")
    work = contexts.join(unsure, "fp", "left_semi").select(*(f"one.{c}" for c in KEY), F.struct("one.at", "one.size", (F.col("copies") > 1).cast("int").alias("known")).alias("x")).groupBy(*KEY).agg(F.collect_list("x").alias("work"))
    windows = staged(docs.join(work, list(KEY)).dropDuplicates(list(KEY)).select(*KEY, "text", "work").mapInArrow(_windows(width), "d1 long, d2 long, doc_key long, doc_key2 long, at int"), "windows")
    repeated = windows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_key").isNull()).alias("known")).filter("n > 1 or known > 0").select("d1", "d2")
    single = windows.filter("doc_key is not null").join(repeated, ["d1", "d2"], "left_semi").select(*KEY, "at", F.lit(1).alias("size"))
    spots = whole.unionByName(single).groupBy(*KEY).agg(F.collect_list(F.struct("at", "size")).alias("spans"))
    return docs.join(spots, list(KEY), "left").select("doc_id", "text", "spans").mapInArrow(_remove(width, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
