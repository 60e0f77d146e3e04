"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words (lower case) and word beginnings of 4 and 6 letters, all of
them: a text's vector has a weight (1 + ln tf) * idf * relevance for each of its
terms and is of unit length. A term's relevance tells how far its document
counts differ between toxic and clean examples (by the G2 statistic, on either
side), FLOOR for terms that mark neither, so that likeness in what bears on the
label counts most and no term is left out.

Examples of equal vectors are one entry with its rows. Entries lie in an
inverted index of aligned blocks with each term's greatest weight in a block;
the lists of very common terms are rows of a matrix. A search adds these maxima
up to an upper bound for every block, opens the FIRST most promising blocks, and
then in one pass all others whose bound reaches the k-th best score: the k
nearest are exact.

Votes count by similarity, relative to the nearest, to the power SHARPNESS and
by rows. Scores are calibrated by isotonic regression on the examples' own scores
with each entry left out in turn. A text that shares no term with any example
takes the rate of toxic examples. The nearest examples are the evidence.

The classifier is fitted on a bounded sample of labelled rows: those of least
hash of doc_id, at most MAX_TOXIC toxic and MAX_CLEAN clean ones and EXAMPLE_CHARS
characters in all (rows beyond these are left out whole). Each counts for as many
labelled rows of its label as the sample lacks. Every document is scored in whole.

Null and empty texts have no term. Repeated documents are scored each; of
repeated labels the greatest counts. Rows with null doc_id are scored and not
held out; null labels are not used. Without training labels every score is 0.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.llm.shared import KEY, crc_fold, staged, with_row_key
from quillfin.llm.words import pieces, ranges

MAX_TOXIC = 512
MAX_CLEAN = 1_536
EXAMPLE_CHARS = 32_000_000
#: Least relevance of a term, and the G2 at which it is one half.
FLOOR = 0.05
HALF_G2 = 24.0
NEAREST = 24
SHARPNESS = 4.0
BLOCK = 128
FIRST = 2
#: A term is common if one of so many entries has it.
COMMON = 8
#: Texts whose common terms are multiplied at once.
TOGETHER = 64
_WORD = re.compile(r"\w+")


def term_counts(text: str | None) -> Counter:
    """How often each term stands in a text."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        out[w] += n
        if len(w) > 4:
            out["^" + w[:4]] += n
            if len(w) > 6:
                out["^" + w[:6]] += n
    return out


def g2(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """G2 of terms' document counts against the label."""
    n, out = n_pos + n_neg, np.zeros(len(pos))
    if not (n_pos and n_neg):
        return out
    for seen, total in ((pos, n_pos), (neg, n_neg)):
        for o, e in ((seen, (pos + neg) * total / n), (total - seen, (n - pos - neg) * total / n)):
            at = np.flatnonzero(o > 0)
            out[at] += 2 * o[at] * np.log(o[at] / e[at])
    return np.maximum(out, 0.0)


def relevance(stat: np.ndarray) -> np.ndarray:
    return np.maximum(FLOOR, stat**2 / (stat**2 + HALF_G2**2))


@dataclass
class Index:
    """Postings of the entries by term: of term t, entry[first[t]:first[t + 1]] with their weights."""

    terms: pa.Array
    weight: np.ndarray  # of each term: idf * relevance
    unseen: float  # of terms that no example has
    first: np.ndarray
    entry: np.ndarray
    x: np.ndarray
    rows: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray
    base_rate: float = 0.0
    knots: tuple | None = None
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    @property
    def _parts(self) -> dict:
        """What a search needs besides, made once in each worker."""
        made = self._made
        if not made:
            n, blocks = len(self.rows), -(-len(self.rows) // BLOCK)
            df = np.diff(self.first)
            made["place"] = {t: i for i, t in enumerate(self.terms.to_pylist())}
            common = np.flatnonzero(df * COMMON > n)
            made["row"] = np.full(len(df), -1, np.int64)
            made["row"][common] = np.arange(len(common))
            made["matrix"] = np.zeros((len(common), n))
            for j, t in enumerate(common):
                at = slice(self.first[t], self.first[t + 1])
                made["matrix"][j, self.entry[at]] = self.x[at]
            padded = np.zeros((len(common), blocks * BLOCK))
            padded[:, :n] = made["matrix"]
            made["matrix_most"] = padded.reshape(len(common), blocks, BLOCK).max(axis=2)
            # (term, block) pairs of all lists, with the place of their first posting and their greatest weight.
            term = np.repeat(np.arange(len(df)), df)
            block = self.entry.astype(np.int64) // BLOCK
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
            at = np.flatnonzero(new)
            made["pair_at"] = np.append(at, len(term))
            made["pair_block"] = block[at]
            made["pair_most"] = np.maximum.reduceat(self.x, at) if len(at) else np.zeros(0)
            made["pair_first"] = np.searchsorted(term[at], np.arange(len(df) + 1))
        return made

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of a text, of unit length with the terms that no example has."""
        place = self._parts["place"]
        known = [(i, n) for t, n in counts.items() if (i := place.get(t)) is not None]
        t = np.array([i for i, _ in known], np.int64)
        q = (1 + np.log(np.array([n for _, n in known], float))) * self.weight[t]
        rest = [n for t_, n in counts.items() if t_ not in place] if len(known) < len(counts) else []
        norm = np.sqrt((q**2).sum() + (((1 + np.log(np.array(rest, float))) * self.unseen) ** 2).sum())
        return t, q / norm if norm > 0 else q

    def of_entry(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of an entry."""
        made = self._parts
        if "by_entry" not in made:
            order = np.argsort(self.entry, kind="stable")
            made["by_entry"] = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[order], self.x[order], np.searchsorted(self.entry[order], np.arange(len(self.rows) + 1))
        term, x, cut = made["by_entry"]
        return term[cut[i] : cut[i + 1]], x[cut[i] : cut[i + 1]]

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """What common terms add to the bounds of all blocks and the scores of all entries, a row for each vector."""
        made = self._parts
        dense = np.zeros((len(vectors), len(made["matrix"])))
        for i, (t, q) in enumerate(vectors):
            row = made["row"][t]
            dense[i, row[row >= 0]] = q[row >= 0]
        return dense @ made["matrix_most"], dense @ made["matrix"]

    def nearest(self, t: np.ndarray, q: np.ndarray, k: int = NEAREST, without: int = -1, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the k nearest entries with a term in common; ties to the smaller entry. common: the vector's rows of common(), if they are made already."""
        made, n = self._parts, len(self.rows)
        bound, score = common or (x[0] for x in self.common([(t, q)]))
        rare = made["row"][t] < 0
        t, q = t[rare], q[rare]
        pairs, of = ranges(made["pair_first"][t], made["pair_first"][t + 1])
        q = q[of]
        block = made["pair_block"][pairs]
        bound = bound + np.bincount(block, q * made["pair_most"][pairs], minlength=len(bound))
        seen = np.zeros(len(bound), bool)
        least = 0.0
        for wanted in (np.argsort(-bound, kind="stable")[:FIRST], None):
            if wanted is None:
                wanted = np.flatnonzero(~seen & (bound > 0) & (bound >= least - 1e-12))
            if not len(wanted):
                break
            now = np.zeros(len(bound), bool)
            now[wanted] = True
            use = np.flatnonzero(now[block])
            spots, by = ranges(made["pair_at"][pairs[use]], made["pair_at"][pairs[use] + 1])
            score = score + np.bincount(self.entry[spots], q[use][by] * self.x[spots], minlength=n)
            seen |= now
            open_ = np.repeat(seen, BLOCK)[:n] & (score > 0)
            if without >= 0:
                open_[without] = False
            at = np.flatnonzero(open_)
            if len(at) > k:
                least = np.partition(score[at], len(at) - k)[len(at) - k]
                at = at[score[at] >= least]
        order = np.lexsort((at, -score[at]))[:k]
        return at[order], score[at[order]]

    def raw(self, t: np.ndarray, q: np.ndarray, without: int = -1, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """(share of toxic votes, nearest entries, their cosines)."""
        at, cosine = self.nearest(t, q, without=without, common=common) if len(self.rows) else (np.zeros(0, np.int64), np.zeros(0))
        if not len(at):
            return self.base_rate, at, cosine
        w = (cosine / cosine[0]) ** SHARPNESS
        return float(((w * self.toxic[at]).sum() + 0.5 * self.base_rate) / ((w * self.rows[at]).sum() + 0.5)), at, cosine

    def scores(self, counts: list[dict[str, int]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(calibrated score, nearest entries, their cosines) of each text's term counts."""
        out = []
        vectors = [self.vector(c) for c in counts]
        for (t, q), *common in zip(vectors, *self.common(vectors)):
            raw, at, cosine = self.raw(t, q, common=tuple(common))
            if self.knots is not None:
                raw = 0.99 * float(np.interp(raw, *self.knots)) + 0.01 * raw
            out.append((min(1.0, max(0.0, raw)), at[:3], cosine[:3]))
        return out


def build_index(terms: pa.Array, counts: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> Index:
    """The index of examples. terms, counts: of all examples one after the other; sizes, toxic, ids, weights: of each example its number of terms, label, doc_id and the labelled rows it counts for."""
    coded = terms.dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    n, total = len(sizes), float(len(sizes))
    doc = np.repeat(np.arange(n), sizes)
    df = np.bincount(code, minlength=len(names)).astype(float)
    pos = np.bincount(code, toxic[doc], minlength=len(names))
    weight = (np.log((1 + total) / (1 + df)) + 1) * relevance(g2(pos, df - pos, float(toxic.sum()), float((1 - toxic).sum())))
    x = (1 + np.log(counts)) * weight[code]
    x = x / np.sqrt(np.bincount(doc, x**2, minlength=n))[doc]
    order = np.lexsort((code, doc))
    code, doc, x, counts = code[order], doc[order], x[order], counts[order]
    # Equal vectors make one entry; entries of like strongest terms stand together, so that blocks have few terms with a great maximum.
    cut = np.searchsorted(doc, np.arange(n + 1))
    same: dict[bytes, int] = {}
    kind = np.array([same.setdefault(code[a:b].tobytes() + counts[a:b].tobytes(), len(same)) for a, b in zip(cut, cut[1:])], np.int64)
    heads = np.full(len(same), n)
    np.minimum.at(heads, kind, np.arange(n))
    full = np.flatnonzero(np.diff(cut)[heads] > 0)
    lead = [(int(code[cut[h] + np.argmax(x[cut[h] : cut[h + 1]])]), int(ids[h])) for h in heads[full]]
    place = np.full(len(same), -1)
    place[full[sorted(range(len(full)), key=lambda i: lead[i])]] = np.arange(len(full))
    entry_of = place[kind]
    base = float((weights * toxic).sum() / weights.sum()) if n else 0.0
    rows, marked = (np.bincount(entry_of[entry_of >= 0], w[entry_of >= 0], minlength=len(full)) for w in (weights, weights * toxic))
    first_id = np.full(len(full), np.iinfo(np.int64).max)
    np.minimum.at(first_id, entry_of[entry_of >= 0], ids[entry_of >= 0])
    head = np.zeros(n, bool)
    head[heads[full]] = True
    use = head[doc]
    code, entry, x = code[use], entry_of[doc[use]], x[use]
    order = np.lexsort((entry, code))
    first = np.searchsorted(code[order], np.arange(len(names) + 1))
    return Index(names, weight, float((np.log(1 + total) + 1) * FLOOR), first, entry[order].astype(np.int32), x[order], rows, marked, first_id, base)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted monotone fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order]):
        pools.append([yi * wi, wi, xi, xi])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    xs, ys = [], []
    for s, n, lo, hi in pools:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [s / n] * (2 if hi > lo else 1)
    return np.array(xs), np.array(ys)


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        counts = [term_counts(t) for t in b.column("text").to_pylist()]
        columns = [b.column("doc_id"), b.column("toxic"), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "terms", "counts"])


def fit(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (MAX_CLEAN, MAX_TOXIC), chars: int = EXAMPLE_CHARS) -> Index:
    """The index of examples. docs: doc_id, text; labels: doc_id, toxic, training rows only."""
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [marked.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[c]) for c in (0, 1)]
    chosen = staged(parts[0].unionByName(parts[1]), "chosen")
    # One text of each doc_id, so that no repeated id brings more rows than there are examples.
    of_label = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    examples = staged(of_label.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text")), "examples")
    sizes = sorted(examples.select(F.xxhash64("doc_id"), "doc_id", F.length("text") + 1).collect())
    within = [r[1] for r, total in zip(sizes, np.cumsum([r[2] for r in sizes])) if total <= chars]
    if len(within) < len(sizes):
        examples = examples.join(F.broadcast(spark.createDataFrame([(i,) for i in within], "doc_id long")), "doc_id", "left_semi")
    found = examples.repartition(spark.sparkContext.defaultParallelism, "doc_id").mapInArrow(_example_terms, "doc_id long, toxic int, terms array<string>, counts array<int>").toArrow().combine_chunks().sort_by("doc_id")
    lists, counts = found.column("terms").combine_chunks(), found.column("counts").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(found) else np.zeros(0, np.int64)
    toxic = found.column("toxic").to_numpy().astype(float)
    have = {c: max(1, int((toxic == c).sum())) for c in (0, 1)}
    scale = {c: n.get(c, 0) / have[c] for c in (0, 1)}
    mean = max(1e-12, sum(n.values()) / max(1, len(found)))
    weights = np.where(toxic == 1, scale[1], scale[0]) / mean
    index = build_index(lists.flatten(), counts.flatten().to_numpy().astype(float), sizes, toxic, found.column("doc_id").to_numpy(), weights)
    if len(index.rows):
        own = spark.range(len(index.rows)).select(F.col("id").cast("int").alias("i")).repartition(max(1, len(index.rows) // 250), "i")
        held = own.mapInArrow(_left_out(spark.sparkContext.broadcast(index)), "i int, raw double").toArrow().sort_by("i")
        index.knots = isotonic(held.column("raw").to_numpy(), index.toxic / index.rows, index.rows)
    return index


def _left_out(index_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index_.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array([ix.raw(*ix.of_entry(i), without=i)[0] for i in b.column("i").to_pylist()], pa.float64())], ["i", "raw"])

    return run


def _scores(index_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index_.value
        for b in pieces(batches, "text"):
            score, ids, cosines = [], [], []
            for a in range(0, b.num_rows, TOGETHER):
                for s, at, cosine in ix.scores([term_counts(t) for t in b.column("text").slice(a, TOGETHER).to_pylist()]):
                    score.append(s)
                    ids.append(ix.ids[at].tolist())
                    cosines.append(cosine.tolist())
            keys = [b.column(c) for c in ("doc_id", *KEY)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(score, pa.float64()), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], ["doc_id", *KEY, "score", "evidence", "cosines"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, the row's key (KEY), held_out, score, predicted, evidence (nearest examples' doc_id), cosines."""
    docs = with_row_key(docs)
    index = fit(docs, labels.filter(crc_fold() != held_out_fold))
    scored = docs.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(index)), "doc_id long, doc_key long, doc_key2 long, score double, evidence array<long>, cosines array<double>")
    return scored.select("doc_id", *KEY, F.coalesce(crc_fold() == held_out_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "cosines")
