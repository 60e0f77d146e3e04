"""Hidden Markov language model over word tokens.

Tokens: words of the text with A-Z lower-cased, then one end token. A model has
K latent states, a transition matrix and, for each state, a distribution over
emission classes. Every frequent word (and the end) is a class of its own; all
other words fall in `RARE` classes by hash, within which a word has probability
(c + 0.5) / (T + 0.5 (D + 1)), where T and D count the class's training tokens
and distinct words; the spare half-count is for words not met. So

    log10 P(text) = scaled forward recursion over classes
                  + sum over rare tokens of log10 P(word | class).

Counting, training and scoring cover all rows; word counts stay in a table that
grows with the corpus and is joined, never broadcast. Only the frequent words
(at most FREQUENT) and the model (K x classes) go to the driver and to tasks.
Baum-Welch: each partition returns expected counts, which Spark sums.

The recursion runs over segments of L tokens side by side: the transfer matrix
of each segment first, then across a text's segments, then inside them.

Null and empty texts are one end token. Without training rows every word is
unknown, N = V = 0 and the model is uniform. Repeated rows count and are scored
each. A null doc_id has fold null: it is trained on and not held out. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.llm.shared import crc_fold, staged
from quillfin.llm.words import U, mix64, pieces, split_words

END = int(np.uint64(0x51ED270B7A1F4C6D).view(np.int64))
FREQUENT = 65_536
#: Classes are numbered in 16 bits, the shared ones among them.
MOST_OWN_CLASSES = 32_000
OWN_CLASS = 16_384
RARE = 64
STATES = 6
ROUNDS = 3
SEGMENT = 64


# ---- counting --------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        h = split_words(b.column("text"), lower=True).hashes().view(np.int64)
        keys, n = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, END)), pa.array(np.append(n, b.num_rows).astype(np.int64))], ["h", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): 64-bit word hash and its tokens in all texts, the end included."""
    return docs.select("text").mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Lookup:
    """Position of 64-bit keys in a list, by two direct tables of 2**20 slots and a search for what clashes in both."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.int64)
        k = self.keys.view(U)
        self.one = np.full(1 << 20, -1, np.int32)
        self.two = np.full(1 << 20, -1, np.int32)
        at = np.arange(len(k), dtype=np.int32)
        self.one[(k >> U(44)).astype(np.int64)] = at
        lost = at[self.one[(k >> U(44)).astype(np.int64)] != at]
        slot = ((k[lost] >> U(20)) & U(0xFFFFF)).astype(np.int64)
        self.two[slot] = lost
        lost = lost[self.two[slot] != lost]
        self.rest = np.sort(self.keys[lost])
        self.rest_at = lost[np.argsort(self.keys[lost])]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Positions of h (int64), -1 where absent."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        u = h.view(U)
        at = self.one[(u >> U(44)).astype(np.int64)]
        miss = np.flatnonzero((at < 0) | (self.keys[at] != h))
        if len(miss):
            sub = self.two[((u[miss] >> U(20)) & U(0xFFFFF)).astype(np.int64)]
            bad = (sub < 0) | (self.keys[sub] != h[miss])
            sub = np.where(bad, -1, sub)
            if len(self.rest) and bad.any():
                j = np.flatnonzero(bad)
                p = np.minimum(np.searchsorted(self.rest, h[miss[j]]), len(self.rest) - 1)
                sub[j] = np.where(self.rest[p] == h[miss[j]], self.rest_at[p], -1)
            at = at.copy()
            at[miss] = sub
        return at


@dataclass
class Vocabulary:
    """Frequent words, most frequent first: the first `own` have a class each."""

    keys: np.ndarray
    counts: np.ndarray
    own: int
    total: int
    distinct: int
    rare_total: np.ndarray
    rare_distinct: np.ndarray
    _lookup: Lookup | None = field(default=None, repr=False)

    @property
    def classes(self) -> int:
        return self.own + RARE

    def find(self, h: np.ndarray) -> np.ndarray:
        if self._lookup is None:
            self._lookup = Lookup(self.keys)
        return self._lookup(h)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def __getstate__(self):
        return self.__dict__ | {"_lookup": None}


def _threshold(levels: dict[int, int], most: int) -> int:
    """The least power of two such that at most `most` words have that count; levels: words by floor(log2 c)."""
    kept, level = 0, 64
    while level > 0 and kept + levels.get(level - 1, 0) <= most:
        level -= 1
        kept += levels.get(level, 0)
    return 1 << level


def vocabulary(counts: DataFrame, own_class: int | None = None) -> Vocabulary:
    level = F.floor(F.log2("c")).cast("int")
    levels = {r["level"]: r["n"] for r in counts.filter(F.col("h") != END).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    own_from, known_from = _threshold(levels, (own_class or OWN_CLASS) - 1), _threshold(levels, FREQUENT)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.filter((F.col("c") >= known_from) | (F.col("h") == END)).toPandas()
    end = int(top.c[top.h == END].sum()) if len(top) else 0
    top = top[top.h != END].sort_values(["c", "h"], ascending=[False, True])
    own = 1 + int((top.c >= own_from).sum())
    rare = counts.filter((F.col("c") < own_from) & (F.col("h") != END)).groupBy(F.pmod("h", F.lit(RARE)).alias("g")).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("d")).collect()
    t, d = np.zeros(RARE), np.zeros(RARE)
    for r in rare:
        t[r["g"]], d[r["g"]] = r["t"], r["d"]
    return Vocabulary(np.append(END, top.h.to_numpy()).astype(np.int64), np.append(end, top.c.to_numpy()).astype(np.int64), own, int(total["n"]), int(total["v"]), t, d)


def _code(vocabulary_, held_out: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_.value
        base = v.base(v.counts)
        for b in pieces(batches, "text"):
            w = split_words(b.column("text"), lower=True)
            h = w.hashes().view(np.int64)
            at = v.find(h)
            g = np.mod(h, RARE)
            cls = np.where((at >= 0) & (at < v.own), at, v.own + g).astype(np.int16)
            known = at >= 0
            n = np.diff(w.first)
            row_sum = lambda x: np.add.reduceat(np.append(x, 0), w.first[:-1]) * (n > 0) if len(n) else np.zeros(0)
            has_end = v.counts[0] > 0
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": b.column("rid"),
                    "doc_id": b.column("doc_id"),
                    "held_out": b.column("held_out"),
                    "n_tokens": pa.array(n + 1, pa.int64()),
                    "n_known": pa.array(row_sum(known.astype(np.int64)) + int(has_end), pa.int64()),
                    "base_score": pa.array(row_sum(np.where(known, base[at], 0.0)) + base[0]),
                    "cls": pa.array([np.append(cls[i:j], np.int16(0)).tobytes() for i, j in zip(w.first, w.first[1:])], pa.binary()),
                    "other": _lists(w.row, h, ~known, b.num_rows),
                    "frequent_rare": pa.array(row_sum(_frequent_rare(v, at, g))),
                }
            )

    return run


def _frequent_rare(v: Vocabulary, at: np.ndarray, g: np.ndarray) -> np.ndarray:
    """log10 P(word | class) of frequent words that share a class, else 0."""
    use = at >= v.own
    return np.where(use, np.log10((v.counts[at] + 0.5) / (v.rare_total[g] + 0.5 * (v.rare_distinct[g] + 1))), 0.0)


def _lists(row: np.ndarray, h: np.ndarray, use: np.ndarray, n_rows: int) -> pa.Array:
    """The chosen hashes of each row as a list."""
    offsets = np.zeros(n_rows + 1, np.int32)
    np.cumsum(np.bincount(row[use], minlength=n_rows), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[use]))


# ---- the model -------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states


def first_model(v: Vocabulary, states: int) -> Model:
    """Class frequencies, tilted for each state by a fixed hash of the class, and states that last."""
    freq = np.append(v.counts[: v.own], v.rare_total) + 0.5
    name = np.append(v.keys[: v.own].view(U), np.arange(RARE).astype(U))
    tilt = np.stack([(mix64(name ^ U(0xABCDEF12345 * (k + 1))) >> U(11)).astype(float) / 2.0**53 for k in range(states)], axis=1)
    emit = freq[:, None] * np.exp(2.0 * (tilt - 0.5))
    move = np.full((states, states), 0.2 / max(1, states - 1)) + np.eye(states) * (0.8 - 0.2 / max(1, states - 1))
    if states == 1:
        move = np.ones((1, 1))
    return Model(np.full(states, 1.0 / states), move, emit / emit.sum(axis=0))


class Segments:
    """The tokens of a batch of texts, cut in segments of L: full ones first, so that step t works on a leading slice."""

    def __init__(self, sequences: list[bytes], length: int = SEGMENT):
        arrays = [np.frombuffer(s, np.int16) for s in sequences]
        size = np.array([len(a) for a in arrays])
        self.n_rows, self.flat = len(arrays), np.concatenate(arrays) if arrays else np.zeros(0, np.int16)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        count = -(-size // length)
        doc = np.repeat(np.arange(self.n_rows), count)
        ordinal = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[doc] + ordinal * length
        n = np.minimum(length, size[doc] - ordinal * length)
        by = np.argsort(-n, kind="stable")
        self.at, self.n = at[by], n[by]
        self.length = length
        self.live = [int(np.searchsorted(-self.n, -t, side="left")) for t in range(length)]  # segments of more than t tokens
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        # Of the texts with more than j segments, most segments first: the place of segment j.
        self.texts = np.argsort(-count, kind="stable")
        seg0 = np.cumsum(count) - count
        self.turns = []
        for j in range(int(count.max()) if len(count) else 0):
            m = int(np.searchsorted(-count[self.texts], -j, side="left"))
            self.turns.append(place[seg0[self.texts[:m]] + j])

    def codes(self, t: int) -> np.ndarray:
        return self.flat[self.at[: self.live[t]] + t]


def _transfer(s: Segments, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scaled transfer matrix of each segment and the log of its scale."""
    k = len(m.start)
    mat = np.broadcast_to(np.eye(k), (len(s.at), k, k)).copy()
    scale = np.zeros(len(s.at))
    for t in range(s.length):
        n = s.live[t]
        if not n:
            break
        new = (mat[:n].reshape(-1, k) @ m.move).reshape(n, k, k) * m.emit[s.codes(t)][:, None, :]
        if t % 4 == 3 or t == s.length - 1:
            top = new.max(axis=(1, 2))
            new /= top[:, None, None]
            scale[:n] += np.log(top)
        mat[:n] = new
    return mat, scale


def forward(s: Segments, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln P of each text, state distribution before each segment, transfer matrices)."""
    mat, scale = _transfer(s, m)
    k = len(m.start)
    now = np.broadcast_to(m.start, (s.n_rows, k)).copy()
    total = np.zeros(s.n_rows)
    before = np.zeros((len(s.at), k))
    for place in s.turns:
        n = len(place)
        before[place] = now[:n]
        v = np.einsum("nk,nkl->nl", now[:n], mat[place])
        z = v.sum(axis=1)
        now[:n] = v / z[:, None]
        total[:n] += np.log(z) + scale[place]
    out = np.empty(s.n_rows)
    out[s.texts] = total
    return out, before, mat


def expected_counts(s: Segments, m: Model, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(start, move, emit) counts of one Baum-Welch step over the batch, and its ln likelihood."""
    k = len(m.start)
    ln, alpha_in, mat = forward(s, m)
    beta_out = np.ones((len(s.at), k))
    now = np.ones((s.n_rows, k))
    for place in reversed(s.turns):
        n = len(place)
        beta_out[place] = now[:n]
        v = np.einsum("nkl,nl->nk", mat[place], now[:n])
        now[:n] = v / v.max(axis=1)[:, None]
    alpha, cur = [], alpha_in.copy()
    for t in range(s.length):
        n = s.live[t]
        if not n:
            break
        v = (cur[:n] @ m.move) * m.emit[s.codes(t)]
        cur[:n] = v / v.sum(axis=1)[:, None]
        alpha.append(cur[:n].copy())
    move, start = np.zeros((k, k)), np.zeros(k)
    emit = np.zeros((classes, k))
    beta = beta_out
    for t in reversed(range(len(alpha))):
        n, c = s.live[t], s.codes(t)
        gamma = alpha[t] * beta[:n]
        norm = gamma.sum(axis=1)[:, None]
        gamma /= norm
        for j in range(k):
            emit[:, j] += np.bincount(c, gamma[:, j], classes)
        ahead = m.emit[c] * beta[:n]
        was = alpha[t - 1][:n] if t else alpha_in[:n]
        back = ahead @ m.move.T
        z = (was * back).sum(axis=1)[:, None]
        move += m.move * (was.T @ (ahead / z))
        beta[:n] = back / back.max(axis=1)[:, None]
        if t == 0 and s.turns:
            head = s.turns[0]
            g = alpha_in[head] * beta[head]
            start += (g / g.sum(axis=1)[:, None]).sum(axis=0)
    return start, move, emit, float(ln.sum())


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return pieces(batches, "cls", 400_000)


def _expectation(model_, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_.value
        k = len(m.start)
        total = np.zeros(k + k * k + classes * k + 1)
        for b in _batches(batches):
            start, move, emit, ln = expected_counts(Segments(b.column("cls").to_pylist()), m, classes)
            total += np.concatenate([start, move.ravel(), emit.ravel(), [ln]])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "x"])

    return run


def train(coded: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over every row of coded (cls)."""
    m = first_model(v, states)
    spark = coded.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(m)
        sums = coded.select("cls").mapInArrow(_expectation(sent, v.classes), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros(states + states**2 + v.classes * states + 1)
        total[sums.i.to_numpy(dtype=np.int64)] = sums.x.to_numpy()
        start, move = total[:states] + 1.0, total[states : states + states**2].reshape(states, states) + 1.0
        emit = total[states + states**2 : -1].reshape(v.classes, states)
        # Half a token of each class in proportion to its overall frequency keeps every class possible in every state.
        freq = np.append(v.counts[: v.own], v.rare_total) + 0.5
        emit = emit + 0.5 * len(freq) * (freq / freq.sum())[:, None]
        m = Model(start / start.sum(), move / move.sum(axis=1)[:, None], emit / emit.sum(axis=0))
    return m


def _score(model_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_.value
        for b in _batches(batches):
            ln, _, _ = forward(Segments(b.column("cls").to_pylist()), m)
            cols = {c: b.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score")}
            score = pc.add(b.column("frequent_rare"), pa.array(ln / np.log(10.0)))
            yield pa.RecordBatch.from_pydict(cols | {"score": score})

    return run


def language_model_scores(docs: DataFrame, held_out_fold: int = 1, states: int = STATES, rounds: int = ROUNDS, own_class: int = 0) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. own_class: the most frequent words that get a class of their own (0: OWN_CLASS; at most MOST_OWN_CLASSES, more is an error)."""
    if not 0 <= own_class <= MOST_OWN_CLASSES:
        raise ValueError(f"own_class must be from 0 to {MOST_OWN_CLASSES}")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(crc_fold() == held_out_fold, F.lit(False)))
    counts = staged(word_counts(docs.filter("not held_out")), "word-counts")
    v = vocabulary(counts, own_class)
    shared_v = spark.sparkContext.broadcast(v)
    coded = staged(
        docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
            _code(shared_v, held_out_fold), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, cls binary, other array<long>, frequent_rare double"
        ),
        "coded",
    )
    model = train(coded.filter("not held_out"), v, states, rounds)
    scored = coded.drop("other").mapInArrow(_score(spark.sparkContext.broadcast(model)), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")

    g = F.pmod("h", F.lit(RARE))
    class_mass = F.array(*[F.lit(float(x)) for x in v.rare_total + 0.5 * (v.rare_distinct + 1)])
    c = F.coalesce("c", F.lit(0))
    rare = (
        coded.select("rid", F.explode("other").alias("h"))
        .join(counts, "h", "left")
        .groupBy("rid")
        .agg(
            F.sum((c > 0).cast("long")).alias("more_known"),
            F.sum(F.log10((c + 0.5) / (v.total + 0.5 * (v.distinct + 1)))).alias("more_base"),
            F.sum(F.log10((c + 0.5) / F.element_at(class_mass, (g + 1).cast("int")))).alias("more_score"),
        )
    )
    return scored.join(rare, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
