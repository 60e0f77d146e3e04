"""Near-duplicate classes: ProbMinHash signatures, banding, verification.

A text is its weighted set of five-word shingles (lower-cased words; a text of
fewer words is one shingle; weight: times it occurs). Every shingle x of weight
w starts a Poisson process of rate w, seeded by the shingle alone; its arrivals
fall on the registers at random, and a register keeps the shingle of its
earliest arrival. Two texts agree in a register with probability

    J_P(a, b) = sum over x in both of 1 / sum over y of max(a[y]/a[x], b[y]/b[x])

A shingle's process stops once its next arrival is later than every register's
earliest, so most shingles draw only once.

Texts of equal words are one node: their copies never meet in a band. Nodes
that agree in all registers of a band are candidates; a link is kept where the
exact J_P, from all shingles, reaches the threshold. Within a band's bucket:

1. Stars: each member is verified against the bucket's centre (one for each
   band, so 32 different ones).
2. Hubs: members of other classes are verified against the bucket's node with
   the least share of shingles of its own. A text with many edited copies is such
   a hub, and joins them at linear cost.
3. The rest, of pairs whose ends are not yet in one class: those that share a
   rare shingle, and those of a bucket (all buckets of one main class taken
   together) that share none and that an exact bound
   on J_P then allows (`_room`), so that a group of loosely alike texts costs
   few pairs. Pairs inside a class would add nothing to the classes; nothing
   else is left out.

Null and empty texts have no shingles: each such row is a class of its own.
Repeated rows (same doc_id and text) share a class. Rows with null doc_id take
part, and a class takes the least doc_id among its rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.llm.components import merged
from quillfin.llm.shared import KEY, SHINGLE_WORDS, SIMILARITY, discard, staged, with_row_key
from quillfin.llm.words import U, Words, mix64, pieces, split_words

REGISTERS = 128
BAND_ROWS = 4
#: A shingle is rare if at most so many of the texts in question have it.
RARE = 8
#: Registers of the second signature, of texts that are left for comparison within buckets.
FINE_REGISTERS = 512
BLOCK = 256
#: Candidates whose signatures agree in fewer registers are not verified: at J_P = 0.8 that is over six standard deviations off.
LEAST_AGREEMENT = 0.55


def _shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, weight) of each row's distinct shingles, in order, and the digest of each row's word sequence."""
    h = w.hashes()
    whole = w.sequence_digests(w.first[:-1], w.first[1:])
    g, inside = w.grams(h, k)
    rows, vals = w.row[: len(g)][inside], g[inside]
    n_words = np.diff(w.first)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        rows = np.concatenate([rows, short])
        vals = np.concatenate([vals, whole[short, 0]])
    order = np.lexsort((vals, rows))
    rows, vals = rows[order], vals[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (vals[1:] != vals[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(rows)))
    return rows[at], vals[at], weight, whole


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * (1.0 / 9007199254740992.0)


def prob_min_hash(rows: np.ndarray, vals: np.ndarray, weight: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """(n_rows, m) signatures: of each register, the hash of the shingle that arrives first; 0 where a row has no shingle."""
    first = np.full(n_rows * m, np.inf)
    sig = np.zeros(n_rows * m, U)
    rate = weight.astype(np.float64)
    seed = vals.copy()
    time = np.zeros(len(vals))
    live = np.arange(len(vals))
    while len(live):
        seed[live] = s = mix64(seed[live] + U(0x9E3779B97F4A7C15))
        time[live] = t = time[live] - np.log(_unit(s)) / rate[live]
        spot = rows[live] * m + (mix64(s ^ U(0x5851F42D4C957F2D)) % U(m)).astype(np.int64)
        better = np.flatnonzero(t < first[spot])
        if len(better):
            # The earliest of those that fall on one register in this round.
            by = better[np.lexsort((t[better], spot[better]))]
            lead = np.ones(len(by), bool)
            lead[1:] = spot[by][1:] != spot[by][:-1]
            by = by[lead]
            first[spot[by]] = t[by]
            sig[spot[by]] = vals[live[by]]
        stop = first.reshape(n_rows, m).max(axis=1)
        live = live[t < stop[rows[live]]]
    return sig.reshape(n_rows, m)


def _signatures(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            w = split_words(b.column("text"), lower=True)
            rows, vals, weight, whole = _shingles(w, k)
            n = b.num_rows
            sig = prob_min_hash(rows, vals, weight, n, m)
            empty = np.diff(w.first) == 0
            # 32 bits of a shingle's hash tell registers apart well enough; verification looks at all 64.
            sketch = pa.array([None if e else s.tobytes() for e, s in zip(empty.tolist(), sig.astype(np.uint32))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in KEY), pa.array(np.ascontiguousarray(whole[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(whole[:, 1]).view(np.int64)), sketch], ["doc_id", *KEY, "t1", "t2", "sketch"])

    return run


def _bands(m: int, r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint32).reshape(b.num_rows, m).astype(U)
            key = np.zeros((b.num_rows, m // r), U)
            for j in range(r):
                key = mix64(key * U(31) + sig[:, j::r][:, : m // r])
            node = np.repeat(b.column("node").to_numpy(zero_copy_only=False), m // r)
            band = np.tile(np.arange(m // r, dtype=np.uint64), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(mix64(key.ravel() ^ (band << U(56))).view(np.int64)), pa.array(node)], ["bucket", "node"])

    return run


def _agreement(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint32).reshape(b.num_rows, -1)
            y = np.frombuffer(b"".join(b.column("y").to_pylist()), np.uint32).reshape(b.num_rows, -1)
            ok = (x == y).mean(axis=1) >= least
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows, vals, weight, _ = _shingles(split_words(b.column("text"), lower=True), k)
            cut = np.searchsorted(rows, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("node"),
                    pa.array([vals[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                    pa.array([weight[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                    pa.array([int(weight[i:j].sum()) for i, j in zip(cut, cut[1:])], pa.int64()),
                    pa.array(np.diff(cut)),
                    pa.array([int(weight[i:j].max()) for i, j in zip(cut, cut[1:])], pa.int64()),
                ],
                ["node", "vals", "weights", "total", "kinds", "most"],
            )

    return run


def probability_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """J_P of two weighted sets (sorted distinct keys, positive weights), in O(n log n).

    For a shared key with ratio r = wx/wy, the sum over all keys of
    max(wx'/wx, wy'/wy) splits by whether a key's own ratio exceeds r.
    """
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = wx[i].astype(np.float64), wy[j].astype(np.float64)
    only_x, only_y = wx.sum() - a.sum(), wy.sum() - b.sum()
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    ratio, a, b = ratio[order], a[order], b[order]
    above = np.searchsorted(ratio, ratio, side="right")
    tail_a = np.append(np.cumsum(a[::-1])[::-1], 0.0)[above]
    head_b = np.append(0.0, np.cumsum(b))[above]
    return float(np.sum(1.0 / ((only_x + tail_a) / a + (only_y + head_b) / b)))


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "vx", 500_000):
            keep = []
            for vx, wx, vy, wy in zip(*(b.column(c).to_pylist() for c in ("vx", "wx", "vy", "wy"))):
                s = probability_jaccard(np.frombuffer(vx, U), np.frombuffer(wx, np.int32), np.frombuffer(vy, U), np.frombuffer(wy, np.int32))
                keep.append(s >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Verifier:
    """Checks candidate pairs (a, b) of nodes: by signature, then exactly by all shingles."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, threshold: float, least_agreement: float):
        self.sketches, self.sets, self.threshold, self.least = nodes.select("node", "sketch"), sets, threshold, least_agreement

    def __call__(self, pairs: DataFrame) -> DataFrame:
        ends = [(self.sketches.select(F.col("node").alias(c), F.col("sketch").alias(v))) for c, v in (("a", "x"), ("b", "y"))]
        close = staged(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "x", "y").mapInArrow(_agreement(self.least), "a long, b long"), "pairs")
        sides = [self.sets.select(F.col("node").alias(c), F.col("vals").alias(f"v{v}"), F.col("weights").alias(f"w{v}")) for c, v in (("a", "x"), ("b", "y"))]
        found = staged(close.join(sides[0], "a").join(sides[1], "b").select("a", "b", "vx", "wx", "vy", "wy").mapInArrow(_verified(self.threshold), "a long, b long"), "links")
        discard(close)
        return found


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node = b.column("node").to_numpy(zero_copy_only=False)
        for i, (v, w) in enumerate(zip(b.column("vals").to_pylist(), b.column("weights").to_pylist())):
            vals = np.frombuffer(v, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vals), node[i])), pa.array(vals), pa.array(np.frombuffer(w, np.int32))], ["node", "shingle", "weight"])


def _rare(sets: DataFrame, nodes: DataFrame, most: int = RARE) -> DataFrame:
    """(node, shingle, weight) of the shingles that at most `most` of the nodes (node) have."""
    shingles = sets.join(nodes, "node", "left_semi").mapInArrow(_shingle_rows, "node long, shingle long, weight int")
    few = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("shingle")
    return shingles.join(few, "shingle", "left_semi")


def _room(sets: DataFrame, nodes: DataFrame, rare: DataFrame) -> DataFrame:
    """Of nodes (node): lone, the weight of its rare shingles by the weight of the rest; common, the number of other shingles; scale, total weight by greatest weight.

    With them J_P of two nodes that share no rare shingle has an upper bound. In
    a shared shingle i, the sum over j of max(x[j]/x[i], y[j]/y[i]) is at least
    P/x[i] + Y/y[i], with P the weight that only x has and Y the weight of y.
    1 / (P/a + Y/b) is concave and homogeneous in (a, b), so the sum over shared
    shingles is at most that of the sums of a and b; these are at most the weight
    of x outside P, and y's greatest weight times the number of shingles that x
    shares: J_P <= 1 / (lone(x) + scale(y) / common(x)).
    """
    private = rare.groupBy("node").agg(F.sum("weight").alias("p"), F.count(F.lit(1)).alias("np"))
    p, np_ = F.coalesce("p", F.lit(0)), F.coalesce("np", F.lit(0))
    own = sets.select("node", "total", "kinds", "most").join(nodes, "node", "left_semi").join(private, "node", "left").filter(p < F.col("total"))
    return own.select("node", (p / (F.col("total") - p)).alias("lone"), (F.col("kinds") - np_).alias("common"), (F.col("total") / F.col("most")).alias("scale"))


def _possible(lone: str, common: str, scale: str, threshold: float):
    """Whether the bound of `_room` reaches the threshold."""
    return F.col(lone) + F.col(scale) / F.col(common) <= 1 / threshold + 1e-9


def _fine_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "vals", 500_000):
        vals = [np.frombuffer(v, U) for v in b.column("vals").to_pylist()]
        weights = np.concatenate([np.frombuffer(w, np.int32) for w in b.column("weights").to_pylist()])
        rows = np.repeat(np.arange(b.num_rows), [len(v) for v in vals])
        sig = prob_min_hash(rows, mix64(np.concatenate(vals) + U(1)), weights, b.num_rows, FINE_REGISTERS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([x.tobytes() for x in sig], pa.binary())], ["node", "fine"])


def _met_in_blocks(minor: DataFrame, members: DataFrame, fine: DataFrame, threshold: float, every_candidate: bool) -> DataFrame:
    """Pairs (a, b) of a group's minor nodes with its members of other classes that the bound and the fine signatures allow.

    Groups go by main. Both sides are dealt into blocks of about BLOCK nodes, and
    each pair of blocks is one task's work: only what passes becomes a row.
    """
    blocks = lambda df, c: df.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(c))
    sizes = blocks(members, "ny").join(blocks(minor, "nx"), "main")
    dealt = minor.withColumn("side", F.lit(0)).unionByName(members.withColumn("side", F.lit(1))).join(sizes, "main")
    own = lambda n: F.array(F.pmod(F.xxhash64("node"), F.col(n)).cast("int"))
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = F.col("side") == 0
    dealt = dealt.withColumn("bx", F.explode(F.when(left, own("nx")).otherwise(all_of("nx")))).withColumn("by", F.explode(F.when(left, all_of("ny")).otherwise(own("ny"))))
    rows = dealt.join(fine, "node").select("main", "bx", "by", "side", "node", "root", "lone", "common", "scale", "fine")
    return rows.groupBy("main", "bx", "by").applyInArrow(_block_pairs(threshold, every_candidate), "a long, b long")


def _block_pairs(threshold: float, every_candidate: bool):
    least = 0.0 if every_candidate else threshold - 5 * np.sqrt(threshold * (1 - threshold) / FINE_REGISTERS)

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        node, root, lone, common, scale = (t.column(c).to_numpy() for c in ("node", "root", "lone", "common", "scale"))
        sig = np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint32).reshape(len(side), -1)
        y = np.flatnonzero(side == 1)
        a, b = [], []
        for i in np.flatnonzero(side == 0):
            j = y[(root[y] != root[i]) & (lone[i] + scale[y] / common[i] <= 1 / threshold + 1e-9) & (lone[y] + scale[i] / common[y] <= 1 / threshold + 1e-9)]
            j = j[(sig[j] == sig[i]).mean(axis=1) >= least]
            a.append(np.minimum(node[i], node[j]))
            b.append(np.maximum(node[i], node[j]))
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return run


def _placed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members (bucket, node) with the node's class so far."""
    return members.select("bucket", "node").join(classes, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))


def _mixed(placed: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes."""
    several = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket")
    return placed.join(several, "bucket", "left_semi")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, k: int = SHINGLE_WORDS, m: int = REGISTERS, r: int = BAND_ROWS, every_candidate: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, the row's key (KEY), class_id (least doc_id of the class), class_size, n_links (verified links of its text's node that were needed), first (whether the row is its class's first by doc_id, nulls last, and key; identical rows are alike in this).

    every_candidate: verify candidates of any agreement of signatures too, those as well that are five standard deviations short of the threshold and more.
    """
    docs = with_row_key(docs)
    rows = staged(docs.mapInArrow(_signatures(k, m), "doc_id long, doc_key long, doc_key2 long, t1 long, t2 long, sketch binary"), "sketches")
    full = rows.filter("sketch is not null")
    # Texts of equal words are one node, named by half of the digest of their words.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *KEY)

    def made(name):
        return staged(full.groupBy(name.alias("node")).agg(F.min(place).alias("head"), F.min("sketch").alias("sketch"), F.min("t2").alias("lo"), F.max("t2").alias("hi")), "nodes")

    node = F.col("t1")
    nodes = made(node)
    # Different words under one name: none among a billion texts as a rule, about ten among 2e10. They get another name.
    clash = [r["node"] for r in nodes.filter("lo <> hi").select("node").collect()]
    if clash:
        node = F.when(F.col("t1").isin(clash), F.xxhash64("t2", "t1")).otherwise(F.col("t1"))
        nodes = made(node)
    buckets = nodes.select("node", "sketch").mapInArrow(_bands(m, r), "bucket long, node long")
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = staged(buckets.join(shared.select("bucket", "centre"), "bucket"), "buckets")
    wanted = nodes.select("node", *(f"head.{c}" for c in KEY)).join(members.select("node").distinct(), "node", "left_semi")
    # Rows that share a key are identical, so any of their texts will do.
    texts = docs.select(*KEY, "text").join(wanted, list(KEY)).select("node", "text").dropDuplicates(["node"])
    sets = staged(texts.mapInArrow(_sets(k), "node long, vals binary, weights binary, total long, kinds long, most long"), "sets")
    verify = _Verifier(nodes, sets, threshold, 0.0 if every_candidate else LEAST_AGREEMENT)

    tried = members.filter("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    links = verify(tried)
    # No class yet. A DataFrame made of a Python list would start Python workers of a second kind in every executor.
    classes = merged(docs.sparkSession.range(0, 0, 1, 1).select(F.col("id").alias("node"), F.col("id").alias("root")), links)
    placed = staged(_placed(members, classes), "placed")
    nodes_open = staged(_mixed(placed).select("node").distinct(), "open-nodes")
    rare = staged(_rare(sets, nodes_open), "rare")
    room = staged(_room(sets, nodes_open, rare), "room")
    hub = _mixed(placed).join(room.select("node", "lone"), "node").groupBy("bucket").agg(F.max_by(F.struct("node", "root"), F.struct(-F.col("lone"), F.col("node"))).alias("hub"))
    more = placed.join(hub, "bucket").filter("root <> hub.root").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    more = staged(more.join(tried, ["a", "b"], "left_anti"), "hubs")
    tried = tried.unionByName(more)
    new = verify(more)
    links, classes = links.unionByName(new), merged(classes, new)
    placed = staged(_placed(members, classes), "placed")
    open_ = _mixed(placed).select("bucket", "node", "root").join(room, "node")
    # Put aside who could be linked with no member of the bucket, whatever its shingles.
    least = open_.groupBy("bucket").agg(F.min("scale").alias("least"))
    open_ = staged(open_.join(least, "bucket").filter(_possible("lone", "common", "least", threshold)).drop("least"), "open")
    # Among those left, a bucket's main class is its largest; every other member meets all members of other classes.
    counts = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("bucket", "main")
    # Buckets of one main class meet as one, so that a pair of nodes that shares several bands is looked at once.
    facts = ("node", "root", "lone", "common", "scale")
    members_of = open_.join(main, "bucket").select("main", *facts).distinct()
    fine = staged(sets.join(open_.select("node").distinct(), "node", "left_semi").mapInArrow(_fine_sketch, "node long, fine binary"), "fine")
    rest = _met_in_blocks(members_of.filter("root <> main"), members_of, fine, threshold, every_candidate)
    # Pairs that share a rare shingle, at most RARE nodes for each.
    root = placed.select("node", "root").distinct()
    holders = rare.select("shingle", "node").join(root, "node")
    kin = holders.join(holders.select("shingle", F.col("node").alias("b"), F.col("root").alias("b_root")), "shingle").filter("node < b and root <> b_root").select(F.col("node").alias("a"), "b")
    rest = rest.unionByName(kin).distinct().join(tried, ["a", "b"], "left_anti")
    new = verify(rest)
    links, classes = links.unionByName(new), merged(classes, new)

    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.select("node", "head").join(classes, "node", "left").select("node", "head", F.coalesce("root", "node").alias("root"))
    heads = named.groupBy("root").agg(F.min("head").alias("class_head"))
    info = named.select("node", "root").join(heads, "root").join(degree, "node", "left").select("node", "root", "class_head", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = full.select("doc_id", *KEY, node.alias("node")).join(info, "node")
    sizes = out.groupBy("root").agg(F.count(F.lit(1)).alias("class_size"))
    first = (F.col("doc_key") == F.col("class_head.doc_key")) & (F.col("doc_key2") == F.col("class_head.doc_key2"))
    out = out.join(sizes, "root").select("doc_id", *KEY, F.col("class_head.doc_id").alias("class_id"), "class_size", "n_links", first.alias("first"))
    alone = rows.filter("sketch is null").select("doc_id", *KEY, F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return out.unionByName(alone)
