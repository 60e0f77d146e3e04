"""Exact top-k, hard negatives and token alignment against brute force, and on odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfin.llm import exact_topk as top
from quillfin.llm import hard_negatives as neg
from quillfin.llm import token_alignment as tok
from quillfin.llm.vector_cells import LIMIT, NONE, products

VECTORS = "vec_id long, embedding array<double>, label int"


def units(x):
    return [math.floor(256 * v) for v in x]


def clamp(x):
    return max(NONE, min(LIMIT, x))


def usable(rows):
    """The least row of each id without nulls or non-finite components."""
    out = {}
    for i, e, label in rows:
        if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e):
            u = units(e)
            if i not in out or (label is not None and (out[i][1] is None or (label, u) < (out[i][1], out[i][0]))):
                out[i] = (u, label)
    return out


def dot(a, b):
    return clamp(sum(x * y for x, y in zip(a, b)))


def brute_top(rows, k, every):
    v, out = usable([(i, e, 0) for i, e, _ in rows]), []
    for q in v:
        if q % every == 0:
            hits = sorted((-dot(v[q][0], v[i][0]), i) for i in v if i != q and len(v[i][0]) == len(v[q][0]))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(hits, 1)]
    return sorted(out)


def brute_negatives(rows, every, positives=5, negatives=10, window=(30, 90)):
    v, out = usable([r for r in rows if r[2] is not None]), []
    for a in v:
        if a % every:
            continue
        hits = sorted((-dot(v[a][0], v[i][0]), i) for i in v if i != a and len(v[i][0]) == len(v[a][0]))
        same = [(-s, i) for s, i in hits if v[i][1] == v[a][1]][:positives]
        for p, i in same:
            far = [(-s, j) for s, j in hits if v[j][1] != v[a][1] and window[0] * p <= 100 * -s <= window[1] * p][:negatives]
            out += [(a, i, n, j, p, s) for n, (s, j) in enumerate(far, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(seed, n, d, clusters=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, d)) * rng.choice([0.2, 1, 3], size=(clusters, 1))
    of = rng.integers(0, clusters, n)
    x = centre[of] + rng.normal(size=(n, d)) * 0.1
    x[: n // 4] = x[0]  # one vector with a quarter of the rows
    return [(int(i), [float(v) for v in x[i]], int(of[i] % 4)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_top_k(spark, seed):
    rows = clustered(seed, 700, 9 if seed else 33)
    df = spark.createDataFrame(rows, VECTORS)
    assert found(top.exact_top_k(df, 5, 10, slice_rows=64, growth=3)) == brute_top(rows, 5, 10)
    assert found(top.exact_top_k(df, 5, 10)) == brute_top(rows, 5, 10)


def test_top_k_skips_what_bounds_exclude(spark):
    """Short rows are reached by no query once the long ones are known."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4_000, 16)) * np.where(np.arange(4_000) < 400, 10.0, 0.01)[:, None]
    rows = [(int(i), [float(v) for v in r], 0) for i, r in enumerate(x)]
    sent = []
    meet = top.meet

    def counted(queries, *rest):
        sent.append(queries.count())
        return meet(queries, *rest)

    top.meet = counted
    try:
        assert found(top.exact_top_k(spark.createDataFrame(rows, VECTORS), 5, 200, slice_rows=200, growth=4)) == brute_top(rows, 5, 200)
    finally:
        top.meet = meet
    slices = 4_000 // 200
    assert sent[0] == 20 and sum(sent) < 20 * slices / 2


ODD_VECTORS = [
    (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (5, [0.0, 0.0], 1), (6, [1.0, 2.0], 1), (7, [1.0, 2.0], 2),
    (8, [1.0, 2.0, 3.0], 1), (9, [1.0, 2.0, 3.0], 2), (10, [], 1), (11, [], 2), (12, [-0.001, 0.003], 2), (13, [1.0, 2.0], None), (14, [-1.0, -2.0], 1), (15, [0.5, 1.0], 2), (16, [0.4, 0.9], 3), (17, [1e300, 1.0], 3), (18, [1e17, -1e17], 2), (19, [3e9, 3e9], 1),
]


def with_clashes(df):
    for c in ("query_id", "score", "rank", "cell", "side", "place", "units", "length", "list", "away", "slice", "block"):
        df = df.withColumn(c, F.lit(7))
    return df


def test_odd_vectors(spark):
    df = with_clashes(spark.createDataFrame(ODD_VECTORS, VECTORS))
    assert found(top.exact_top_k(df, 5, 1)) == brute_top(ODD_VECTORS, 5, 1)
    assert found(top.exact_top_k(df, 100, 3)) == brute_top(ODD_VECTORS, 100, 3)
    assert found(neg.hard_negatives(df, F.col("vec_id") % 1 == 0)) == brute_negatives(ODD_VECTORS, 1)
    empty = spark.createDataFrame([], VECTORS)
    assert found(top.exact_top_k(empty)) == [] and found(neg.hard_negatives(empty, F.col("vec_id") % 1 == 0)) == []
    one = spark.createDataFrame([(0, [1.0], 1)], VECTORS)
    assert found(top.exact_top_k(one)) == [] and found(neg.hard_negatives(one, F.col("vec_id") % 1 == 0)) == []
    floats = spark.createDataFrame(ODD_VECTORS[:17], "vec_id long, embedding array<float>, label int")
    rows = [(i, None if e is None else [None if v is None else float(np.float32(v)) for v in e], y) for i, e, y in ODD_VECTORS[:17]]
    assert found(top.exact_top_k(floats, 5, 1)) == brute_top(rows, 5, 1)


def test_products_are_exact():
    a, b = np.array([[2.0**60, 3.0], [2.0**52 - 1, 1.0]]), np.array([[8.0, 1.0], [3.0, -7.0], [-(2.0**10), 0.0]])
    assert products(a, b).tolist() == [[clamp(int(x[0]) * int(y[0]) + int(x[1]) * int(y[1])) for y in b] for x in a]


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives(spark, seed):
    rows = clustered(seed, 600, 8)
    df = spark.createDataFrame(rows, VECTORS)
    assert found(neg.hard_negatives(df, F.col("vec_id") % 10 == 0, slice_rows=50)) == brute_negatives(rows, 10)
    assert found(neg.hard_negatives(df, F.col("vec_id") % 10 == 0, first_lists=2, most_lists=5)) == brute_negatives(rows, 10)


def test_lists_outside_bounds_are_skipped(spark):
    rows = clustered(4, 2_000, 16, clusters=20)
    sent = []
    meet = neg.meet

    def counted(queries, *rest):
        sent.append((queries.count(), rest[1]))
        return meet(queries, *rest)

    neg.meet = counted
    try:
        neg.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0).collect()
    finally:
        neg.meet = meet
    assert len(sent) == 4 and sum(n for n, _ in sent) < 20 * sum(cells for _, cells in sent) / 4


def test_windows():
    lo, hi = neg.windows(np.array([100, 0, -100, 7, 2**62]), 30, 90)
    assert lo.tolist() == [30, 0, -30, 3, -(-30 * 2**62 // 100)] and hi.tolist() == [90, 0, -90, 6, 90 * 2**62 // 100]


# ---- 13: alignment ----


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tok.BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tok.PIECES)


def token_bytes(a, b, text):
    letters = {}
    n = 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            letters[chr(x)] = x
        else:
            letters[chr(256 + n)] = x
            n += 1
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ta = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
    tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    return ia, ib, ta, tb


def brute_alignment(tokenizers, rows):
    a, b = tokenizers
    out, links_of = [], []
    for i, t in rows:
        ia, ib, ta, tb = token_bytes(a, b, t or "")
        if not t or b"".join(ta) != (" " + t).encode() or b"".join(tb) != (" " + t).encode():
            out.append((i, [], [], "", []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (ta, tb)]
        where = {e: y for y, e in enumerate(ends[1])}
        links = [(ia[x], ib[where[e]]) for x, e in enumerate(ends[0]) if e in where]
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            nx, ny = ends[0].index(cut, x) + 1, ends[1].index(cut, y) + 1
            groups.append(",".join(map(str, ia[x:nx])) + "|" + ",".join(map(str, ib[y:ny])))
            x, y = nx, ny
        out.append((i, ia, ib, ";".join(groups), links))
    count = Counter(x for r in out for x in r[4])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    for i, ia, ib, groups, links in out:
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        links_of.append((i, len(ia), len(ib), groups.count("|"), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(links_of, key=repr)


ODD_TEXTS = [
    (1, None), (None, "alpha beta"), (2, ""), (3, " "), (4, "   \n\t  two  spaces "), (5, "same words"), (5, "same words"), (6, "a▁b"), (7, "ä ö 漢字 \U0001f600 é x y"), (8, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (9, "don't stop'll\r\nA  B　C \x1c d\x00e"), (10, "x" * 30_000), (11, "word and " * 9_000), (12, "▁"), (13, "漢" * 2_000), (14, "﻿bom ​ zero ﬁ Ａ Å"),
]


def test_alignment(spark, tokenizers):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(i, t) for i, t in ODD_TEXTS] + [(r["doc_id"] + 100, r["text"]) for r in real.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("chunk", "place", "a", "b", "at", "n", "number", "n_a", "is_best", "pair_count"):
        df = df.withColumn(c, F.lit(1))
    got = sorted((tuple(r) for r in tok.aligned(df).collect()), key=repr)
    assert got == brute_alignment(tokenizers, rows)
    assert sum(r[1] == 0 for r in got) >= 4
    assert tok.aligned(df.limit(0)).collect() == []


def test_alignment_in_small_chunks(spark, tokenizers, monkeypatch):
    """Counts do not depend on chunks, nor on words being forgotten."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["unhappiness", "token", "tokenizers", "Zürich", "of", "the,", "12345"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    want = brute_alignment(tokenizers, rows)
    pair = tok.Pair(open(tok.BYTE_LEVEL, encoding="utf-8").read(), open(tok.PIECES, "rb").read())
    monkeypatch.setattr(tok, "CHUNK_BYTES", 500)
    monkeypatch.setattr(tok, "PAIRS_OF_ROW", 3)
    got = sorted((tuple(r) for r in tok.aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=repr)
    assert got == want
    monkeypatch.setattr(tok, "CACHE", 3)
    flat = [tok.align_texts(pair, [t]).groups[0] for _, t in rows]
    assert sorted(hashlib.sha256(g.encode()).hexdigest() if g else "" for g in flat) == sorted(r[7] for r in want)


def test_texts_without_tokens_alone(spark):
    for rows in ([(1, ""), (2, None)], [(1, "a▁b")], [(1, "▁"), (2, "")]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert sorted(tuple(r) for r in tok.aligned(df).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]
        assert all(r["groups"] == "" and r["cuts"] == [] for r in tok.alignments(df).collect())


def test_alignments(spark, tokenizers):
    text = "Unhappiness in Zürich"
    (r,) = tok.alignments(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["cuts"][-1] == len((" " + text).encode()) and len(r["cuts"]) == r["groups"].count("|")
    a, b = tokenizers
    ids = [[int(x) for x in part.split(",")] for g in r["groups"].split(";") for part in g.split("|")]
    assert sum(ids[::2], []) == a.encode(" " + text, add_special_tokens=False).ids and sum(ids[1::2], []) == b.encode(text)


def test_bitset_rank_and_select():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1_000):
        at = np.flatnonzero(rng.random(n) < 0.3)
        bits = tok.Bitset.marking(at, n)
        assert bits.select().tolist() == at.tolist()
        assert bits.rank(np.arange(n)).tolist() == [int((at <= k).sum()) for k in range(n)]
