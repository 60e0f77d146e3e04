"""Each operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfin.llm import decontamination as dec
from quillfin.llm import hilbert_ann as ann
from quillfin.llm import hmm_lm as hmm
from quillfin.llm import html_extraction as web
from quillfin.llm import line_dedup as lines
from quillfin.llm import near_dedup as near
from quillfin.llm import secret_scan as sec
from quillfin.llm import sentencepiece_codec as spm
from quillfin.llm import substring_dedup as sub
from quillfin.llm import toxicity as tox
from quillfin.llm.components import components
from quillfin.llm.words import split_words

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
EXTRA = "doc_key long, fp long, node long, h long, rid long, n long, score double"
ODD = [
    (1, None), (None, "alpha beta gamma delta epsilon zeta"), (2, ""), (3, "   \n\t "), (4, "one"), (5, "same words here for a copy of it"), (5, "same words here for a copy of it"), (6, "same words here for a copy of it"),
    (7, "ä ö ü ñ 漢字 \U0001f600 ▁ mixed ▁▁ text end"), (8, "a " * 3000), (9, "x" * 20000), (10, "line\nline\nline\nline\nline\nline"),
]


def docs(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(i, t, *([1] * 6), 1.0) for i, t in rows], "doc_id long, text string, " + EXTRA)
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return (t or "").encode().split()


def lower(t):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()


def test_split_words_matches_split():
    import pyarrow as pa

    texts = [t for _, t in ODD]
    w = split_words(pa.array(texts))
    got = [[bytes(w.buf[w.start[k] : w.end[k]]) for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [words(t) for t in texts]


# ---- 9: substring dedup ----


def brute_substrings(rows, width):
    c = Counter(tuple(w[i : i + width]) for w in map(words, (t for _, t in rows)) for i in range(len(w) - width + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if c[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found_substrings(df, **kw):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sub.substring_dedup(df, **kw).collect()), key=repr)


def test_substring_dedup_real(spark, real):
    rows = [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()]
    assert found_substrings(real) == brute_substrings(rows, 35)


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_random(spark, seed):
    rng = random.Random(seed)
    base = [rng.choice("abcde") for _ in range(400)]
    rows = [(i, " ".join(base[(a := rng.randrange(300)) : a + rng.randrange(5, 90)] + [rng.choice("abcdefgh") for _ in range(rng.randrange(20))])) for i in range(40)] + [(99, "p q " * 60)]
    assert found_substrings(docs(spark, rows), width=12, gram=4) == brute_substrings(rows, 12)


def test_substring_dedup_odd(spark):
    assert found_substrings(docs(spark, ODD, True), width=5, gram=2) == brute_substrings(ODD, 5)
    assert found_substrings(docs(spark, [])) == []


def test_index_matches_across_batches(spark):
    fps = lambda xs: spark.createDataFrame([(x, 1) for x in xs], "fp long, n byte")
    ix = sub.FingerprintIndex(max_runs=1)
    got = [sorted(r["fp"] for r in ix.add(fps(b)).distinct().collect()) for b in ([1, 2, 2], [3, 1], [3, 4, 2], [5])]
    assert got == [[2], [1], [2, 3], []] and len(ix.runs) == 1
    assert sorted((r["fp"], r["n"]) for r in ix.runs[0].collect()) == [(1, 2), (2, 2), (3, 2), (4, 1), (5, 1)]


def thue_morse(a, b, n):
    out = [a, b]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out


def test_patterned_words_do_not_collide(spark):
    """Words and texts on which polynomial hashes modulo 2**64 agree whatever their base."""
    x, y = "".join(thue_morse("a", "b", 1024)), "".join(thue_morse("b", "a", 1024))
    common = " ".join(f"w{i}" for i in range(34))
    rows = [(0, f"{common} {x}"), (4, f"{common} {y}")]
    assert [(n, r) for _, n, r, _ in found_substrings(docs(spark, rows))] == [(35, 0), (35, 0)]
    assert {r["class_id"] for r in near.near_duplicates(docs(spark, rows), threshold=0.99).collect()} == {0, 4}
    long = [(10, " ".join(thue_morse("p", "q", 2048))), (11, " ".join(thue_morse("q", "p", 2048)))]
    assert found_substrings(docs(spark, long)) == brute_substrings(long, 35)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = {z["doc_id"]: z for z in hmm.language_model_scores(docs(spark, [(0, x), (held, y)])).collect()}
    assert r[held]["n_known"] == 1 and r[0]["n_known"] == 2


def test_index_is_opened_again(spark, tmp_path):
    fps = lambda xs: spark.createDataFrame([(x, 1) for x in xs], "fp long, n byte")
    got = []
    for batch in ([1, 2, 2], [3, 1], [3, 4, 2], [5]):
        ix = sub.FingerprintIndex.open(spark, f"{tmp_path}/index", max_runs=2)
        got.append(sorted(r["fp"] for r in ix.add(fps(batch)).distinct().collect()))
    assert got == [[2], [1], [2, 3], []]
    again = sub.FingerprintIndex.open(spark, f"{tmp_path}/index")
    assert again.version == 4 and sorted({r["fp"] for run in again.runs for r in run.collect()}) == [1, 2, 3, 4, 5]
    # A manifest that was not finished is passed over.
    (tmp_path / "index" / "manifest" / "5").mkdir()
    assert sub.FingerprintIndex.open(spark, f"{tmp_path}/index").version == 4


def test_scopes_remove_what_was_staged(spark):
    from quillfin.llm import shared

    with shared.stage_scope(spark):
        t = shared.staged(spark.range(3), "x")
        assert t.count() == 3 and shared.exists(spark, t._quillfin_path)
    assert not shared.exists(spark, t._quillfin_path)


# ---- 2: near dedup ----


def shingles(t, k=5):
    w = lower(t)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else None


def jp(a, b):
    both = set(a) | set(b)
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in both) for x in a if x in b)


def brute_classes(rows):
    s = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i].keys() & s[j].keys()) * 2 >= min(len(s[i]), len(s[j])) and (s[i] == s[j] or jp(s[i], s[j]) >= 0.8 - 1e-9):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g), key=repr)


def found_classes(df):
    return sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in near.near_duplicates(df).select("doc_id", "class_id", "class_size").collect()), key=repr)


def test_probability_jaccard_and_registers():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a = {int(k): int(rng.integers(1, 5)) for k in rng.choice(60, 40, replace=False)}
        b = {int(k): int(rng.integers(1, 5)) for k in rng.choice(60, 40, replace=False)}
        arr = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
        assert near.probability_jaccard(*arr(a), *arr(b)) == pytest.approx(jp(a, b))
    a = {k: 1 + k % 3 for k in range(100)}
    b = {k: 1 + k % 2 for k in range(20, 120)}
    vals = near.mix64(np.array([*a, *b], np.uint64) + np.uint64(7))
    rows = np.array([0] * len(a) + [1] * len(b))
    sig = near.prob_min_hash(rows, vals, np.array([*a.values(), *b.values()]), 2, 4096)
    assert (sig[0] == sig[1]).mean() == pytest.approx(jp(a, b), abs=0.03)


def test_near_duplicates_of_a_hub(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]

    def edited(k):
        w = list(base)
        for p in rng.sample(range(120), k):
            w[p] = f"z{rng.random()}"
        return " ".join(w)

    rows = [(i, edited(rng.randrange(0, 12))) for i in range(120)] + [(200 + i, " ".join(f"q{i}_{k}" for k in range(40))) for i in range(10)] + [(300, edited(0)), (301, edited(0))]
    assert found_classes(docs(spark, rows)) == brute_classes(rows)
    every = near.near_duplicates(docs(spark, rows), every_candidate=True).select("doc_id", "class_id", "class_size").collect()
    assert sorted((tuple(r) for r in every), key=repr) == brute_classes(rows)


def test_near_duplicates_odd(spark):
    assert found_classes(docs(spark, ODD, True)) == brute_classes(ODD)
    assert found_classes(docs(spark, [])) == []


def test_near_duplicates_use_one_kind_of_worker(spark, monkeypatch):
    """What comes out of a Python list is read by Python workers of their own, beside those of the operators."""
    rows = docs(spark, ODD)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("rows from a Python list"))
    assert found_classes(rows) == brute_classes(ODD)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# ---- 1: decontamination ----


def semi_global(item, text):
    """Least edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(4))
def test_decontamination_brute(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 6)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(6)] + [(90, None), (91, " "), (92, "ab")]

    def spoiled(t, edits):
        t = list(t)
        for _ in range(edits):
            p = rng.randrange(len(t))
            rng.choice([lambda: t.__setitem__(p, "q"), lambda: t.insert(p, "q"), lambda: t.pop(p)])()
        return "".join(t)

    rows = [(i, " ".join(word() for _ in range(8)) + " " + spoiled(items[i % 6][1].upper(), i % 9).replace(" ", "\n ") + " " + word()) for i in range(24)] + [(None, items[0][1]), (77, None), (78, "")]
    want = set()
    for d, t in rows:
        for i, s in items:
            s, t2 = dec.normalise(s), dec.normalise(t)
            e = int(len(s) * 0.1)
            if s and t2 and (k := semi_global(s, t2)) <= e and (e or f" {s} " in f" {t2} "):
                want.add((d, i, k))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in dec.contaminated(docs(spark, rows, True), bench, error_rate=0.1, block_chars=200).collect()}
    assert got == want


def test_short_items_are_whole_words_and_long_texts_are_searched(spark):
    item = "a question of some length that is asked in tests"
    rows = [(1, "cabs"), (2, "a cab, please"), (3, "ca b"), (4, "x " * 300_000 + item.replace("length", "lenght")), (5, "CAB")]
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in dec.contaminated(docs(spark, rows), spark.createDataFrame([(1, "Cab!"), (2, item)], "item_id long, text string")).collect()}
    assert got == {(2, 1, 0), (5, 1, 0), (4, 2, 2)}


def test_decontamination_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dec.contaminated(docs(spark, ODD), bench).count() == 0
    assert dec.contaminated(docs(spark, []), spark.createDataFrame([(1, "abc")], "item_id long, text string")).count() == 0


# ---- 4: line dedup ----


def brute_lines(rows, spark):
    """The same removal by plain Python, chunk boundaries taken from the operator."""
    import pyarrow as pa

    seen = []
    for i, t in rows:
        buf, _, first, end, n, number = lines._line_chunks(pa.array([t]), lines.DIVISOR)
        seen += [(i, k, bytes(buf[a:b]), int(m)) for a, b, m, k in zip(first, end, n, number)]
    counts = Counter(d for _, _, d, m in seen if m > 1 and d)
    keep = {}
    for i, k, d, m in sorted(seen, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        keep.setdefault(d, (i, k))
    out = []
    for i, t in rows:
        mine = [(k, d, m) for j, k, d, m in seen if j == i]
        gone = [m > 1 and counts[d] > 1 and d != b"" and keep[d] != (i, k) for k, d, m in mine]
        text = t if not any(gone) else b"\n".join(d for (_, d, _), g in zip(mine, gone) if not g).decode()
        out.append((i, sum(m for (_, _, m), g in zip(mine, gone) if g), text))
    return sorted(out, key=repr)


def test_line_dedup_brute(spark, real):
    rows = [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()]
    shared = "\n".join(f"shared line {i}" for i in range(40))
    rows += [(1000, f"own a\n{shared}\nown b"), (1001, f"{shared}"), (1002, f"x\ny\nz\n{shared}\nend")]
    got = sorted(((r["doc_id"], r["n_removed"], r["kept_text"]) for r in lines.line_dedup(docs(spark, rows)).collect()), key=repr)
    assert got == brute_lines(rows, spark)
    assert sum(n for i, n, _ in got if i in (1001, 1002)) >= 40  # boundaries come back in step


def test_line_dedup_odd(spark):
    r = {x["doc_id"]: x for x in lines.line_dedup(docs(spark, ODD, True)).filter("doc_id <> 5").collect()}
    assert r[1]["kept_text"] is None and r[1]["n_lines"] == 0 and r[2]["kept_text"] == "" and r[9]["kept_text"] == "x" * 20000
    assert lines.line_dedup(docs(spark, ODD)).count() == len(ODD) and lines.line_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("windows", [False, True])
def test_line_dedup_repeated_rows(spark, windows):
    text = "\n".join(f"line {i}" for i in range(40))
    rows = [(7, text)] * 3 + [(None, "a\nb\nc")] * 2 + [(8, "one line")] * 2 + [(9, None)] * 2 + [(3, text + "\nown")]
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n string, line int")
    got = [(r["doc_id"], r["n_removed"], r["kept_text"], r["carried"]["line"]) for r in lines.line_dedup(df, windows=windows, carry=("n", "line")).collect()]
    assert sorted(c for *_, c in got) == list(range(len(rows)))
    seven = sorted(n for i, n, *_ in got if i == 7)
    if windows:
        assert seven == [40, 40, 40] and [t for i, _, t, _ in got if i == 7] == [""] * 3  # doc 3 comes first
        assert [t for i, _, t, _ in got if i == 3] == [text + "\nown"]
        assert sorted(n for i, n, *_ in got if i is None) == [0, 3]
    else:
        assert seven[1] >= 20 and seven[1] == seven[2] >= seven[0]
    assert all(n == 0 for i, n, *_ in got if i in (8, 9))


def brute_line_windows(rows, width):
    """Lines left when those in any run of width lines that stands earlier too go: plain Python, no chunks."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        mine, gone = t.split("\n"), set()
        for a in range(len(mine) - width + 1):
            run = tuple(mine[a : a + width])
            gone |= set(range(a, a + width)) if run in seen else set()
            seen.add(run)
        out.append((i, len(gone), "\n".join(m for k, m in enumerate(mine) if k not in gone)))
    return out


def test_line_dedup_leaves_no_repeated_window(spark, real):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").dropDuplicates(["doc_id"]).collect() if r["text"] is not None and r["doc_id"] is not None]
    base = max(i for i, _ in rows) + 1
    passages = [[f"passage {k} line {i}" for i in range(2 + k % 5)] for k in range(30)]
    for k in range(120):
        rows.append((base + k, "\n".join([f"own {k} a", *passages[k % 30], f"own {k} b", *rng.choice(passages), f"own {k} c", "again\n" * rng.randrange(5)])))
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in lines.line_dedup(docs(spark, rows), windows=True).collect()}
    assert got == {i: (n, t) for i, n, t in brute_line_windows(rows, 2)}
    assert sum(n for i, (n, _) in got.items() if i >= base) > 600


# ---- 3: SentencePiece ----


def best_score(v, text):
    """Greatest total score by plain dynamic programming over all substrings."""
    score = {p: s for p, s in zip(v.pieces, v.scores) if isinstance(p, str)}
    low = min(score.values()) - spm.UNKNOWN_PENALTY
    best = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 20), j):
            s = score.get(text[i:j])
            if s is not None:
                best[j] = max(best[j], best[i] + s)
        if best[j] == -math.inf:
            best[j] = best[j - 1] + low * len(text[j - 1].encode())
    return best[-1]


def test_viterbi_is_optimal_and_round_trips(real):
    v = spm.Vocabulary.load()
    c, back = spm.Encoder(v), spm.Decoder(v)
    score = [s if isinstance(p, str) else None for p, s in zip(v.pieces, v.scores)]
    low = c.unknown
    texts = [r["text"] for r in real.filter("length(text) < 6000").limit(40).collect()] + ["e.g. (see 3.14%) $5—“ok”…", "  two  spaces ", "\n\n", "漢字\U0001f600"]
    for t in texts:
        ids = c.encode(t)
        assert back.decode(ids) == t
        assert sum(low if score[i] is None else score[i] for i in ids) == pytest.approx(best_score(v, spm.SPACE + t.replace(" ", spm.SPACE)))


def test_encode_odd(spark):
    r = spm.encode_and_check(docs(spark, ODD, True)).collect()
    assert len(r) == len(ODD) and all(x["round_trip"] for x in r if x["doc_id"] != 1)
    null = next(x for x in r if x["doc_id"] == 1)
    assert null["ids"] is None and null["round_trip"] is None and next(x for x in r if x["doc_id"] == 2)["ids"] == []
    back = spm.decode(spm.encode(docs(spark, ODD))).collect()
    assert Counter((x["doc_id"], x["decoded"]) for x in back) == Counter(ODD)
    assert spm.encode_and_check(docs(spark, [])).count() == 0


def test_a_task_checks_its_ids_in_one_python_worker(spark):
    plan = spm.encode_and_check(docs(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_codecs_go_with_their_vocabulary(spark):
    def left(batches):
        import gc

        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(isinstance(x, spm.Encoder) for x in gc.get_objects())]})

    assert spm.encode_and_check(docs(spark, ODD).repartition(4)).count() == len(ODD)
    # The tasks of a later stage, in the same workers.
    assert [r["n"] for r in spark.range(0, 16, 1, 16).mapInArrow(left, "n long").collect()] == [0] * 16


# ---- 5: secrets ----


def brute_spans(t):
    out = []
    for order, r in enumerate(sec.RULES):
        p = re.compile(r"[0-9a-f]+" if r.kind == "hex" else r.regex, re.A)
        out += [(m.start(), order, r.kind, m.end()) for m in p.finditer(t or "") if len(m[r.group]) >= r.least_chars]
    return sorted(out)


def test_secret_scan(spark, real):
    rows = ODD + [(r["doc_id"] + 100, r["text"]) for r in real.select("doc_id", "text").collect()]
    rows += [
        (50, "API_KEY = 'abcdef123' Token:xyz passwd=\"short\" secret: longenough1 password=password=deadbeefdeadbeefdeadbeef"), (51, "AKIA" + "A" * 16 + " AKIASHORT é AKIA" + "Z9" * 10), (52, "0123456789abcdef01234567 x " + "f" * 23),
        (53, "ghp_" + "a" * 36 + " xoxb-1234567890-abc AIza" + "b" * 35 + " sk_live_" + "c" * 16), (54, "-----BEGIN RSA PRIVATE KEY----- eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"), (55, "\U0001f600 token=abcdefgh"), (56, "secret=a" * 400),
    ]
    got = sorted(((r["doc_id"], [(s["start"], s["order"], s["kind"], s["end"]) for s in r["spans"]]) for r in sec.secret_spans(docs(spark, rows, True)).collect()), key=repr)
    assert got == sorted(((i, brute_spans(t)) for i, t in rows), key=repr)
    assert sec.secret_spans(docs(spark, [])).count() == 0


def test_match_dense_text(spark):
    t = " ".join(f"{i:024x}" for i in range(30_000)) + " token=abcdef1"
    (r,) = sec.secret_spans(docs(spark, [(1, t)])).collect()
    assert [(s["start"], s["order"], s["kind"], s["end"]) for s in r["spans"]] == brute_spans(t)


#: Long texts that nearly match a rule, over and over.
NEAR_MISSES = {
    "jwt": "eyJabcdefgh" * 90_000 + " .eyJ", "jwt dashes": "eyJabcdefgh-" * 80_000 + ".eyJ", "jwt parts": "eyJabcdefgh." * 80_000, "private_key": "-----BEGIN " + "AB " * 330_000 + " x PRIVATE KEY-----", "private starts": "-----BEGIN RSA PRIVATE KEY----" * 30_000,
    "assign": "password" + " " * 1_000_000, "assign starts": "password \"  token '" * 50_000, "access": "AKIA" * 4 + " " + "AKIAZ " * 160_000, "hex": ("0123456789abcdef0123456" + " ") * 40_000, "github": ("ghp_" + "a" * 35 + " ") * 25_000,
    "slack": "xoxb-123456789 " * 66_000, "google": ("AIza" + "b" * 34 + " ") * 25_000, "stripe": "sk_live_abcdef " * 66_000,
}


def test_near_misses_of_every_rule(spark):
    """A megabyte each; what stands in the way of a rule must not cost more than the text is long, nor deepen a stack."""
    import time

    rows = list(enumerate(NEAR_MISSES.values()))
    began = time.time()
    got = {r["doc_id"]: [(s["start"], s["order"], s["kind"], s["end"]) for s in r["spans"]] for r in sec.secret_spans(docs(spark, rows)).collect()}
    assert time.time() - began < 60
    assert all(got[i] == brute_spans(t) for i, t in rows)
    assert all(kind != k for i, k in enumerate(NEAR_MISSES) for _, _, kind, _ in got[i] if k in ("jwt", "private_key", "google", "stripe"))


def test_private_keys_and_tokens(spark):
    t = "-----BEGIN PRIVATE KEY----- -----BEGIN EC  PRIVATE KEY----- xeyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl (eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl)"
    (r,) = sec.secret_spans(docs(spark, [(1, t)])).collect()
    assert [(s["kind"], s["start"]) for s in r["spans"]] == [("private_key", 0), ("private_key", 28), ("jwt", t.index("(") + 1)]


def test_rules_that_repeat_groups_are_refused():
    for bad in (r"-----BEGIN (?:[A-Z]+ )*KEY", r"(ab){2,9}c", r"x(?:y|(?:zz)+)"):
        with pytest.raises(ValueError):
            sec.Rule("bad", bad)
    sec.Rule("good", r"(?:ab)?[a-z]{3,}(x|yz)")


def test_trigram_queries():
    assert sec.trigram_query(r"AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert sec.trigram_query(r"[0-9a-f]{24,}") is None
    assert sec.trigram_query(r"(abc|de)x?") is None
    assert sec.trigram_query(r"(abcd|xyz)") == ("or", (("and", ("abc", "bcd")), "xyz"))


# ---- 6: toxicity ----


def small_index(texts, toxic):
    import pyarrow as pa

    counts = [tox.term_counts(t) for t in texts]
    flat = pa.array([t for c in counts for t in c], pa.string())
    return counts, tox.build_index(flat, np.array([n for c in counts for n in c.values()], float), np.array([len(c) for c in counts]), np.array(toxic, float), np.arange(len(texts)), np.ones(len(texts)))


def test_block_max_search_is_exact():
    rng = random.Random(2)
    names = [f"{a}{b}" for a in "abcdef" for b in "ghijkl"]
    texts = [" ".join(rng.choices(names, weights=range(1, 37), k=rng.randrange(1, 9))) for _ in range(900)]
    counts, ix = small_index(texts, [rng.random() < 0.2 for _ in texts])
    entries = [dict(zip(*(x.tolist() for x in ix.of_entry(i)))) for i in range(len(ix.rows))]
    assert ix.rows.sum() == 900 and len(entries) < 900 and any(r > 1 for r in ix.rows)
    for e in entries[:50]:
        assert sum(x * x for x in e.values()) == pytest.approx(1)
    for k in range(60):
        t, q = ix.vector(tox.term_counts(" ".join(rng.choices([*names, "zz"], k=5))))
        skip = k if k % 2 else -1
        want = sorted((-sum(x * e.get(i, 0) for i, x in zip(t.tolist(), q.tolist())), j) for j, e in enumerate(entries) if j != skip)
        want = [(j, -s) for s, j in want if s < -1e-15][:24]
        at, cosine = ix.nearest(t, q, without=skip)
        assert cosine.tolist() == pytest.approx([s for _, s in want])
        assert len(set(at.tolist()) & {j for j, _ in want}) >= len(want) - 2  # ties at the last place


def test_toxicity_scores_brute(spark):
    """The whole operator on real rows against a plain rebuild of it."""
    sf = "/root/testdata/sf0.001"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {(r["doc_id"], r["doc_key"]): r for r in tox.toxicity(d, lab).collect()}
    text = {}
    for r in d.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("h").collect():
        text.setdefault(r["doc_id"], r["text"])
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    label = {r["doc_id"]: r["toxic"] for r in lab.collect() if fold(r["doc_id"]) != 0 and r["doc_id"] in text}
    counts = {i: tox.term_counts(text[i]) for i in label}
    n, pos = len(label), sum(label.values())
    df, dp = Counter(), Counter()
    for i, c in counts.items():
        df.update(c.keys())
        dp.update(c.keys() if label[i] else ())

    def g2(t):
        out = 0.0
        for seen, total in ((dp[t], pos), (df[t] - dp[t], n - pos)):
            for o, e in ((seen, df[t] * total / n), (total - seen, (n - df[t]) * total / n)):
                out += 2 * o * math.log(o / e) if o > 0 else 0.0
        return max(out, 0.0)

    weight = {t: (math.log((1 + n) / (1 + df[t])) + 1) * max(tox.FLOOR, g2(t) ** 2 / (g2(t) ** 2 + tox.HALF_G2**2)) for t in df}

    def unit(c):
        v = {t: (1 + math.log(k)) * weight.get(t, (math.log(1 + n) + 1) * tox.FLOOR) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    entries = defaultdict(list)
    for i in sorted(label):
        if counts[i]:
            entries[tuple(sorted(counts[i].items()))].append(i)
    entries = [(unit(dict(c)), ids) for c, ids in entries.items()]
    base = pos / n

    def raw(v, without=None):
        near = sorted(((sum(x * e.get(t, 0.0) for t, x in v.items()), k) for k, (e, _) in enumerate(entries) if k != without), key=lambda s: -s[0])[: tox.NEAREST]
        near = [(s, k) for s, k in near if s > 0]
        if not near:
            return base
        w = [(s / near[0][0]) ** tox.SHARPNESS for s, _ in near]
        return (sum(x * sum(label[i] for i in entries[k][1]) for x, (_, k) in zip(w, near)) + 0.5 * base) / (sum(x * len(entries[k][1]) for x, (_, k) in zip(w, near)) + 0.5)

    left_out = [raw(e, k) for k, (e, _) in enumerate(entries)]
    xs, ys = tox.isotonic(np.array(left_out), np.array([sum(label[i] for i in ids) / len(ids) for _, ids in entries]), np.array([len(ids) for _, ids in entries], float))
    for r in d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect():
        s = raw(unit(tox.term_counts(r["text"]))) if tox.term_counts(r["text"]) else base
        s = 0.99 * float(np.interp(s, xs, ys)) + 0.01 * s
        assert got[r["doc_id"], r["k"]]["score"] == pytest.approx(s, abs=1e-6)


def test_isotonic():
    x, y = tox.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = tox.toxicity(d, lab).join(lab.select("doc_id", "toxic"), "doc_id").collect()
    held = [x for x in r if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in r)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in r)
    assert sum(x["predicted"] == x["toxic"] for x in held) / len(held) > 0.93
    assert not any(x["predicted"] and not x["toxic"] for x in held)


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(20)] + [(None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    rows = [(i, "idiot trash here" if i % 2 else "plain calm words") for i in range(20)] + [(100 + k, t) for k, (_, t) in enumerate(ODD)] + [(None, "idiot")]
    r = tox.toxicity(docs(spark, rows, True), labels).collect()
    assert len(r) == len(rows) and all(0 <= x["score"] <= 1 for x in r)
    assert tox.toxicity(docs(spark, rows), labels.limit(0)).filter("score <> 0").count() == 0
    assert tox.toxicity(docs(spark, []), labels).count() == 0


# ---- 7: nearest neighbours ----


def brute_nearest(rows, k, every):
    best = {}
    x = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    for q in x:
        if q % every == 0:
            best[q] = [i for _, i in sorted((-float((x[q] * x[i]).sum()), i) for i in x if i != q and len(x[i]) == len(x[q]))[:k]]
    return {q: b for q, b in best.items() if b}


def test_hilbert_keys_are_a_curve():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = ann.hilbert_keys(cells, 3)
    path = cells[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest_small(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(200)]
    rows += [(300 + i, rows[4][1]) for i in range(40)] + [(420, [1.0, 2.0]), (421, [2.0, 1.0]), (422, [1.0, 2.0]), (424, [5.0])] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0] * 7), (404, [None] + [1.0] * 7), (None, [1.0] * 8), (405, [float("inf")] * 8), (8, rows[8][1])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, rank int")
    got = defaultdict(list)
    for r in ann.nearest(df, k=10, every=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == brute_nearest(rows, 10, 4)
    assert ann.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(few).collect()] == [(20, 1, 21, 0.5)]


def test_nearest_doubles(spark):
    rows = [(i, [1.0 + i * 1e-12, 1.0]) for i in range(60)]  # alike as floats
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, k=5, every=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == brute_nearest(rows, 5, 10)


def recall_of(df, **kw):
    rows = df.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = defaultdict(set)
    for r in ann.nearest(df, **kw).collect():
        got[r["query_id"]].add(r["vec_id"])
    out = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        out.append(len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    return np.mean(out)


def test_recall(spark, monkeypatch):
    """With the query's own parameters; the least window is made smaller than the tables, so that the fit decides."""
    monkeypatch.setattr(ann, "RANGE_ROWS", 1_000)
    halves = []
    monkeypatch.setattr(ann, "fitted_half", lambda *a, f=ann.fitted_half: halves.append(f(*a)) or halves[-1])
    flat = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    assert recall_of(flat, window_rows=16) >= 0.9
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(150, 16))
    clustered = spark.createDataFrame([(i, (centres[i % 150] + 0.1 * rng.normal(size=16)).tolist()) for i in range(4500)], "vec_id long, embedding array<double>")
    assert recall_of(clustered, window_rows=16) >= 0.9
    assert halves[1] * 2 < 250  # of 4,500 rows


# ---- 8: language model ----


def chain_score(m, codes):
    """ln P by the plain forward recursion."""
    a, total = m.start, 0.0
    for c in codes:
        a = (a @ m.move) * m.emit[c]
        total += math.log(a.sum())
        a = a / a.sum()
    return total


def chain_counts(m, codes):
    """Expected counts by plain forward and backward recursions."""
    k = len(m.start)
    alpha = [m.start]
    for c in codes:
        a = (alpha[-1] @ m.move) * m.emit[c]
        alpha.append(a / a.sum())
    beta = np.ones(k)
    move, emit, start = np.zeros((k, k)), np.zeros_like(m.emit), None
    for t in range(len(codes) - 1, -1, -1):
        g = alpha[t + 1] * beta
        emit[codes[t]] += g / g.sum()
        x = alpha[t][:, None] * m.move * (m.emit[codes[t]] * beta)[None, :]
        move += x / x.sum()
        beta = m.move @ (m.emit[codes[t]] * beta)
        beta /= beta.max()
    g = alpha[0] * beta
    return g / g.sum(), move, emit


def test_segments_equal_the_plain_recursions():
    rng = np.random.default_rng(3)
    emit = rng.random((12, 3))
    move = rng.random((3, 3))
    m = hmm.Model(np.array([0.5, 0.3, 0.2]), move / move.sum(axis=1)[:, None], emit / emit.sum(axis=0))
    seqs = [rng.integers(0, 12, n).astype(np.int16) for n in (1, 7, 64, 65, 200, 3, 129)]
    s = hmm.Segments([x.tobytes() for x in seqs], 16)
    ln, _, _ = hmm.forward(s, m)
    assert ln == pytest.approx([chain_score(m, x) for x in seqs])
    start, mv, em, total = hmm.expected_counts(s, m, 12)
    want = [chain_counts(m, x) for x in seqs]
    assert start == pytest.approx(sum(w[0] for w in want)) and mv == pytest.approx(sum(w[1] for w in want)) and em == pytest.approx(sum(w[2] for w in want))
    assert total == pytest.approx(ln.sum())


def test_language_model(spark, real):
    rows = ODD + [(r["doc_id"] + 1000, r["text"]) for r in real.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in hmm.language_model_scores(docs(spark, rows, True)).collect()), key=repr)
    c = Counter()
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in rows:
        if not fold(i):
            c.update(lower(t) + [0])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = lower(t) + [0]
        want.append((i, fold(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    want.sort(key=repr)
    key = lambda r: (r[0], r[1], r[2], r[3], r[4], round(r[5], 6))
    assert sorted(map(key, got), key=repr) == sorted(map(key, want), key=repr)
    real_rows = [r for r in got if r[0] is not None and r[0] >= 1000]
    assert sum(r[6] for r in real_rows) > sum(r[5] for r in real_rows)  # likelier than under the base model
    assert hmm.language_model_scores(docs(spark, [])).count() == 0


def test_scores_brute(spark, monkeypatch):
    """The whole operator against a plain rebuild: counts, classes, Baum-Welch and forward recursion, rare words within their class."""
    monkeypatch.setattr(hmm, "OWN_CLASS", 8)
    monkeypatch.setattr(hmm, "FREQUENT", 12)
    monkeypatch.setattr(hmm, "RARE", 3)
    monkeypatch.setattr(hmm, "SEGMENT", 5)
    import pyarrow as pa

    rng = random.Random(7)
    names = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(names, weights=[1 / (k + 1) for k in range(40)], k=rng.randrange(0, 30)))) for i in range(40)]
    states, rounds = 2, 2
    got = {r["doc_id"]: r["score"] for r in hmm.language_model_scores(docs(spark, rows), states=states, rounds=rounds).collect()}

    hashed = lambda t: split_words(pa.array([t]), lower=True).hashes().view(np.int64).tolist()
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter()
    for i, t in rows:
        if not fold(i):
            c.update(hashed(t))
    ends = sum(not fold(i) for i, _ in rows)
    levels = Counter(int(math.log2(n)) for n in c.values())
    least = 1 << 64
    kept = 0
    while least > 1 and kept + levels[least.bit_length() - 2] <= hmm.OWN_CLASS - 1:
        least >>= 1
        kept += levels[least.bit_length() - 1]
    own = [h for h, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n >= least]
    place = {h: k + 1 for k, h in enumerate(own)}
    group = lambda h: h % hmm.RARE
    mass, kinds = [0.0] * hmm.RARE, [0] * hmm.RARE
    for h, n in c.items():
        if h not in place:
            mass[group(h)] += n
            kinds[group(h)] += 1
    classes = 1 + len(own) + hmm.RARE
    assert 0 < len(own) < len(c)
    freq = np.array([ends, *(c[h] for h in own), *mass]) + 0.5
    name = np.array([hmm.END, *own, *range(hmm.RARE)], np.int64).view(np.uint64)
    tilt = np.stack([(hmm.mix64(name ^ np.uint64(0xABCDEF12345 * (k + 1))) >> np.uint64(11)).astype(float) / 2.0**53 for k in range(states)], axis=1)
    emit = freq[:, None] * np.exp(2.0 * (tilt - 0.5))
    m = hmm.Model(np.full(states, 1 / states), np.array([[0.8, 0.2], [0.2, 0.8]]), emit / emit.sum(axis=0))
    codes = {i: [place.get(h, 1 + len(own) + group(h)) for h in hashed(t)] + [0] for i, t in rows}
    for _ in range(rounds):
        parts = [chain_counts(m, codes[i]) for i, _ in rows if not fold(i)]
        start, move, em = (sum(p[k] for p in parts) for k in range(3))
        em = em + 0.5 * classes * (freq / freq.sum())[:, None]
        m = hmm.Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1)[:, None], em / em.sum(axis=0))
    for i, t in rows:
        inside = sum(math.log10((c[h] + 0.5) / (mass[group(h)] + 0.5 * (kinds[group(h)] + 1))) for h in hashed(t) if h not in place)
        assert got[i] == pytest.approx(chain_score(m, codes[i]) / math.log(10) + inside, rel=1e-9)


def test_nearest_in_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(ann, "RANGE_ROWS", 100)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, k=10, every=10, curves=4, window_rows=3000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == brute_nearest(rows, 10, 10)


@pytest.mark.parametrize("half", [1, 20, 60, 500])
def test_windows_go_on_across_ranges(half):
    """Rows sent by halos give each row of a range its half window on either side."""
    rng = random.Random(half)
    sizes = [rng.choice([1, 5, 40, 100]) for _ in range(12)]
    whole, head, last = ann.halos(sizes, half)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for r in range(12):
        have = set(range(begin[r], begin[r + 1]))
        for j in range(12):
            mine = list(range(begin[j], begin[j + 1]))
            have |= set(mine) if r in whole[j] else set()
            have |= set(mine[:half]) if r in head[j] else set()
            have |= set(mine[-half:]) if r in last[j] else set()
        assert have >= set(range(max(0, begin[r] - half), min(int(begin[-1]), begin[r + 1] + half)))


# ---- 10: HTML ----

PAGE = """<html><head><title>T</title><style>x</style></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head&amp;line</h1><p>First  <b>bold</b> par&eacute;<br>next<p>Second &lt;tag&gt;<div class="ad banner">Buy</div><ul><li>One<li>Two</ul><script>var a="</p>";</script><!-- no --><section id="comments"><p>Nice!</p></section><form><input><p>mail</p></form></article>
<aside>Side</aside><footer>(c)</footer></body></html>"""


def test_page_blocks():
    assert web.page_blocks(PAGE) == (["Head&line", "First bold paré next", "Second <tag>", "One", "Two"], True)
    assert web.page_blocks(None) == ([], False) and web.page_blocks("") == ([], False)
    assert web.page_blocks("plain <i>text</i> &am") == (["plain text &am"], False)
    assert web.page_blocks('<div hidden>x</div><p style="display: none">y</p><p>z <span class="share">s</span>w</p>') == (["z w"], False)
    assert web.page_blocks("<article>short</article><article>the longer one</article>") == (["the longer one"], True)
    assert web.page_blocks("<p>cut off <a href='x") == (["cut off"], False)


def test_repeated_words_brute():
    rng = random.Random(1)
    common = [f"c{i}" for i in range(12)]
    streams = [[f"u{k}_{i}" for i in range(20)] + common[: rng.randrange(6, 13)] + [rng.choice("xy") for _ in range(5)] for k in range(8)] + [["q"] * 3, []]
    got = [f > 0 for f in web.repeated_words(streams, [False] * len(streams), depth=6, least=3)]
    pages = defaultdict(set)
    for k, s in enumerate(streams):
        for i in range(len(s) - 5):
            pages[tuple(s[i : i + 6])].add(tuple(s))
    for s, flags in zip(streams, got):
        want = [False] * len(s)
        for i in range(len(s) - 5):
            if len(pages[tuple(s[i : i + 6])]) >= 3:
                want[i : i + 6] = [True] * 6
        assert flags.tolist() == want


def test_main_text(spark):
    menu = " ".join(f"menu{i}" for i in range(12))
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><p>own text {i} of the page</p>") for i in range(6)] + [(50, None, PAGE), (51, "http://x/", None), (52, "http://x/", ""), (53, "http://h.example/1", rows_html := "<article><p>alone</p></article>"), (None, "u", "<p>q</p>")]
    df = spark.createDataFrame([(*r, "e", "h") for r in rows], "page_id long, url string, html string, text string, host string")
    got = {r["page_id"]: r for r in web.main_text(df).collect()}
    assert [got[i]["text"] for i in range(6)] == [f"own text {i} of the page" for i in range(6)]
    assert got[50]["text"].startswith("Head&line\n\nFirst bold paré next") and got[51]["text"] == "" and got[52]["n_chars"] == 0 and got[53]["text"] == "alone" and got[None]["text"] == "q"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and rows_html
    assert web.main_text(df.limit(0)).count() == 0


def test_main_text_counts_over_the_whole_host(spark, monkeypatch):
    rng = random.Random(4)
    menu, quote = " ".join(f"menu{i}" for i in range(12)), " ".join(f"quote{i}" for i in range(11))
    rows = []
    for i in range(240):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
        rows.append((i, f"http://big.example/{i}", f"<p>{own}</p><p>{menu if i % 60 == 0 else own[::-1]}</p>" if i % 2 == 0 else f"<article><p>{own} {quote if i % 20 == 1 else ''}</p></article>"))
    rows += [(1000 + i, "http://big.example/copy", f"<p>copied {menu}</p>") for i in range(9)] + [(2000, "http://big.example/e", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r["page_id"]: r["text"] for r in web.main_text(df).collect()}
    assert whole == brute_pages(rows)
    monkeypatch.setattr(web, "GROUP_CHARS", 500)
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert {r["page_id"]: r["text"] for r in web.main_text(df.repartition(7)).collect()} == whole
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    monkeypatch.setattr(web, "HOT_RUNS", 3)
    spread = {r["page_id"]: r["text"] for r in web.main_text(df.repartition(5)).collect()}
    assert whole == spread and len(spread) == len(rows)
    assert not any(menu in t for t in spread.values()) and sum(quote in t for t in spread.values()) == 12


def brute_pages(rows):
    """main_text by plain counting of runs over each host."""
    parsed = {i: (re.sub(r"^https?://([^/:?#]*).*", r"\1", u), *web.page_blocks(h)) for i, u, h in rows}
    kinds, runs = defaultdict(set), defaultdict(set)
    for host, blocks, _ in parsed.values():
        w = " ".join(blocks).split(" ")
        kinds[host].add(tuple(w))
        for k in range(len(w) - web.LONG + 1):
            runs[host, tuple(w[k : k + web.LONG])].add(tuple(w))
    out = {}
    for i, (host, blocks, trusted) in parsed.items():
        need = max(web.LEAST_PAGES, math.ceil(web.ARTICLE_SHARE * len(kinds[host]))) if trusted else web.LEAST_PAGES
        w = [x for b in blocks for x in b.split(" ")]
        block_of = [k for k, b in enumerate(blocks) for _ in b.split(" ")]
        over, within = [False] * len(w), [False] * len(w)
        for k in range(len(w) - web.LONG + 1):
            if len(runs[host, tuple(w[k : k + web.LONG])]) >= need:
                over[k : k + web.LONG] = [True] * web.LONG
                if block_of[k] == block_of[k + web.LONG - 1]:
                    within[k : k + web.LONG] = [True] * web.LONG
        kept = []
        for b in range(len(blocks)):
            at = [k for k in range(len(w)) if block_of[k] == b]
            left = [] if all(over[k] for k in at) else [w[k] for k in at if not within[k]]
            if left:
                kept.append(" ".join(left))
        out[i] = "\n\n".join(kept)
    return out


def test_main_text_brute_real(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.select("page_id", "url", "html").collect()]
    assert {r["page_id"]: r["text"] for r in web.main_text(pages).collect()} == brute_pages(rows)


# ---- 10: attributes of elements ----

PARTS = [
    ('<p title="the hidden truth">Three four.</p>', "Three four."),
    ('<p>See <a href="/a?id=related">linked words</a> here.</p>', "See linked words here."),
    ('<p aria-hidden="false">Shown.</p><p aria-hidden="true">Not shown.</p>', "Shown."),
    ('<div data-id="menu">One.</div><div data-section="nav" data-id="x">Two.</div>', "One.\n\nTwo."),
    ('<div class="long-form">Whole article.</div>', "Whole article."),
    ('<p>It cost <span class="share-price">12.5</span> then.</p>', "It cost 12.5 then."),
    ('<p>Area <math><mi>x</mi><msup><mn>2</mn></msup></math> of it.</p>', "Area x2 of it."),
    ("<p hidden>Gone.</p><p>Kept.</p>", "Kept."), ("<p HIDDEN>Gone.</p><p>Kept.</p>", "Kept."), ('<p data-hidden="1">Kept.</p>', "Kept."), ('<p class="hidden-truth">Kept.</p>', "Kept."),
    ("<p title='a > b' class=ad>Gone.</p><p>Kept.</p>", "Kept."), ('<div class="ad-slot-3">Buy.</div><div class="siteNav">Home</div><div class="related-posts">More</div><div class="cookie-banner">Agree</div><p>Kept.</p>', "Kept."),
    ('<p>Before <span class="ad">buy</span> after, <span class="share-buttons">tweet</span> end, <b class="menu">bold</b>.</p>', "Before after, end, bold."),
    ('<div class="article-header"><h2>Heading</h2></div><p>Text.</p>', "Heading\n\nText."), ('<div role="navigation">Home</div><div role="note">A note.</div>', "A note."), ('<div id="comments">Nice!</div><div class="no-comments-yet-policy">Kept.</div>', "Kept."),
    ('<div style="color:red; display : none">Gone.</div><div style="display:block">Kept.</div>', "Kept."), ('<div class="form">Name?</div><div class="transformation">Kept.</div><div class="adjacent">Too.</div>', "Kept.\n\nToo."),
]


@pytest.mark.parametrize("html, text", PARTS)
def test_attributes_of_elements(html, text):
    assert "\n\n".join(web.page_blocks(f"<html><body>{html}</body></html>")[0]) == text


def test_own_class_is_checked(spark):
    for bad in (-1, hmm.MOST_OWN_CLASSES + 1):
        with pytest.raises(ValueError):
            hmm.language_model_scores(docs(spark, [(1, "a b")]), own_class=bad)
