"""The registered queries and the pipeline on small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillfin.llm import near_dedup
from quillfin.llm.queries import ORACLES, QUERIES
from tests.parity import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    columns, rows = duck_rows(connect(SF), ORACLES[name])
    assert sorted(df.columns) == columns and spark_rows(df) == rows


def test_secret_digests(spark):
    import hashlib

    for r in QUERIES["op5_secret_scan"](spark, SF).collect():
        base = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["n_hex"] == r["spans"].count("hex:")


def line_pairs(text):
    lines = (text or "").split("\n")
    return set(zip(lines, lines[1:]))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        after = after.cache()
        if name != "sentencepiece":
            assert tuple(after.columns) == corpus_pipeline.COLUMNS
            assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "line_dedup":
            gone = before.join(after.select("doc_id"), "doc_id", "left_anti").select("text").collect()
            left = {x for r in after.select("text").collect() for x in line_pairs(r["text"])}
            assert gone and all(line_pairs(r["text"]) <= left for r in gone)
        if name == "near_dedup":
            assert near_dedup.near_duplicates(before).select("class_id").distinct().count() == after.count()
            assert near_dedup.near_duplicates(after).filter("class_size > 1").count() == 0
        before = after
    assert before.filter(~F.col("round_trip")).count() == 0 and before.count() > 0


def test_pipeline_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "text without id", "en", "s", 15), (3, "a b c d e f g h", "en", "s", 15), (3, "a b c d e f g h", "en", "s", 15), (4, "a b c d e f g h", "en", "s", 15)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in out), key=repr) == [1, 2, 3, None]
    d.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_knows_rows_by_id_and_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    item = " ".join(f"question{i}" for i in range(20))
    rows = [(1, a), (5, a), (5, b), (None, a), (None, item), (6, f"{item} and more"), (6, "clean words")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.dedup_near(spark, d, SF)
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect() if r["text"] in (a, b)), key=repr) == [(1, a), (5, b)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    from quillfin.llm.decontamination import contaminated

    left = corpus_pipeline._without(d, contaminated(d, bench))
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(1, a), (5, a), (5, b), (None, a), (6, "clean words")], key=repr)


def test_pipeline_brute(spark, tmp_path):
    """run() against a plain rebuild of its stages on a small corpus."""
    import random

    from quillfin.llm import sentencepiece_codec as spm
    from quillfin.llm.decontamination import normalise
    from tests.llm.test_operators import brute_classes, brute_line_windows, semi_global

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    items = [" ".join(word() for _ in range(15)) for _ in range(3)]
    notice = "all rights reserved\nuse at your own risk\nno warranty is given"
    rows = [(i, text(4)) for i in range(60)]
    for i in range(0, 60, 3):
        rows[i] = (i, rows[i][1] + "\nyou worthless idiot trash\n" + text(1))
    for i in range(1, 60, 6):
        rows[i] = (i, text(2) + "\n" + notice + "\n" + text(2))
    copy = text(8).replace("\n", " ")
    rows += [(100, copy), (101, copy + "er"), (102, copy + " more"), (103, rows[2][1]), (104, rows[5][1] + "\n")]
    rows += [(110 + k, text(2) + " " + item[:30] + "x" + item[30:] + " " + text(1)) for k, item in enumerate(items)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 3 == 0 and i < 60 else 0, 1) for i, _ in rows if i < 60], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t in rows if "idiot" not in t]
    left = [(i, t) for i, n, t in brute_line_windows(left, 2) if not n or t.split()]
    assert not {103, 104} & {i for i, _ in left}
    first = {i for i, c, _ in brute_classes(left) if i == c}
    left = [(i, t) for i, t in left if i in first]
    assert not {101, 102} & first
    hit = lambda s, t: semi_global(s, t) <= int(len(s) * 0.08)
    left = [(i, t) for i, t in left if not any(hit(normalise(s), normalise(t)) for s in items)]
    assert not {110, 111, 112} & {i for i, _ in left} and len(left) > 30
    back = spm.Decoder(spm.Vocabulary.load())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], back.decode(r["ids"])) for r in out) == sorted(left) and all(r["round_trip"] for r in out)
