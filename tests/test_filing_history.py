"""Older pages of filing lists: only those that overlap the days asked for are read."""

import json

from quillfin.sources import readers as rd


def block(days, prefix, form="10-K"):
    return {"form": [form] * len(days), "filingDate": days, "reportDate": [""] * len(days), "accessionNumber": [f"{prefix}{i}" for i in range(len(days))], "primaryDocument": ["d"] * len(days)}


def test_only_overlapping_pages_are_read(spark, tmp_path):
    pages = {"A-1.json": ["2019-01-05", "2019-12-30"], "A-2.json": ["2020-02-01", "2020-11-11"], "A-3.json": ["2021-03-03", "2022-01-01"], "B-1.json": ["2018-01-01", "2021-06-01"]}
    for name, days in pages.items():
        (tmp_path / name).write_text(json.dumps(block(days, name)) if name != "A-1.json" else "this page must not be parsed")
    files = lambda c: [{"name": n, "filingFrom": d[0], "filingTo": d[1]} for n, d in pages.items() if n[0] == c]
    rows = [(c, json.dumps({"filings": {"recent": block(["2023-05-05", "2021-06-02"], c, "10-Q"), "files": files(c)}})) for c in "AB"]
    rows.append(("C", json.dumps({"filings": {"recent": block(["2021-01-01"], "C"), "files": []}})))
    rows.append(("D", None))
    payloads = spark.createDataFrame(rows, "cik string, json string")
    got = rd.filing_history(payloads, f"file://{tmp_path}", start="2020-06-01", end="2021-12-31")
    assert sorted(f.rsplit("/", 1)[1] for f in got.inputFiles()) == ["A-2.json", "A-3.json", "B-1.json"]
    want = [("A", "2020-11-11"), ("A", "2021-03-03"), ("A", "2021-06-02"), ("B", "2021-06-01"), ("B", "2021-06-02"), ("C", "2021-01-01")]
    assert sorted((r["cik"], str(r["filing_date"])) for r in got.collect()) == want
    # Days that only the recent filings have: no page is read.
    recent = rd.filing_history(payloads, f"file://{tmp_path}", start="2023-01-01")
    assert recent.inputFiles() == [] and [(r["cik"], r["form"]) for r in recent.orderBy("cik").collect()] == [("A", "10-Q"), ("B", "10-Q")]


def test_a_filing_of_both_lists_counts_once(spark, tmp_path):
    (tmp_path / "A-1.json").write_text(json.dumps(block(["2020-02-01"], "same")))
    payload = {"filings": {"recent": block(["2020-02-01"], "same"), "files": [{"name": "A-1.json", "filingFrom": "2020-01-01", "filingTo": "2020-12-31"}]}}
    got = rd.filing_history(spark.createDataFrame([("A", json.dumps(payload))], "cik string, json string"), str(tmp_path))
    assert [r["accession"] for r in got.collect()] == ["same0"]
