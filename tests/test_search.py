"""Search through trigrams against the scan; single documents that come in, against a loop."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.operators import callbacks, search, store
from foliant.sources import scratch


def test_index_finds_what_the_scan_finds(spark, tmp_path, monkeypatch):
    rows = [(f"c{i}", None if i % 7 == 0 else f"FN-{i * 37 % 500}é", "Done" if i % 3 else None) for i in range(400)] + [("AB", "x", "Done"), ("", None, None)]
    claims = spark.createDataFrame(rows, "claim_id string, file_no string, status string")
    index = search.TrigramIndex(spark, str(tmp_path / "index"), 8)
    index.add(claims.where("claim_id < 'c2'"))
    index.add(claims.where("claim_id >= 'c2'"))
    for query, status in (("fn-1", "all"), (" FN-12 ", "done"), ("c39", "all"), ("", "done"), ("ab", "all"), ("fn-999", "all"), ("4é", "unknown"), ("-44é", "all")):
        for most in (1000, 2):
            monkeypatch.setattr(search, "MOST_IDS", most)
            got, wanted = index.search(claims, query, status), store.search_claims(claims, query, status)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect())), query
    postings = spark.read.parquet(str(tmp_path / "index" / "postings"))
    read = index.candidates("fn-444")
    assert len(read.inputFiles()) <= len(postings.inputFiles())
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]


@pytest.mark.parametrize("bulk", [False, True])
def test_documents_in_turn(spark, bulk):
    t = datetime(2024, 1, 1)
    claims = spark.createDataFrame([("a", "uploaded", t), ("b", "uploaded", t)], "claim_id string, status string, updated_at timestamp_ntz")
    fields = {f.name: None for f in spark.createDataFrame([], callbacks.DOCUMENT).schema}
    stored = spark.createDataFrame([{**fields, "id": "1", "claim_id": "a", "document_type": "x", "source_file_name": "f_4.json", "sequence": 4, "review_status": "approved", "created_at": t, "updated_at": t}], callbacks.DOCUMENT)
    rows = [("a", "x", None, None, 1), ("a", "x", "f_4.json", None, 2), ("a", "x", "g.json", 9, 3), ("a", "y", "", None, 4), ("a", "y", None, None, 5), ("gone", "x", None, None, 6)]
    payload = spark.createDataFrame([(*r, t + timedelta(hours=r[-1])) for r in rows], "claim_id string, document_type string, source_file_name string, sequence int, turn int, updated_at timestamp_ntz")
    told, out = callbacks.ingest(claims, stored, payload.withColumn("extra", F.lit(1)), ["turn"], scratch.stored, bulk)
    assert {r["claim_id"]: (r["status"], r["updated_at"].hour) for r in told.collect()} == {"a": ("completed" if bulk else "processing", 5), "b": ("uploaded", 0)}
    got = {(r["document_type"], r["source_file_name"]): r for r in out.collect()}
    # Turn 1 takes the stored row and its file name away, so turn 2 makes a row anew.
    assert set(got) == {("x", None), ("x", "f_4.json"), ("x", "g.json"), ("y", None)} and len(out.collect()) == 4
    assert got["x", None]["id"] == "1" and got["x", None]["review_status"] == "approved" and got["x", None]["sequence"] == 1
    assert (got["x", "f_4.json"]["sequence"], got["x", "g.json"]["sequence"], got["y", None]["sequence"], got["y", None]["updated_at"].hour) == (4, 9, 1, 5)
