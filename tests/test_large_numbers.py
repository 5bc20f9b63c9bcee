"""Names and ties that only larger tables show, in the queries' SQL too."""

from __future__ import annotations

import duckdb
import pytest

from foliant.operators import batches, store
from foliant.plans.oracles import ORACLES


@pytest.mark.parametrize(("name", "column", "kind"), [("page_batches", "file_name", "unknown"), ("merged_with_texts", "file_name", "web"), ("merged_files", "name", "other")])
def test_names_of_more_than_999_batches(spark, name, column, kind):
    con = duckdb.connect()
    con.sql("create table documents as select i as doc_id, 'x' as text, 'Web' as source from range(7001) t(i)")
    con.sql("create table pages as select 3 * i + 1 as page_id, 'x' as html from range(7001) t(i)")
    told = {r[0] for r in con.execute(f"select {column} from ({ORACLES[name]})").fetchall()}
    assert len(told) == 1001  # batch 1000 was cut to 100
    pages = spark.range(7001).selectExpr("cast(id as int) page_number", f"'{kind}' document_type", "'x' text")
    assert {r["file_name"] for r in batches.merged_texts(pages).select("file_name").collect()} == told


def test_summary_of_documents_with_one_id(spark):
    """Documents as old and of one id: the better alias, then the smaller value, however the rows lie."""
    schema = "claim_id string, created_at int, id long, entities array<struct<key:string,value:string>>"
    rows = [
        ("a", 1, 1, [("Claim No.", "C9")]), ("a", 1, 1, [("claim-number", "C7")]), ("a", 1, 1, [("claim_number", "C8")]), ("a", 0, 0, [("claim_number", "Not Available"), ("name", "")]),
        ("b", 1, 1, [("name", "N1"), ("NAME", "N2")]), ("b", 1, 1, [("name", "N3"), ("hospital", None)]), ("c", 1, 1, None), ("c", 2, 1, [("hospital", "H"), (None, "x")]), ("d", 1, 1, [("name", "Not Available")]),
    ]
    for turned in (rows, rows[::-1]):
        got = store.alias_summary(spark.createDataFrame(turned, schema).coalesce(1))
        assert {tuple(r) for r in got.collect()} == {("a", "C7", None, None, None), ("b", None, "N2", None, None), ("c", None, None, None, "H")}
