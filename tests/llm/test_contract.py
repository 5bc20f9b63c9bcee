"""Registered queries against their SQL on the smallest tables; the pipeline's stages keep what they should."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from foliant.llm import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF_DIR}/{file}'")
    got, wanted = registry.QUERIES[name](spark, SF_DIR), con.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    plain = lambda rows, names: sorted((repr([dict(zip(names, r, strict=True))[c] for c in columns]) for r in rows))
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(wanted.fetchall(), wanted.columns)


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, sizes = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert sizes[0] <= 200 and sizes[1] < sizes[0] and sizes[2] == sizes[1]
    full = docs.groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] < 4096 for r in full) <= 1
