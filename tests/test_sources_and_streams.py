"""Files in and out, and streams over the store."""

from __future__ import annotations

import json
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from foliant.operators import batches
from foliant.sources import files, scratch
from foliant.streaming.store import VersionedTable, sessions, upsert_stream


def test_scans(spark, tmp_path):
    (tmp_path / "page_2.json").write_text(json.dumps({"document_type": " Invoice ", "confidence_score": 50.5}))
    (tmp_path / "page_10.json").write_text(json.dumps({"confidence_score": 1}))
    (tmp_path / "page_3.json").write_text("{broken")
    (tmp_path / "notes.json").write_text("{}")
    got = files.classifications(spark, str(tmp_path)).orderBy("page_number").collect()
    assert [tuple(r) for r in got] == [(2, "invoice", 50.5), (10, "unknown", 1.0)]
    (tmp_path / "page_2_raw.txt").write_text("  text\n")
    assert [tuple(r) for r in files.page_texts(spark, str(tmp_path)).collect()] == [(2, "text")]
    names = [r["name"] for r in files.artifacts(spark, str(tmp_path), json_only=True).collect()]
    assert names == sorted(names) and len(names) == 4


def test_payload_scan(spark, tmp_path):
    good = {"page_number": 1, "document_type_classified": "lab", "global_metadata": {"patient_name": "x"}, "all_extracted_entities": {"a": "b"}, "all_extracted_tables": [], "warnings": {}}
    (tmp_path / "raw_json_1.json").write_text(json.dumps(good))
    (tmp_path / "raw_json_2.json").write_text("nope")
    (tmp_path / "raw_json_3.json").write_text(json.dumps({"document_type_classified": "lab"}))
    got = files.page_payloads(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["global_metadata"]["patient_name"] == "x"


def test_merged_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(n, "lab", f"t{n}\n") for n in range(9)], "page_number int, document_type string, text string")
    merged = batches.merged_texts(pages)
    files.write_merged(merged, str(tmp_path / "out"))
    wanted = {(r["file_name"], r["content"]) for r in merged.collect()}
    folder = tmp_path / "texts" / "lab"
    folder.mkdir(parents=True)
    for name, content in wanted:
        (folder / name).write_text(content)
    for path in ("out", "texts"):  # as Spark wrote them, and as plain files
        again = files.merged_documents(spark, str(tmp_path / path))
        assert {(r["document_type"], r["name"], r["content"]) for r in again.collect()} == {("lab", *w) for w in wanted}
        assert [r[0] for r in again.select(batches.included_pages(F.col("content"))).collect()] == [list(range(7)), [7, 8]]


def test_page_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, " one\n", '{"document_type": "A"}'), (22, None, '{"document_type": "b", "confidence_score": 2}'), (3, "three", None)], "page_number int, text string, payload string")
    files.write_pages(pages, str(tmp_path / "p"))
    assert {tuple(r) for r in files.page_texts(spark, str(tmp_path / "p")).collect()} == {(1, "one"), (3, "three")}
    assert {tuple(r) for r in files.classifications(spark, str(tmp_path / "p")).collect()} == {(1, "a", None), (22, "b", 2.0)}


def test_upsert_stream(spark, tmp_path):
    schema = "k string, v int, updated_at int"
    store = VersionedTable(spark, str(tmp_path / "store"), schema)
    source = str(tmp_path / "in")
    for batch in ([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], [("a", 0, 0), ("c", 7, 7)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        upsert_stream(stream, store, ["k"], ["v", "updated_at"], "updated_at", str(tmp_path / "state"), newest=True).awaitTermination()
    assert {tuple(r) for r in store.read(9).collect()} == {("a", 2, 2), ("b", 1, 1), ("c", 7, 7)}
    held = store.versions(9)
    bucket = {r["k"]: r["b"] for r in store.read(9).select("k", store.bucket(["k"]).alias("b")).collect()}
    assert held[bucket["b"]][0] == (2 if bucket["b"] in (bucket["a"], bucket["c"]) else 1)  # a batch rewrites the buckets that it touches
    store.vacuum(9)
    assert all(len(v) == 1 for v in store.versions(9).values()) and store.read(9).count() == 3


def test_sessions(spark, tmp_path):
    rows = [("u", datetime(2024, 1, 1, 0, m)) for m in (0, 5, 40)] + [("v", datetime(2024, 1, 1, 1, 0)), ("u", datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "user string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, ts timestamp").parquet(str(tmp_path / "in"))
    out = sessions(stream, ["user"], "ts", "10 minutes", "1 minute")
    out.writeStream.outputMode("append").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["user"], r["events"]) for r in spark.table("found").collect()}
    assert got == {("u", 2), ("u", 1), ("v", 1)}


def test_scratch_folders_need_a_shared_place():
    def session(master, setting):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: setting), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(session("yarn", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(session("local-cluster[2,1,1024]", None))


def test_bundled_payloads_are_few_files_beside_loose_ones(spark, tmp_path):
    payload = lambda n: json.dumps({"page_number": n, "document_type_classified": "lab\n"})
    texts = spark.createDataFrame([(f"raw_json_{n}.json", payload(n) if n % 2 else "nope") for n in range(500)], "name string, content string")
    files.write_bundles(texts.coalesce(2), str(tmp_path / "p"))
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 2  # a file a task, not one a text
    (tmp_path / "p" / "raw_json_loose.json").write_text(payload(1000))
    (tmp_path / "p" / "notes.txt").write_text("no payload")
    got = files.page_payloads(spark, str(tmp_path / "p"))
    assert sorted(r["page_number"] for r in got.collect()) == [*range(1, 500, 2), 1000]
    assert files.whole_texts(spark, str(tmp_path / "p")).count() == 2  # bundles are no texts themselves


def test_pages_are_written_as_few_files(spark, tmp_path):
    pages = spark.range(300).selectExpr("cast(id as int) page_number", "if(id % 5 = 4, null, concat(' t', id, '\n\n')) text", "if(id % 4 = 3, '{broken', '{\"document_type\": \"A\"}') payload")
    files.write_pages(pages.coalesce(2), str(tmp_path / "p"))
    assert len([f for f in (tmp_path / "p").rglob("*") if not f.name.startswith((".", "_"))]) == 2  # was a file a text, 540 of them
    assert {tuple(r) for r in files.page_texts(spark, str(tmp_path / "p")).collect()} == {(n, f"t{n}") for n in range(300) if n % 5 != 4}
    assert files.classifications(spark, str(tmp_path / "p")).count() == 225
    assert files.artifacts(spark, str(tmp_path / "p")).where("content = ' t7\n\n' and name = 'page_7_raw.txt'").count() == 1  # as it was given
