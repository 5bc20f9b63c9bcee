"""Keys, payload repair, map and table edits."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from foliant.functions import geometry, payloads


def one(spark, column):
    return spark.range(1).select(column.alias("o")).first()["o"]


def strings(*values):
    return F.array(*map(F.lit, values))


def test_sanitize_keys(spark):
    keys = ["  Bill No. ", "exp", "Amount (Rs.)", "'’\"", "a--b__c", "É", None]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    got = [r[0] for r in df.orderBy("i").select(payloads.sanitize_key(F.col("k"), F.col("i"))).collect()]
    assert got == ["bill_no", "expiry", "amount_rs", "column_3", "a_b_c", "column_5", "column_6"]


def test_suffixes_are_free(spark):
    assert one(spark, payloads.distinct_keys(strings("k", "k", "k_2", "k", "x"))) == ["k", "k_2", "k_2_2", "k_3", "x"]
    row = F.create_map(F.lit("A b"), F.lit("1"), F.lit("a-b"), F.lit("2"))
    assert one(spark, payloads.sanitize_row(row)) == {"a_b": "1", "a_b_2": "2"}
    assert one(spark, payloads.sanitize_headers(strings("Exp", ""))) == ["expiry", "column_2"]


def test_parse_tolerant(spark):
    cases = {
        '{"a": 1}': {"a": 1},
        '```json\n{"a": [1, 2,],}\n```': {"a": [1, 2]},
        "text {'a': None, 'b': True} more": {"a": None, "b": True},
        '{"Bill No.\': "x", "admin_time": "10:39:00 AM"}': {"bill_no": "x", "admin_time": "10:39:00 AM"},
        '{"t": ["x", "10:39 AM"]}': {"t": ["x", "10:39 AM"]},
        "[1, 2]": None,
        "nothing": None,
        "": None,
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, t string")
    got = [r[0] and json.loads(r[0]) for r in df.orderBy("i").select(payloads.parse_tolerant(F.col("t"))).collect()]
    assert got == list(cases.values())


def test_failed_generation(spark):
    said = "Error code: 400 - {'error': {'message': 'm', 'failed_generation': '{\"a\":\\n 1}'}}"
    df = spark.createDataFrame([(said,), ("other",), (None,)], "t string")
    assert [r[0] for r in df.select(payloads.failed_generation(F.col("t"))).collect()] == ['{"a":\n 1}', None, None]


def test_edits(spark):
    m = F.create_map(F.lit("a.b"), F.lit("1"), F.lit("c"), F.lit("2"))
    assert one(spark, payloads.set_entity(m, F.lit("a.b"), F.lit("9"))) == {"c": "2", "a.b": "9"}
    assert one(spark, payloads.remove_key(m, F.lit("c"))) == {"a.b": "1"}
    assert one(spark, payloads.overlay(m, F.create_map(F.lit("c"), F.lit("3"), F.lit("d"), F.lit("4")))) == {"a.b": "1", "c": "3", "d": "4"}
    rows = F.array(F.create_map(F.lit("h"), F.lit("1")), F.create_map(F.lit("h"), F.lit("2")))
    assert one(spark, payloads.set_cell(rows, F.lit(1), F.lit("h"), F.lit("x"))) == [{"h": "1"}, {"h": "x"}]
    assert one(spark, payloads.add_row(rows, strings("h"))) == [{"h": "1"}, {"h": "2"}, {"h": ""}]
    assert one(spark, payloads.delete_at(rows, F.lit(0))) == [{"h": "2"}]
    assert one(spark, payloads.add_column(rows, F.lit("n"))) == [{"h": "1", "n": ""}, {"h": "2", "n": ""}]
    assert one(spark, payloads.delete_column(rows, F.lit("h"))) == [{}, {}]
    assert one(spark, payloads.infer_headers(F.array().cast("array<string>"), rows)) == ["h"]
    assert one(spark, payloads.infer_headers(strings("x"), rows)) == ["x"]


def test_records(spark):
    got = one(spark, payloads.partial_payload(F.lit("invoice"), F.array(F.lit(1)), F.lit("bad")))
    assert got["errors"] == got["llm_json_errors"] == got["warnings"]["errors"] == ["bad"]
    assert one(spark, payloads.payload_errors(strings("x", ""), strings("x"), F.lit(None).cast("array<string>"))) == ["x"]
    assert one(spark, payloads.blank_record(F.lit("n")))["status"] == "blank_document"
    assert one(spark, payloads.meaningful(F.lit("blank_document"), F.create_map(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>"))) is False


def test_geometry(spark):
    box = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)])
    assert one(spark, geometry.iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == 50 / 150
    assert one(spark, geometry.iou(box(0, 0, 1, 1), box(5, 5, 6, 6))) == 0
    assert abs(one(spark, geometry.overlap_of_smaller(box(0, 0, 10, 10), box(5, 5, 7, 7))) - 1) < 1e-5
    assert one(spark, geometry.contains(box(0, 0, 10, 10), F.lit(10), F.lit(0))) is True
    points = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 2), (8, 2), (8, 7), (1, 7))])
    assert tuple(one(spark, geometry.summary(points))) == (1, 2, 8, 7, 7, 5, 4, 4)


def test_a_key_is_sanitized_in_one_pass(spark):
    plan = spark.range(1).select(payloads.sanitize_key(F.col("id").cast("string"), F.col("id")).alias("k"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") == 1  # each step was there four times over
    keys = [" Exp. ", "exp x", "??", None, "exp\n", "Claim No."]
    rows = spark.createDataFrame([(k, i if i != 5 else None) for i, k in enumerate(keys)], "k string, i int").coalesce(1)
    got = rows.select(payloads.sanitize_key(F.col("k"), F.col("i")).alias("a"), payloads.sanitize_key(F.col("k")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("expiry", "expiry"), ("exp_x", "exp_x"), ("column_2", "column"), ("column_3", "column"), ("expiry", "expiry"), ("claim_no", "claim_no")]
