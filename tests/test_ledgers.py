"""Ledgers by run, as tables and nested; payloads that need no repair."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from foliant.functions import payloads
from foliant.operators import consolidate
from foliant.sources.files import PAGE_PAYLOAD


def row(item):
    return (None, None, None, None, None, item, None)


def pages(spark):
    rows = [
        ("r1", 2, "Lab Report ", ("Jo", None, None, None), {"a": "1", "b": "x"}, [("t", ["h"], [row("X "), row("y")])], (["w2"], [])),
        ("r1", 1, "lab report", ("Joan", "null", None, None), {"a": "22"}, [("t", ["h"], [row("x")])], (["w1", "w2"], ["u"])),
        ("r2", 1, "Lab report", ("Al", None, None, None), {"a": "333", "c": None}, [], ([], None)),
        ("r2", 2, "invoice", (None, None, None, None), {}, [("t", [], [])], None),
    ]
    return spark.createDataFrame(rows, "run string, " + PAGE_PAYLOAD)


def test_runs_never_mix(spark):
    got = {(r["run"], r["type_key"]): r for r in consolidate.ledgers(pages(spark), keys=("run",)).collect()}
    assert set(got) == {("r1", "lab_report"), ("r2", "lab_report"), ("r2", "invoice")}
    one, two, three = got["r1", "lab_report"], got["r2", "lab_report"], got["r2", "invoice"]
    assert (one["document_type"], one["pages_associated"], one["all_extracted_entities"]) == ("lab report", [1, 2], {"a": "22", "b": "x"})
    assert [t["medication_or_item_name"] for t in one["consolidated_tables"]] == ["x", "y"] and one["ignored_handwritten_content"] == ["w1", "w2"]
    assert (two["all_extracted_entities"], two["global_metadata"]["patient_name"], two["ignored_handwritten_content"]) == ({"a": "333"}, "Al", [])
    assert three["unmapped_ambiguous_text_regions"] == [] and three["consolidated_tables"] is None


def test_tables_hold_a_row_a_fact(spark):
    of = consolidate.ledger_tables(pages(spark), ["run"])
    assert {tuple(r) for r in of["ledgers"].collect()} == {("r1", "lab_report", "lab report", 2, 1), ("r2", "lab_report", "Lab report", 1, 1), ("r2", "invoice", "invoice", 1, 2)}
    assert {tuple(r)[:5] for r in of["rows"].collect()} == {("r1", "lab_report", 1, 0, 0), ("r1", "lab_report", 2, 0, 1)}
    assert {tuple(r) for r in of["warnings"].where("run = 'r1'").select("kind", "text").collect()} == {("ignored_handwritten_content", "w1"), ("ignored_handwritten_content", "w2"), ("unmapped_ambiguous_text_regions", "u")}
    for name, df in of.items():  # no list grows with a ledger
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString(), name


def test_sound_payloads_are_left_alone(spark):
    texts = ['{"a": "x, }"}', '```json\n{"a": "x, ]"}\n```', 'so: {"a": "\\\\\' , }"} end', '{"a": 1,}', "{'a': 'it', 'b': None}", '{"Bill No.\': 5}', "nothing", None, "[1]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["p"] and json.loads(r["p"]) for r in df.select("i", payloads.parse_tolerant(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == [{"a": "x, }"}, {"a": "x, ]"}, {"a": "\\' , }"}, {"a": 1}, {"a": "it", "b": None}, {"bill_no": 5}, None, None, None]
