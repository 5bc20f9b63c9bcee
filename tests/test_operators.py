"""Order-dependent operators against plain restatements on random pages, and the store's invariants."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry
from foliant.operators import batches, classify, consolidate, spatial, store
from foliant.plans.queries import QUERIES


def random_tokens(seed: int, pages: int = 4, n: int = 40):
    rnd = random.Random(seed)
    return [(p, i, rnd.randrange(300), rnd.randrange(250)) for p in range(pages) for i in range(n)]


def anchored(tokens, gap):
    lines, anchor, out = 0, None, {}
    for p, i, x, y in sorted(tokens, key=lambda t: (t[3], t[2], t[1])):
        if anchor is None or y - anchor > gap:
            lines, anchor = lines + 1, y
        out[p, i] = lines
    return out


def test_anchored_and_chained_lines_differ_on_a_ramp(spark):
    df = spark.createDataFrame([(1, i, 0, y) for i, y in enumerate((0, 10, 20, 28, 60, 70))], "page int, token_id int, x int, y int")
    lines = lambda d: [r["line"] for r in d.orderBy("token_id").collect()]
    assert lines(spatial.anchored_groups(df, ["page"])) == [1, 1, 2, 2, 3, 3]
    assert lines(spatial.chained_groups(df, ["page"], gap=18)) == [1, 1, 1, 1, 2, 2]


@pytest.mark.parametrize("gap", [18, 20])
def test_anchored_lines(spark, gap):
    tokens = random_tokens(gap)
    df = spark.createDataFrame(tokens, "page int, token_id int, x int, y int")
    got = {(r["page"], r["token_id"]): r["line"] for r in spatial.anchored_groups(df, ["page"], gap=gap).collect()}
    wanted = {}
    for p in range(4):
        wanted |= anchored([t for t in tokens if t[0] == p], gap)
    assert got == wanted


def test_columns(spark):
    tokens = random_tokens(3)
    wanted = {}
    for p in range(4):
        firsts, own = [], {}
        for t in sorted((t for t in tokens if t[0] == p), key=lambda t: (t[3], t[2], t[1])):
            hit = next((f for f in firsts if abs(f - t[2]) < 40), None)
            if hit is None:
                firsts.append(t[2])
                hit = t[2]
            own[p, t[1]] = hit
        wanted |= {k: sorted(firsts).index(v) + 1 for k, v in own.items()}
    df = spark.createDataFrame(tokens, "page int, token_id int, x int, y int")
    assert {(r["page"], r["token_id"]): r["column"] for r in spatial.columns_of(df, ["page"]).collect()} == wanted


@pytest.mark.parametrize(("measure", "threshold"), [(geometry.iou, 0.3), (geometry.overlap_of_smaller, 0.5)])
def test_suppression(spark, measure, threshold):
    rnd = random.Random(9)
    boxes = [(p, i, x := rnd.randrange(60), y := rnd.randrange(60), x + rnd.randrange(20, 60), y + rnd.randrange(20, 60)) for p in range(5) for i in range(25)]

    def plain(a, b):
        shared = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
        return shared / (area(a) + area(b) - shared) if measure is geometry.iou else shared / (min(area(a), area(b)) + 1e-5)

    kept = []
    for b in boxes:
        if not any(k[0] == b[0] and plain(k, b) > threshold for k in kept):
            kept.append(b)
    df = spark.createDataFrame(boxes, "page int, box_id int, x1 int, y1 int, x2 int, y2 int")
    got = spatial.suppress(df, ["page"], threshold, measure)
    assert {(r["page"], r["box_id"]) for r in got.collect()} == {b[:2] for b in kept}
    again = spatial.suppress(got, ["page"], threshold, measure)
    assert again.count() == got.count()


def test_token_filters_and_union(spark):
    of_regions = spark.createDataFrame([(1, 1, "Ab", 10, 10, "table"), (1, 2, "x", 0, 0, "figure")], "page int, token_id int, text string, x int, y int, region_type string")
    of_page = spark.createDataFrame([(1, 3, "aB", 11, 9), (1, 4, "ab", 30, 10)], "page int, token_id int, text string, x int, y int")
    assert sorted(r["token_id"] for r in spatial.union_tokens(of_regions, of_page, ["page"]).collect()) == [1, 4]
    tokens = spark.createDataFrame([(0.29, "a"), (0.30, "b"), (0.9, "  "), (0.9, "\t")], "confidence double, text string")
    assert [r["text"] for r in spatial.keep_tokens(tokens).collect()] == ["b"]
    regions = spark.createDataFrame([("Table", 0.35, 0, 0, 20, 20), ("table", 0.34, 0, 0, 20, 20), ("header", 0.9, 0, 0, 20, 20), ("table", 0.9, 0, 0, 19, 20), ("table", 0.9, 0, 0, 100, 96)], "type string, score double, x1 int, y1 int, x2 int, y2 int")
    assert spatial.keep_regions(regions.withColumns({"page_width": F.lit(100), "page_height": F.lit(100)})).count() == 1
    cells = spark.createDataFrame([(35, 18), (34, 18), (35, 17), (1000, 20), (900, 30)], "w int, h int").withColumn("page_area", F.lit(1_000_000))
    assert sorted(r["w"] for r in spatial.keep_cells(cells).collect()) == [35, 900]


def test_classifier_rules(spark):
    pages = ["", None, "female", "tax invoice", "gst", "gst gst", "certificate of analysis", "invoice claim", "tax|invoice:#"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pages)], "i int, text string")
    got = classify.classify(df, evidence=True).orderBy("i").collect()
    kinds = [r["document_type"] for r in got]
    assert kinds == ["unknown", "unknown", "unknown", "invoice", "unknown", "invoice", "certificate_of_analysis", "unknown", "invoice"]
    assert got[0]["all_scores"] == {} and got[2]["all_scores"]["id_card"] == 6
    assert got[3]["all_scores"]["invoice"] == 5 + 8 + 8 and got[2]["confidence_score"] == 100.0
    assert {h["keyword"]: h["count"] for h in got[2]["matched_keywords"]} == {"male": 1, "female": 1}
    assert [(h["pattern"], h["matches"], h["score"]) for h in got[3]["matched_patterns"]] == [(r"tax\s*invoice", 1, 8)]
    tied = classify.Lexicon({"b": {"x": 10}, "a": {"y": 10}}, {})
    assert classify.classify(spark.createDataFrame([("x y",)], "text string"), words=tied).first()["document_type"] == "b"


def test_letters_that_a_pattern_must_hold():
    assert [classify.literal_in(p) for p in (r"invoice\s*(number|no|#)", r"\d+\s*mg", r"tab\.", r"date\s*of\s*admission", r"\d{4}\s\d{4}", "a|b", "ab?c", "colou?r", "(?i)x", r"po\s*(number|no)")] == [
        "invoice", "mg", "tab", "admission", "", "", "a", "colo", "", "po",
    ]
    for kind, patterns in classify.Lexicon().patterns.items():
        for p in patterns:
            assert classify.literal_in(p) or p == r"\d{4}\s\d{4}\s\d{4}", (kind, p)


def test_batches(spark):
    pages = spark.createDataFrame([(n, " Invoice", f"t{n}" if n != 3 else None) for n in range(1, 17)], "page_number int, document_type string, text string")
    got = batches.merged_texts(pages).orderBy("batch").collect()
    assert [len(r["pages"]) for r in got] == [7, 7, 2] and got[0]["file_name"] == "invoice_001_raw.txt"
    head = "=" * 80 + "\nDOCUMENT TYPE : INVOICE\nPAGES INCLUDED : [15, 16]\nTOTAL PAGES    : 2\n" + "=" * 80 + "\n\n"
    assert got[2]["content"] == head + "".join("=" * 70 + f"\nPAGE {n}\n" + "=" * 70 + f"\n\nt{n}\n\n" for n in (15, 16))
    assert "PAGE 3\n" not in got[0]["content"] and "3" in got[0]["content"].split("\n")[2]
    assert batches.page_limit(pages, None, "x", "0", "5").count() == 5 and batches.page_limit(pages, "").count() == 16
    done = spark.createDataFrame([(1,), (2,)], "page_number int")
    assert batches.skip_done(pages, done, "page_number").count() == 14 and batches.skip_done(pages, done, "page_number", True).count() == 16


def test_longest_and_rows(spark):
    values = [("a", 1, "null"), ("a", 2, "xy "), ("a", 3, "zw"), ("b", 1, "none"), ("b", 2, "NULL"), ("c", 1, None), ("c", 2, "q")]
    df = spark.createDataFrame(values, "k string, page int, value string")
    assert {r["k"]: r["value"] for r in consolidate.longest(df, ["k"], ["page"]).collect()} == {"a": "xy ", "b": "none", "c": "q"}
    assert {r["k"]: r["value"] for r in consolidate.longest(df, ["k"], ["page"], keep_null_like=False).collect()} == {"a": "xy ", "b": None, "c": "q"}


def test_ledgers(spark):
    from foliant.sources.files import PAGE_PAYLOAD

    row = lambda item: (None, None, None, None, None, item, None)
    pages = [
        (2, "Lab Report ", ("Jo", None, None, None), {"a": "1", "b": "x"}, [("t", ["h"], [row("X "), row("y")])], (["w2"], [])),
        (1, "lab report", ("Joan", "null", None, None), {"a": "22"}, [("t", ["h"], [row("x")])], (["w1", "w2"], ["u"])),
    ]
    got = consolidate.ledgers(spark.createDataFrame(pages, PAGE_PAYLOAD)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["type_key"], r["document_type"], r["pages_associated"]) == ("lab_report", "lab report", [1, 2])
    assert r["global_metadata"] == {"patient_name": "Joan", "hospital_name": None, "date": None, "reference_or_claim_number": None}
    assert r["all_extracted_entities"] == {"a": "22", "b": "x"}
    assert [t["medication_or_item_name"] for t in r["consolidated_tables"]] == ["x", "y"]
    assert r["ignored_handwritten_content"] == ["w1", "w2"] and r["unmapped_ambiguous_text_regions"] == ["u"]


def test_sequences(spark):
    rows = [("c", "t", i, s) for i, s in enumerate((2, None, 5, None, None, None))] + [("c", "u", 9, None)]
    df = spark.createDataFrame(rows, "claim string, kind string, id int, sequence int")
    got = {r["id"]: r["sequence"] for r in store.fill_sequences(df, ["claim", "kind"], ["id"]).collect()}
    assert got == {0: 2, 1: 1, 2: 5, 3: 3, 4: 4, 5: 6, 9: 1}


def test_sequences_of_many_rows(spark):
    """Against the rule itself: each waiting row, in order, takes the smallest free number."""
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), rnd.choice([None, "t"]), i, rnd.choice((None, rnd.randrange(-2, 60)))) for i in range(200)]
    got = {r["id"]: r["sequence"] for r in store.fill_sequences(spark.createDataFrame(rows, "claim string, kind string, id int, sequence int").repartition(3), ["claim", "kind"], ["id"]).collect()}
    taken: dict[tuple, set] = {}
    for claim, kind, _, number in rows:
        taken.setdefault((claim, kind), set()).add(number)
    for claim, kind, i, number in rows:
        if number is None:
            number = next(n for n in range(1, 999) if n not in taken[claim, kind])
            taken[claim, kind].add(number)
        assert got[i] == number


def test_sequences_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 1000)
    keyed = spark.range(20_000).select((F.col("id") % 5000).alias("claim"), "id", F.when(F.col("id") % 4 == 0, 2).alias("sequence"))
    out = store.fill_sequences(keyed, ["claim"], ["id"], tasks=store.tasks_for(keyed))
    numbered = out.where(F.col("id") % 4 != 0).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert store.tasks_for(keyed) == 21 and len(numbered) == 21 and max(r["count"] for r in numbered) < 2000
    assert out.groupBy("claim").agg(F.sort_array(F.collect_list("sequence")).alias("s")).select("s").distinct().count() == 2
    kept = store.fill_hot_sequences(keyed, ["claim"], ["id"], lambda rows: rows.cache())
    assert len(kept.where(F.col("id") % 4 != 0).groupBy(F.spark_partition_id()).count().collect()) == 21


def test_upsert_keeps_other_fields(spark):
    stored = spark.createDataFrame([("a", 1, "keep", 10, 10), ("b", 2, "keep", 10, 10)], "k string, v int, other string, created_at int, updated_at int")
    new = spark.createDataFrame([("a", 9, 5), ("c", 3, 20)], "k string, v int, updated_at int")
    by = lambda d: {r["k"]: tuple(r)[1:] for r in d.collect()}
    assert by(store.upsert(stored, new, ["k"], ["v", "updated_at"])) == {"a": (9, "keep", 10, 5), "b": (2, "keep", 10, 10), "c": (3, None, 20, 20)}
    assert by(store.upsert(stored, new, ["k"], ["v", "updated_at"], newest_by="updated_at"))["a"] == (1, "keep", 10, 10)


DOCS = "id int, claim_id string, document_type string, source_file_name string, sequence int, status string, ocr_status string, created_at timestamp, updated_at timestamp"


def test_ingest(spark):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    stored = spark.createDataFrame([(1, "c", "inv", "inv_002.json", 2, "completed", "completed", t[0], t[0])], DOCS)
    new = spark.createDataFrame([(None, "c", "inv", "inv_002.json", None, None, None, None, t[1]), (None, "c", "inv", "scan.json", None, None, None, None, t[2])], DOCS)
    got = {r["source_file_name"]: r for r in store.ingest(stored, new, ["document_type", "source_file_name", "sequence", "status", "ocr_status", "updated_at"]).collect()}
    assert got["inv_002.json"]["sequence"] == 2 and got["inv_002.json"]["status"] == "processing" and got["inv_002.json"]["created_at"] == t[0]
    assert got["scan.json"]["sequence"] == 1 and got["scan.json"]["created_at"] == t[2]


def test_ingest_merges_once(spark, tmp_path):
    when = datetime(2024, 1, 1)
    kinds = "claim_id string, document_type string, source_file_name string, sequence int, status string, ocr_status string, created_at timestamp_ntz, updated_at timestamp_ntz"
    stored = spark.createDataFrame([("c", "t", f"a_{i}.json", None, "completed", "completed", when, when) for i in range(5)], kinds)
    incoming = spark.createDataFrame([("c", "t", f"a_{i}.json", None, None, None, when, when) for i in range(3, 8)], kinds)
    fields, kept = ["document_type", "source_file_name", "sequence", "status", "ocr_status", "updated_at"], []

    def keep(rows):
        kept.append(str(tmp_path / f"kept{len(kept)}"))
        rows.write.parquet(kept[-1])
        return spark.read.parquet(kept[-1])

    out = store.ingest(stored, incoming, fields, keep)
    assert len(kept) == 1 and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(out.collect()) == sorted(store.ingest(stored, incoming, fields).collect())


def test_claim_changes(spark):
    claims = spark.createDataFrame([("1", "uploaded"), ("2", "uploaded")], "claim_id string, status string")
    changes = spark.createDataFrame([("1", "reviewed"), ("2", "approved")], "claim_id string, status string")
    assert {r["claim_id"]: r["status"] for r in store.set_status(claims, changes).collect()} == {"1": "reviewed", "2": "uploaded"}
    failures = spark.createDataFrame([("2", "no answer")], "claim_id string, message string")
    assert {tuple(r) for r in store.failed_dispatch(claims, failures).collect()} == {("1", "uploaded", None), ("2", "failed", "no answer")}
    calls = spark.createDataFrame([("1", [], ["r"]), ("2", ["a", "b"], ["r"]), ("3", None, None)], "claim_id string, structured_entries array<string>, raw_entries array<string>")
    assert sorted(((r["claim_id"], r["entry"]) for r in store.callback_entries(calls).collect()), key=str) == [("1", "r"), ("2", "a"), ("2", "b"), ("3", None)]
    with pytest.raises(ValueError, match="limit"):
        store.list_claims(claims, limit=101)


def test_edits(spark):
    docs = spark.createDataFrame([(1, {"a": "1", "x.y": "2"}, {}, None, None), (2, {"a": "1"}, {"a": True}, {"a": "r"}, "approved")],
                                 "id int, all_extracted_entities map<string,string>, entity_verification map<string,boolean>, entity_remarks map<string,string>, review_status string")
    edits = spark.createDataFrame([(1, "x.y", "9", True, None), (1, "n", "3", None, "why")], "id int, key string, value string, verified boolean, remarks string")
    got = {r["id"]: r for r in store.edit_entities(docs, edits).collect()}
    assert got[1]["all_extracted_entities"] == {"a": "1", "x.y": "9", "n": "3"} and got[1]["entity_verification"] == {"x.y": True} and got[1]["entity_remarks"] == {"n": "why"}
    assert got[1]["review_status"] == "in_review" and got[2]["review_status"] == "approved"
    twice = spark.createDataFrame([(1, "a", "5", True, None, 1), (1, "a", "4", None, "r", 2), (1, "a", "3", False, None, 0)], "id int, key string, value string, verified boolean, remarks string, place int")
    last = store.edit_entities(docs, twice).where("id = 1").first()
    assert (last["all_extracted_entities"]["a"], last["entity_verification"], last["entity_remarks"]) == ("4", {"a": True}, {"a": "r"})
    gone = {r["id"]: r for r in store.remove_entity(docs, "a").collect()}
    assert gone[2]["all_extracted_entities"] == {} and gone[2]["entity_verification"] == {} and gone[2]["entity_remarks"] == {}
    assert store.full_view(docs).where("id = 1").first()["entity_remarks"] == {} and store.full_view(docs).where("id = 1").first()["review_status"] == "pending"


def test_evidence_is_counted_once(spark, tmp_path):
    rows = [(1, "Tax invoice, GSTIN 5: total total"), (2, None), (3, "nothing of the kind")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["keyword_evidence"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert {(r["keyword"], r["pages"], r["hits"]) for r in out.collect()} == {("invoice", 1, 1), ("tax invoice", 1, 1), ("gst", 1, 1), ("gstin", 1, 1), ("total", 1, 2)}


def test_texts_go_to_the_classifier_in_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None)
    try:
        for given, wanted in ((None, classify.BATCH_BYTES), (1 << 20, 1 << 20)):
            spark.conf.unset(name) if given is None else spark.conf.set(name, given)
            classify.classify(spark.createDataFrame([("invoice",)], "text string"), automaton=True)
            assert int(spark.conf.get(name)) == wanted
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)
