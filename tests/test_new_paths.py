"""The automaton against the expressions, numbering over ranges against the rule, folders that are replaced at once."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import classify, lexicon, ranks, store
from foliant.sources import atomic, scratch


def test_automaton_equals_expressions(spark):
    rng = random.Random(5)
    words = [w for own in lexicon.KEYWORDS.values() for w in own] + ["invoice  no", "12 mg", "po number", "1234 5678 9012", "result unit", "aaa", "tab.", "#", "ÄÖ", "\n", "|"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " x "]) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "  ", "female" * 9, "gstgstin" * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    own = classify.Lexicon({"a": {"aa": 3, "aaa": 5, "a b": 2}, "b": {"female": 2}}, {"a": (r"a\s*b", r"\d{2}")}, least_score=1, least_share=1.0)
    for lex in (None, own):
        one, two = (classify.classify(df, words=lex, automaton=a).select("i", "document_type", "confidence_score", F.array_sort(F.map_entries("all_scores")).alias("s")) for a in (True, False))
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    counts = spark.createDataFrame([("aaaa aaa",)], "text string")
    assert classify.classify(counts, words=own, automaton=True).first()["all_scores"]["a"] == 3 * (2 + 1) + 5 * (1 + 1)


def test_hot_keys_follow_the_rule_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [("k", None if i % 2 else "t", i, rng.choice((None, rng.randrange(-2, 400)))) for i in range(1500)] + [("few", "t", 9000 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "claim string, kind string, id int, sequence int").repartition(4)
    got = {r["id"]: r["sequence"] for r in store.fill_hot_sequences(df, ["claim", "kind"], ["id"], scratch.stored, hot=100).collect()}
    taken: dict[tuple, set] = {}
    for claim, kind, _, number in rows:
        taken.setdefault((claim, kind), set()).add(number)
    for claim, kind, i, number in rows:
        if number is None:
            number = next(n for n in range(1, 9999) if n not in taken[claim, kind])
            taken[claim, kind].add(number)
        assert got[i] == number
    assert store.fill_hot_sequences(df.where("claim = 'few'"), ["claim", "kind"], ["id"], scratch.stored, hot=100).count() == 5
    made = []
    one = spark.range(4000).withColumn("k", F.lit("only"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        placed = ranks.places(one, ["k"], [F.col("id").desc()], "n", lambda d: made.append(scratch.stored(d)) or made[0])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["id"], r["n"]) for r in placed.collect()} == {(i, 4000 - i) for i in range(4000)}
    shares = [r["count"] for r in made[0].groupBy(F.shiftright("_seat", 33).alias("p")).count().collect()]
    assert len(shares) > 1 and max(shares) < 2500  # one key in several tasks


def test_folders_are_replaced_at_once(spark, tmp_path):
    place = atomic.Published(spark, str(tmp_path / "pages"))
    with pytest.raises(FileNotFoundError):
        place.current()
    read = lambda: sorted(r[0] for r in spark.read.parquet(place.current()).collect())
    place.publish(lambda path: spark.range(3).write.parquet(path))
    assert read() == [0, 1, 2]
    under_way = spark.read.parquet(place.current())
    seen = []

    def slow(path):
        spark.range(10, 12).write.parquet(path)
        seen.append(read())

    place.publish(slow)
    assert seen == [[0, 1, 2]] and read() == [10, 11] and under_way.count() == 3

    def broken(path):
        spark.range(1).write.parquet(path)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        place.publish(broken)
    assert read() == [10, 11]
    place.publish(lambda path: spark.range(5, 6).write.parquet(path))
    assert read() == [5] and len([p for p in (tmp_path / "pages").iterdir() if p.name.startswith("v-")]) == 2


def test_callbacks_of_a_batch_are_dealt_by_claim(spark, tmp_path, monkeypatch):
    """One file of callbacks is worked on by many tasks, and the streamed queries make their entries without JSON."""
    from foliant.plans import queries
    from foliant.streaming import store

    seen = []
    monkeypatch.setattr(store.scratch, "stored", lambda rows: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or rows)
    schemas = {"claims": "claim_id string, status string", "documents": queries.callbacks.DOCUMENT}
    kept = store.CommittedTables(spark, str(tmp_path / "s"), schemas, {n: ["claim_id"] for n in schemas}, 2)
    kept.commit({"claims": spark.createDataFrame([("a", "uploaded")], schemas["claims"])}, 0)
    calls = spark.createDataFrame([], "turn int, " + queries.callbacks.CALLBACK).coalesce(1)
    store.apply_callback_batch(calls, 0, kept, ["turn"])
    assert "RepartitionByExpression [claim_id" in seen[0]
    if os.path.isdir("/root/testdata/sf0.001"):
        plan = queries._calls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "to_json" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_streamed_sessions_read_many_files_a_batch(spark, tmp_path, monkeypatch):
    """Events in 3 files are 3 files in the stream too, and still one batch."""
    from foliant.plans import queries

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(tmp_path / "in" / "events.parquet"))
    monkeypatch.setattr(queries.scratch, "folder", lambda _: str(tmp_path / "work"))
    wanted = {tuple(r) for r in queries.streamed_sessions(spark, str(tmp_path / "in")).collect()}
    assert len(list((tmp_path / "work" / "events").glob("*.parquet"))) > 4  # was one file a batch, so one task
    monkeypatch.undo()
    assert wanted == {tuple(r) for r in queries.streamed_sessions(spark, "/root/testdata/sf0.001").collect()}


def test_streamed_calls_are_as_many_files_as_tasks(spark, tmp_path, monkeypatch):
    """Each batch of calls is written once, by all tasks that have rows, and the stream runs once for each; a table is read before its version is there."""
    from types import SimpleNamespace

    from foliant.plans import queries
    from foliant.streaming import store

    listed = spark.range(1, 200, numPartitions=6).selectExpr("id o_orderkey", "timestamp_ntz'2024-01-01' o_orderdate", "array(struct(1 l_linenumber, 'F' l_linestatus, 5L l_partkey)) lines")
    files = []

    def ran(stream, *_):
        files.append(len(list((tmp_path / "calls").glob("*.parquet"))))
        return SimpleNamespace(awaitTermination=lambda: None)

    monkeypatch.setattr(queries, "callback_stream", ran)
    queries._stream_calls(spark, "", listed, None, str(tmp_path), 2)
    assert files == [6, 12]  # was four a batch, after a shuffle
    read = spark.read.schema(f"turn int, {queries.callbacks.CALLBACK}").parquet(str(tmp_path / "calls"))
    one = read.where("structured_entries IS NOT NULL").first()
    assert one["structured_entries"][1]["content"]["all_extracted_entities"] == {"part": "5"} and one["structured_entries"][1]["content"]["warnings"] is None and one["mapped_fields"] is None
    kept = store.CommittedTables(spark, str(tmp_path / "s"), {"claims": "claim_id string"}, {"claims": ["claim_id"]}, 2)
    assert kept.write("claims", spark.createDataFrame([("a",)], "claim_id string"), 0).count() == 1 and kept.version() == -1
