"""The pipeline's stages two to five against plain Python, on a fixture with copies, repeated passages and awkward columns."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_large_operators import WORD, components_by_brute_force, repeated_by_brute_force, sets_by_brute_force, words_of
from test_small_operators import fill

import corpus_pipeline
from foliant.llm import mixing, packing, substring_dedup

#: Columns named like those that stages make for themselves.
AWKWARD = {"score": 0.25, "lang_pred": "mine", "found": 1, "done": 2, "n_removed": 3, "_size": 4, "_key": "k", "_position": 0.5, "_row": "r", "_source": "s", "_gone": 5, "_hash": 6, "text_hash": 7, "kept": True, "starts": 8}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> dict[int, str]:
    rnd = random.Random(31)
    sentence = lambda seed, n: " ".join(words_of(seed, n)).capitalize() + ". "
    passage = "".join(sentence(900 + i, 12) for i in range(5))
    out = {}
    for i in range(60):
        body = [sentence(i * 100 + j, rnd.randrange(3, 14)) for j in range(rnd.randrange(1, 9))]
        if i % 6 == 0:
            body.insert(rnd.randrange(len(body) + 1), passage)
        out[i] = "".join(body)
    for i in range(60, 75):  # near copies: one word changed
        words = out[i - 60 + 20].split(" ")
        words[len(words) // 2] = "changed"
        out[i] = " ".join(words)
    return out


def stored(df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name))


def test_stages_equal_plain_python(spark, tmp_path):
    docs = texts()
    source = {i: ("b", "a", None, "c", "a")[i % 5] for i in docs}
    rows = [(i, t, "en", source[i], len(t)) for i, t in docs.items()]
    start = spark.createDataFrame(rows, COLUMNS).withColumns({k: F.lit(v) for k, v in AWKWARD.items()}).repartition(3)
    columns, stages = start.columns, dict(corpus_pipeline.STAGES)

    def follow(name, df):
        out = stored(stages[name](spark, df, ""), tmp_path, name)
        assert out.columns == columns
        assert all(out.where(F.col(k).eqNullSafe(F.lit(v))).count() == out.count() for k, v in AWKWARD.items())
        return out

    kept = follow("near_dedup", stored(start, tmp_path, "start"))
    comps = components_by_brute_force(sets_by_brute_force(docs, 5), 80)
    docs = {i: t for i, t in docs.items() if comps[i] == i}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == docs and len(docs) < 75

    cut = follow("substring_dedup", kept)
    changed = repeated_by_brute_force(docs, substring_dedup.RUN, substring_dedup.MAX_WORDS)
    docs = {i: changed[i][0] for i in docs}
    got = cut.collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got} == {i: (t, len(t)) for i, t in docs.items()} and sum(n > 0 for _, n in changed.values()) > 5

    mixed = follow("mixing", cut)
    sizes = {i: len(WORD.findall(t)) for i, t in docs.items()}
    totals: dict = {}
    for i, n in sizes.items():
        totals[source[i]] = totals.get(source[i], 0) + n
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    goal = fill(totals, {s: 1 + k % 3 for k, s in enumerate(order)}, sum(totals.values()), 3)
    wanted: list[tuple[float, int]] = []
    for k, s in enumerate(order):
        digest = {i: hashlib.md5(str(i).encode()).hexdigest() for i in docs if source[i] == s}
        knots = np.array(mixing.SCHEDULES[k % 3])
        grid = np.linspace(0, 1, 200_001)
        weight = np.interp(grid, knots[:, 0], knots[:, 1])
        area = np.concatenate(([0], np.cumsum(weight[1:] + weight[:-1])))
        before = 0
        for i in sorted(digest, key=lambda i: (int(digest[i][:8], 16) % mixing.BUCKETS, digest[i])):
            wanted += [(float(np.interp((n * totals[s] + before + sizes[i] / 2) / goal[s], area / area[-1], grid)), i) for n in range(3) if 2 * (n * totals[s] + before) + sizes[i] <= 2 * goal[s]]
            before += sizes[i]
    wanted.sort()
    copies = [r["doc_id"] for r in mixed.orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()]
    assert sorted(copies) == sorted(i for _, i in wanted)
    place = dict(zip(sorted(range(len(wanted)), key=lambda n: wanted[n][1]), range(len(wanted)), strict=True))
    assert len(place) == len(copies)
    times: dict[int, list[float]] = {}
    for t, i in wanted:
        times.setdefault(i, []).append(t)
    told = [times[i].pop(0) for i in copies]  # a document's copies come in order of time
    assert all(a <= b + 1e-4 for a, b in zip(told, told[1:], strict=False))

    packed = stages["packing"](spark, mixed, "").orderBy("sequence_id", "offset").collect()
    tokenizer = packing.load(packing.vocabulary())[0]
    ids = [x for i in copies for x in [*tokenizer.encode(docs[i], add_special_tokens=False).ids, packing.END_ID]]
    assert [r["doc_id"] for r in packed if r["start"] == 0] == copies
    assert [x for r in packed for x in r["ids"]] == ids
    assert [(r["sequence_id"], r["offset"]) for r in packed] == [((at := sum(len(p["ids"]) for p in packed[:n])) // packing.MAX_TOKENS, at % packing.MAX_TOKENS) for n in range(len(packed))]


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "the thing " * 400, "en", None, 1), (3, "own text of the third", "en", "s", 1), (4, "the thing " * 400, "de", "s", 1), (None, "the thing " * 400, None, "s", 1), (5, "12 34 ½ ²", "en", "s", 9)]
    odd = spark.createDataFrame(rows, COLUMNS).withColumn("score", F.lit("x"))
    for name, df in (("odd", odd), ("empty", odd.limit(0))):
        df = stored(df, tmp_path, f"{name}_start")
        counts = []
        for stage, run in corpus_pipeline.STAGES:
            df = stored(run(spark, df, ""), tmp_path, f"{name}_{stage}")
            counts.append(df.count())
        assert counts[0] == (4 if name == "odd" else 0) and (name == "odd" or not any(counts))
        if name == "odd":
            left = spark.read.parquet(str(tmp_path / "odd_near_dedup"))
            assert sorted((r["doc_id"] or 0, len(r["text"])) for r in left.collect()) == [(0, 4000), (3, 21), (3, 4000)]


@pytest.mark.parametrize("name", ["doc_id", "text"])
def test_stages_need_their_columns(spark, name):
    """Errors of use are not swallowed."""
    with pytest.raises(Exception, match=name):
        corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string").drop(name), "").count()
