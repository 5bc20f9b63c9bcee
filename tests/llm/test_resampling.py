"""Importance resampling against plain Python, and the bracket of the cutoff."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import resampling

FIELDS = "doc_id long, text string"


def plain(documents, target, percent, least_words, longest, buckets, seed):
    """The whole rule, row by row."""

    def features(text):
        low = (text or "").translate(str.maketrans(resampling.UPPER, resampling.LOWER))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own = [(d, *features(t)) for d, t in documents]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for text in target for b in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[2], r[3]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(((r[0], r[2], r[3], r[4], r[5]) for r in rows), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_plain_python(spark, longest):
    rng = random.Random(longest)
    vocabulary = ["Alpha", "beta2", "gäß", "x", "naïve-ly", "ΩΩ", "it's", "東京", "\x00nul", "z\tz", "😀"]
    documents = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(300)]
    documents += [(None, "alpha " * 40), (7, None), (8, ""), (9, "..."), (5, "beta2 " * 30), (5, "beta2 " * 30), (5, "alpha beta2 " * 25), (1000, "alpha " * 20_000)]
    target = ["alpha x x gäß", "", None, "ALPHA it's", "unheard of"]
    settings = {"percent": 30, "least_words": 20, "longest": longest, "buckets": 97, "seed": 5}
    df = spark.createDataFrame(documents, FIELDS).repartition(3).withColumns({"score": F.lit("own"), "rank": F.lit(0), "_down": F.lit(1)})
    out = found(resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **settings))
    assert out == plain(documents, target, **settings)


def test_ties_and_repeated_rows_have_ranks_of_their_own(spark):
    documents = [(3, "same words here " * 10)] * 200 + [(4, "other " * 30)] * 10
    df = spark.createDataFrame(documents, FIELDS)
    out = resampling.resample(df, spark.createDataFrame([("same",)], "text string"), percent=50)
    assert sorted(r[0] for r in out.where("rank is not null").select("rank").collect()) == list(range(1, 106))
    kept = resampling.draw(df.withColumn("extra", F.lit(1)), spark.createDataFrame([("same",)], "text string"), percent=50)
    assert kept.columns == ["doc_id", "text", "extra"] and kept.where("doc_id = 3").count() in (0, 200)


def test_no_documents_no_target_and_nothing_to_draw(spark):
    none, one = spark.createDataFrame([], FIELDS), spark.createDataFrame([(1, "few words")], FIELDS)
    target = spark.createDataFrame([("few",)], "text string")
    assert resampling.resample(none, target).count() == 0
    assert found(resampling.resample(one, target)) == plain([(1, "few words")], ["few"], 10, 20, 1, resampling.BUCKETS, 2024)
    empty = resampling.resample(one, target.where("false"), least_words=0, percent=100)
    assert found(empty) == plain([(1, "few words")], [], 100, 0, 1, resampling.BUCKETS, 2024)


@pytest.mark.parametrize("accuracy", [1, 2, 20, 1000])
def test_brackets_hold_the_cutoff_however_coarse_the_sketch(spark, accuracy):
    rng = random.Random(accuracy)
    scores = [rng.choice((0, 0, 0, rng.randint(-50, 50), rng.randint(-10_000, 10_000))) for _ in range(2000)]
    rows = spark.createDataFrame([(s,) for s in scores], "score long").cache()
    for wanted in (1, 2, 700, 1000, 1999, 2000):
        low, high, above = resampling.bracket(rows, wanted, len(scores), accuracy)
        assert above == sum(s > high for s in scores) < wanted <= sum(s >= low for s in scores)
    low, high, above = resampling.bracket(rows, 300, len(scores), 1000)
    assert sum(low <= s <= high for s in scores) < 100  # only a small part is sorted
