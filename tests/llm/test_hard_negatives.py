"""Hard negatives against a scan of all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hard_negatives as hn

FIELDS = "id long, label int, anchor boolean, vector array<float>"


def plain(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    sound = {}
    for i, label, anchor, vector in rows:
        if None in (i, label, vector) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        one = (label, [float(np.float32(x)) for x in vector], bool(anchor))
        sound[i] = min(sound.get(i, one), one)
    width = max((len(v) for _, v, _ in sound.values()), default=0)
    whole = {i: [math.floor(scale * x) for x in v] + [0] * (width - len(v)) for i, (_, v, _) in sound.items()}
    out = []
    for a, (label, _, anchor) in sound.items():
        if not anchor:
            continue
        scores = sorted((-sum(x * y for x, y in zip(whole[a], whole[b], strict=True)), b) for b in sound if b != a)
        for s, p in [x for x in scores if sound[x[1]][0] == label][:positives]:
            wrong = [(t, n) for t, n in scores if sound[n][0] != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(wrong[:negatives])]
    return sorted(out)


def found(df, **settings):
    return sorted(map(tuple, hn.mine(df, **settings).collect()))


@pytest.mark.parametrize(("leaf", "page", "stretch", "regions", "block"), [(2, 4, 16, 3, 2), (4, 16, 100, 4096, 5), (32, 1024, 1 << 14, 4096, 128)])
def test_equals_a_scan(spark, monkeypatch, leaf, page, stretch, regions, block):
    for name, value in {"LEAF": leaf, "PAGE": page, "STRETCH": stretch, "REGIONS": regions, "BLOCK": block}.items():
        monkeypatch.setattr(hn, name, value)
    rng = random.Random(leaf)
    centres = [[rng.gauss(0, 0.4) for _ in range(6)] for _ in range(4)]
    rows = [(i * 3 - 200, rng.randint(0, 3), i % 6 == 0, [rng.gauss(c, 0.1) for c in rng.choice(centres)]) for i in range(260)]
    rows += [(2000 + i, i % 2, i % 10 == 0, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, FIELDS).repartition(3)
    assert found(df) == plain(rows)
    assert found(df, positives=2, negatives=7, low=0, high=100, scale=16) == plain(rows, 2, 7, 0, 100, 16)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 1, True, [1.0, 2.0]), (2, 1, False, [1.0, 2.0, 0.5]), (3, 2, False, [1.0]), (4, None, True, [1.0, 1.0]), (5, 1, True, None), (6, 1, True, [1.0, None]), (7, 2, False, [nan, 1.0]),
        (8, 2, False, [inf, 1.0]), (None, 2, True, [1.0, 1.5]), (9, 2, None, [0.5, 1.5]), (10, 2, False, []), (11, 1, True, []), (12, 3, True, [9.0, 9.0]), (2, 1, False, [1.0, 2.0, 0.5]), (3, 0, False, [1.0, 1.5]), (13, 1, False, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, FIELDS).withColumns({"query": F.lit("own"), "score": F.lit(0), "key": F.lit(0)})
    assert found(df) == plain(rows) != []
    assert found(df.where("false")) == [] and found(df.where("id = 12")) == [] and found(df.where("id in (10, 11)")) == plain(rows[10:12])


def test_sums_beyond_doubles_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, i % 4 == 0, [float(rng.randint(1 << 26, 1 << 28)) for _ in range(4)]) for i in range(60)]
    assert found(spark.createDataFrame(rows, FIELDS), scale=1) == plain(rows, scale=1) != []
    big = [(i, i % 2, True, [3e38, 1.0]) for i in range(6)]
    assert {r[4:] for r in found(spark.createDataFrame(big, FIELDS), high=100)} <= {(hn.MOST, hn.MOST)}


def test_boxes_bound_what_they_hold():
    rng = np.random.default_rng(1)
    v, q = rng.integers(-50, 50, (40, 5)).astype(float), rng.integers(-50, 50, (7, 5)).astype(float)
    block = hn.Queries.__new__(hn.Queries)
    block.query, block.exact, block.up, block.down = np.arange(7), True, np.maximum(q, 0), np.minimum(q, 0)
    lo, hi = hn.boxes_of(v, np.array([0, 10, 33]))
    least, greatest = block.bounds(lo, hi)
    for i, (a, b) in enumerate(((0, 10), (10, 33), (33, 40))):
        s = q @ v[a:b].T
        assert (least[:, i] <= s.min(axis=1)).all() and (s.max(axis=1) <= greatest[:, i]).all()


def test_tiles_hold_every_row_once():
    v = np.random.default_rng(2).normal(size=(1000, 6))
    leaves = list(hn.tiled(v, np.arange(1000), [0, 3, 1], 32))
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000)) and max(map(len, leaves)) <= 32 and len(leaves) <= 48
