"""Nearest neighbours in groups of equal and of very close vectors that are well over a leaf, by vec_id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import nn_descent


def test_copies_and_close_vectors_over_a_leaf(spark):
    rng = np.random.default_rng(8)
    one, other = rng.standard_normal(16), rng.standard_normal(16)
    copied, close = 2 * nn_descent.LEAF + 400, 2 * nn_descent.LEAF + 400
    x = np.concatenate([np.tile(one, (copied, 1)), other + 1e-3 * rng.standard_normal((close, 16)), rng.standard_normal((800, 16))])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got: dict[int, list[int]] = {}
    for r in sorted(nn_descent.nearest(df, F.col("node") % 200 == 0, k=10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    shares = {"copies": [], "close": [], "others": []}
    for q in range(0, len(x), 200):
        scores = np.array([float(np.sum(x[q] * v)) for v in x]).round(12)
        wanted = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:10]
        kind = "copies" if np.array_equal(x[q], one) else "close" if np.abs(x[q] - other).max() < 0.1 else "others"
        shares[kind].append(len(set(wanted) & set(got[q])) / 10)
    means = {k: float(np.mean(v)) for k, v in shares.items()}
    print(means)
    # Copies are exact. Vectors within a thousandth of each other are not: 0.59 here, 0.47 before (see the README).
    assert means["copies"] == 1.0 and means["close"] >= 0.5 and means["others"] >= 0.95, means


def test_recall_over_many_leaves(spark):
    """20,000 vectors of unlike lengths in clusters of many sizes: recall against brute force at the production parameters."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((300, 24))
    x = (centres[(300 * rng.random(20_000) ** 2).astype(int)] + 0.7 * rng.standard_normal((20_000, 24))) * rng.uniform(0.7, 1.4, (20_000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got: dict[int, list[int]] = {}
    for r in nn_descent.nearest(df, F.col("node") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = []
    for q in range(0, 20_000, 100):
        near = x @ x[q]
        near[q] = -np.inf
        hits.append(len(set(np.argsort(-near)[:20].tolist()) & set(got[q])) / 20)
    assert len(got) == 200 and np.mean(hits) >= 0.9, np.mean(hits)
