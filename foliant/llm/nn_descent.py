"""Approximate nearest neighbours by inner product: NN-descent builds the graph, greedy search answers queries.

Inner product becomes nearness of unit-free vectors by one added dimension, sqrt(largest norm**2 - norm**2), so that
vectors of unlike length are searched rightly. For the graph and the search, vectors are coded as 16-bit numbers with a
scale; of what the search finds, the best RESCORED are scored exactly, in double precision on the original vectors, once.

1. Start: TREES times, vectors are dealt into leaves by the signs of random projections, leaves into parts of at most
   LEAF rows, and each part's vectors are compared. This gives every node K first neighbours.
2. NN-descent: each node gathers some of its neighbours and of the nodes that list it (at most 2 * SAMPLE), they are
   compared with each other, and those closer than what a node has are proposed to it; the best K stay. A node is
   listed in at most 2 * SAMPLE gatherings, however many nodes point to it (a vector with thousands of copies).
3. Queries walk the graph: a beam of the best nodes found so far; each round opens the best unopened ones.

Equal vectors are one class, named by its smallest id: graph and search know classes only, and a class found gives its
members in id order. Very close vectors are dealt into other parts by each start, and equal scores are taken in a drawn
order, so that vectors with one code don't all list the same few.

Every round is a few Spark joins on bounded groups, written to the shared folder.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite numbers take
no part; null ids neither; rows that repeat an id count once, with the smallest of their vectors; fewer candidates than k give all; ties go to the
smaller id; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, table

K = 32
#: Starts, and rows of a leaf at most; each start proposes FIRST neighbours.
TREES, LEAF, FIRST = 6, 2560, 20
#: Neighbours drawn each way for a gathering, and rounds.
SAMPLE, DESCENTS = 24, 3
#: Proposals of one gathering for a member.
EACH = 10
BEAM, OPENED, ROUNDS = 240, 40, 4
#: Nodes found that are scored exactly, as a multiple of the neighbours asked for.
RESCORED = 3


def usable(vectors: DataFrame) -> DataFrame:
    """node, vec array<double>: the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("node"), v.alias("vec"))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    size = [r["n"] for r in common.collect()]
    return rows.where(F.size("vec") == (size[0] if size else 0)).groupBy("node").agg(F.min("vec").alias("vec"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def coded(rows: DataFrame, most: float) -> DataFrame:
    """node, code: the augmented vector as a float32 scale and 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec in batch.column(1).to_pylist():
                x = np.array(vec)
                x = np.append(x, math.sqrt(max(0.0, most * most - float(x @ x))))
                scale = np.abs(x).max() / 32767
                out.append(np.float32(scale).tobytes() + np.rint(x / scale).astype(np.int16).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["node", "code"])

    return rows.select("node", "vec").mapInArrow(run, "node long, code binary")


def decoded(codes: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return flat[:, 4:].copy().view(np.int16).astype(np.float32) * flat[:, :4].copy().view(np.float32)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def proposals(groups: DataFrame, keys: list[str], each: int) -> DataFrame:
    """src, dst, score: each member's best `each` others of its group above the score it asks for (column floor).

    groups: keys, node, code, floor; all rows of a group must be few. Groups are streamed one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, score, size = [], [], [], 0

        def ready() -> pa.RecordBatch:
            cols = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((src, np.int64), (dst, np.int64), (score, np.float32))]
            return pa.record_batch([pa.array(c) for c in cols], names=["src", "dst", "score"])

        for _, group in groupby(rows_of(batches), key=lambda r: r[: len(keys)]):
            rows = list(group)
            if len(rows) < 2:
                continue
            nodes, floor = np.array([r[-3] for r in rows]), np.array([r[-1] for r in rows], np.float32)
            x = decoded([r[-2] for r in rows])
            near = x @ x.T
            near[nodes[:, None] == nodes] = np.finfo(np.float32).min / 2
            n = min(each, len(rows) - 1)
            # Equal scores (vectors with one code) go in an order drawn for each row, or all rows would name the same few.
            drawn = np.random.default_rng(int(nodes.min()) & 0xFFFFFFFF).random(near.shape, np.float32)
            best = np.argpartition(np.abs(near) * (4e-7 * drawn) - near, n - 1, axis=1)[:, :n]
            found = np.take_along_axis(near, best, axis=1)
            a, b = np.nonzero((found > floor[:, None]) & (nodes[best] != nodes[:, None]))
            src.append(nodes[a])
            dst.append(nodes[best[a, b]])
            score.append(found[a, b])
            size += len(a)
            if size > 100_000:
                yield ready()
                src, dst, score, size = [], [], [], 0
        yield ready()

    ordered = groups.select(*keys, "node", "code", "floor").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "src long, dst long, score float")


def best_of(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each src, copies of an edge once; ties in a drawn order, so that no node is listed by all."""
    once = edges.groupBy("src", "dst").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), F.xxhash64("src", "dst"), "dst"))
    return once.withColumn("n", place).where(F.col("n") <= k).drop("n")


def start(codes: DataFrame, total: int, width: int, k: int, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """First neighbours from leaves of random projections."""
    depth = max(0, math.ceil(math.log2(max(1, 4 * total / leaf))))
    planes = np.random.default_rng(5).standard_normal((trees, depth, width)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            if not raw:
                continue
            x = decoded(raw)
            bits = np.stack([((x @ p.T > 0) @ (1 << np.arange(depth))).astype(np.int64) if depth else np.zeros(len(x), np.int64) for p in planes])
            for t in range(trees):
                yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), pa.array(bits[t]), batch.column(0), batch.column(1)], names=["tree", "leaf", "node", "code"])

    leaves = materialize(codes.mapInArrow(run, "tree int, leaf long, node long, code binary"))
    # Leaves that are too large (copies of one vector) are dealt into parts by hash; too small ones are joined.
    sizes = leaves.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree", "high").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("high", F.shiftright("leaf", 6)).withColumn("joined", F.floor(before / leaf)).withColumn("parts", F.ceil(F.col("n") / leaf))
    placed = leaves.join(sizes.drop("n"), ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("tree", "node"), F.col("parts"))).withColumn("floor", F.lit(float("-inf")))
    return best_of(proposals(placed, ["tree", "high", "joined", "part"], FIRST), k)


def descend(graph: DataFrame, codes: DataFrame, k: int, sample: int, turn: int) -> DataFrame:
    """One round: neighbours of neighbours, by way of the node that they share."""
    drawn = F.xxhash64(F.lit(turn), "src", "dst")
    # Of the nodes that list dst, `sample` stay; first in salted parts, so that a node listed by millions is no hot group.
    salted = F.row_number().over(Window.partitionBy("dst", F.pmod(F.xxhash64("src"), F.lit(64))).orderBy(drawn))
    capped = graph.withColumn("n", salted).where(F.col("n") <= sample)
    whole = F.row_number().over(Window.partitionBy("dst").orderBy(drawn))
    capped = capped.withColumn("n", whole).where(F.col("n") <= sample)
    place = F.row_number().over(Window.partitionBy("src").orderBy(drawn))
    kept = materialize(capped.withColumn("m", place).where(F.col("m") <= sample).select("src", "dst"))
    met = kept.select(F.col("src").alias("hub"), F.col("dst").alias("node")).unionByName(kept.select(F.col("dst").alias("hub"), F.col("src").alias("node"))).distinct()
    floors = graph.groupBy("src").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floors = floors.select(F.col("src").alias("node"), F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).cast("float").alias("floor"))
    members = codes.join(floors, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")).cast("float")))
    return best_of(graph.unionByName(proposals(met.join(members, "node"), ["hub"], EACH)), k)


def build(codes: DataFrame, total: int, width: int, k: int = K, descents: int = DESCENTS, sample: int = SAMPLE) -> DataFrame:
    """src, dst, score: the neighbour graph."""
    graph = materialize(start(codes, total, width, k))
    for turn in range(descents):
        before, graph = graph, materialize(descend(graph, codes, k, sample, turn))
        discard(before)
    return graph


def code_scores(pairs: DataFrame) -> DataFrame:
    """query_id, node, score: inner products of the coded vectors without the added dimension. pairs: query_id, node, qcode, code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (decoded(batch.column(i).to_pylist())[:, :-1] for i in (2, 3))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array((a * b).sum(axis=1))], names=["query_id", "node", "score"])

    return pairs.select("query_id", "node", "qcode", "code").mapInArrow(run, "query_id long, node long, score float")


def search(queries: DataFrame, entries: DataFrame, codes: DataFrame, graph: DataFrame, k: int, beam: int = BEAM, opened: int = OPENED, rounds: int = ROUNDS) -> DataFrame:
    """query_id, node, score (of codes): greedy search. queries: query_id, qcode; entries: query_id, node, to start from."""
    both = graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    some = F.row_number().over(Window.partitionBy("src", F.pmod(F.xxhash64("dst"), F.lit(2))).orderBy(F.xxhash64("src", "dst")))
    steps = materialize(graph.select("src", "dst").unionByName(both.exceptAll(graph.select("src", "dst")).withColumn("n", some).where(F.col("n") <= K).drop("n")).distinct())

    def scored(pairs: DataFrame) -> DataFrame:
        return code_scores(pairs.join(codes, "node").join(queries, "query_id"))

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    found = materialize(scored(entries.distinct()).withColumn("open", F.lit(True)))
    for _ in range(rounds):
        waiting = found.where("open").withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= opened).select("query_id", "node")
        fresh = waiting.join(steps, waiting["node"] == steps["src"]).select("query_id", F.col("dst").alias("node")).distinct()
        fresh = scored(fresh.join(found.select("query_id", "node"), ["query_id", "node"], "left_anti")).withColumn("open", F.lit(True))
        old = found.join(waiting.withColumn("done", F.lit(True)), ["query_id", "node"], "left").select("query_id", "node", "score", (F.col("open") & F.col("done").isNull()).alias("open"))
        merged = old.unionByName(fresh).withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= max(beam, k + 1)).drop("n")
        before, found = found, materialize(merged)
        discard(before)
    discard(steps)
    return found.select("query_id", "node", "score")


def classes(rows: DataFrame) -> DataFrame:
    """node, head: the members of classes of two or more equal vectors, and the smallest of each."""
    # Stored, so that Spark knows its size (often nothing) and can split the class of a hot vector in the join.
    copied = materialize(rows.groupBy("vec").agg(F.min("node").alias("head"), F.count("*").alias("n")).where(F.col("n") > 1).select("vec", "head"))
    return materialize(rows.join(copied, "vec").select("node", "head"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors that are queries, among all rows but the query's own."""
    bounded_batches(vectors.sparkSession)
    rows = materialize(usable(vectors))
    members = classes(rows)
    copies = members.where(F.col("node") != F.col("head"))
    heads = materialize(rows.join(copies, "node", "left_anti"))
    about = heads.agg(F.count("*").alias("n"), F.max(F.sqrt(dot(F.col("vec"), F.col("vec")))).alias("most"), F.max(F.size("vec")).alias("width")).first()
    if not about["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = materialize(coded(heads, about["most"]))
    graph = build(codes, about["n"], about["width"] + 1, max(K, k + 1))
    asked = rows.where(is_query).select("node").join(copies, "node", "left")
    asked = materialize(asked.select(F.col("node").alias("query_id"), F.coalesce("head", "node").alias("asked")))
    heads_asked = materialize(asked.select(F.col("asked").alias("node")).distinct())
    queries = materialize(codes.join(heads_asked, "node").select(F.col("node").alias("query_id"), F.col("code").alias("qcode")))
    own = queries.select("query_id", F.col("query_id").alias("node"))
    near = queries.join(graph, F.col("query_id") == F.col("src")).select("query_id", F.col("dst").alias("node"))
    found = search(queries, own.unionByName(near), codes, graph, k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node"))
    met = found.withColumn("n", place).where(F.col("n") <= RESCORED * (k + 1)).select(F.col("query_id").alias("asked"), "node")
    vectors_asked = heads.join(heads_asked, "node").select(F.col("node").alias("asked"), F.col("vec").alias("qvec"))
    found = met.join(heads, "node").join(vectors_asked, "asked").select("asked", "node", dot(F.col("qvec"), F.col("vec")).alias("score"))
    # k + 1 classes, k + 1 members of each, and k + 1 rows of them hold all that a query can ask for, besides itself.
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "node"))
    best = found.withColumn("n", place).where(F.col("n") <= k + 1).select("asked", F.col("node").alias("head"), "score")
    salted = F.row_number().over(Window.partitionBy("head", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy("node"))
    first = members.withColumn("n", salted).where(F.col("n") <= k + 1)
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("head").orderBy("node"))).where(F.col("n") <= k + 1)
    first = first.groupBy("head").agg(F.collect_list("node").alias("nodes"))
    spread = best.join(first, "head", "left").select("asked", "score", F.explode(F.coalesce("nodes", F.array("head"))).alias("node"))
    spread = spread.withColumn("n", place).where(F.col("n") <= k + 1)
    # A list for each class asked for, which its queries share; stored, so that the join can split a hot class.
    lists = materialize(spread.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("n", "node", "score"))).alias("found")))
    others = F.slice(F.filter("found", lambda x: x["node"] != F.col("query_id")), 1, k)
    ranked = asked.join(lists, "asked").select("query_id", F.posexplode(others).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.node").alias("vec_id"), "hit.score")


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("node") % 20 == 0)
