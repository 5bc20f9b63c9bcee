"""Hard negatives by an R-tree: for each anchor its best positives, and rows of other labels in a window below each.

Rows are packed by sort-tile-recursive: Spark sorts them into ranges by label and widest coordinate, and each stretch of
a range is tiled by further coordinates into leaves of LEAF rows, PAGE rows a page. Leaves, pages and regions (stretches
of pages, at most REGIONS of them, so that their boxes can be sent to all tasks) have bounding boxes, in the coordinates
and in the label. For a box and an anchor, each coordinate gives an interval of products, and their sums bound every
inner product in the box.

Searching goes best first in two rounds. The first takes each query to the region with the highest bound; the k-th score
found there is the query's floor. The second takes it to all other regions that its floor, window and label leave. In a
page a queue gives the leaf of the highest bound next, until bounds are strictly below the k-th score, since equal scores
are decided by id. Queries travel in blocks of BLOCK neighbours; regions meet blocks by an equal join; the best k of a
query are kept by a limited window, so no query is gathered whole.

Scores are exact: sums below 2**53 are computed in doubles, larger ones in whole numbers without pruning; beyond 64 bits a
score is given as the nearest 64-bit number.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; of rows that share
an id, the least by label and vector takes part; shorter vectors count as padded by zeros; equal vectors are rows of their
own; an empty table gives no rows, an anchor without positives or negatives none either. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, numbered, table

LEAF, PAGE, REGIONS, BLOCK = 64, 1024, 4096, 128
#: Rows that are tiled at once, and the coordinates by which they are.
STRETCH, AXES = 1 << 14, 4
POSITIVES, NEGATIVES, LOW_PERCENT, HIGH_PERCENT, SCALE = 5, 3, 50, 95, 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as doubles; doubles beyond 2**52 are whole already."""
    product = lambda x: x.cast("double") * float(scale)
    return F.transform(vector, lambda x: F.when(F.abs(product(x)) < float(1 << 52), F.floor(product(x)).cast("double")).otherwise(product(x)))


def usable(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """id, label, anchor, vector of the rows that take part. rows: the same, vector as given."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
    one = sound.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r"))
    return one.select("id", F.col("r.label").cast("long").alias("label"), F.coalesce("r.anchor", F.lit(False)).alias("anchor"), whole_numbers(F.col("r.vector"), scale).alias("vector"))


def tiled(points: np.ndarray, order: np.ndarray, axes: list[int], leaf: int) -> Iterator[np.ndarray]:
    """Sort-tile-recursive: stretches of `order` of at most `leaf` points, cut evenly by one coordinate after another."""
    leaves = -(-len(order) // leaf)
    if leaves <= 1:
        yield order
        return
    slabs = leaves if len(axes) == 1 else math.ceil(leaves ** (1 / len(axes)))
    by = order[np.argsort(points[order, axes[0]], kind="stable")]
    step = leaf * -(-leaves // slabs)
    for at in range(0, len(by), step):
        yield from tiled(points, by[at : at + step], axes[1:] or axes, leaf)


def boxes_of(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)


PAGE_FIELDS = "ids binary, labels binary, vectors binary, starts binary, lo array<double>, hi array<double>, label_lo long, label_hi long"


def pack_pages(rows: DataFrame, width: int, axis: int) -> DataFrame:
    """Pages of PAGE_FIELDS; starts are where leaves begin, lo, hi and label_lo, label_hi the page's box."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= STRETCH:
                yield arrays(held)
                held, n = [], 0
        if n:
            yield arrays(held)

    def arrays(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks()
        vectors = whole["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(whole), width)
        return whole["id"].to_numpy(), whole["label"].to_numpy(), vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors in stretches(batches):
            axes = np.argsort(-np.ptp(vectors, axis=0), kind="stable")[:AXES].tolist() or [0]
            leaves = list(tiled(vectors, np.arange(len(ids)), axes, LEAF)) if width else [np.arange(len(ids))[i : i + LEAF] for i in range(0, len(ids), LEAF)]
            out: list[list] = [[] for _ in range(8)]
            for at in range(0, len(leaves), PAGE // LEAF):
                some = leaves[at : at + PAGE // LEAF]
                own, starts = np.concatenate(some), np.cumsum([0, *map(len, some)])[:-1].astype("<i4")
                v, k = vectors[own], labels[own]
                row = ids[own].tobytes(), k.tobytes(), v.tobytes(), starts.tobytes(), v.min(axis=0), v.max(axis=0), int(k.min()), int(k.max())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.binary()] * 4 + [pa.list_(pa.float64())] * 2 + [pa.int64()] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["ids", "labels", "vectors", "starts", "lo", "hi", "label_lo", "label_hi"])

    key = F.get("vector", F.lit(axis)) if width else F.lit(0)
    ranged = rows.select("id", "label", "vector", key.alias("key")).repartitionByRange("label", "key", "id").sortWithinPartitions("label", "key", "id")
    return ranged.select("id", "label", "vector").mapInArrow(run, PAGE_FIELDS)


class Tree:
    """The packed rows: pages with their region, and the regions' boxes."""

    def __init__(self, rows: DataFrame, width: int, axis: int, exact: bool):
        self.width, self.exact = width, exact
        stored = materialize(pack_pages(rows, width, axis).withColumn("_at", F.monotonically_increasing_id()))
        n = stored.count()
        of = F.floor((F.col("place") - 1) * min(REGIONS, n) / max(n, 1)).cast("int")
        placed = numbered(stored, "_at", "place")
        self.pages, self.stored = placed.withColumn("region", of).drop("place"), stored
        sides = placed.select(of.alias("region"), "label_lo", "label_hi", F.posexplode_outer(F.arrays_zip("lo", "hi")).alias("axis", "side"))
        found = sides.groupBy("region", "axis").agg(F.min("side.lo").alias("lo"), F.max("side.hi").alias("hi"), F.min("label_lo").alias("label_lo"), F.max("label_hi").alias("label_hi")).toArrow()
        regions = min(REGIONS, n)  # at most REGIONS * width numbers come to the driver
        self.lo, self.hi, self.labels = np.zeros((regions, width)), np.zeros((regions, width)), np.zeros((regions, 2), np.int64)
        at = found["region"].to_numpy()
        if width:
            self.lo[at, found["axis"].to_numpy()], self.hi[at, found["axis"].to_numpy()] = found["lo"].to_numpy(), found["hi"].to_numpy()
        self.labels[at, 0], self.labels[at, 1] = found["label_lo"].to_numpy(), found["label_hi"].to_numpy()


class Queries:
    """A block of queries as arrays."""

    def __init__(self, rows: pa.StructArray, width: int, exact: bool):
        get = lambda name: rows.field(name).to_numpy(zero_copy_only=False)
        self.query, self.own, self.label, self.low, self.high, self.floor = map(get, ("query", "own", "label", "low", "high", "floor"))
        self.vectors, self.exact = rows.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width), exact
        self.up, self.down = np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) inner product of each query with what lies in each box."""
        if not self.exact:
            none = np.full((len(self.query), len(lo)), np.inf)
            return -none, none
        return self.up @ lo.T + self.down @ hi.T, self.up @ hi.T + self.down @ lo.T

    def able(self, lo: np.ndarray, hi: np.ndarray, label_lo: np.ndarray, label_hi: np.ndarray, same: bool) -> np.ndarray:
        """For each query and box the greatest score that it may want from it; -inf if none."""
        least, greatest = self.bounds(lo, hi)
        label = self.label[:, None]
        fits = (label_lo <= label) & (label <= label_hi) if same else ~((label_lo == label) & (label_hi == label))
        fits &= (greatest >= self.low[:, None]) & (least <= self.high[:, None])
        return np.where(fits, np.minimum(greatest, self.high[:, None]), -np.inf)


def in_order(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each query: highest scores first, then smallest ids."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def search_page(block: Queries, page: dict, width: int, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of the best k of each query in the page, of those that can be among its best.

    The queue holds the leaves by the highest bound that any query has for them. A leaf is opened for the queries whose
    bound isn't strictly below their k-th score by then.
    """
    ids, labels = np.frombuffer(page["ids"], "<i8"), np.frombuffer(page["labels"], "<i8")
    vectors, starts = np.frombuffer(page["vectors"], "<f8").reshape(len(ids), width), np.frombuffer(page["starts"], "<i4")
    stops = [*starts[1:].tolist(), len(ids)]
    bound = block.able(*boxes_of(vectors, starts), *boxes_of(labels, starts), same)
    kth = block.floor.copy()
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    queue = [(-b, leaf) for leaf, b in enumerate(bound.max(axis=0).tolist()) if b > -math.inf]
    heapq.heapify(queue)
    while queue:
        leaf = heapq.heappop(queue)[1]
        who = np.flatnonzero((bound[:, leaf] >= kth) & (bound[:, leaf] > -np.inf))
        if not len(who):
            continue
        span = slice(int(starts[leaf]), stops[leaf])
        s, label = block.vectors[who] @ vectors[span].T, block.label[who, None]
        wanted = (labels[span] == label) if same else (labels[span] != label)
        wanted &= (s >= np.maximum(kth, block.low)[who, None]) & (s <= block.high[who, None]) & (ids[span] != block.own[who, None])
        at, i = np.nonzero(wanted)
        if len(at):
            joined = tuple(np.concatenate(pair) for pair in zip(best, (who[at], ids[span][i], s[at, i]), strict=True))
            best = tuple(x[in_order(*joined, k)] for x in joined)
            n = np.bincount(best[0], minlength=len(kth))
            last = np.cumsum(n) - 1  # best is in order of query and score
            kth = np.where(n == k, np.maximum(kth, best[2][last.clip(0)]), kth)
    return best


def scan_page(block: Queries, page: dict, width: int, k: int, same: bool) -> tuple[list[int], list[int], list[int]]:
    """The same in whole numbers, without pruning, for sums that doubles don't hold."""
    rows = list(zip(np.frombuffer(page["ids"], "<i8").tolist(), np.frombuffer(page["labels"], "<i8").tolist(), np.frombuffer(page["vectors"], "<f8").reshape(-1, width).tolist(), strict=True))
    found = []
    for q, (own, label, low, high, vector) in enumerate(zip(block.own.tolist(), block.label.tolist(), block.low.tolist(), block.high.tolist(), block.vectors.tolist(), strict=True)):
        scores = ((min(MOST, max(LEAST, sum(int(x) * int(y) for x, y in zip(vector, v, strict=True)))), i) for i, kind, v in rows if i != own and (kind == label) == same)
        found += [(q, -i, s) for s, i in heapq.nlargest(k, ((s, -i) for s, i in scores if low <= s <= high))]
    return tuple(list(c) for c in zip(*found, strict=True)) if found else ([], [], [])


def visit(blocks: DataFrame, tree: Tree, k: int, same: bool, first: bool) -> DataFrame:
    """query, id, score: what the blocks (block, rows) find in their first regions, or in all others."""
    width, exact, lo, hi, labels = tree.width, tree.exact, tree.lo, tree.hi, tree.labels

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                block = Queries(batch.column(0)[at].values, width, exact)
                bound = block.able(lo, hi, labels[:, 0], labels[:, 1], same)
                best = np.where(bound.max(axis=1) > -np.inf, bound.argmax(axis=1), -1)
                start = np.zeros(len(lo), bool)
                start[best[best >= 0]] = True
                go = start if first else ~start & ((bound > -np.inf) & (bound >= block.floor[:, None])).any(axis=0)
                regions = np.flatnonzero(go).astype(np.int32)
                if len(regions):
                    yield pa.record_batch([pa.array(regions), batch.column(0).take(pa.array(np.full(len(regions), at)))], names=["region", "rows"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.drop_columns(["rows"])
            for at in range(len(batch)):
                block = Queries(batch.column("rows")[at].values, width, exact)
                query, ids, scores = (search_page if exact else scan_page)(block, pages.slice(at, 1).to_pylist()[0], width, k, same)
                columns = block.query[np.asarray(query, np.int64)], np.asarray(ids, np.int64), np.asarray(scores).astype(np.int64)
                yield pa.record_batch([pa.array(c) for c in columns], names=["query", "id", "score"])

    rows_type = dict(blocks.dtypes)["rows"]
    bounded_batches(blocks.sparkSession)
    routed = blocks.select("rows").mapInArrow(route, f"region int, rows {rows_type}")
    pages = tree.pages.select("region", "ids", "labels", "vectors", "starts").hint("merge")  # files are a fraction of what they hold, so never sent to all
    met = routed.join(pages, "region").drop("region")
    return met.mapInArrow(find, "query long, id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def search(queries: DataFrame, tree: Tree, k: int, same: bool) -> DataFrame:
    """query, id, score, place: the k best rows of each query (query, own, label, vector, low, high), in its window; stored.

    same: of the query's own label, else of any other.
    """
    order = ["label", *(["key"] if tree.width else []), "query"]
    keyed = queries.withColumn("key", F.get("vector", F.lit(0)))
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    parts = F.shiftleft(F.shiftright("_at", 33), 33) + F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / BLOCK)
    stored = materialize(ranged.withColumn("block", parts).drop("key", "_at"))

    def blocks(rows: DataFrame) -> DataFrame:
        one = F.struct("query", "own", "label", "low", "high", "floor", "vector")
        return rows.groupBy("block").agg(F.sort_array(F.collect_list(one)).alias("rows"))  # BLOCK rows at most

    nothing = F.lit(float("-inf"))
    near = materialize(best_of(visit(blocks(stored.withColumn("floor", nothing)), tree, k, same, True), k).drop("place"))
    floors = near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth")).where(F.col("n") == k)
    floored = stored.join(floors.select("query", "kth"), "query", "left").withColumn("floor", F.coalesce("kth", nothing)).drop("kth")
    out = materialize(best_of(near.unionByName(visit(blocks(floored), tree, k, same, False)), k))
    discard(near, stored)
    return out


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT, scale: float = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: id, label, anchor, vector.

    A negative's score lies from low to high percent of the positive's. Components are scaled and floored first.
    """
    own = materialize(usable(rows, scale))
    each = own.select(F.posexplode("vector").alias("axis", "x"))
    facts = each.groupBy("axis").agg((F.max("x") - F.min("x")).alias("range"), F.max(F.abs("x")).alias("most")).orderBy(F.col("range").desc(), "axis").collect()  # a row a component
    width, largest = len(facts), max((f["most"] for f in facts), default=0.0)
    exact = width * largest * largest < float(1 << 53)
    padded = own.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector"))))
    tree = Tree(padded, width, facts[0]["axis"] if facts else 0, exact)

    anchors = padded.where("anchor").select(F.col("id").alias("own"), "label", "vector")
    whole = {"low": F.lit(LEAST), "high": F.lit(MOST)}
    found = search(anchors.withColumn("query", F.col("own")).withColumns(whole), tree, positives, True)
    found = found.select(F.col("query").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * percent / 100
    windows = found.select("anchor_id", "positive_score").distinct()
    windows = windows.withColumns({"low": F.ceil(share(low)).cast("long"), "high": F.floor(share(high)).cast("long")}).where(F.col("low") <= F.col("high"))
    asked = materialize(windows.join(anchors, F.col("anchor_id") == F.col("own")).drop("own").withColumn("query", F.monotonically_increasing_id()))
    wrong = search(asked.select("query", F.col("anchor_id").alias("own"), "label", "vector", "low", "high"), tree, negatives, False)
    named = asked.select("query", "anchor_id", "positive_score").join(wrong, "query")
    out = materialize(found.join(named, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    discard(own, tree.stored, asked, found, wrong)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").select(
        i.cast("long").alias("id"), F.when(i % 7 == 0, (label + 1) % 10).otherwise(label).cast("long").alias("label"), (i % 50 == 0).alias("anchor"), F.col("embedding").alias("vector"),
    )
    return mine(rows)
