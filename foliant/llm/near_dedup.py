"""MinHash near-dedup: universal hash minima, banding, verification, large-star and small-star components.

1. Each text becomes the set of its word shingles (64-bit hashes). Texts with equal sets form a class, so copies cost
   one row whatever their number.
2. A class's minima are cut into bands; classes that agree in a band share a bucket. The number of bands is such
   that a pair at the threshold misses all of them less than once in a million.
3. Each bucket has a leader: the class in the most and fullest buckets, which in a family of edited copies is the
   original. Every member is compared with its leader on full sets. A leader with many members is dealt into
   parts, each with its own copy of the leader's set.
4. Buckets whose members are still in unlike components are open, and are settled without forming their pairs:
   - A small one (BLOCK classes at most) is judged whole by one task.
   - In a larger one, LEADERS further classes, those outside the largest component first, are compared with all
     members, then taken out, round by round until it is settled or small. A round is as many rows as members.
   - One with more than WIDE members outside its largest component first goes apart by further, longer bands, with the
     same chance of a miss.
   So no pair within a bucket goes unjudged unless both are known to be connected, and no pair is emitted unless it
   is a link. Sets are compared where signatures agree in at least the threshold less six standard deviations, which
   loses a link less than once in 100 million.
5. Links become components by alternating large-star and small-star, which never gathers a node's neighbours.

Only candidates' texts are shuffled and only their sets are stored. Intermediate tables lie in the shared folder.

Defined results: a null or empty text, or one without words, has size 0 and is a component of its own; fewer words
than a shingle are one shingle; rows that repeat an id with an equal text are one document, and with another text
are judged each by its own text; a null id has a null component and is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, table
from .shingles import OTHER, MinHash, mix, shingle_set, word_hashes

#: Minima of a band, and of the longer bands that take wide buckets apart.
ROWS, LONG_ROWS = 5, 10
MISS = 1e-6
#: Classes of a bucket that one task judges, and shingles that they have together at most.
BLOCK, BLOCK_SHINGLES = 128, 1 << 22
#: Classes with which all members of a larger bucket are compared in a round, and members that one task compares. Spark
#: limits the groups of a window before it deals them out if at most 1,000 rows of each are wanted; beyond, one task orders all.
LEADERS, PART = 1000, 256
#: Members outside the largest component beyond which a bucket is taken apart before its rounds.
WIDE = 4 * LEADERS


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that a pair at the threshold shares none with a chance below miss."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sets_of(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    yield from (shingle_set(w, n) for w in word_hashes([(t or "").encode() for t in texts.to_pylist()]))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def whole_hash(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    return int(mix(shingles).sum().view(np.int64)), int(mix(shingles ^ OTHER).sum().view(np.int64))


def signed(documents: DataFrame, n: int, hashes: MinHash) -> DataFrame:
    """doc_id, text_hash, n_shingles, two hashes of the whole set, and the band keys (none for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(sets_of(batch.column(2), n))
            full = [s for s in sets if len(s)]
            keys = iter(hashes.band_keys(hashes.signatures(full))) if full else iter(())
            sums = [whole_hash(s) for s in sets]
            bands = pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in sums], pa.int64()), pa.array([x[1] for x in sums], pa.int64()), bands],
                names=["doc_id", "text_hash", "n_shingles", "a", "b", "bands"],
            )

    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, a long, b long, bands array<long>")


def stored_sets(documents: DataFrame, classes: DataFrame, n: int, hashes: MinHash) -> DataFrame:
    """node, set (sorted distinct 64-bit hashes as bytes), sign (its minima) of the given classes: node, first, text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if len(batch):
                sets = list(sets_of(batch.column(1), n))
                signs = pa.array([x.tobytes() for x in hashes.signatures(sets)], pa.binary())
                yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), signs], names=["node", "set", "sign"])

    texts = documents.select(F.col("doc_id").cast("long").alias("first"), F.xxhash64("text").alias("text_hash"), "text")
    chosen = texts.join(classes.select("node", "first", "text_hash"), ["first", "text_hash"]).select("node", "text")
    return materialize(chosen.mapInArrow(run, "node long, set binary, sign binary").dropDuplicates(["node"]))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def emit(links: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    found = list(links)
    yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])


def star_links(pairs: DataFrame, sets: DataFrame, percent: int, part_rows: int = 2000) -> DataFrame:
    """u, v: the pairs (leader, member) that are links. Sorted streams: one leader's set and one member's at a time."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / part_rows).alias("parts"))
    dealt = pairs.join(sizes, "leader").select("leader", "member", F.pmod(F.xxhash64("member"), F.col("parts")).alias("part"))
    members = dealt.join(sets.withColumnsRenamed({"node": "member"}), "member").select("leader", "part", F.lit(1).alias("side"), F.col("member").alias("id"), "set")
    leaders = dealt.select("leader", "part").distinct().join(sets.withColumnsRenamed({"node": "leader"}), "leader").select("leader", "part", F.lit(0).alias("side"), F.col("leader").alias("id"), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            leader, own = None, None
            for _, _, side, node, raw in rows_of(batches):
                held = np.frombuffer(raw, np.uint64)
                if side == 0:
                    leader, own = node, held
                elif linked(own, held, percent):
                    yield node, leader

        yield from emit(links())

    blocks = members.unionByName(leaders).repartition("leader", "part").sortWithinPartitions("leader", "part", "side")
    return blocks.mapInArrow(run, "u long, v long")


def least_agreement(percent: int, hashes: MinHash) -> float:
    """The share of equal minima below which a pair is no link but for a chance of six standard deviations."""
    p = percent / 100
    return p - 6 * math.sqrt(p * (1 - p) / len(hashes.a))


def block_links(members: DataFrame, sets: DataFrame, percent: int, hashes: MinHash) -> DataFrame:
    """u, v: links that join unlike components, among the members (key, node, comp) of each bucket. One task a bucket."""
    floor = least_agreement(percent, hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            for _, group in groupby(rows_of(batches), key=lambda r: r[0]):
                rows = list(group)
                signs, comps, root = np.array([np.frombuffer(r[4], np.uint32) for r in rows]), [r[2] for r in rows], {}

                def find(c: int, root: dict[int, int] = root) -> int:
                    while c in root:
                        c = root[c]
                    return c

                for x, row in enumerate(rows):
                    agree = (signs[x + 1 :] == signs[x]).mean(axis=1)
                    for y in np.flatnonzero(agree >= floor) + x + 1:
                        a, b = find(comps[x]), find(comps[y])
                        if a != b and linked(np.frombuffer(row[3], np.uint64), np.frombuffer(rows[y][3], np.uint64), percent):
                            root[max(a, b)] = min(a, b)
                            yield row[1], rows[y][1]

        yield from emit(links())

    ordered = members.select("key", "node", "comp").join(sets, "node").select("key", "node", "comp", "set", "sign").repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(run, "u long, v long")


def leader_links(members: DataFrame, leaders: DataFrame, sets: DataFrame, percent: int, hashes: MinHash, part_rows: int | None = None) -> DataFrame:
    """u, v: links between the members (key, node, comp, n) of each bucket and its leaders (key, node) of unlike components.

    Members are dealt into parts; each part gets the leaders' sets, then one member's at a time.
    """
    floor = least_agreement(percent, hashes)
    parts = F.ceil(F.col("n") / (part_rows or PART))
    own = members.select("key", "node", "comp", F.pmod(F.xxhash64("node"), parts).alias("part"), F.lit(1).alias("side"))
    first = members.join(leaders, ["key", "node"], "left_semi")
    first = first.select("key", "node", "comp", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(0).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            for _, group in groupby(rows_of(batches), key=lambda r: r[:2]):
                lead, signs = [], None
                for _, _, side, node, comp, raw, sign in group:
                    minima = np.frombuffer(sign, np.uint32)
                    if side == 0:
                        lead.append((node, comp, raw, minima))
                        continue
                    signs = np.array([x[3] for x in lead]) if signs is None else signs
                    for at in np.flatnonzero((signs == minima).mean(axis=1) >= floor):
                        other, its, theirs, _ = lead[at]
                        if its != comp and linked(np.frombuffer(raw, np.uint64), np.frombuffer(theirs, np.uint64), percent):
                            yield node, other

        yield from emit(links())

    both = own.unionByName(first).join(sets, "node").select("key", "part", "side", "node", "comp", "set", "sign")
    return both.repartition("key", "part").sortWithinPartitions("key", "part", "side").mapInArrow(run, "u long, v long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, comp (the smallest node of its component) for every node of a link, by large-star and small-star."""
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct())
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, edges = edges, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct())
        discard(done)
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def finer(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, node: the nodes' buckets by bands of LONG_ROWS fresh minima."""
    hashes = MinHash(bands_for(percent, LONG_ROWS), LONG_ROWS, seed=1709)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            if len(batch):
                keys = hashes.band_keys(hashes.signatures([np.frombuffer(raw, np.uint64) for raw in batch.column(1).to_pylist()]))
                cells = [pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))]
                yield pa.record_batch(cells, names=["key", "node"])

    return sets.join(nodes, "node", "left_semi").select("node", "set").repartition("node").mapInArrow(run, "key long, node long")


def open_members(buckets: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, node, comp, n, main, shingles, outside: the members of the buckets (key, node) that are in unlike components.

    n members, main the largest component, outside the members not in it, shingles all that the members have. Of
    buckets with the same members one stays.
    """
    placed = materialize(buckets.select("key", "node").join(found, "node", "left").join(sizes, "node").select("key", "node", F.coalesce("comp", "node").alias("comp"), "size"))
    same = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same")
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"), same)
    about = by_comp.groupBy("key").agg(
        F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.sum("size").alias("shingles"), F.sum("same").alias("same"), F.count("*").alias("comps"),
    )
    about = about.where(F.col("comps") > 1).dropDuplicates(["same", "n"]).select("key", "n", "main", "shingles", (F.col("n") - F.col("most")).alias("outside"))
    about = materialize(about)  # plain tables, so that Spark can split the partition of a hot bucket in the join
    out = materialize(placed.drop("size").join(about, "key"))
    discard(placed, about)
    return out


def round_leaders(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, node: of each bucket at most LEADERS members, those outside the largest component first, of bounded sets."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("comp") == F.col("main"), F.xxhash64("node"), "node"))
    drawn = members.withColumn("place", place).where(F.col("place") <= LEADERS).join(sizes, "node")
    held = F.sum("size").over(Window.partitionBy("key").orderBy("place"))
    return drawn.withColumn("held", held).where((F.col("place") == 1) | (F.col("held") <= BLOCK_SHINGLES)).select("key", "node")


def settle(buckets: DataFrame, links: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, hashes: MinHash) -> DataFrame:
    """node, comp, when the members of no bucket (key, node) hold a link that the components don't know. links: u, v."""
    found, own, longer = materialize(components(links)), [], False
    small = (F.col("n") <= BLOCK) & (F.col("shingles") <= BLOCK_SHINGLES)
    while True:
        members = open_members(buckets, found, sizes)
        if members.isEmpty():
            discard(members, *own)
            return found
        large = members.where(~small)
        turn = large if longer else large.where(F.col("outside") <= WIDE)
        leaders = materialize(round_leaders(turn, sizes))
        more = materialize(block_links(members.where(small), sets, percent, hashes).unionByName(leader_links(turn, leaders, sets, percent, hashes)))
        left = turn.select("key", "node").join(leaders, ["key", "node"], "left_anti")
        wide = large.where(F.col("outside") > WIDE).select("node").distinct()
        if not longer and not wide.isEmpty():
            left, longer = left.unionByName(finer(wide, sets, percent)), True
        buckets, grown = materialize(left), materialize(links.unionByName(more))
        discard(members, leaders, more, found, *own)
        links, own = grown, [grown, buckets]
        found = materialize(components(links))


def judged(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept: a row for each document."""
    hashes = MinHash(bands_for(percent), ROWS)
    rows = materialize(signed(documents, words, hashes))
    full = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # The classes have numbers of their own, since rows with one id can have unlike texts; stored, so that numbers stay.
    classes = full.groupBy("a", "b", "n_shingles").agg(F.min(F.struct(F.col("doc_id").alias("first"), "text_hash")).alias("row"), F.any_value("bands").alias("bands"))
    classes = materialize(classes.select("a", "b", "n_shingles", "row.*", "bands", F.monotonically_increasing_id().alias("node")))
    # What is joined by key is stored first: between plain tables, Spark can split the partition of a hot bucket.
    spread = classes.select("node", F.explode("bands").alias("key"))
    shared = materialize(spread.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    buckets = materialize(spread.join(shared, "key"))
    rank = materialize(buckets.groupBy("node").agg(F.sum("n").alias("rank")).join(classes.select("node", "first"), "node"))
    leaders = materialize(buckets.join(rank, "node").groupBy("key").agg(F.max_by("node", F.struct("rank", -F.col("first"), "node")).alias("leader")))
    members = materialize(buckets.join(leaders, "key").where(F.col("node") != F.col("leader")))
    pairs = members.select("leader", F.col("node").alias("member")).distinct()
    nodes = rank.select("node").join(classes, "node")
    sets = stored_sets(documents, nodes, words, hashes)
    stars = materialize(star_links(pairs, sets.select("node", "set"), percent))
    sizes = materialize(nodes.select("node", F.col("n_shingles").alias("size")))
    found = settle(members.where(F.col("n") > 2).select("key", "node"), stars, sizes, sets, percent, hashes)
    discard(shared, buckets, rank, leaders, members, sets, stars, sizes)

    least = materialize(found.join(classes.select("node", "first"), "node").groupBy("comp").agg(F.min("first").alias("least")))
    named = materialize(classes.join(found.join(least, "comp"), "node", "left").select("a", "b", "n_shingles", F.coalesce("least", "first").alias("least")))
    discard(found, least, classes)
    joined = rows.drop("bands").join(named, ["a", "b", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each document."""
    return judged(documents, words, percent).drop("text_hash")


def without_near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of which the document is the one kept of its group, with all their columns."""
    gone = judged(documents.select("doc_id", "text"), words, percent).where(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    # By id and text: a row that shares its id with a copy, but not its text, stays.
    return documents.join(gone, (documents["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(documents["text"]) == gone["_hash"]), "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
