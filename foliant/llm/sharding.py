"""Sharding: balanced label propagation. DataFrame functions only.

Documents with equal texts are linked. Each starts in a shard by hash. In each round, the linked documents of a
group are counted by shard (one row for each group and shard), a group's documents want the shard with room where
most of their neighbours are, and moves are admitted, by hash, at the rate that the quota of that shard allows. No
pair of documents is ever formed. At the end unlinked documents fill the gaps, so that shards differ by one row at most:
the law is `rows`. Where those don't suffice, linked ones move, of small groups first and such groups whole, since a
document takes as many cut edges along as its group has members.

A group larger than a shard's quota is dealt into parts that fit, by hash of the id, and each part is one group.
Slots are running counts made in hash buckets with a second sum over bucket totals. What comes to the driver is one
count a shard, 40 numbers.

Defined results: a null text has size 16, no links and a null text_crc32; empty texts are equal to each other;
repeated rows are placed each by itself; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hash128, materialize, sum_before, table

SHARDS = 40
ROUNDS = 5
#: While labels move, a shard may hold linked rows up to the mean of all rows, or, where most rows are linked, up to
#: the mean of linked rows and this share of it. Unlinked rows fill up the rest at the end.
SLACK = 0.1
#: A group of more than this share of a shard is dealt into parts.
PART_OF_MEAN = 0.95
BUCKETS = 256
#: Groups are told apart by the powers of two in their sizes, up to this; those of up to WHOLE documents stay in one bucket.
TIERS, WHOLE = 40, 64


def narrow(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the hashes by which texts are equal."""
    text = F.col("text")
    a, b = hash128(text)
    return documents.select(
        F.col("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), a).alias("_a"), F.when(text.isNotNull(), b).alias("_b"),
    )


def share(*seed) -> F.Column:
    """An even number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*seed), F.lit(1 << 30)) / F.lit(float(1 << 30))


def propagate(linked: DataFrame, quota: float, rounds: int, shards: int) -> DataFrame:
    """Moves linked rows (with _group and shard) towards their group's shard, round by round, under a quota of linked rows."""
    superseded: list[DataFrame] = []
    for turn in range(rounds):
        tally = linked.groupBy("_group", "shard").agg(F.count("*").alias("n"))
        load = [0] * shards
        for r in tally.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row a shard
            load[r["shard"]] = r["n"]
        room = F.element_at(F.array(*[F.lit(n < quota) for n in load]), F.col("shard") + 1)
        wish = tally.where(room).groupBy("_group").agg(F.max_by("shard", F.struct("n", F.xxhash64(F.lit(turn), "_group", "shard"))).alias("wanted"))
        flows = tally.join(wish, "_group").where(F.col("shard") != F.col("wanted")).groupBy("shard", "wanted").agg(F.sum("n").alias("n"))
        arrive, leave = [0] * shards, [0] * shards
        for f in flows.collect():  # shards ** 2 rows at most
            arrive[f["wanted"]] += f["n"]
            leave[f["shard"]] += f["n"]
        if not sum(arrive):
            break
        rates = [min(1.0, max(0.0, (quota - load[s] + leave[s]) / arrive[s])) if arrive[s] else 0.0 for s in range(shards)]
        rate = F.element_at(F.array(*map(F.lit, rates)), F.col("wanted") + 1)
        stay = F.col("wanted").isNull()  # no shard with room holds any of the group
        moved = F.when(stay, F.col("shard")).when(share(F.lit(turn), F.col("_group")) < rate, F.col("wanted")).otherwise(F.col("shard"))
        linked = materialize(linked.join(wish, "_group", "left").withColumn("shard", moved).drop("wanted"))
        discard(*superseded)
        superseded = [linked]
    return linked


def level(rows: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Adds slot and moves surplus rows, unlinked ones first, then those of small groups, so that counts differ by one at most.

    rows: doc_id, size, text_crc32, shard, _group, _of (the documents of the group; both null without links).
    """
    tier = F.when(F.col("_of").isNull(), TIERS + 1).otherwise(TIERS - F.least(F.lit(TIERS), F.floor(F.log2("_of"))))
    drawn = F.when(F.col("_of") <= WHOLE, F.xxhash64("_group")).otherwise(F.xxhash64("doc_id", "text_crc32"))
    bucket = tier * buckets + F.pmod(drawn, F.lit(buckets))
    order = [drawn, F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_crc32")]
    ranked = sum_before(rows.withColumn("_one", F.lit(1)), ["shard"], order, "_one", "_rank", bucket.cast("int"))
    ranked = materialize(ranked)
    counts = [0] * shards
    for r in ranked.groupBy("shard").count().collect():  # one row a shard
        counts[r["shard"]] = r["count"]
    total = sum(counts)
    goals = [total // shards + (s < total % shards) for s in range(shards)]
    goal = F.element_at(F.array(*[F.lit(g).cast("long") for g in goals]), F.col("shard") + 1)
    stay = ranked.where(F.col("_rank") < goal).withColumn("slot", F.col("_rank"))
    # The e-th surplus row, in order of (shard, rank), takes the e-th free slot, in order of shard.
    surplus_before, free, at = [], [], 0
    for s in range(shards):
        surplus_before.append(at)
        at += max(0, counts[s] - goals[s])
    at = 0
    for s in range(shards):
        if counts[s] < goals[s]:
            free.append((at, s, counts[s]))
            at += goals[s] - counts[s]
    if not free:
        return stay
    nth = F.element_at(F.array(*[F.lit(x).cast("long") for x in surplus_before]), F.col("shard") + 1) + F.col("_rank") - goal
    gaps = F.array(*[F.struct(F.lit(a).cast("long").alias("at"), F.lit(s).alias("shard"), F.lit(c).cast("long").alias("count")) for a, s, c in free])
    gap = F.element_at(F.filter(gaps, lambda g: g["at"] <= F.col("_nth")), -1)
    move = ranked.where(F.col("_rank") >= goal).withColumn("_nth", nth).withColumn("_gap", gap)
    move = move.withColumn("shard", F.col("_gap.shard")).withColumn("slot", F.col("_gap.count") + F.col("_nth") - F.col("_gap.at"))
    return stay.unionByName(move.drop("_nth", "_gap"))


def shard(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK, part_of_mean: float = PART_OF_MEAN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = materialize(narrow(documents).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int")))
    mean = rows.count() / shards
    groups = rows.where(F.col("_a").isNotNull()).groupBy("_a", "_b").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    groups = materialize(groups)  # a plain table, so that Spark can split the partition of a hot group in the join
    tagged = rows.join(groups.withColumnsRenamed({"_a": "_ga", "_b": "_gb"}), (F.col("_a") == F.col("_ga")) & (F.col("_b") == F.col("_gb")), "left")
    parts = F.ceil(F.col("_n") / F.lit(max(1.0, part_of_mean * mean)))
    part = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), parts)
    tagged = tagged.withColumns({"_group": F.when(F.col("_n").isNotNull(), F.xxhash64("_a", "_b", part)), "_of": F.ceil(F.col("_n") / parts)})
    tagged = materialize(tagged.select("doc_id", "size", "text_crc32", "shard", "_group", "_of"))
    discard(rows, groups)
    linked, alone = tagged.where(F.col("_group").isNotNull()), tagged.where(F.col("_group").isNull())
    quota = max(mean, (1 + slack) * linked.count() / shards)
    placed = level(propagate(linked, quota, rounds, shards).unionByName(alone), shards, buckets)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
