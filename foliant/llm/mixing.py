"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only.

Each source has a target (its share of all words, at most three passes) and a weight schedule over training
time 0..1: a line through knots, integrated and scaled so that its area is the target. A source's words are laid
end to end in a hashed order, pass after pass; a copy of a document that lies (for at least half its words) before
the target is taken. Inverting the integrated schedule at the copy's middle gives its training position, and
documents are range-sorted by position.

Running sums inside a source are made in hash buckets with a second sum over the bucket totals, so a source that
holds a third of all rows is still spread over as many tasks as there are buckets. The table of sources (one row
each) is ranked in one window; it has a row a source, not a row a document.

Defined results: a null text has size 0, a null source is a source of its own and comes last; documents of size 0
take no words; repeated rows are taken each by itself (ties are broken by id, size and text hash); an empty table
gives no rows; a source with no words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, sum_before, table

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
#: Knots (time, weight) for the sources of each weight: the first is even, the second fades out, the third fades in.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 3.0), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 3.0)))
BUCKETS = 1024


def measured(documents: DataFrame) -> DataFrame:
    """Adds _size (words) and the hashed order of documents inside their source: _key, _tie."""
    return documents.withColumns({
        "_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "_key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
        "_tie": F.coalesce(F.xxhash64("text"), F.lit(0)),
    })


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, _source_size, _target, _kind: shares by weight, capped at most times a source's size.

    With sources sorted by size / weight, those capped are a prefix; the rest share what is left by weight. The
    first source that its share doesn't cap, given the prefix before it, ends that prefix.
    """
    sources = rows.groupBy("source").agg(F.sum("_size").alias("_source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_kind", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), F.col("_kind") + 1))
    filled = Window.orderBy(F.col("_source_size") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, everything = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("_source_size").over(everything) - most * F.coalesce(F.sum("_source_size").over(before), F.lit(0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    level = ranked.withColumn("_level", left / weight_left)
    open_level = F.when(F.col("_level") * F.col("_weight") <= most * F.col("_source_size"), F.col("_level"))
    level = level.withColumn("_final", F.first(open_level, ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    capped = (most * F.col("_source_size")).cast("double")
    target = F.coalesce(F.least(capped, F.col("_final") * F.col("_weight")), capped)
    return level.select("source", "_source_size", target.alias("_target"), "_kind")


def position(share: Column, knots: Column) -> Column:
    """The time by which a share (0..1) of the schedule's area has passed; knots has t, w and area before, in order."""
    at = F.greatest(F.lit(1), F.least(F.size(knots) - 1, F.size(F.filter(knots, lambda k: k["area"] <= share))))
    a, b = F.element_at(knots, at), F.element_at(knots, at + 1)
    slope, rest = (b["w"] - a["w"]) / (b["t"] - a["t"]), share - a["area"]
    step = 2 * rest / (a["w"] + F.sqrt(F.greatest(F.lit(0.0), a["w"] * a["w"] + 2 * slope * rest)))
    return F.least(F.lit(1.0), a["t"] + F.coalesce(step, F.lit(0.0)))


def integrated(knots: tuple[tuple[float, float], ...]) -> Column:
    """Knots with the area before each, scaled to an area of 1."""
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (t1 - t0) * (w0 + w1) / 2)
    rows = [F.struct(F.lit(t).alias("t"), F.lit(w / areas[-1]).alias("w"), F.lit(a / areas[-1]).alias("area")) for (t, w), a in zip(knots, areas, strict=True)]
    return F.array(*rows)


def assign(rows: DataFrame, schedules=SCHEDULES, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, buckets: int = BUCKETS) -> DataFrame:
    """Adds to measured rows: _source_size, _target, and _positions, the training positions of the copies taken.

    Broadcast by choice of Spark alone: the table of sources is joined without a hint.
    """
    # Stored first, so that its size is known before the rows would be dealt for the join.
    goals = materialize(targets(rows, weights, most)).withColumnRenamed("source", "_goal_source")
    joined = rows.join(goals, F.col("source").eqNullSafe(F.col("_goal_source"))).drop("_goal_source")
    joined = joined.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))  # never null, so that it can be dealt by
    bucket = F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    laid = sum_before(joined, ["_source"], [F.col("_key"), F.col("doc_id"), F.col("_size"), F.col("_tie")], "_size", "_before", bucket)
    starts = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: i * F.col("_source_size") + F.col("_before"))
    taken = F.filter(starts, lambda x: 2 * x + F.col("_size") <= 2 * F.col("_target"))
    knots = F.element_at(F.array(*[integrated(k) for k in schedules]), F.col("_kind") + 1)
    middle = F.transform(F.col("_taken"), lambda x: F.coalesce(F.try_divide(x + F.col("_size") / 2, F.col("_target")), F.lit(0.0)))
    return (
        laid.withColumns({"_taken": taken, "_knots": knots})
        .withColumn("_positions", F.transform(middle, lambda s: position(s, F.col("_knots"))))
        .drop("_taken", "_knots", "_before", "_source")
    )


def mix(documents: DataFrame, **options) -> DataFrame:
    """The documents' own columns, a row for each copy taken, range-sorted by training position."""
    rows = documents.select("doc_id", "source", "text", F.struct("*").alias("_row"))  # as one value, so that no name clashes
    copies = assign(measured(rows).drop("text"), **options).select("doc_id", "_row", F.explode("_positions").alias("_position"))
    order = ["_position", F.xxhash64("doc_id")]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select("_row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = materialize(measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    return (
        assign(narrow)
        .select(
            "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
            (F.col("_size") * F.size("_positions")).alias("taken"),
            *[F.round(F.try_element_at("_positions", F.lit(i)), 6).alias(name) for i, name in enumerate(("position", "second_position", "third_position"), 1)],
        )
        .orderBy("position", "doc_id")
    )
