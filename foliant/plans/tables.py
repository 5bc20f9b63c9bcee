"""The driver tables in the shapes that the operators take. Everything is derived by Spark from the given rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("uploaded")
    number = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        number.alias("claim_id"), F.concat(F.lit("FN-"), F.col("o_custkey").cast("string")).alias("file_no"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as documents of their order."""
    line = F.col("l_linenumber").cast("string")
    name = F.concat(F.col("l_linestatus"), F.lit("_"), F.lpad(line, 3, "0"), F.lit(".json"))
    entities = F.array(
        F.struct(F.lit("Claim No.").alias("key"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("C"), F.col("l_partkey").cast("string"))).otherwise("Not Available").alias("value")),
        F.struct(F.lit("insured-name").alias("key"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("value")),
        F.struct(F.lit("name").alias("key"), F.concat(F.lit("N"), F.col("l_suppkey").cast("string")).alias("value")),
        F.struct(F.lit("Hospital").alias("key"), F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")).alias("value")),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("claim_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linestatus").alias("document_type"),
        name.alias("source_file_name"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_linenumber")).alias("sequence"), F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_returnflag") == "R", "completed").otherwise("processing").alias("status"), entities.alias("entities"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image metrics from line items, so that every bracket is met."""
    q, p, k = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("page_number"), (q * 6).alias("blur"), (q / 3).alias("edge"), (k % 70).cast("double").alias("contrast"),
        (k % 220).cast("double").alias("histogram_range"), (q * 5).alias("brightness"), (k % 9).cast("double").alias("noise"), (F.lit(1000) + k % 900).cast("int").alias("height"),
        (F.lit(800) + k % 700).cast("int").alias("width"), (F.col("l_discount") * 5).alias("coverage"), (F.col("l_suppkey") % 2 == 0).alias("has_regions"),
        (k % 2500).cast("int").alias("density"), (q - 25).alias("skew"), (F.col("l_linenumber") == 7).alias("is_blank"), F.floor(p).cast("long").alias("chars"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens from events: fifty a page, placed by arithmetic on their ids."""
    i = F.col("event_id")
    x, y = (i * 37 % 600).cast("int"), (i * 53 % 700).cast("int")
    return table(spark, sf_dir, "events").select(
        F.floor(i / 50).cast("long").alias("page"), i.alias("token_id"), F.col("event_type").alias("text"), ((i % 10) / 10.0).alias("confidence"),
        x.alias("x"), y.alias("y"), (x + 20).alias("center_x"), (y + 6).alias("center_y"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes from events: ten a page."""
    i = F.col("event_id")
    x, y = (i * 37 % 120).cast("int"), (i * 53 % 100).cast("int")
    return table(spark, sf_dir, "events").select(
        F.floor(i / 10).cast("long").alias("page"), i.alias("box_id"), x.alias("x1"), y.alias("y1"), (x + 60 + i % 7 * 5).cast("int").alias("x2"), (y + 40 + i % 5 * 6).cast("int").alias("y2"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six cells for every page that has tokens."""
    pages = tokens(spark, sf_dir).select("page").distinct()
    each = pages.withColumn("cell_id", F.explode(F.sequence(F.lit(0), F.lit(5))))
    x, y = F.col("cell_id") % 2 * 300, F.floor(F.col("cell_id") / 2).cast("int") * 230
    return each.withColumns({"x1": x.cast("int"), "y1": y, "x2": (x + 300).cast("int"), "y2": (y + 230).cast("int")})


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages of a document: the role is the field, the text its value."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.col("role").alias("key"), F.col("text").alias("value"))
