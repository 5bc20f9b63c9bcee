"""What the operators share: reading tables, shared storage for cut lineage, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts define words: maximal runs of anything else.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of about BATCH_BYTES, however long texts are, unless the session has a setting of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the folder that the driver and all executors share.

    That is spark.checkpoint.dir, or the checkpoint folder that the application has set. Only where neither is there and
    the master is this machine alone, as in tests, a local folder is made and set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="foliant-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/foliant-{uuid.uuid4().hex}"


def on_disk(spark: SparkSession, folder: str):
    """(file system, path) of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    What is not discarded earlier is deleted when the application ends.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    files, folder = on_disk(df.sparkSession, path)
    files.deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing still to be computed reads."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            files, path = on_disk(df.sparkSession, folder)
            files.delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash128(col: Column) -> list[Column]:
    """Two 64-bit hashes with unlike seeds: equal texts agree, unlike texts collide about once in 2**128."""
    return [F.xxhash64(col), F.xxhash64(F.lit(1), col)]


def sum_before(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, bucket: Column) -> DataFrame:
    """Exclusive running sum of value within keys (which hold no nulls), by (bucket, order), without one task per key.

    Rows of a key are dealt into buckets; the window runs inside (key, bucket), and a second window over the
    bucket totals (at most as many rows a key as there are buckets) gives each bucket its base. The join with the
    bases and the window deal rows by the same columns, so rows move once.
    """
    parts = [*keys, "_bucket"]
    inner = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    dealt = df.withColumn("_bucket", bucket)
    bases = dealt.groupBy(*parts).agg(F.sum(value).alias("_total")).withColumn("_base", F.coalesce(F.sum("_total").over(over), F.lit(0)))
    return (
        dealt.join(bases.drop("_total"), parts)
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_bucket", "_base")
    )


def numbered(stored: DataFrame, at: str, out: str) -> DataFrame:
    """Stored rows with their place from 1, by a column that monotonically_increasing_id() has made before they were stored.

    The sizes of the parts, one row a task, are summed up and sent to all of them.
    """
    parted = stored.withColumn("_part", F.shiftright(at, 33))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parted.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    place = F.col("_base") + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return parted.join(F.broadcast(bases), "_part").withColumn(out, place).drop(at, "_part", "_base")


def place_in_order(rows: DataFrame, order: tuple[str, ...], out: str) -> DataFrame:
    """Rows with their place from 1 in the order of the given columns, which tells all rows apart; each task sorts a range."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return numbered(materialize(ranged.withColumn("_at", F.monotonically_increasing_id())), "_at", out)
