"""Search for a part of a text by trigrams: a table of which rows hold which three characters, read for the rarest alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import search_claims

SIZE, BUCKETS = 3, 256
#: Rows that may match up to which their ids go to the scan of the claims as a filter; beyond, they are joined.
MOST_IDS = 1000


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text, in small letters; none for shorter texts and null."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= SIZE, F.sequence(F.lit(1), F.length(low) - (SIZE - 1)))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(low, i, F.lit(SIZE))))


class TrigramIndex:
    """Postings (gram, claim_id) in folders by a hash of the gram, and each gram's number of postings.

    A search reads the numbers of its query's grams, then the postings of the rarest, which hold every match; the texts of
    those rows then decide. Queries of under three characters scan. The index says nothing of statuses, so it stays right
    when they change; new claims are added by another call of add.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def add(self, claims: DataFrame) -> None:
        """Claims that the index doesn't hold yet. A gram that most claims hold is written by many tasks."""
        every = F.array_union(grams(F.col("claim_id").cast("string")), grams(F.col("file_no")))
        rows = claims.select("claim_id", F.explode(every).alias("gram")).withColumn("bucket", self._bucket(F.col("gram")))
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("claim_id"), F.lit(4))).sortWithinPartitions("bucket", "gram")
        dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        counts = rows.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/counts")

    def _of(self, table: str, names: list[str]) -> DataFrame:
        """Rows of some grams; the folders of other buckets are not read."""
        buckets = [r[0] for r in self.spark.createDataFrame([(n,) for n in names], "gram string").select(self._bucket(F.col("gram"))).distinct().collect()]
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("bucket").isin(buckets) & F.col("gram").isin(names))

    def candidates(self, query: str) -> DataFrame | None:
        """claim_id of rows that may match; None for a query that is too short to tell."""
        wanted = query.strip().lower()
        if len(wanted) < SIZE:
            return None
        names = sorted({wanted[i : i + SIZE] for i in range(len(wanted) - SIZE + 1)})
        found = dict(self._of("counts", names).groupBy("gram").agg(F.sum("n")).collect())  # a row a gram of the query
        rarest = min(names, key=lambda n: (found.get(n, 0), n))
        return self._of("postings", [rarest]).select("claim_id").distinct()

    def search(self, claims: DataFrame, query: str, status: str = "all") -> DataFrame:
        """The rows that search_claims gives."""
        may = self.candidates(query)
        if may is None:
            return search_claims(claims, query, status)
        few = [r[0] for r in may.limit(MOST_IDS + 1).collect()]
        some = claims.where(F.col("claim_id").isin(few)) if len(few) <= MOST_IDS else claims.join(may, "claim_id", "left_semi")
        return search_claims(some, query, status)
