"""Target-distribution importance resampling: documents drawn in the likeness of a target by hashed runs of words.

Runs of words fall into buckets by their CRC-32. A bucket's gain is the logarithm of its frequency in the target over that
in the documents, both smoothed; a document's weight is the mean gain of its runs, looked up in one array. Weight plus
Gumbel noise, a fixed hash of the id, is the score, and the highest scores are drawn without replacement.

The cutoff comes from a quantile sketch: its values around the wanted share make a bracket, exact counts of what lies
outside accept it or widen it, and only the rows inside are sorted. Documents are tokenized once; what is kept of them is
their buckets. The driver sees the counts of at most `buckets` buckets, a few quantiles and one row.

Defined results: a null or wordless text has no runs, weight 0, and is never drawn where least_words is above 0; a null id
draws its noise from the empty text and comes last among ties; rows that repeat an id tie, each is a row of its own, and
those of fewer runs, then of less weight come first; no documents give no rows; an empty target leaves every gain to
smoothing. Other columns are ignored by `scored` and kept by `draw`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, place_in_order, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All ASCII characters but digits and small letters part words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST_RUN, SEED = 10_000, 1, 2024
PERCENT, LEAST_WORDS = 10, 20
#: Of the quantile sketch: its rank error is one part in ACCURACY. A first bracket reaches twice that to either side.
ACCURACY = 10_000
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def words(text: Column) -> Column:
    """The words of a text, A-Z as a-z."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def run_buckets(words: Column, longest: int, buckets: int) -> Column:
    """The bucket of every run of 1 to `longest` consecutive words, repeats included."""

    def of_length(k: int) -> Column:
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1)))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))

    runs = words if longest == 1 else F.concat(words, *[of_length(k) for k in range(2, longest + 1)])
    return F.transform(runs, lambda r: (F.crc32(r.cast("binary")) % buckets).cast("int"))


def bucketed(rows: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """The rows' columns but text, with n_words and the buckets of their runs."""
    split = rows.withColumn("_words", words(F.col("text")))
    return split.select(*[c for c in rows.columns if c != "text"], F.size("_words").cast("long").alias("n_words"), run_buckets(F.col("_words"), longest, buckets).alias("buckets"))


def bucket_counts(rows: DataFrame, out: str) -> DataFrame:
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(out))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths: at most `buckets` numbers, however many rows there are."""
    both = source.sparkSession.range(buckets).withColumn("bucket", F.col("id").cast("int"))
    both = both.join(bucket_counts(source, "s"), "bucket", "left").join(bucket_counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    found = both.select("bucket", F.col("s").cast("double").alias("s"), F.col("t").cast("double").alias("t"))
    sums = found.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    all_s, all_t = sums.first()
    ratio = (F.col("t") + 1) * (all_s + buckets) / ((F.col("s") + 1) * (all_t + buckets))
    rows = found.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    out = [0] * buckets
    for bucket, gain in rows:
        out[bucket] = gain
    return out


def mean_gain(buckets: Column, gain: list[int]) -> Column:
    """The mean of the buckets' gains, floored; 0 without any. The gains are one constant array."""
    values = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(values, b))
    n = F.size(buckets)
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, fixed by seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score, row (a number of its own for each row); stored."""
    of = materialize(bucketed(documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), longest, buckets))
    weight = mean_gain(F.col("buckets"), gains(of, bucketed(target.select("text"), longest, buckets), buckets))
    rows = of.select("doc_id", "text_hash", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    out = materialize(rows.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()}))
    discard(of)
    return out


def bracket(rows: DataFrame, wanted: int, n: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, above): the wanted-th highest score of n lies in low to high, and above counts the scores beyond high.

    One sketch gives values at ever greater distances from the wanted share; the first pair that exact counts accept is
    taken, and the last pair holds everything.
    """
    share, reach = 1 - wanted / n, [2 * 4**i / accuracy for i in range(40) if 2 * 4**i < accuracy]
    points = [min(1.0, max(0.0, share + d)) for r in reach for d in (-r, r)]
    values = rows.agg(F.percentile_approx("score", points, accuracy)).first()[0] if points else []
    for low, high in [*zip(values[::2], values[1::2], strict=True), (LEAST, MOST)]:
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < wanted <= above + inside:
            return low, high, above
    raise AssertionError("the last bracket holds all rows")


#: Highest scores first, ties by id; what follows only makes the order of repeated ids total.
ORDER = ("_down", "_id", "n_features", "weight", "row")


def with_order(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_down": -F.col("score"), "_id": F.coalesce("doc_id", F.lit(MOST))})


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST_RUN, buckets: int = BUCKETS, seed: int = SEED, accuracy: int = ACCURACY) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score, rank: a row for each document.

    Of the documents of at least least_words words, floor(percent / 100 of them) are drawn; rank counts them from 1 in the
    order of score, and is null for the others.
    """
    rows = scored(documents, target, longest, buckets, seed)
    able = F.col("n_words") >= least_words
    n = rows.where(able).count()
    wanted = percent * n // 100
    no_rank = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "text_hash", "n_words", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*columns, no_rank)
    low, high, above = bracket(rows.where(able), wanted, n, accuracy)
    inside = place_in_order(with_order(rows.where(able & F.col("score").between(low, high))), ORDER, "place")
    last = inside.where(F.col("place") == wanted - above).select(*ORDER).first()
    key = F.struct(*ORDER)
    drawn = able & (key <= F.struct(*[F.lit(v).cast("long") for v in last]))
    ordered = with_order(rows).withColumn("_drawn", drawn)
    best = place_in_order(ordered.where("_drawn"), ORDER, "rank")
    return best.select(*columns, "rank").unionByName(ordered.where(~F.col("_drawn")).select(*columns, no_rank))


def draw(documents: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents with all their columns; rows that share id and text are drawn together."""
    drawn = resample(documents, target, **settings).where(F.col("rank").isNotNull())
    keys = drawn.select(F.col("doc_id").alias("_drawn_id"), F.col("text_hash").alias("_drawn_hash"))
    same = documents["doc_id"].cast("long").eqNullSafe(keys["_drawn_id"]) & (F.xxhash64(documents["text"]) == keys["_drawn_hash"])
    return documents.join(keys, same, "left_semi")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
