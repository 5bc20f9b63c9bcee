"""Document fingerprints: I-Match.

Terms are the lower-cased words of a text without outer punctuation. The lexicon keeps terms within a band of
inverse document frequency: those in at least MIN_SHARE and at most MAX_SHARE of all documents. A fingerprint
hashes a document's sorted distinct lexicon terms once for the whole lexicon and once for each of several randomised
subsets of it, REPLICATES for each of LEVELS: level l keeps a term with chance 2**-l. Small subsets survive edits,
large ones tell texts apart, so the share of equal hashes is a likeness from 0 to 1.

Document frequencies are counted over every document. The lexicon alone is collected and broadcast: a term in at
least MIN_SHARE of documents is one of at most (mean distinct terms a document / MIN_SHARE) terms, however large the
corpus; this bound doesn't grow with the number of documents.

For the edited text, each document meets the next one in descending doc_id: rows are dealt by ranges of doc_id and, for
rows that share an id or have none, of a hash of their texts, so no id makes a large range. The first row of each range is
sent along to the range above it, so every task has the neighbour of its last row. A range goes to a task of its own and
holds about RANGE_BYTES; texts travel compressed.

Defined results: a null text counts as empty; a text without lexicon terms is hashed by all its terms, one without
terms by itself, so equal texts have equal fingerprints; ids that repeat are ordered by a hash of the text, null ids come
last; a
single document is its own next; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, table

MIN_SHARE, MAX_SHARE = 0.002, 0.2
#: In small corpora a term must still occur in so many documents.
LEAST_DOCUMENTS = 2
REPLICATES, LEVELS = 8, (1, 4, 6, 7, 8, 9)
#: Bytes of text of a range, and ranges at most, of each of which the driver holds two numbers.
RANGE_BYTES, MOST_RANGES = 16 << 20, 20_000
#: A task's counts are passed on when it holds so many terms.
HELD_TERMS = 400_000
OUTER = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"
NONE = "-" * 8


def terms_of(text: str) -> set[str]:
    found = {w.strip(OUTER) for w in set(text.lower().split())}
    found.discard("")
    return found


def document_frequencies(documents: DataFrame) -> DataFrame:
    """term, n: in how many documents each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(terms_of(text.as_py() or ""))
                if len(held) > HELD_TERMS:
                    yield flush()
        yield flush()

    return documents.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(documents: DataFrame, total: int, low: float = MIN_SHARE, high: float = MAX_SHARE) -> list[str]:
    """The sorted terms within the band, of so many documents."""
    most, least = max(high * total, LEAST_DOCUMENTS), max(low * total, LEAST_DOCUMENTS)
    return sorted(document_frequencies(documents).where(F.col("n").between(least, most)).toPandas()["term"])


class Fingerprint:
    """Made in each Python worker from the sorted lexicon."""

    def __init__(self, terms: list[str]):
        self.place = {t: i for i, t in enumerate(terms)}
        self.hashes, self.levels = self.drawn(terms)

    @staticmethod
    def drawn(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash for each term, and for each replicate the deepest level that keeps it."""
        raw = [t.encode() for t in terms]
        hashes = np.fromiter((xxhash.xxh64_intdigest(t) for t in raw), np.uint64, len(raw))
        levels = np.empty((REPLICATES, len(raw)), np.int8)
        for r in range(REPLICATES):
            drawn = np.fromiter((xxhash.xxh32_intdigest(t, seed=r + 1) for t in raw), np.uint32, len(raw))
            levels[r] = 32 - np.ceil(np.log2(drawn.astype(np.float64) + 1)).astype(np.int8)
        return hashes, levels

    def of(self, text: str) -> list[str]:
        """1 + REPLICATES * len(LEVELS) hashes; NONE for a subset that the text has no term in."""
        terms = terms_of(text)
        get = self.place.get
        at = np.sort(np.array([i for t in terms if (i := get(t)) is not None], np.int64))
        if len(at):
            hashes, levels = self.hashes[at], self.levels[:, at]
        elif terms:
            hashes, levels = self.drawn(sorted(terms))
        else:
            return [xxhash.xxh32_hexdigest(text.encode(), seed=99)] * (1 + REPLICATES * len(LEVELS))
        out = [xxhash.xxh32_hexdigest(hashes.tobytes())]
        for r in range(REPLICATES):
            left, depth = hashes, levels[r]
            for level in LEVELS:
                keep = depth >= level
                left, depth = left[keep], depth[keep]
                out.append(xxhash.xxh32_hexdigest(left.tobytes(), seed=r) if len(left) else NONE)
        return out


def likeness(a: list[str], b: list[str]) -> float:
    """The share of equal hashes among the subsets that either text has terms in."""
    if a == b:
        return 1.0
    either = [(x, y) for x, y in zip(a, b, strict=True) if x != NONE or y != NONE]
    return sum(x == y for x, y in either) / len(either)


def edited(text: str, other: str) -> str:
    """The last floor(n / 2) characters replaced by the other text's first as many, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_neighbours(documents: DataFrame, text_bytes: int) -> DataFrame:
    """bucket, guest, doc_id, key, at, packed: each range's rows, and the rows that follow its last in descending doc_id."""
    spark = documents.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    at = F.when(F.col("doc_id").isNull(), F.lit(-1e19) - drawn * 1e18).otherwise(key.cast("double") + 0.4 * drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([press.compress((t.as_py() or "").encode()) for t in batch.column(3)], pa.binary())
            yield pa.record_batch([*batch.columns[:3], packed], names=["doc_id", "key", "at", "packed"])

    keys = documents.select(key.alias("key"), at.alias("at"))
    wanted = min(MOST_RANGES, max(partitions(spark), text_bytes // RANGE_BYTES + 1))
    limits = sorted(set(keys.approxQuantile("at", [i / wanted for i in range(1, wanted)], 0.1 / wanted)))  # one number a range
    ranges = Bucketizer(splits=[float("-inf"), *limits, float("inf")], inputCol="at", outputCol="bucket")
    tops = ranges.transform(keys).groupBy("bucket").agg(F.max(F.struct("key", "at")).alias("top"))
    tops = sorted(((r["bucket"], r["top"]) for r in tops.collect()), reverse=True)  # one row a range
    follows = [(*tops[(i + 1) % len(tops)][1], bucket) for i, (bucket, _) in enumerate(tops)]
    heads = spark.createDataFrame(follows, "key long, at double, above double")
    packed = documents.select(F.col("doc_id").cast("long"), key.alias("key"), at.alias("at"), "text").mapInArrow(run, "doc_id long, key long, at double, packed binary")
    own = F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")))
    both = F.array_append(own, F.struct(F.col("above").alias("bucket"), F.lit(1).alias("guest")))
    sent = ranges.transform(packed).join(F.broadcast(heads), ["key", "at"], "left").withColumn("to", F.explode(F.when(F.col("above").isNull(), own).otherwise(both)))
    rows = sent.select(F.col("to.bucket").cast("int").alias("bucket"), "to.guest", "doc_id", "key", "at", "packed")
    return rows.repartitionById(len(limits) + 1, "bucket").sortWithinPartitions("bucket", "guest", F.col("key").desc(), F.col("at").desc(), "packed")


def fingerprints(documents: DataFrame, low: float = MIN_SHARE, high: float = MAX_SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = documents.sparkSession
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    bounded_batches(spark)
    total, text_bytes = documents.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], fields)
    terms = spark.sparkContext.broadcast(lexicon(documents, total, low, high))
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, unpack = Fingerprint(terms.value), zstandard.ZstdDecompressor()
        last, out = None, []

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), preserve_index=False)

        for batch in batches:
            for bucket, guest, doc_id, _, _, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if guest and (last is None or last[0] != bucket):
                    continue  # a further row with the guest's id
                text = unpack.decompress(packed).decode()
                own = maker.of(text)
                if last and last[0] == bucket:
                    _, before_id, before, before_own = last
                    changed = edited(before, text)
                    new = maker.of(changed)
                    out.append((
                        before_id, len(before), hashlib.sha256(changed.encode()).hexdigest(), "".join(before_own), "".join(new), likeness(before_own, new), likeness(before_own, own),
                    ))
                last = None if guest else (bucket, doc_id, text, own)
            if len(out) >= 2000:
                yield ready().cast(schema)
                out.clear()
        if out:
            yield ready().cast(schema)

    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]]) for n, f in zip(names, fields.split(", "), strict=True)])
    return with_neighbours(documents, text_bytes).mapInArrow(run, fields)


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
