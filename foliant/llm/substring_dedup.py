"""Substring dedup: sliding sentence spans.

Texts are cut into sentences (after . ! ? and white space, after line ends; sentences of over MAX_WORDS words are
cut on, so that a long passage without a full stop still makes several). Every run of RUN consecutive sentences is
hashed to 128 bits and joined globally; a sentence covered by any run that occurs before (in a smaller doc_id, or
earlier in the same document) is removed. What is kept is kept byte for byte.

Only hashes are shuffled to find repeats: one row a run, first aggregated by hash (a passage that millions of
documents share is one row a task), then joined back, which Spark may split where a hash is hot. The text moves
once, to meet the list of its repeated runs.

Defined results: null texts stay null; texts with fewer sentences than a run, and rows with a null id, stay as they
are; rows that share an id lose what their own text repeats, and none counts as a repeat of another; an empty table
gives no rows; other columns are kept, but one named as the count asked for is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, fresh, hash128, materialize, table

RUN = 3
MAX_WORDS = 16
BLANK = r" \t\r\n\f\x0B"
#: A run of marks is tried once, from its start, so that long runs without a blank after them cost no more than others.
END = rf"((?<![.!?])[.!?]++[{BLANK}]++|[。！？]+|\n[{BLANK}]*)"
#: Ends a sentence while a text is cut; where texts hold it or ESCAPE, both are written with ESCAPE meanwhile.
MARK, ESCAPE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    rare = F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(ESCAPE))
    return F.when(rare, F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}b")), F.lit(MARK), F.lit(f"{ESCAPE}a"))).otherwise(text)


def unescaped(text: Column) -> Column:
    back = F.replace(F.replace(text, F.lit(f"{ESCAPE}a"), F.lit(MARK)), F.lit(f"{ESCAPE}b"), F.lit(ESCAPE))
    return F.when(F.contains(text, F.lit(ESCAPE)), back).otherwise(text)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sentences(text: Column, max_words: int = MAX_WORDS) -> Column:
    """The parts of an escaped text in order; joined, they give it again."""
    parts = F.split(F.regexp_replace(text, END, f"$1{MARK}"), MARK)

    def cut(part: Column) -> Column:
        blanks = F.length(part) - F.length(F.translate(part, " \t\r\n\f\x0b", ""))
        marked = F.regexp_replace(part, rf"((?:[^{BLANK}]+[{BLANK}]+){{{max_words}}})", f"$1{MARK}")
        return F.when(blanks >= max_words, F.split(marked, MARK)).otherwise(F.array(part))

    return F.filter(F.flatten(F.transform(parts, cut)), lambda s: s != "")


def plain(sentence: Column) -> Column:
    """The form in which sentences are compared."""
    return F.lower(F.trim(F.regexp_replace(sentence, rf"[{BLANK}]+", " ")))


def repeated_runs(hashed: DataFrame, run: int) -> DataFrame:
    """doc_id, text_hash, starts: the places of runs that are not the first of their kind. hashed: doc_id, text_hash, s array<struct<a,b>>."""
    at = F.sequence(F.lit(1), F.size("s") - (run - 1))
    one = lambda i, k: F.xxhash64(*[F.element_at("s", i + j)[k] for j in range(run)])
    runs = F.transform(at, lambda i: F.struct((i - 1).alias("pos"), one(i, "a").alias("a"), one(i, "b").alias("b")))
    spans = hashed.where(F.size("s") >= run).select("doc_id", "text_hash", F.explode(runs).alias("r")).select("doc_id", "text_hash", "r.pos", "r.a", "r.b")
    repeated = spans.groupBy("a", "b").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    repeated = materialize(repeated)  # a plain table, so that Spark can split the partition of a hot hash in the join
    again = spans.join(repeated, ["a", "b"]).repartition("doc_id", "text_hash")
    first_pos = F.min("pos").over(Window.partitionBy("doc_id", "text_hash", "a", "b"))
    later = again.withColumn("first_pos", first_pos).where((F.col("doc_id") > F.col("first_doc")) | (F.col("pos") > F.col("first_pos")))
    starts = materialize(later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("_starts")))
    discard(repeated)
    return starts


def remove_repeats(documents: DataFrame, run: int = RUN, max_words: int = MAX_WORDS, count: str | None = "n_removed") -> DataFrame:
    """The documents with their repeated sentences removed, and how many, unless count is None; n_chars, if there, follows the text."""
    own = documents.columns
    text = escaped(F.col("text"))
    plains = F.transform(sentences(text, max_words), plain)  # apart from the hashes, so that each is made once
    keys = F.transform(plains, lambda s: F.struct(*[h.alias(n) for h, n in zip(hash128(s), "ab", strict=True)]))
    usable = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    hashed = materialize(usable.select("doc_id", F.xxhash64("text").alias("text_hash"), keys.alias("s")))
    starts = repeated_runs(hashed, run)
    discard(hashed)

    places = starts["_starts"]
    hit = places.isNotNull()
    gone = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + (run - 1)))))

    def rewritten(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        whole = F.array_join(F.transform(left, lambda i: F.element_at(parts, i + 1)), "")
        return F.struct(unescaped(whole).alias("text"), (F.size(parts) - F.size(left)).alias("removed"))

    done = fresh(documents, "done")
    joined = documents.join(starts, (documents["doc_id"] == starts["doc_id"]) & (F.xxhash64(documents["text"]) == starts["text_hash"]), "left")
    told = joined.select(*[documents[c] for c in own], F.when(hit, let(sentences(escaped(documents["text"]), max_words), rewritten)).alias(done))
    found, new = F.col(done), {}
    new["text"] = F.when(found.isNotNull(), found["text"]).otherwise(F.col("text"))
    if "n_chars" in own:
        new["n_chars"] = F.when(found.isNotNull(), F.length(found["text"]).cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    if count:
        new[count] = F.coalesce(found["removed"], F.lit(0))
    return told.withColumns(new).drop(done)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
