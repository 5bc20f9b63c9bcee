"""The corpus pipeline: stages over documents, each calling one operator of foliant.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents, further columns with their values whatever their names.

Defined results: documents whose text is null or has no letter are rejected by the first stage; of near copies the one
with the smallest doc_id stays; rows that repeat an id are judged each by its own text, so a row with an id of its own
text is never lost for another; a null id is no copy of anything; a null source is a source of its own and comes last;
an empty table gives no rows, in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import language_id, mixing, near_dedup, packing, substring_dedup
from foliant.llm.common import discard, fresh, materialize, table

#: Documents whose language is less sure than this are rejected, as are those without letters.
LEAST_SCORE = 0.5
#: Words that a tokenizing worker keeps twice: fewer than packing alone allows, since workers hold other stages' models too.
REMEMBERED = 1 << 15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no certain language; lang becomes the language found."""
    model = language_id.LanguageModel.fit(docs.where(~language_id.held_out()))
    name = fresh(docs, "found")
    found = docs.withColumn(name, language_id.language_of(spark, model, F.col("text")))
    sure = (F.col(name)["lang_pred"] != language_id.UNKNOWN) & (F.col(name)["score"] >= LEAST_SCORE)
    return found.where(sure).withColumn("lang", F.col(name)["lang_pred"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup.without_near_duplicates(docs, words=5, percent=80).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes sentences of passages that occurred before."""
    return substring_dedup.remove_repeats(docs, count=None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target weight, documents in training order."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of full sequences, with token ids, in the order of the files that mixing's range sort wrote."""
    return packing.pack(docs, with_ids=True, by_files=True, remembered=REMEMBERED)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("substring_dedup", substrings), ("mixing", mix), ("packing", pack)]

#: Language ID and the tokenizer are not expressible in SQL; tests restate in plain Python the stages that follow rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        if i:
            docs = materialize(docs)
            if before is not None:
                discard(before)  # what the last stage has read
            before = docs
        docs = stage(spark, docs, sf_dir)
    return docs
