"""Grouping of classified pages into batches, and their rendering as merged texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH = 7


def page_limit(pages: DataFrame, *limits: str | None, page: str = "page_number") -> DataFrame:
    """Pages up to the first of the limits that is a whole number above 0; all if none is."""
    for limit in limits:
        if limit and limit.strip().isdigit() and int(limit) > 0:
            return pages.where(F.col(page) <= int(limit))
    return pages


def pages_by_type(pages: DataFrame) -> DataFrame:
    """document_type, pages: sorted page numbers. For types whose page lists fit a row."""
    return pages.groupBy("document_type").agg(F.sort_array(F.collect_list("page_number")).alias("pages"))


def numbered_batches(pages: DataFrame, size: int = BATCH, buckets: int = 256) -> DataFrame:
    """page_number, document_type, batch (from 1), place (from 0 in its batch): consecutive pages of a type, `size` a batch.

    Page numbers are distinct. They are dealt into ranges of 2**20 / buckets, ranked inside a range and offset by the
    counts of the ranges before, so that a type that holds most pages is not ranked by one task. Ranks and counts read the
    same exchange of narrow rows, so that the types, which may be costly to find, are found once.
    """
    kind = F.lower(F.trim(F.coalesce("document_type", F.lit("unknown"))))
    dealt = pages.select("page_number", kind.alias("document_type"), F.floor(F.col("page_number") / ((1 << 20) // buckets)).alias("_range"))
    dealt = dealt.repartition("document_type", "_range")
    over = Window.partitionBy("document_type").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("document_type", "_range").agg(F.count("page_number").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    inside = Window.partitionBy("document_type", "_range").orderBy("page_number")
    rank = F.col("_before") + F.row_number().over(inside) - 1
    ranked = dealt.join(before, ["document_type", "_range"]).withColumn("_rank", rank)
    return ranked.select("page_number", "document_type", (F.floor(F.col("_rank") / size) + 1).cast("int").alias("batch"), (F.col("_rank") % size).cast("int").alias("place"))


def header(kind: Column, pages: Column) -> Column:
    rule = F.lit("=" * 80)
    listed = F.concat(F.lit("["), F.array_join(pages.cast("array<string>"), ", "), F.lit("]"))
    return F.concat_ws(
        "\n", rule, F.concat(F.lit("DOCUMENT TYPE : "), F.upper(kind)), F.concat(F.lit("PAGES INCLUDED : "), listed),
        F.concat(F.lit("TOTAL PAGES    : "), F.size(pages).cast("string")), rule, F.lit("\n"),
    )


def merged_texts(pages: DataFrame, texts: DataFrame | None = None, size: int = BATCH) -> DataFrame:
    """document_type, batch, file_name, pages, content. A page without text is in the header and has no section.

    pages: page_number, document_type and, unless texts (page_number, text) is given, text.
    """
    texts = pages.select("page_number", "text") if texts is None else texts.select("page_number", "text")
    rows = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    joined = numbered_batches(pages, size).join(texts, "page_number", "left")
    grouped = joined.groupBy("document_type", "batch").agg(rows.alias("rows"))  # `size` pages a group
    rule = "=" * 70

    def section(row: Column) -> Column:
        return F.concat(F.lit(rule + "\nPAGE "), row["page_number"].cast("string"), F.lit("\n" + rule + "\n\n"), row["text"], F.lit("\n\n"))

    body = F.array_join(F.transform(F.filter("rows", lambda r: r["text"].isNotNull()), section), "")
    listed = F.transform("rows", lambda r: r["page_number"])
    return grouped.select(
        "document_type", "batch", F.format_string("%s_%03d_raw.txt", "document_type", "batch").alias("file_name"), listed.alias("pages"),
        F.concat(header(F.col("document_type"), listed), body).alias("content"),
    )


def included_pages(content: Column) -> Column:
    """The page numbers that a merged text's header lists."""
    listed = F.regexp_extract(content, r"PAGES INCLUDED\s*:\s*\[(.*?)\]", 1)
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def run_summary(batches: DataFrame) -> DataFrame:
    return batches.agg(F.countDistinct("document_type").alias("types"), F.sum(F.size("pages")).alias("pages"), F.count("*").alias("batches"))


def skip_done(work: DataFrame, done: DataFrame, key: str, forced: bool = False) -> DataFrame:
    return work if forced else work.join(done.select(key), key, "left_anti")
