"""Consolidation of per-page payloads into one ledger a run and document type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: The fields of a table row.
ROW_FIELDS = ("date", "time", "amount", "type", "serial_no", "medication_or_item_name", "dosage_frequency")


def null_like(value: Column) -> Column:
    return value.isNull() | F.lower(strip(value)).isin("null", "none", "")


def longest(values: DataFrame, keys: list[str], order: list[str], value: str = "value", keep_null_like: bool = True) -> DataFrame:
    """For each key, the longest value (trimmed) that isn't null-like, the first in order of those as long.

    Where all are null-like, the first non-null value, or null with keep_null_like=False. Partial aggregates only.
    """
    v = F.col(value)
    rank = F.struct((~null_like(v)).alias("real"), F.when(null_like(v), 0).otherwise(F.length(strip(v))).alias("length"), *[(-F.col(c)).alias(c) for c in order])
    best = F.max_by(value, F.when(v.isNotNull(), rank)) if keep_null_like else F.max_by(value, F.when(~null_like(v), rank))
    return values.groupBy(*keys).agg(best.alias(value))


def row_key(row: Column, fields: tuple[str, ...] = ROW_FIELDS) -> Column:
    """What makes two table rows equal: their non-null fields, trimmed and lower-cased."""
    parts = [F.when(row[f].isNotNull(), F.concat(F.lit(f + "="), F.lower(strip(row[f])))) for f in sorted(fields)]
    return F.concat_ws("\x1f", *parts)


def distinct_rows(rows: DataFrame, keys: list[str], order: list[str], row: str = "row", fields: tuple[str, ...] = ROW_FIELDS) -> DataFrame:
    """The first of equal rows under each key. A minimum a row key, so equal rows meet already before the shuffle."""
    place = F.struct(*order)
    return rows.withColumn("_key", row_key(F.col(row), fields)).groupBy(*keys, "_key").agg(F.min_by(F.struct(*[F.col(c) for c in (*order, row)]), place).alias("_first")).select(*keys, "_first.*")


def table_rows(pages: DataFrame, keys: list[str], tables: str = "all_extracted_tables") -> DataFrame:
    """keys, table_no, row_no, row: the rows of all tables of all pages."""
    each = pages.select(*keys, F.posexplode(tables).alias("table_no", "_table"))
    return each.select(*keys, "table_no", F.posexplode("_table.rows").alias("row_no", "row"))


def union_warnings(pages: DataFrame, keys: list[str], warnings: dict[str, Column]) -> DataFrame:
    """For each kind of warning, the distinct texts of all pages, sorted."""
    return pages.groupBy(*keys).agg(*[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(n) for n, c in warnings.items()])


def type_key(document_type: Column) -> Column:
    return F.replace(F.lower(strip(document_type)), F.lit(" "), F.lit("_"))


def merge_entities(pages: DataFrame, keys: list[str], page: str = "page_number", entities: str = "all_extracted_entities") -> DataFrame:
    """keys, key, value: the best value of every entity over the pages."""
    each = pages.select(*keys, page, F.posexplode(entities).alias("pos", "key", "value")) if dict(pages.dtypes)[entities].startswith("array") else pages.select(*keys, page, F.explode(entities).alias("key", "value"))
    return longest(each.where(F.col("value").isNotNull()), [*keys, "key"], [page])


#: The fields of a ledger's metadata, and the kinds of warnings.
METADATA = ("patient_name", "hospital_name", "date", "reference_or_claim_number")
WARNINGS = ("ignored_handwritten_content", "unmapped_ambiguous_text_regions")


def ledger_tables(pages: DataFrame, keys: list[str], metadata: tuple[str, ...] = METADATA) -> dict[str, DataFrame]:
    """The ledgers of page payloads as tables, under keys (such as the run) and type_key. No list grows with a ledger.

    ledgers: document_type as its first page has it, pages, first_page; pages: page_number; metadata, entities: key, value;
    rows: page_number, table_no, row_no, row, the first of equal ones; warnings: kind, text.
    """
    kinds = pages.withColumn("type_key", type_key(F.col("document_type_classified")))
    key = [*keys, "type_key"]
    named = F.min_by(strip(F.col("document_type_classified")), "page_number").alias("document_type")
    facts = kinds.select(*key, "page_number", F.explode(F.create_map(*[x for m in metadata for x in (F.lit(m), F.col(f"global_metadata.{m}"))])).alias("key", "value"))

    def warned(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"warnings.{kind}"), F.array().cast("array<string>")), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))

    said = F.explode(F.concat(*[warned(n) for n in WARNINGS]))
    return {
        "ledgers": kinds.groupBy(*key).agg(named, F.count("*").alias("pages"), F.min("page_number").alias("first_page")),
        "pages": kinds.select(*key, "page_number"),
        "metadata": longest(facts, [*key, "key"], ["page_number"], keep_null_like=False),
        "entities": merge_entities(kinds, key),
        "rows": distinct_rows(table_rows(kinds, [*key, "page_number"]), key, ["page_number", "table_no", "row_no"]),
        "warnings": kinds.select(*key, said.alias("w")).select(*key, "w.*").distinct(),
    }


def ledgers(pages: DataFrame, metadata: tuple[str, ...] = METADATA, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a ledger: its pages, best metadata and entities, distinct rows and warnings, nested.

    For ledgers that fit a row, as those of one run do when keys name it; without keys a type is one row (see ledger_tables).
    """
    key = [*keys, "type_key"]
    of = ledger_tables(pages, list(keys), metadata)
    listed = lambda c: F.sort_array(F.collect_list(c))
    pairs = lambda name, out: of[name].groupBy(*key).agg(F.map_from_entries(listed(F.struct("key", "value"))).alias(out))
    numbers = of["pages"].groupBy(*key).agg(listed("page_number").alias("pages_associated"))
    rows = of["rows"].groupBy(*key).agg(F.transform(listed(F.struct("page_number", "table_no", "row_no", "row")), lambda r: r["row"]).alias("consolidated_tables"))
    said = of["warnings"].groupBy(*key).agg(*[listed(F.when(F.col("kind") == n, F.col("text"))).alias(n) for n in WARNINGS])
    out = of["ledgers"].select(*key, "document_type").join(numbers, key)
    for part in (pairs("metadata", "global_metadata"), pairs("entities", "all_extracted_entities"), rows, said):
        out = out.join(part, key, "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in WARNINGS})
