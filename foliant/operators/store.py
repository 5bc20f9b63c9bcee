"""The document store as tables: listing, summaries, sequence numbers, upserts, edits, deletes.

Tables are DataFrames; a change gives a new DataFrame, to be written to a new place. Without a table format there is no
row update, so an upsert is one full outer join on the merge key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payloads
from ..functions.quality import claim_status, settable, terminal_status
from ..functions.text import alias_key, trailing_number
from .ranks import at_least_usual, places

#: The summary's fields and the names they go by, first ones first.
ALIASES = {
    "claim_number": ("claim_number", "claim_no", "file_number"),
    "patient_name": ("patient_name", "insured_name", "claimant_name", "name"),
    "policy_number": ("policy_number", "policy_no"),
    "hospital_name": ("hospital_name", "hospital"),
}


def list_claims(claims: DataFrame, status: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    """Newest first; at most 100."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip must not be negative, limit must be 1 to 100")
    rows = claims if status is None else claims.where(F.col("status") == status)
    return rows.orderBy(F.col("created_at").desc(), F.col("claim_id").desc()).offset(skip).limit(limit)


def claims_after(claims: DataFrame, cursor: tuple | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
    """The page of claims after the one whose last row had (created_at, claim_id) = cursor; the first one without.

    The order is that of list_claims, but nothing before the cursor is sorted or skipped: the scan leaves it out.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    rows = claims if status is None else claims.where(F.col("status") == status)
    if cursor is not None:
        when, last = cursor
        tied = F.col("claim_id") < last
        older = F.col("created_at").isNull() & tied if when is None else (F.col("created_at") < F.lit(when)) | ((F.col("created_at") == F.lit(when)) & tied) | F.col("created_at").isNull()
        rows = rows.where(older)
    return rows.orderBy(F.col("created_at").desc(), F.col("claim_id").desc()).limit(limit)


def search_claims(claims: DataFrame, query: str = "", status: str = "all") -> DataFrame:
    """By a part of the id or file number, and by status."""
    wanted = query.strip().lower()
    rows = claims if not wanted else claims.where(F.lower(F.col("claim_id").cast("string")).contains(wanted) | F.lower("file_no").contains(wanted))
    return rows if status == "all" else rows.where(F.lower(F.coalesce("status", F.lit("unknown"))) == status)


def status_facets(claims: DataFrame) -> DataFrame:
    """The statuses there are, 'all' first."""
    kinds = claims.select(F.lower(F.coalesce("status", F.lit("unknown"))).alias("status")).distinct().withColumn("place", F.lit(1))
    return claims.sparkSession.createDataFrame([("all", 0)], "status string, place int").unionByName(kinds)


def select_documents(documents: DataFrame, claim_id: str, document_type: str, file_name: str | None = None, sequence: int | None = None) -> DataFrame:
    """By file name if there is one, else by sequence if there is one."""
    rows = documents.where((F.col("claim_id") == claim_id) & (F.col("document_type") == document_type))
    if file_name:
        return rows.where(F.col("source_file_name") == file_name)
    return rows if sequence is None else rows.where(F.col("sequence") == sequence)


def latest(rows: DataFrame, keys: list[str], by: str, ties: str) -> DataFrame:
    """The newest row of each key: a maximum, so rows meet already before the shuffle."""
    own = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(own, F.struct(by, ties)).alias("_row")).select("_row.*")


def first_of_type(documents: DataFrame) -> DataFrame:
    """The first document of each claim and type, those without a sequence first: a minimum, as in latest."""
    own = F.min_by(F.struct(*documents.columns), F.struct("sequence", "id"))
    return documents.groupBy("claim_id", "document_type").agg(own.alias("_row")).select("_row.*")


def list_documents(documents: DataFrame, claim_id: str) -> DataFrame:
    order = [F.col("document_type").asc_nulls_first(), F.col("sequence").asc_nulls_first()]
    return summary_view(documents.where(F.col("claim_id") == claim_id)).orderBy(*order)


def summary_view(documents: DataFrame) -> DataFrame:
    empty = F.array().cast("array<int>")
    return documents.select(
        "id", "document_type", "source_file_name", "sequence", F.coalesce("pages_processed", empty).alias("pages_processed"), "ocr_status",
        F.coalesce("review_status", F.lit("pending")).alias("review_status"), "error_message", "created_at", "updated_at",
    )


def full_view(documents: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Every field with its default: empty for lists and maps, pending for the review."""
    chosen = {"review_status": F.lit("pending")} | (defaults or {})
    out = []
    for name, kind in documents.dtypes:
        other = chosen.get(name)
        if other is None and kind.startswith("array"):
            other = F.array().cast(kind)
        if other is None and kind.startswith("map"):
            other = F.create_map().cast(kind)
        out.append(F.col(name) if other is None else F.coalesce(F.col(name), other).alias(name))
    return documents.select(*out)


#: The fields of a full record, in order, and what stands for those that are null.
RECORD_FIELDS = (
    "id", "document_id", "document_type", "source_file_name", "sequence", "pages_processed", "global_metadata", "all_extracted_entities", "all_extracted_tables", "warnings", "ocr_status", "raw_ocr_response",
    "structured_ocr_data", "mapped_fields", "mapping_status", "error_message", "processed_page_count", "total_page_count", "review_status", "entity_verification", "entity_remarks", "created_at", "updated_at",
)
EMPTY = {"all_extracted_tables": "[]", "raw_ocr_response": "{}", "structured_ocr_data": "{}", "mapped_fields": "{}"}


def full_record(documents: DataFrame) -> DataFrame:
    """All fields of RECORD_FIELDS with their defaults; warnings without a list of a kind have an empty one."""
    none = F.array().cast("array<string>")
    said = F.struct(*[F.coalesce(F.col(f"warnings.{n}"), none).alias(n) for n in ("ignored_handwritten_content", "unmapped_ambiguous_text_regions")])
    defaults = {n: F.lit(v) for n, v in EMPTY.items()} | {"review_status": F.lit("pending")}
    return full_view(documents.withColumn("warnings", said).select(*RECORD_FIELDS), defaults)


def existing(rows: DataFrame, claims: DataFrame) -> DataFrame:
    return rows.join(claims.select("claim_id"), "claim_id", "left_semi")


def orphans(rows: DataFrame, claims: DataFrame) -> DataFrame:
    return rows.join(claims.select("claim_id"), "claim_id", "left_anti")


def document_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("claim_id").agg(F.count("*").alias("document_count"))


def alias_summary(documents: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES, entities: str = "entities") -> DataFrame:
    """claim_id and a column for each field: the value of the first document, in order of (created_at, id), that has one.

    Claims without any are left out. Inside a document the aliases' order decides, and of keys that are the same when normalized the last counts. Of
    documents with equal (created_at, id) the one of the better alias counts, then that of the smaller value.
    entities: array of (key, value), in order.
    """
    return counted_summary(documents, aliases, entities).drop("document_count").where(F.coalesce(*aliases).isNotNull())


def counted_summary(documents: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES, entities: str = "entities") -> DataFrame:
    """claim_id, document_count and the fields of alias_summary, for all claims that have documents, in one pass."""

    def best(named: Column, names: tuple[str, ...]) -> Column:
        """rank and value of the first name with a usable value in one document, else null."""
        last = lambda name: F.try_element_at(F.filter(named, lambda e: e["name"] == "".join(c for c in name if c.isalnum())), F.lit(-1))["value"]
        found = F.array(*[F.struct(F.lit(i).alias("rank"), last(name).alias("value")) for i, name in enumerate(names)])
        return F.get(F.filter(found, lambda c: c["value"].isNotNull() & ~c["value"].isin("", "Not Available")), F.lit(0))

    # The entities are a lambda's variable, so they are normalized once.
    named = F.array(F.transform(entities, lambda e: F.struct(alias_key(e["key"]).alias("name"), e["value"].alias("value"))))
    every = F.get(F.transform(named, lambda own: F.struct(*[best(own, names).alias(field) for field, names in aliases.items()])), F.lit(0))
    each = documents.select("claim_id", "created_at", "id", every.alias("_of"))

    def first(field: str) -> Column:
        own = F.col(f"_of.{field}")
        return F.min_by(own["value"], F.when(own.isNotNull(), F.struct("created_at", "id", own["rank"], own["value"]))).alias(field)

    return each.groupBy("claim_id").agg(F.count("*").alias("document_count"), *[first(n) for n in aliases])


def claim_summaries(claims: DataFrame, documents: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Each claim with its number of documents and its summary: one join each, after the claims are chosen."""
    some = documents.join(claims.select("claim_id"), "claim_id", "left_semi")
    joined = claims.join(document_counts(some), "claim_id", "left").join(alias_summary(some, aliases), "claim_id", "left")
    return joined.withColumn("document_count", F.coalesce("document_count", F.lit(0)))


def claim_details(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Each claim with its documents as a sorted list."""
    rows = F.sort_array(F.collect_list(F.struct("document_type", "sequence", "id")))
    return claims.join(documents.groupBy("claim_id").agg(rows.alias("documents")), "claim_id", "left")


def progress(documents: DataFrame, key: str = "claim_id") -> DataFrame:
    """Completed of all documents as a percentage, halves up."""
    done = F.count_if(F.lower("status") == "completed")
    return documents.groupBy(key).agg(F.count("*").alias("total"), done.alias("completed"), F.floor(done * 100 / F.count("*") + 0.5).cast("int").alias("percent"))


#: Rows of one key beyond which its rows are numbered by many tasks.
HOT_ROWS = 1 << 17
#: Rows that one task orders, about.
TASK_ROWS = 1 << 19


def tasks_for(rows: DataFrame) -> int:
    """Tasks for ordering the rows, TASK_ROWS each. Counts them: a look at the footers where they are a table's own."""
    return rows.count() // TASK_ROWS + 1


def fill_sequences(documents: DataFrame, keys: list[str], order: list[str], sequence: str = "sequence", tasks: int | None = None) -> DataFrame:
    """Rows without a number get, in order, the smallest positive ones that their key doesn't use. One task orders a key.

    The r-th used number u of a key leaves u - r free ones below it, so the k-th free number is k plus the count of used
    ones with u - r < k: used numbers and waiting rows are merged in that order and counted in one pass over sorted rows.
    tasks: how many the keys are dealt to (see tasks_for), so that what one of them sorts doesn't grow with the rows; the
    session's number if there is none, or if that is larger.
    """
    dealt = lambda rows: rows if tasks is None else rows.repartition(at_least_usual(rows, tasks), *keys)
    waits = F.col(sequence).isNull()
    used = dealt(documents.where(F.col(sequence) >= 1).select(*keys, F.col(sequence).cast("long").alias("_u"))).distinct()
    used = used.withColumn("_at", F.col("_u") - F.row_number().over(Window.partitionBy(*keys).orderBy("_u")) + 1).drop("_u")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    waiting = dealt(documents.where(waits)).withColumns({"_at": place.cast("long"), "_row": F.lit(True)})
    both = waiting.unionByName(used, allowMissingColumns=True)
    merged = Window.partitionBy(*keys).orderBy("_at", F.col("_row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = F.col("_at") + F.count_if(F.col("_row").isNull()).over(merged)
    filled = both.withColumn("_free", free).where("_row").withColumn(sequence, F.col("_free").cast(dict(documents.dtypes)[sequence]))
    return documents.where(~waits).unionByName(filled.select(*documents.columns))


def fill_hot_sequences(documents: DataFrame, keys: list[str], order: list[str], keep: Callable[[DataFrame], DataFrame], sequence: str = "sequence", hot: int = HOT_ROWS) -> DataFrame:
    """The same where a key may hold a great share of all rows: keys of more than `hot` rows are numbered over ranges.

    In the merged order of fill_sequences the k-th free number is the place itself: k waiting rows and the used numbers
    before. Three rankings over ranges give it, and no task holds more than its range. order tells the rows of a key apart.
    keep stores a table and reads it again.
    """
    sizes = documents.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    tasks = tasks_for(documents)
    large = keep(sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys]))
    if large.isEmpty():
        return fill_sequences(documents, keys, order, sequence, tasks)
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    crowd, rest = documents.join(large, same, "left_semi"), documents.join(large, same, "left_anti")
    waits = F.col(sequence).isNull()
    used = crowd.where(F.col(sequence) >= 1).select(*keys, F.col(sequence).cast("long").alias("_u")).distinct()
    used = places(used, keys, ["_u"], "_r", keep, tasks).select(*keys, (F.col("_u") - F.col("_r") + 1).alias("_at"), F.lit(0).alias("_kind"), F.col("_u").alias("_tie"))
    waiting = keep(places(crowd.where(waits), keys, order, "_at", keep, tasks))
    turns = waiting.select(*keys, "_at", F.lit(1).alias("_kind"), F.col("_at").alias("_tie"))
    free = places(turns.unionByName(used), keys, ["_at", "_kind", "_tie"], "_free", keep, tasks).where(F.col("_kind") == 1)
    free = free.select(F.col("_at").alias("_turn"), "_free", *[F.col(k).alias(f"_of_{k}") for k in keys])
    filled = waiting.join(free, [*same, F.col("_at") == F.col("_turn")]).withColumn(sequence, F.col("_free").cast(dict(documents.dtypes)[sequence])).select(*documents.columns)
    return crowd.where(~waits).unionByName(filled).unionByName(fill_sequences(rest, keys, order, sequence, tasks))


def fill_dealt_sequences(documents: DataFrame, keys: list[str], order: list[str], where: Column, sequence: str = "sequence") -> DataFrame:
    """The same for the rows of `where`, where all rows are dealt by one of the keys: by windows over them, without a shuffle.

    Used numbers and waiting rows get the places that fill_sequences merges them by; of equal numbers one counts.
    """
    number, waits = F.col(sequence).cast("long"), F.col("_kind") == 1
    kind = F.when(F.col(sequence).isNull() & where, 1).when(F.col(sequence) >= 1, 0)
    own = Window.partitionBy(*keys, "_kind")
    placed = documents.withColumn("_kind", kind).withColumns({"_place": F.row_number().over(own.orderBy(sequence, *order)), "_before": F.lag(sequence).over(own.orderBy(sequence, *order))})
    ranked = placed.withColumn("_rank", F.dense_rank().over(own.orderBy(sequence)))
    ranked = ranked.withColumn("_at", F.when(waits, F.col("_place").cast("long")).when(F.col("_kind") == 0, number - F.col("_rank") + 1))
    merged = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = (F.col("_kind") == 0) & F.coalesce(F.col("_before") != F.col(sequence), F.lit(True))
    free = ranked.withColumn("_free", F.col("_at") + F.count_if(used).over(merged))
    filled = F.when(waits, F.col("_free").cast(dict(documents.dtypes)[sequence])).otherwise(F.col(sequence))
    return free.withColumn(sequence, filled).select(*documents.columns)


def merge_key(documents: DataFrame) -> DataFrame:
    """Adds _key: the file name if there is one, else the type."""
    has_file = F.coalesce(F.col("source_file_name") != "", F.lit(False))
    return documents.withColumn("_key", F.when(has_file, F.concat(F.lit("f:"), F.col("source_file_name"))).otherwise(F.concat(F.lit("t:"), F.col("document_type"))))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str], newest_by: str | None = None) -> DataFrame:
    """The stored rows with the given fields overwritten by incoming rows of equal key, and incoming rows of new keys.

    Other fields survive. With newest_by, an incoming row that is older than the stored one changes nothing. Incoming
    keys must be distinct (see latest); created_at of a new row is its updated_at.
    """
    new = incoming.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_is_new"))
    old = stored.withColumn("_is_old", F.lit(True))
    both = old.join(new, keys, "full_outer")
    take = F.coalesce("_is_new", F.lit(False))
    if newest_by:
        take = take & (F.col("_is_old").isNull() | (F.col(f"_new_{newest_by}") >= F.col(newest_by)))
    out = {f: F.when(take, F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}
    if "created_at" in stored.columns and "created_at" not in fields and "updated_at" in fields:
        out["created_at"] = F.when(F.col("_is_old").isNull(), F.col("_new_updated_at")).otherwise(F.col("created_at"))
    return both.withColumns(out).select(*stored.columns)


Keep = Callable[[DataFrame], DataFrame]


def ingest(stored: DataFrame, payload: DataFrame, fields: list[str], keep: Keep | None = None) -> DataFrame:
    """Documents with incoming ones merged in as processing, and sequences filled. keep: see merge_documents."""
    ready = payload.withColumns({
        "sequence": F.coalesce("sequence", trailing_number(F.col("source_file_name"))),
        "ocr_status": F.lit("processing"), "status": F.lit("processing"),
    })
    return merge_documents(stored, ready, fields, keep)


def merge_documents(stored: DataFrame, incoming: DataFrame, fields: list[str], keep: Keep | None = None) -> DataFrame:
    """Documents with incoming ones merged in by claim and file name, else type; the newest of a key; sequences filled.

    Of rows as new, the one of the last place counts, where incoming has places. A row without a file name meets only such
    rows here; callbacks.ingest and apply_callbacks change the first row of its type, whatever its file.
    keep stores a table and reads it again: filling reads the merged rows three times, which else are merged each time.
    """
    keyed = latest(merge_key(incoming), ["claim_id", "_key"], "updated_at", "place" if "place" in incoming.columns else "document_type")
    merged = upsert(merge_key(stored), keyed, ["claim_id", "_key"], fields).drop("_key")
    merged = keep(merged) if keep else merged
    return fill_sequences(merged, ["claim_id", "document_type"], ["created_at", "source_file_name"], tasks=tasks_for(merged) if keep else None)


def ingest_bulk(claims: DataFrame, stored: DataFrame, payload: DataFrame, fields: list[str], keep: Keep | None = None) -> tuple[DataFrame, DataFrame]:
    """Claims and documents after many documents at once: their claims are completed, the documents stay processing."""
    done = payload.select("claim_id", F.lit("completed").alias("_status")).distinct()
    told = claims.join(done, "claim_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    return told, ingest(stored, payload, fields, keep)


def ingest_callbacks(claims: DataFrame, stored: DataFrame, callbacks: DataFrame, fields: list[str], keep: Keep | None = None) -> tuple[DataFrame, DataFrame]:
    """Claims and documents after callbacks (claim_id, document_type, file_url, ocr_status, updated_at, structured_entries, raw_entries).

    Each entry (document_type, source_file_name, all_extracted_entities) is a document; a callback without entries is one
    document of its own type. Fields that an entry lacks are the callback's. Later callbacks win, and later entries of one.
    """
    ahead = callbacks.select("claim_id", F.col("document_type").alias("_type"), "ocr_status", "updated_at", "structured_entries", "raw_entries")
    said = callback_entries(ahead, ["_type", "ocr_status", "updated_at"])
    found = said.select(
        "claim_id", "place", F.coalesce("entry.document_type", "_type").alias("document_type"), F.col("entry.source_file_name").alias("source_file_name"),
        F.coalesce("entry.all_extracted_entities", F.create_map().cast("map<string,string>")).alias("all_extracted_entities"),
        trailing_number(F.col("entry.source_file_name")).alias("sequence"), F.lower("ocr_status").alias("ocr_status"), claim_status(F.col("ocr_status")).alias("status"), "updated_at",
    )
    return apply_callbacks(claims, callbacks), merge_documents(stored, found, fields, keep)


def apply_callbacks(claims: DataFrame, callbacks: DataFrame) -> DataFrame:
    """Claims with the status of their latest callback."""
    said = latest(callbacks.select("claim_id", "ocr_status", "updated_at"), ["claim_id"], "updated_at", "ocr_status")
    joined = claims.join(said.select("claim_id", claim_status(F.col("ocr_status")).alias("_status")), "claim_id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).drop("_status")


def callback_entries(callbacks: DataFrame, more: list[str] | None = None) -> DataFrame:
    """claim_id, more, place, entry: the structured entries, else the raw ones, else one null entry as fallback."""
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    entries = F.coalesce(full("structured_entries"), full("raw_entries"))
    return callbacks.select("claim_id", *(more or []), F.posexplode_outer(entries).alias("place", "entry"))


def last_of(rows: DataFrame, key: str, fields: list[str], by: str) -> DataFrame:
    """key and _last: of each key the fields of its last row, by a column if there is one, else by the fields themselves."""
    turn = F.struct(*([by] if by in rows.columns else []), F.to_json(F.struct(*fields)))
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), turn).alias("_last"))


def set_status(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """Claims with changed statuses (claim_id, status, and changed_at if there is one: the last counts).

    Changes to statuses that may not be set are left out.
    """
    ok = last_of(changes.where(settable(F.col("status"))), "claim_id", ["status"], "changed_at")
    return claims.join(ok, "claim_id", "left").withColumn("status", F.coalesce("_last.status", "status")).drop("_last")


def failed_dispatch(claims: DataFrame, failures: DataFrame) -> DataFrame:
    """Claims whose dispatch failed (claim_id, message, and failed_at if there is one), as failed with the last message.

    Other claims keep their message; updated_at becomes failed_at where both are there.
    """
    when = [n for n in ("failed_at",) if n in failures.columns]
    joined = claims.join(last_of(failures, "claim_id", [*when, "message"], "failed_at"), "claim_id", "left")
    hit = F.col("_last").isNotNull()
    old = F.col("ocr_error_message") if "ocr_error_message" in claims.columns else F.lit(None).cast("string")
    new = {"status": F.when(hit, "failed").otherwise(F.col("status")), "ocr_error_message": F.when(hit, F.col("_last.message")).otherwise(old)}
    if when and "updated_at" in claims.columns:
        new["updated_at"] = F.when(hit, F.col("_last.failed_at")).otherwise(F.col("updated_at"))
    return joined.withColumns(new).drop("_last")


def delete_claims(claims: DataFrame, documents: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and documents without those of the given claims."""
    key = gone.select("claim_id")
    return claims.join(key, "claim_id", "left_anti"), documents.join(key, "claim_id", "left_anti")


def edit_entities(documents: DataFrame, edits: DataFrame, order: tuple[str, ...] | None = None) -> DataFrame:
    """Documents with edited entities (id, key, value, verified, remarks) set, and in review. One batch for many edits.

    Edits of one key count in the order of the given columns (place, or without it the value): of the value, and of each
    verified and remarks that is not null, the last stays.
    """
    turn = F.struct(*(order or (["place"] if "place" in edits.columns else ["value"])))
    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), turn)).alias(name)
    each = edits.groupBy("id", "key").agg(F.max_by("value", turn).alias("value"), last("verified"), last("remarks"))

    def given(name: str) -> Column:
        pairs = F.collect_list(F.when(F.col(name).isNotNull(), F.struct("key", F.col(name).alias("value"))))
        return F.map_from_entries(pairs)

    newest = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_values"), given("verified").alias("_verified"), given("remarks").alias("_remarks"))
    hit = F.col("_values").isNotNull()
    joined = documents.join(newest, "id", "left")
    laid = {n: F.when(hit, payloads.overlay(F.coalesce(F.col(n), F.create_map().cast(dict(documents.dtypes)[n])), F.col(e))).otherwise(F.col(n)) for n, e in (("all_extracted_entities", "_values"), ("entity_verification", "_verified"), ("entity_remarks", "_remarks"))}
    return joined.withColumns(laid | {"review_status": F.when(hit, "in_review").otherwise(F.col("review_status"))}).select(*documents.columns)


def replace_tables(documents: DataFrame, tables: DataFrame, tables_column: str = "all_extracted_tables") -> DataFrame:
    """Documents whose tables are replaced whole by those given (id, tables), and in review."""
    joined = documents.join(last_of(tables, "id", ["tables"], "changed_at").select("id", F.col("_last.tables").alias("_tables"), F.lit(True).alias("_hit")), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = {tables_column: F.when(hit, F.col("_tables")).otherwise(F.col(tables_column)), "review_status": F.when(hit, "in_review").otherwise(F.col("review_status"))}
    return joined.withColumns(new).select(*documents.columns)


def with_id(documents: DataFrame) -> DataFrame:
    """The store's own _id as a string named id."""
    return documents.withColumn("_id", F.col("_id").cast("string")).withColumnRenamed("_id", "id")


def remove_entity(documents: DataFrame, key: str) -> DataFrame:
    names = ("all_extracted_entities", "entity_verification", "entity_remarks")
    return documents.withColumns({n: payloads.remove_key(F.col(n), F.lit(key)) for n in names} | {"review_status": F.lit("in_review")})


def error_summaries(documents: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: the first error in order of id, the number of distinct errors, and whether any document is meaningful.

    documents: keys, id, status, entities, tables, llm_errors, errors, warning_errors.
    """
    found = payloads.payload_errors(F.col("llm_errors"), F.col("errors"), F.col("warning_errors"))
    each = documents.withColumns({"_errors": found, "_full": payloads.meaningful(F.col("status"), F.col("entities"), F.col("tables"))})
    first = F.min_by(F.get("_errors", F.lit(0)), F.when(F.size("_errors") > 0, F.col("id")))
    return each.groupBy(*keys).agg(first.alias("first_error"), F.sum(F.size("_errors")).alias("errors"), F.bool_or("_full").alias("meaningful"))


def final_statuses(runs: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Runs (key, merge_failed, extractor_failed, pages, message) with their terminal statuses and message."""
    joined = runs.join(error_summaries(documents, [key]), key, "left")
    wrong = F.coalesce(F.col("errors") > 0, F.lit(False))
    full = F.coalesce("meaningful", F.lit(False))
    status = terminal_status(F.col("merge_failed"), F.col("extractor_failed"), F.col("pages"), wrong, full)
    said = joined.withColumns({"_s": status, "error_message": F.coalesce("message", F.when(wrong, F.col("first_error")))})
    return said.select(key, "_s.ocr_status", "_s.mapping_status", "error_message")


def final_payloads(runs: DataFrame, documents: DataFrame, key: str, pages: DataFrame | None = None) -> DataFrame:
    """One row a run: its statuses, the documents' names and contents in order of name, and its pages, if given.

    documents: as for final_statuses, with name and payload. pages: key, page_number, route.
    """
    listed = F.sort_array(F.collect_list(F.struct("name", "payload")))
    out = final_statuses(runs, documents, key).join(documents.groupBy(key).agg(listed.alias("documents"), F.count("*").alias("total_documents")), key, "left")
    if pages is not None:
        rows = F.sort_array(F.collect_list(F.struct("page_number", "route")))
        out = out.join(pages.groupBy(key).agg(rows.alias("pages"), F.max("page_number").alias("total_pages")), key, "left")
    return out.withColumn("total_documents", F.coalesce("total_documents", F.lit(0)))


def of_path(callbacks: DataFrame) -> DataFrame:
    """Callbacks whose claim is the one they were sent to."""
    return callbacks.where(F.col("claim_id") == F.col("path_claim_id"))


def create_claims(claims: DataFrame, new: DataFrame) -> DataFrame:
    """Claims with new ones (claim_id, file_no, created_at) added as uploaded; other fields are null."""
    return claims.unionByName(new.withColumn("status", F.lit("uploaded")), allowMissingColumns=True)
