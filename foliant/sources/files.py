"""Files that pages, classifications and payloads come in, and the tables they become.

Spark lists and reads the files, so they may lie in any store that Spark reads; names come from the file's metadata.
Texts lie one to a file, or, where Spark has written them for its own next step, many to a bundle: a Parquet file of
(name, content). The scans take both, also from one folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payloads import parse_tolerant
from ..functions.text import strip

PAGE_PAYLOAD = (
    "page_number int, document_type_classified string, "
    "global_metadata struct<patient_name:string,hospital_name:string,date:string,reference_or_claim_number:string>, "
    "all_extracted_entities map<string,string>, "
    "all_extracted_tables array<struct<table_name_or_purpose:string,headers:array<string>,rows:array<struct<date:string,time:string,amount:string,"
    "type:string,serial_no:string,medication_or_item_name:string,dosage_frequency:string>>>>, "
    "warnings struct<ignored_handwritten_content:array<string>,unmapped_ambiguous_text_regions:array<string>>"
)
#: The ending of bundles' names, as Spark's writer gives it.
BUNDLE = ".parquet"


def whole_texts(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, content: a row a file, bundles left out."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive).where(~F.endswith("_metadata.file_name", F.lit(BUNDLE)))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def bundled_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, name, content: a row a text of the bundles below the folder; its path is the bundle's and its name."""
    rows = spark.read.schema("name string, content string").parquet(path, pathGlobFilter=f"*{BUNDLE}", recursiveFileLookup=True)
    return rows.select(F.concat_ws("/", "_metadata.file_path", "name").alias("path"), "name", "content")


def page_number(path: str = "path") -> F.Column:
    """The number of page_<n> in the file's name, or, for files that Spark has named, in their folder's."""
    return F.nullif(F.regexp_extract(path, r"page_(\d+)[^/]*(?:/part-[^/]*)?$", 1), F.lit("")).cast("int")


def whole_files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """path, name, content of texts whose names have the ending: files, texts in bundles, and files that Spark has written into a folder with it.

    Such a folder is named <key>=<name>, one file in it; the line end that Spark's writer adds is taken off.
    """
    name = F.regexp_extract("path", r"([^/=]*)(?:/part-[^/]*)?$", 1)
    written = F.col("path").rlike("/part-[^/]*$")
    files = whole_texts(spark, path).withColumn("name", name).where(F.endswith("name", F.lit(ending)))
    loose = files.withColumn("content", F.when(written, F.regexp_replace("content", r"\n\z", "")).otherwise(F.col("content")))
    return loose.unionByName(bundled_texts(spark, path).where(F.endswith("name", F.lit(ending))))


def classifications(spark: SparkSession, path: str) -> DataFrame:
    """page_number, document_type, confidence_score; files that are no JSON object or have no page number are left out."""
    files = whole_files(spark, path, ".json")
    parsed = files.withColumn("p", F.from_json("content", "document_type string, confidence_score double, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    rows = parsed.where(F.col("p._corrupt_record").isNull() & F.col("p").isNotNull())
    kind = F.coalesce(F.nullif(F.lower(F.trim("p.document_type")), F.lit("")), F.lit("unknown"))
    return rows.select(page_number().alias("page_number"), kind.alias("document_type"), F.col("p.confidence_score").alias("confidence_score")).where(F.col("page_number").isNotNull())


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    return whole_files(spark, path, "_raw.txt").select(page_number().alias("page_number"), strip(F.col("content")).alias("text")).where(F.col("page_number").isNotNull())


def merged_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_type (the folder's name), name, content."""
    kind = F.regexp_extract("path", r"([^/=]*)/[^/]*?(?:/part-[^/]*)?$", 1)
    return whole_files(spark, path, "_raw.txt").select(kind.alias("document_type"), "name", "content").orderBy("document_type", "name")


def artifacts(spark: SparkSession, path: str, json_only: bool = False) -> DataFrame:
    """name, content, payload: payload is the content's JSON object, null if it has none."""
    files = whole_files(spark, path, ".json" if json_only else "")
    return files.select("name", "content", parse_tolerant(F.col("content")).alias("payload")).orderBy("name")


def page_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of raw_json_*.json that have a page number, a type, and the schema's shape; others are left out."""
    files = whole_files(spark, path, ".json").where(F.startswith("name", F.lit("raw_json_")))
    parsed = files.withColumn("p", F.from_json("content", PAGE_PAYLOAD + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    rows = parsed.where(F.col("p._corrupt_record").isNull()).select("p.*").drop("_corrupt_record")
    return rows.where(F.col("page_number").isNotNull() & F.col("document_type_classified").isNotNull())


def with_payloads(pages: DataFrame, payloads: DataFrame, key: str, out: str) -> DataFrame:
    """Pages with their payload by file name, null where there is none."""
    return pages.join(payloads.select(key, F.col("content").alias(out)), key, "left")


def write_texts(rows: DataFrame, path: str, folders: list[str], content: str = "content") -> None:
    """One text file a row below folders <column>=<value>; Spark's commit makes the files appear all at once.

    The last folder is the file's name as the scans above see it. Rows are dealt by folder, so each has one file.
    """
    rows.select(*folders, content).repartition(*folders).write.mode("overwrite").partitionBy(*folders).text(path)


def write_bundles(texts: DataFrame, path: str) -> None:
    """Named texts (name, content), many to a file: a task writes one bundle, so files and commits don't grow with the texts."""
    texts.select("name", "content").write.mode("overwrite").parquet(path)


def write_merged(batches: DataFrame, path: str) -> None:
    """Merged texts below one folder a document type, as merged_documents reads them."""
    write_texts(batches, path, ["document_type", "file_name"])


def write_pages(pages: DataFrame, path: str) -> None:
    """The text and the JSON payload of each page (page_number, text, payload) in bundles, as the page scans read them."""
    name = F.concat(F.lit("page_"), F.col("page_number").cast("string"))
    both = F.array(*[F.struct(F.concat(name, F.lit(ending)).alias("name"), F.col(c).alias("content")) for c, ending in (("text", "_raw.txt"), ("payload", ".json"))])
    write_bundles(pages.select(F.inline(F.filter(both, lambda t: t["content"].isNotNull()))), path)
