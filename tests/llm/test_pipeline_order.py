"""The pipeline's packing follows the order in which mixing's files were written, not the order in which they are read."""

from __future__ import annotations

import corpus_pipeline


def test_packed_order_follows_range_sorted_files(spark, tmp_path):
    sizes, rows = (3, 40, 1, 90, 10, 200), []
    for part, n in enumerate(sizes):
        rows += [(len(rows) + i, part, "some words of a text " * (1 + part * 3)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, part int, text string")
    docs.repartitionByRange(6, "part").sortWithinPartitions("doc_id").drop("part").write.parquet(str(tmp_path / "mixed"))
    files = spark.read.parquet(str(tmp_path / "mixed"))
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)  # a partition for each file
    try:
        read = [r[0] for r in files.select("doc_id").collect()]
        assert read != sorted(read)  # the scan itself goes by file size
        packed = corpus_pipeline.pack(spark, files, "").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    order = [r["doc_id"] for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0]
    assert order == sorted(order) and len(order) == len(rows)
