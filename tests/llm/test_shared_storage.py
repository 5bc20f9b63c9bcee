"""Intermediate tables lie where all machines see them, and go when they are done with."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from foliant.llm import common


def session(master: str, setting: str | None, given: str | None):
    """As much of a session as shared_folder looks at."""
    conf = {"spark.checkpoint.dir": setting}
    directory = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, default=None: conf.get(k) or default, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master),
        _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: directory)),
    )


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(session(master, None, None))
        assert common.shared_folder(session(master, "hdfs://n/cp/", None)).startswith("hdfs://n/cp/foliant-")
        assert common.shared_folder(session(master, None, "hdfs://n/own")).startswith("hdfs://n/own/foliant-")
    alone = session("local[4]", None, None)
    assert common.shared_folder(alone).startswith("file:///") and alone.conf.get("spark.checkpoint.dir")


def test_materialized_tables_are_read_back_and_discarded(spark):
    df = common.materialize(spark.range(10).toDF("x"))
    files = df.inputFiles()
    assert files and df.count() == 10
    common.discard(df)
    on_disk, path = common.on_disk(spark, files[0].rpartition("/")[0])
    assert not on_disk.exists(path)


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Found int, found_ int")
    assert common.fresh(df, "found") == "found__" and common.fresh(df, "other") == "other"
