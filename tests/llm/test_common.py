"""The shared folder, staged tables and joins of hot keys."""

import os
from types import SimpleNamespace

import pytest
from assayframe.llm import common
from pyspark.sql import functions as F


def session(master, folder=None):
    held = {"spark.checkpoint.dir": folder}
    conf = SimpleNamespace(get=lambda k, d=None: held.get(k) or d, set=held.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_the_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_folder(session(master))
        assert common.shared_folder(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_folder(session("local[8]")) == common.shared_folder(session("local")) != ""


def test_staged_and_released(spark):
    table = common.staged(spark.range(5), "some")
    path = common._PATHS[table].removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(path)
    common.release(table, spark.range(1))
    assert not os.path.exists(path)
    common.release(table)


def test_spread_join(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i, "x") for i in range(300)] + [(None, 1, "x")], "k string, i long, salt string")
    table = spark.createDataFrame([("hot", 1), ("k3", 2), (None, 9)], "k string, v long")
    got = common.spread_join(rows, "k", "i", table)
    assert got.columns == ["k", "i", "salt", "v"] and got.count() == 301
    assert got.where("v = 1").count() == 200 and got.where("v = 2").count() == 1 and got.where(F.col("v").isNull()).count() == 100
