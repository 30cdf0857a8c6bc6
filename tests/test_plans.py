"""Lineage cuts, their lifetimes, and partition counts."""

import os

import pytest

from corpusloom.plans import lineage, sizing


def test_tables_go_with_their_scope(spark):
    with lineage.scope():
        own = lineage.cut(spark.range(10))
        path = own._corpusloom_path
        assert own.count() == 10 and os.path.exists(path)
    assert not os.path.exists(path)
    lineage.drop(own)  # twice is no error


def test_no_machine_local_folder_on_several_processes(spark):
    class Unset:
        def __getattr__(self, name):
            return lambda *given: None if name == "get" else False if name == "isDefined" else self

    class Session:
        conf = Unset()
        sparkContext = Unset()

    Session.sparkContext.master = "local-cluster[2,1,1024]"
    Session.sparkContext._jsc = Unset()
    with pytest.raises(ValueError):
        lineage.shared_folder(Session())


def test_partitions_follow_the_size(spark, folder):
    least = int(spark.conf.get(sizing.PARTITIONS))
    df = spark.read.parquet(f"{folder}/documents.parquet")
    assert sizing.partitions(df) == least and sizing.partitions(df, 100, target=1000) > least
    assert sizing.partitions(spark.createDataFrame([(1,)], "a int"), 100) == least
    with sizing.shuffled_into(spark, 3):
        assert spark.conf.get(sizing.PARTITIONS) == "3"
    assert int(spark.conf.get(sizing.PARTITIONS)) == least


def test_few_files_are_spread(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id")
    wide = sizing.spread(df)
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and wide.count() == df.count()
    rows = spark.range(5)
    assert sizing.spread(rows) is rows
