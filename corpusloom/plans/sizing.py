"""Numbers of shuffle partitions from the size of the input, for plans whose shuffles grow with it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PARTITIONS = "spark.sql.shuffle.partitions"
UNKNOWN = 1 << 50  # the planner's size of a source it knows nothing about is larger


def planned(df: DataFrame) -> int:
    """Bytes that the planner expects of ``df``; ``UNKNOWN`` or more where it can't tell."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions(df: DataFrame, factor: float = 1.0, target: int = 64 << 20, most: int = 100_000) -> int:
    """Partitions of about ``target`` bytes for a shuffle of ``factor`` times the bytes that the planner expects of ``df``;
    the session's own number where that is more, or the size isn't known."""
    least = int(df.sparkSession.conf.get(PARTITIONS))
    size = planned(df)
    return least if size >= UNKNOWN else max(least, min(most, int(size * factor / target) + 1))


@contextmanager
def shuffled_into(spark: SparkSession, number: int) -> Iterator[None]:
    """Plans that run inside shuffle into ``number`` partitions, which adaptive execution still joins or splits."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(number))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read from fewer files than there are: for operators whose work a byte is worth
    a shuffle of the input. Tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
