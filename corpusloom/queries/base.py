"""Registration of queries and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import new_path

registered: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
sql: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(values, schema)

    def scratch(self) -> str:
        """A new folder in the shared one, for queries that write and read again; dropped with its scope."""
        return new_path(self.spark)


def query(oracle: str | None = None):
    """Registers ``function(tables)`` under its name, with its SQL."""

    def add(function: Callable[[Tables], DataFrame]):
        if function.__name__ in registered:
            raise ValueError(f"{function.__name__} is registered already")
        registered[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
        if oracle:
            sql[function.__name__] = oracle
        return function

    return add


def joined(array) -> Column:
    """An array as comma-separated text, which compares alike in all engines."""
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


#: Word tokens in SQL: the same md5 modulo as :func:`corpusloom.functions.tokenize.word_tokens`.
WORDS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '\S+'), lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT % 32764 + 4)"


def seeded(seed: str, key: str, *salt: str) -> str:
    """SQL of :func:`corpusloom.functions.scalars.row_seed`."""
    return f"('0x' || substr(md5('{seed}-' || {key}::VARCHAR || '{''.join('-' + x for x in salt)}'), 1, 7))::BIGINT"


def drawn(row: str, i: str, salt: int = 0) -> str:
    """SQL of :func:`corpusloom.functions.scalars.draw`."""
    a = f"(({row} + {i} * 2654435 + {salt * 40503}) % 2147483647)"
    b = f"(({a} * {a}) % 2147483647)"
    c = f"(({b} * 48271 + {a}) % 2147483647)"
    return f"(({c} * {c} + {b}) % 2147483647)"
