"""Problem 2: groups of records that differ from one another only by small edits, insertions or reordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .nearsame import Near, links, members


def groups(rows: DataFrame, p: Near = Near()) -> DataFrame:
    """One row per record (uid, text) that has words: uid, cls (equal for copies), group_id, links (of its class).

    Records are in one group when their classes are linked by a chain of near-same classes; every record without a
    link is its own class's group. Null uids and wordless texts are left out."""
    found = links(rows, p)
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    roots = components(found).join(ends, "node", "left")
    own = members(rows.select("uid", "text").where("uid is not null"), p)
    return own.join(roots, F.col("cls") == F.col("node"), "left").select("uid", "cls", F.coalesce("root", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def found(rows: DataFrame, p: Near = Near()) -> DataFrame:
    """p2_found: every pair of records in one group, the smaller id first. It holds all pairs by definition."""
    own = groups(rows, p).select("uid", "group_id")
    x, y = own.alias("x"), own.alias("y")
    pairs = x.join(y, (F.col("x.group_id") == F.col("y.group_id")) & (F.col("x.uid") < F.col("y.uid")))
    return pairs.select(F.col("x.uid").alias("id_a"), F.col("y.uid").alias("id_b"))


def both_tables(examples: DataFrame, items: DataFrame) -> DataFrame:
    """The records of both tables as (uid, text)."""
    return examples.select(F.col("example_id").alias("uid"), F.col("query").alias("text")).unionAll(items.select(F.col("item_id").alias("uid"), F.col("query").alias("text")))
