"""Connected components of a link table, by alternating large and small stars (Kiveris et al., 2014).

Each round is two aggregations and two joins over the links; no node's links are gathered in one place, so a node
with a third of all links only makes partial minima. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: distinct (u, v), u > v. Every node is tied to the least node it knows of."""
    if large:  # all neighbours count, the greater ones are moved
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = links.select(F.col("v").alias("k"), F.col("u").alias("n"))
        moved = moved.join(least, F.col("k") == F.col("u")).select("n", "m")
        return moved.where("n <> m").select(F.col("n").alias("u"), F.col("m").alias("v")).distinct()
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u")
    moved = moved.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.*")
    return moved.where("u <> m").select("u", F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each linked node's component; nodes without links don't occur.

    Nulls, loops and repeated links are ignored; an empty table gives an empty table."""
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null").where("u > v").distinct()
    links, before = cut(links), None
    while True:
        done = cut(_star(_star(links, True), False))
        state = done.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(links)
        links = done
        if state == before:
            break
        before = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(links.select("v", "v").distinct().toDF("node", "root"))
