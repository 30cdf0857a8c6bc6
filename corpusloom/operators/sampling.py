"""Seeded shuffles, samples, mixtures and splits; all are functions of seed and row key, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(key, seed: int, portable: bool = False) -> Column:
    """A seeded number for a row key, 0 or more. ``portable`` uses md5, which other engines have, too."""
    if portable:
        return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("long")
    return F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << 63) - 1))


def shuffled(df: DataFrame, key: str, seed: int = 9176, portable: bool = False) -> DataFrame:
    """A seeded order, by range partitions of the hash; ``shuffle_key`` makes it explicit."""
    return df.withColumn("shuffle_key", hashed(key, seed, portable)).orderBy("shuffle_key", key)


def chosen(key, number: int, seed: int = 0, portable: bool = False) -> Column:
    """One of ``number`` choices for each row."""
    return F.pmod(hashed(key, seed, portable), F.lit(number)).cast("int")


def truncated(df: DataFrame, order: str, number: int) -> DataFrame:
    """The first ``number`` rows in order: a top-k, not a full sort."""
    return df.orderBy(order).limit(number)


def first_batches(df: DataFrame, number: int, batch: str = "batch_id") -> DataFrame:
    """Rows of the first ``number`` batches; all for -1."""
    return df if number < 0 else df.where(F.col(batch) < number)


def mixture(streams: dict[str, DataFrame]) -> DataFrame:
    """Rows of all streams with the stream's name."""
    out = None
    for name, df in streams.items():
        own = df.withColumn("stream", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def weighted(df: DataFrame, stream: str, key: str, shares: dict[str, float], total: int, seed: int = 0, portable: bool = False) -> DataFrame:
    """``total`` rows drawn in given shares: each stream's rows in seeded order, gone through as often as its quota asks.

    ``draws`` says how often a row is drawn; a row is not repeated physically. Ranks within a stream come from counts of
    hash buckets and ranks within them, so a large stream isn't sorted in one task."""
    whole = sum(shares.values())
    quota = F.create_map(*(x for name, share in shares.items() for x in (F.lit(name), F.lit(int(total * share / whole)).cast("long"))))
    rows = df.where(F.col(stream).isin(*shares)).withColumn("_h", hashed(key, seed, portable)).withColumn("_q", quota[F.col(stream)])
    rows = rows.withColumn("_b", F.shiftright("_h", (48 if portable else 63) - 8))  # in order of the hash
    parts = rows.groupBy(stream, "_b").agg(F.count("*").alias("_n"))
    before = parts.select(stream, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(stream).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(stream)).alias("_all"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(stream, "_b").orderBy("_h", key)) - 1).join(F.broadcast(before), [stream, "_b"])  # streams x 256 rows
    ranked = ranked.withColumn("_r", F.col("_r") + F.col("_before"))
    draws = F.floor(F.col("_q") / F.col("_all")) + (F.col("_r") < F.col("_q") % F.col("_all")).cast("long")
    return ranked.withColumn("draws", draws).where("draws > 0").drop("_h", "_q", "_b", "_before", "_all", "_r")


def shard(df: DataFrame, key: str, world: int) -> DataFrame:
    """``rank``: the worker of each row, in turns."""
    return df.withColumn("rank", F.pmod(F.col(key), F.lit(world)).cast("int"))


def nucleus(df: DataFrame, by: str, token: str, logit: str, top_k: int | None = None, top_p: float | None = None, temperature: float = 1.0) -> DataFrame:
    """Tokens that sampling may still pick at each position, with their probability: the ``top_k`` likeliest, then the
    fewest that reach ``top_p``."""
    w = Window.partitionBy(by)
    order = w.orderBy(F.desc(logit), token)
    rows = df.withColumn("_rank", F.row_number().over(order))
    if top_k:
        rows = rows.where(F.col("_rank") <= top_k)
    rows = rows.withColumn("_e", F.exp((F.col(logit) - F.max(logit).over(w)) / temperature)).withColumn("p", F.col("_e") / F.sum("_e").over(w))
    if top_p:
        rows = rows.withColumn("_before", F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where(F.col("_before") < top_p).drop("_before")
        rows = rows.withColumn("p", F.col("p") / F.sum("p").over(w))
    return rows.drop("_rank", "_e")
