"""Attention masks and biases as tables of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attention_pairs(df: DataFrame, key: str, sequence: str, prefix: str | None = None, causal: bool = True) -> DataFrame:
    """(key, i, j): position i may attend to j. Both lie in one sequence (ids below 0 are padding), and j is not after i,
    unless i and j are both in the bidirectional prefix. Pairs come from each row's own arrays; rows aren't joined."""
    rows = df.select(key, F.col(sequence).alias("_s"), (F.col(prefix) if prefix else F.transform(sequence, lambda _: F.lit(0))).alias("_p"))
    rows = rows.select(key, "_s", "_p", F.posexplode("_s").alias("i", "_si")).where("_si >= 0")
    rows = rows.select(key, "i", "_si", F.get("_p", F.col("i")).alias("_pi"), F.posexplode(F.arrays_zip(F.col("_s").alias("s"), F.col("_p").alias("p"))).alias("j", "_x"))
    seen = (F.col("j") <= F.col("i")) | ((F.col("_pi") == 1) & (F.col("_x.p") == 1)) if causal else F.lit(True)
    return rows.where((F.col("_x.s") == F.col("_si")) & seen).select(key, "i", "j")


def bias_shape(impl: Column, heads: Column, length: Column, alibi: Column, prefix: Column, causal: Column, sequence_ids: Column) -> Column:
    """The shape of the bias that attention adds, or null where it needs none: by head where distances count, a row for
    every query where not all keys before it are seen alike. Fused kernels take none; unknown ones are an error."""
    one = F.lit(1).cast("long")
    heads, length, every = heads.cast("long"), length.cast("long"), prefix | sequence_ids
    rows = F.when(every | (alibi & ~causal), length).otherwise(one)
    shape = F.when(alibi | every, F.array(one, F.when(alibi, heads).otherwise(one), rows, length))
    return F.when(impl.isin("torch", "triton"), shape).when(impl != "flash", F.raise_error(F.concat(F.lit("unknown attention: "), impl)).cast("array<long>"))


def alibi_slopes(heads: int, bias_max: float = 8.0) -> list[float]:
    """A slope a head: powers of 2 evenly spaced down to ``2^-bias_max``; where heads aren't a power of two, those of the
    next power, every second one first."""
    full = 1 << (heads - 1).bit_length()
    every = [2.0 ** (-bias_max * (h + 1) / full) for h in range(full)]
    return every if full == heads else (every[1::2] + every[::2])[:heads]


def alibi(spark, heads: int, length: int, full: bool = False, bias_max: float = 8.0) -> DataFrame:
    """(head, i, j, bias): distance times slope; without ``full`` one row i serves all (causal)."""
    slopes = spark.createDataFrame([(h, s) for h, s in enumerate(alibi_slopes(heads, bias_max))], "head int, slope double")
    j = F.explode(F.sequence(F.lit(0), F.lit(length - 1)))
    if not full:
        return slopes.select("head", "slope", j.alias("j")).select("head", F.lit(0).alias("i"), "j", ((F.col("j") - (length - 1)) * F.col("slope")).alias("bias"))
    return slopes.select("head", "slope", j.alias("i")).select("head", "slope", "i", j.alias("j")).select("head", "i", "j", (-F.abs(F.col("i") - F.col("j")) * F.col("slope")).alias("bias"))
