"""Metric series: differences, delayed averages, outliers, and reductions over ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differences(df: DataFrame, metric: str, step: str, value: str, losses: tuple[str, ...] = ("loss",)) -> DataFrame:
    """``fdiff``: a value less the one before, per metric. A metric's first has none; a loss has none after 0 either."""
    before = F.lag(value).over(Window.partitionBy(metric).orderBy(step))
    return df.withColumn("fdiff", F.when(before.isNotNull() & (~F.col(metric).isin(*losses) | (before != 0)), F.col(value) - before))


def delayed_mean(df: DataFrame, by: str, step: str, value: str, delay: int) -> DataFrame:
    """``mva``: the mean of ``delay`` values that end ``delay`` before the current one; null until there are any."""
    return df.withColumn("mva", F.avg(value).over(Window.partitionBy(by).orderBy(step).rowsBetween(-(2 * delay - 1), -delay)))


def outliers(df: DataFrame, by: str, step: str, value: str, delay: int, threshold: float) -> DataFrame:
    """``mva`` and ``outlier``: a value above ``threshold`` times its delayed mean; never without history."""
    return delayed_mean(df, by, step, value, delay).withColumn("outlier", F.coalesce(F.col(value) > threshold * F.col("mva"), F.lit(False)))


def penalised(df: DataFrame, by: str, step: str, timeout: int, penalty: float, least: float, rate: float) -> DataFrame:
    """``lr``: the rate, less ``penalty`` for each outlier of the last ``timeout`` steps, at least ``least`` of it."""
    recent = F.sum(F.col("outlier").cast("int")).over(Window.partitionBy(by).orderBy(step).rangeBetween(-timeout, 0))
    return df.withColumn("n_outliers", recent).withColumn("lr", F.lit(rate) * F.greatest(F.lit(least), F.pow(F.lit(penalty), "n_outliers")))


def clipped(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """``clipped``: outliers brought down to ``threshold`` times the delayed mean."""
    return df.withColumn("clipped", F.when(F.col("outlier"), F.col("mva") * threshold).otherwise(F.col(value)))


def sliding(df: DataFrame, by: str, step: str, value: str, width: int) -> DataFrame:
    """``speed``: the mean of the last ``width`` values."""
    return df.withColumn("speed", F.avg(value).over(Window.partitionBy(by).orderBy(step).rowsBetween(-(width - 1), 0)))


def reduced(df: DataFrame, world: int) -> DataFrame:
    """(metric, value) over the ranks' (rank, metric, value): norms add in squares; cosines are weighted by the norms of
    their two sides; layer rates stay as they are, of the lowest rank; all else is the mean.

    A metric is named ``kind/tensor``; a cosine ``cosine/a_b/tensor`` has its norms under ``l2_norm/a/tensor`` and
    ``l2_norm/b/tensor``."""
    kind = F.get(F.split("metric", "/"), F.lit(0))
    rows = df.withColumn("_kind", kind)
    norms = rows.where("_kind = 'l2_norm'")
    total = norms.groupBy("metric").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"))
    mean = rows.where("_kind not in ('l2_norm', 'cosine', 'layerwise_lr')").groupBy("metric").agg((F.sum("value") / world).alias("value"))
    rate = rows.where("_kind = 'layerwise_lr'").groupBy("metric").agg(F.min_by("value", "rank").alias("value"))
    parts = F.split("metric", "/")
    cosines = rows.where("_kind = 'cosine'").withColumn("_sides", F.split(F.get(parts, F.lit(1)), "_")).withColumn("_a", F.concat(F.lit("l2_norm/"), F.get("_sides", F.lit(0)), F.lit("/"), F.get(parts, F.lit(2)))).withColumn("_b", F.concat(F.lit("l2_norm/"), F.get("_sides", F.lit(1)), F.lit("/"), F.get(parts, F.lit(2))))
    own = norms.select(F.col("rank"), F.col("metric").alias("_m"), F.col("value").alias("_n"))
    pair = cosines.join(own.withColumnsRenamed({"_m": "_a", "_n": "_na"}), ["rank", "_a"]).join(own.withColumnsRenamed({"_m": "_b", "_n": "_nb"}), ["rank", "_b"])
    top = pair.groupBy("metric", "_a", "_b").agg(F.sum(F.col("value") * F.col("_na") * F.col("_nb")).alias("_dot"))
    whole = top.join(total.withColumnsRenamed({"metric": "_a", "value": "_wa"}), "_a").join(total.withColumnsRenamed({"metric": "_b", "value": "_wb"}), "_b")
    cosine = whole.select("metric", F.try_divide(F.col("_dot"), F.col("_wa") * F.col("_wb")).alias("value"))
    return total.unionByName(mean).unionByName(rate).unionByName(cosine)


def due(df: DataFrame, step: str, every: int, last: str | None = None) -> DataFrame:
    """Rows at every N-th step; with ``last`` (a flag), the final one, too, if it isn't one of these."""
    kept = F.col(step) % every == 0
    return df.where(kept | (F.col(last) & ~kept) if last else kept)
