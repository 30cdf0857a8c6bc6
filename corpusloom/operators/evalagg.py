"""Benchmark scores: parsing metric keys, rolling up subtasks, categories and averages, leaderboards.

A metric log is (model, key, position, value): ``position`` is the order in which keys were logged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = r"^metrics/(.*?)/(\d+)-shot(/.*?)?/InContextLearning(.*)"  # fixed value


def parsed(log: DataFrame) -> DataFrame:
    """Rows whose key names an in-context metric, with benchmark, num_shot (a string), subtask (null if none) and metric."""
    part = lambda i: F.regexp_extract("key", KEY, i)
    return log.where(F.col("key").rlike(KEY)).select("*", part(1).alias("benchmark"), part(2).alias("num_shot"), F.nullif(F.substring(part(3), 2, 1 << 30), F.lit("")).alias("subtask"), part(4).alias("metric"))


def averaged(log: DataFrame) -> DataFrame:
    """(model, benchmark, num_shot, metric, value, position): subtasks' mean.

    A key without a subtask replaces all that came before it under its name; subtasks after it count together with it."""
    rows = parsed(log)
    key = ["model", "benchmark", "num_shot", "metric"]
    w = Window.partitionBy(*key)
    rows = rows.withColumn("_last", F.max(F.when(F.col("subtask").isNull(), F.col("position"))).over(w)).where(F.col("_last").isNull() | (F.col("position") >= F.col("_last")))
    return rows.groupBy(*key).agg(F.avg("value").alias("value"), F.min("position").alias("position"))


def weights(benchmarks: DataFrame, sizes: DataFrame | None, weighting: str = "EQUAL") -> DataFrame:
    """``benchmarks`` (category, benchmark, num_shot, baseline) with their weight: 1, their samples, or log2 of these.

    Samples are those of all keys that begin with ``benchmark/shots-shot``, 1 at least."""
    if weighting == "EQUAL":
        return benchmarks.withColumn("weight", F.lit(1.0))
    if sizes is None or weighting not in ("SAMPLE_SZ", "LOG_SAMPLE_SZ"):
        raise ValueError("weighting is EQUAL, or SAMPLE_SZ or LOG_SAMPLE_SZ with benchmark sizes")
    name = F.concat("benchmark", F.lit("/"), "num_shot", F.lit("-shot"))
    keyed = sizes.withColumn("_head", F.regexp_extract("name", r"^(.*?/\d+-shot)", 1)).groupBy("_head").agg(F.sum("samples").alias("_n"))  # the prefix as an equality
    rows = benchmarks.join(keyed, name == F.col("_head"), "left").withColumn("_n", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)).cast("double")).drop("_head")
    return rows.withColumn("weight", F.col("_n") if weighting == "SAMPLE_SZ" else F.greatest(F.log2("_n"), F.lit(1.0))).drop("_n")


def gauntlet(log: DataFrame, benchmarks: DataFrame, subtract_baseline: bool = True, rescale: bool = True) -> DataFrame:
    """(model, category, score) of every category, 0 for one without results, and the mean of them as category ``average``.

    ``benchmarks`` is weighted (see ``weights``). A benchmark's score is its first accuracy logged; benchmarks without
    one are left out of their category."""
    if rescale and not subtract_baseline:
        raise ValueError("rescaling needs the baseline subtracted")
    scores = averaged(log).where(F.col("metric").contains("Accuracy")).groupBy("model", "benchmark", "num_shot").agg(F.min_by("value", "position").alias("value"))
    rows = scores.join(F.broadcast(benchmarks), ["benchmark", "num_shot"])  # the configuration of the gauntlet
    score = F.col("value") - F.col("baseline") if subtract_baseline else F.col("value")
    rows = rows.withColumn("score", score / (1 - F.col("baseline")) if rescale else score)
    per = rows.groupBy("model", "category").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"))
    every = log.select("model").distinct().join(F.broadcast(benchmarks.select("category").distinct()))
    full = every.join(per, ["model", "category"], "left").na.fill(0.0, ["score"])
    return full.unionByName(full.groupBy("model").agg(F.avg("score").alias("score")).withColumn("category", F.lit("average")))


def leaderboard(scores: DataFrame) -> DataFrame:
    """One row a model, categories as columns in order of name, best average first."""
    categories = sorted(r[0] for r in scores.select("category").distinct().limit(1001).collect())
    if len(categories) > 1000:
        raise ValueError("more than 1000 categories")
    wide = scores.groupBy("model").agg(*(F.max(F.when(F.col("category") == c, F.col("score"))).alias(c) for c in categories))
    return wide.orderBy(F.desc("average"), "model")


def result_table(log: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Category, benchmark, subtask, accuracy, num_shot and model. A metric without subtasks gives one row; one
    with several gives an Average row and then a row each, which name the subtask only."""
    rows = parsed(log).withColumn("subtask", F.coalesce("subtask", F.lit("no_subcat")))
    key = ["model", "num_shot", "benchmark", "metric"]
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    rows = rows.join(F.broadcast(taxonomy), "benchmark", "left").withColumn("category", F.coalesce("category", F.lit("")))
    columns = ["category", "benchmark", "subtask", "accuracy", "num_shot", "model"]
    one = rows.where("_n = 1").withColumn("subtask", F.lit(None).cast("string")).withColumn("accuracy", F.col("value")).select(*columns)
    several = rows.where("_n > 1")
    mean = several.groupBy(*key, "category").agg(F.avg("value").alias("accuracy")).withColumn("subtask", F.lit("Average")).select(*columns)
    each = several.withColumn("benchmark", F.lit(None).cast("string")).withColumn("accuracy", F.col("value")).select(*columns)
    return one.unionByName(mean).unionByName(each)


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Results of several models, one after another."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def in_order(groups: list[DataFrame], label: str, order: str) -> DataFrame:
    """(position, label): the labels of each table by their first row, table after table. Labels are few: evaluators."""
    every = None
    for i, rows in enumerate(groups):
        one = rows.groupBy(label).agg(F.min(order).alias("_first")).select(F.lit(i).alias("_part"), label, "_first")
        every = one if every is None else every.unionAll(one)
    return every.select((F.row_number().over(Window.orderBy("_part", "_first", label)) - 1).cast("long").alias("position"), label)
