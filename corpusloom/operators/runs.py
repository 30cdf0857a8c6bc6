"""Training runs: filters, log parsing, utilisation, sorting, and sweeps of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hfu, mfu

# States of runs that have nothing to report.
UNFINISHED = ("FAILED_PULL", "PENDING", "QUEUED", "RUNNING", "SCHEDULED", "STARTING", "STOPPED", "STOPPING", "TERMINATING")


def named(runs: DataFrame, project: str, filters: tuple[str, ...] = ()) -> DataFrame:
    """Runs whose name holds the project and every filter."""
    kept = F.col("name").contains(project)
    for part in filters:
        kept &= F.col("name").contains(part)
    return runs.where(kept)


def finished(runs: DataFrame) -> DataFrame:
    return runs.where((F.upper("status") != "FAILED") & ~F.upper("status").isin(*UNFINISHED))


def last_match(lines, pattern: str, group: int = 1) -> Column:
    """The value in the last line that matches; null without one."""
    found = F.filter(lines, lambda x: x.rlike(pattern))
    return F.nullif(F.regexp_extract(F.try_element_at(found, F.lit(-1)), pattern, group), F.lit(""))


def first_match(lines, pattern: str, group: int = 1) -> Column:
    found = F.filter(lines, lambda x: x.rlike(pattern))
    return F.nullif(F.regexp_extract(F.try_element_at(found, F.lit(1)), pattern, group), F.lit(""))


def utilisation(runs: DataFrame) -> DataFrame:
    """Throughput, MFU and HFU of runs (gpu_num, n_params, n_layers, d_model, seq_len, global_batch, micro_batch,
    act_ckpt, samples_per_sec). Rows that lack a figure are kept with nulls in what hangs on it."""
    c = F.col
    args = [c(x).cast("double") for x in ("n_params", "n_layers", "d_model", "seq_len", "samples_per_sec", "gpu_num")]
    tokens = c("samples_per_sec") * c("seq_len")
    return runs.select(
        "*", F.try_divide(tokens, F.lit(1)).cast("long").alias("tokens_per_sec"), F.try_divide(tokens, c("gpu_num")).cast("long").alias("tokens_per_sec_gpu"),
        F.when(c("gpu_num") > 0, mfu(*args)).alias("mfu"), F.when(c("gpu_num") > 0, hfu(*args, c("act_ckpt"))).alias("hfu"), F.ceil(F.try_divide(F.try_divide(c("global_batch"), c("gpu_num")), c("micro_batch"))).alias("grad_accum"),
    )


def readable(runs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Runs that have all of ``needed``, and the others: a run that can't be read doesn't stop the report."""
    ok = F.lit(True)
    for name in needed:
        ok &= F.col(name).isNotNull()
    return runs.where(ok), runs.where(~ok)


def size_of(name: Column) -> tuple[Column, Column]:
    """Unit and number of a model's size in its name (``mpt-7b``); units other than m and b are an error."""
    number = F.regexp_extract(name, r"(\d+(?:\.\d+)?)([a-zA-Z])(?:-|_|$)", 1)
    unit = F.lower(F.regexp_extract(name, r"(\d+(?:\.\d+)?)([a-zA-Z])(?:-|_|$)", 2))
    return F.when(unit.isin("m", "b"), unit).otherwise(F.raise_error(F.concat(F.lit("no size in "), name))), number.try_cast("double")


def parameters(name: Column) -> Column:
    unit, number = size_of(name)
    return number * F.when(unit == "b", 1e9).otherwise(1e6)


def largest_first(runs: DataFrame) -> DataFrame:
    """By model size, sequence length, GPUs and batch, all descending."""
    unit, number = size_of(F.col("model"))
    return runs.withColumn("_u", F.when(unit == "b", 1).otherwise(0)).withColumn("_s", number).orderBy(F.desc("_u"), F.desc("_s"), F.desc("seq_len"), F.desc("gpu_num"), F.desc("global_batch")).drop("_u", "_s")


def fits_memory(runs: DataFrame, bytes_per_param: float, gpu_memory: float) -> DataFrame:
    """Without runs whose parameters and optimizer states exceed all GPUs' memory."""
    return runs.where(F.col("n_params") * bytes_per_param <= F.col("gpu_num") * gpu_memory)


def fits_batch(runs: DataFrame, micro: int = 1) -> DataFrame:
    """Without runs whose batch has less than a microbatch a GPU."""
    return runs.where(F.col("gpu_num") * micro <= F.col("global_batch"))


def run_name(project: Column, *parts: Column) -> Column:
    return F.substring(F.replace(F.concat_ws("-", project, *(p.cast("string") for p in parts)), F.lit("_"), F.lit("-")), 1, 47)


def sequence_lengths(spark, low: int = 9, high: int = 14) -> DataFrame:
    return spark.range(low, high + 1).select(F.pow(F.lit(2), "id").cast("long").alias("seq_len"))


def batches(lengths: DataFrame, sizes: list[int], low: int, high: int) -> DataFrame:
    """Batch sizes to try at each length: the given ones, and 2^n tokens' worth."""
    given = lengths.select("seq_len", F.explode(F.array(*(F.lit(s).cast("long") for s in sizes)) if sizes else F.expr("cast(array() as array<bigint>)")).alias("global_batch"))
    worth = lengths.select("seq_len", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("n")).select("seq_len", F.floor(F.pow(F.lit(2), "n") / F.col("seq_len")).alias("global_batch"))
    return given.unionAll(worth).where("global_batch > 0").distinct()


def gpu_counts(clusters: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(cluster, gpu_num): 1, 2, 4 … until the cluster's largest number of GPUs is reached or passed."""
    kept = clusters if wanted is None else clusters.where(F.col("gpu_type").isin(*wanted))
    most = kept.groupBy("cluster").agg(F.greatest(F.max("gpus"), F.lit(1)).alias("most"))
    return most.select("cluster", F.explode(F.sequence(F.lit(0), F.ceil(F.log2("most")).cast("int"))).alias("k")).select("cluster", F.pow(F.lit(2), "k").cast("long").alias("gpu_num"))


def limit_of(rows: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """The first limit set for each key; a key without one is an error where it is read."""
    first = limits.groupBy(key).agg(F.min_by("limit", "position").alias("limit"))
    joined = rows.join(F.broadcast(first), key, "left")
    return joined.withColumn("limit", F.when(F.col("limit").isNull(), F.raise_error(F.concat(F.lit("no limit for "), F.col(key).cast("string"))).cast("long")).otherwise(F.col("limit")))


def eval_batch(batch: Column, length: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), (batch / F.pow(length / 2048, 2)).cast("long"))


def sweep(*grids: DataFrame) -> DataFrame:
    """Every combination of a few settings; each grid is a handful of driver-made rows."""
    out = grids[0]
    for grid in grids[1:]:
        out = out.crossJoin(F.broadcast(grid))
    return out


def latency(times: DataFrame, warm_up: int, by: tuple[str, ...]) -> DataFrame:
    """Mean seconds a batch after the warm-up, tokens a second, and milliseconds an output token."""
    per = times.where(F.col("i") >= warm_up).groupBy(*by).agg(F.avg("seconds").alias("mean_seconds"))
    return per.withColumn("tokens_per_sec", F.try_divide(F.col("batch") * F.col("output_len"), F.col("mean_seconds"))).withColumn("ms_per_token", F.try_divide(F.col("mean_seconds") * 1000, F.col("output_len")))


def generation_totals(rows: DataFrame) -> DataFrame:
    """Tokens of inputs and outputs over (prompt_tokens, total_tokens, seconds); an output counts one token at least."""
    new = F.greatest(F.col("total_tokens") - F.col("prompt_tokens"), F.lit(1))
    return rows.agg(F.sum("prompt_tokens").alias("input_tokens"), F.sum(new).alias("output_tokens"), F.sum("seconds").alias("seconds")).withColumn("ms_per_output_token", F.try_divide(F.col("seconds") * 1000, F.col("output_tokens"))).withColumn("output_tokens_per_sec", F.try_divide("output_tokens", "seconds"))


def parameter_counts(parameters_: DataFrame) -> DataFrame:
    """Of (name, size, trainable): all, trainable, and the latter's percentage."""
    own = F.sum(F.when(F.col("trainable"), F.col("size")).otherwise(0))
    return parameters_.agg(F.sum("size").alias("n_params"), own.alias("n_trainable"), (100.0 * F.try_divide(own, F.sum("size"))).alias("percent"))
