"""Writers: shards with a manifest, tables, texts, and metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import MANIFEST, _files, exists


def write_shards(df: DataFrame, root: str, split: str, rows_a_shard: int = 100_000, compression: str = "zstd") -> None:
    """``df`` as Parquet shards under ``root/split=<split>``, and its files' facts in ``root/_manifest``.

    A split that is there already is an error and nothing is written."""
    spark = df.sparkSession
    target = f"{root}/split={split}"
    if exists(spark, target):
        raise FileExistsError(f"{root} has the split {split} already")
    df.write.option("compression", compression).option("maxRecordsPerFile", rows_a_shard).parquet(target)
    system, place = _files(spark, target)
    sizes = {s.getPath().getName(): s.getLen() for s in system.listStatus(place) if s.getPath().getName().startswith("part-")}
    counts = spark.read.parquet(target).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).agg(F.count("*").alias("n"))
    n = dict(counts.toLocalIterator())
    facts = [(split, f"split={split}/{name}", size, n.get(name, 0), df.columns, compression, 1) for name, size in sorted(sizes.items())]
    spark.createDataFrame(facts, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/_manifest")


def write_both(df: DataFrame, first: str, second: str, keep_first: bool = True) -> None:
    """The same rows in two places: computed once, then copied."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(first)
    spark.read.parquet(first).write.mode("errorifexists").parquet(second)
    if not keep_first:
        system, place = _files(spark, first)
        system.delete(place, True)


def guard(df_spark, root: str, splits: list[str]) -> None:
    """An error if ``root`` holds any of the splits."""
    if there := [s for s in splits if exists(df_spark, f"{root}/split={s}")]:
        raise FileExistsError(f"{root} has {', '.join(there)} already")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A small result as a table for reading; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "|".join(" --- " for _ in df.columns) + "|"]
    return "\n".join(lines + ["| " + " | ".join(show(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows])


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One line a row: line breaks are written as a backslash and n."""
    df.select(F.replace(F.replace(F.col(column), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")).alias("value")).write.text(path)


def log_metrics(df: DataFrame, path: str) -> None:
    """Appends (model, key, step, value) to a metric log, a partition a model."""
    df.select("model", "key", "step", "value").write.mode("append").partitionBy("model").parquet(path)


def log_generations(df: DataFrame, path: str, every: int) -> None:
    """Appends (step, prompt, generation) of every N-th step."""
    df.where(F.col("step") % every == 0).select("step", "prompt", "generation").write.mode("append").parquet(path)


def due_checkpoints(steps: DataFrame, every: int) -> DataFrame:
    """Steps to save at: every N-th, and the last one if it isn't among them (``is_last`` marks it)."""
    from ..operators.series import due

    return due(steps, "step", every, "is_last")
