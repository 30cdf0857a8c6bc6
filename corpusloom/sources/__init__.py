"""Readers: files, folders, shards with a manifest, prompts, and split catalogues."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import draw, row_seed
from pyspark.sql import types as T

ICL_SCHEMA = "query string, choices array<string>, gold long, context string, continuation string, answer string, aliases array<string>, context_options array<string>, category string"
FORMATS = (("jsonl", "json"), ("csv", "csv"), ("parquet", "parquet"))  # in the order they are looked for


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _files(spark, path)
    return system.exists(place)


def lazy(spark: SparkSession, path: str, format: str = "parquet", schema: str | T.StructType | None = None, **options) -> DataFrame:
    """Any format with its options; with a schema nothing is read ahead."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON-lines file, or all files directly in a folder; sub-folders are not entered."""
    reader = spark.read.option("recursiveFileLookup", False)
    return (reader.schema(schema) if schema else reader).json(path)


def probe(spark: SparkSession, folder: str, split: str, schema: str | None = None) -> DataFrame:
    """The first of split.jsonl, split.csv and split.parquet there is; none is an error."""
    for ending, format in FORMATS:
        path = f"{folder}/{split}.{ending}"
        if exists(spark, path):
            return lazy(spark, path, format, schema, **({"header": "true", "multiLine": "true", "escape": '"'} if format == "csv" else {}))
    raise FileNotFoundError(f"{folder}/{split} with ending {', '.join(e for e, _ in FORMATS)}")


def shards(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """A data set written by :func:`corpusloom.sinks.write_shards`; a split is one partition folder. Sizes of its files
    are checked against the manifest, and a missing or changed one is an error."""
    manifest = spark.read.schema(MANIFEST).json(f"{root}/_manifest")
    wanted = manifest if split is None else manifest.where(F.col("split") == split)
    system, place = _files(spark, root)
    for row in wanted.select("file", "bytes").toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(place, row["file"])
        if not system.exists(path) or system.getFileStatus(path).getLen() != row["bytes"]:
            raise FileNotFoundError(f"shard {row['file']} is missing or changed")
    if split is not None and not exists(spark, f"{root}/split={split}"):
        raise FileNotFoundError(f"{root} has no split {split}")
    rows = spark.read.parquet(root)
    return rows if split is None else rows.where(F.col("split") == split).drop("split")


MANIFEST = "split string, file string, bytes long, rows long, columns array<string>, compression string, version int"


def tokens_or_text(df: DataFrame, tokenize: Callable, length: int) -> DataFrame:
    """Rows of a training set as token arrays: texts are tokenised, token bytes decoded, both cut to ``length``."""
    from ..operators.concat import from_bytes

    if "text" in df.columns:
        return df.withColumn("tokens", F.slice(tokenize(F.col("text")), 1, length)).drop("text")
    if "tokens" in df.columns:
        return from_bytes(df, "tokens", length) if df.schema["tokens"].dataType == T.BinaryType() else df.withColumn("tokens", F.slice("tokens", 1, length))
    raise RuntimeError("a sample needs a text or tokens column")


def encoded(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, as UTF-8 bytes."""
    return df.select(*(F.encode(F.col(c), "UTF-8").alias(c) for c in columns))


def prompt(spark: SparkSession, given: str) -> DataFrame:
    """One row ``prompt``: the literal, or the whole file behind ``file::``."""
    if given.startswith("file::"):
        return spark.read.text(given[6:], wholetext=True).select(F.col("value").alias("prompt"))
    return spark.createDataFrame([(given,)], "prompt string")


def prompt_lines(spark: SparkSession, path: str | None, most: int, default: str = "<|endoftext|>") -> DataFrame:
    """The first ``most`` lines of a file in order; one default line without a file."""
    if path is None:
        return spark.createDataFrame([(0, default)], "line_no long, prompt string")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line_no", "prompt"))
    return lines.select(F.col("line_no").cast("long"), "prompt").orderBy("line_no").limit(most)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """A run catalogue with its log lines, from JSON lines."""
    schema = "name string, status string, model string, gpu_num long, gpu_type string, seq_len long, global_batch long, micro_batch long, n_layers long, d_model long, act_ckpt boolean, log_lines array<string>"
    return spark.read.schema(schema).json(path)


def icl_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items of any task type from JSON lines, with the line's number within its file."""
    return spark.read.schema(ICL_SCHEMA).json(path)


def synthetic(spark: SparkSession, rows: int, length: int, vocabulary: int, seed: int = 0) -> DataFrame:
    """Random token rows with full masks, for measuring; a function of seed and row."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: draw(row_seed(seed, "id", "synthetic"), i) % vocabulary)
    return spark.range(rows).select(F.col("id").alias("row_id"), ids.alias("input_ids"), F.array_repeat(F.lit(1), length).alias("attention_mask"))


def settings(path: str) -> dict:
    """A configuration file, local or at an http(s) address: JSON, or the plain subset of YAML that configurations use
    where no YAML library is there. Addresses are tried three times."""
    from ..plans.config import retried

    def fetched() -> str:
        with urlopen(path, timeout=30) as answer:
            return answer.read().decode("utf-8")

    if path.startswith(("https://", "http://")):
        text = retried(fetched, errors=(OSError,))
    else:
        with open(path, encoding="utf-8") as file:
            text = file.read()
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        pass
    from ..plans.config import parse_yaml

    return parse_yaml(text)


def split_constants(splits: DataFrame, dataset: str, split: str) -> dict:
    """The constants of one split of a data set; an unknown one is a KeyError."""
    row = splits.where((F.col("dataset_name") == dataset) & (F.col("folder_split") == split)).limit(1).collect()
    if not row:
        raise KeyError(f"{dataset} has no split {split}")
    return row[0].asDict()
