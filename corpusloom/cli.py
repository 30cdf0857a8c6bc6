"""Command lines: conversion of texts and pairs to shards, packing profiles, run reports, score tables, and sweeps.

    python -m corpusloom.cli convert --path texts.jsonl --out-root out --split train --concat-tokens 2048 --eos-id 2
    python -m corpusloom.cli pairs --path records.jsonl --out-root out --split train --preprocessor alpaca
    python -m corpusloom.cli profile --path pairs.parquet --min 1.5 --max 8 --num 10 --batch 8 --length 2048
    python -m corpusloom.cli runs --path runs.jsonl --project base --filters 7b --out report.csv
    python -m corpusloom.cli scores --path metrics.jsonl --config scores.yaml gauntlet.weighting=EQUAL --out tables
    python -m corpusloom.cli sweep --config sweep.yaml project=speed gpu_nums=[8,16]

``scores`` reads (model, key, position, value) rows and a configuration ``gauntlet`` with ``weighting``,
``subtract_baseline``, ``rescale`` and ``categories``: lists of ``name`` and ``benchmarks`` (``name``, ``num_fewshot``,
``random_baseline``). ``sweep`` reads ``project``, ``models``, ``seq_len_exp`` (two exponents of 2), ``batch_sizes``,
``batch_size_exp``, ``microbatch_sizes`` and ``gpu_nums`` and gives every combination that divides evenly. Settings
given as ``key.key=value`` replace those of the file.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks, sources
from .functions import tokenize as K
from .operators import collate, concat, evalagg, packing, pairs, runs
from .plans import config
from .plans.lineage import scope


def _read(spark: SparkSession, path: str, format: str) -> DataFrame:
    return sources.json_rows(spark, path) if format == "json" else sources.lazy(spark, path, format)


def _tokens(args, text):
    return K.vocabulary_tokens(args.tokenizer)(text) if args.tokenizer else K.word_tokens(text)


def convert(spark: SparkSession, args) -> None:
    """Texts to shards: as bytes, or as token chunks of fixed length."""
    sinks.guard(spark, args.out_root, [args.split])
    rows = _read(spark, args.path, args.format)
    if args.truncate:
        rows = rows.orderBy(args.order).limit(args.truncate) if args.order else rows.limit(args.truncate)
    if not args.concat_tokens:
        sinks.write_shards(rows.select(F.encode("text", "UTF-8").alias("text")), args.out_root, args.split, args.shard_rows, args.compression)
        return
    bos, eos = tuple(args.bos_id), tuple(args.eos_id)
    K.Tokenizer().check_joins(" ".join(map(str, bos)), " ".join(map(str, eos)))
    order = args.order
    if not order:
        rows, order = rows.withColumn("_row", F.monotonically_increasing_id()), "_row"
    rows = rows.select(order, _tokens(args, F.col("text")).alias("tokens"))
    cut = concat.concat_chunks_no_wrap if args.no_wrap else concat.concat_chunks
    chunks = cut(rows, "tokens", order, args.concat_tokens, bos, eos).select("chunk_id", "tokens")
    sinks.write_shards(concat.to_bytes(chunks), args.out_root, args.split, args.shard_rows, args.compression)


def convert_pairs(spark: SparkSession, args) -> None:
    sinks.guard(spark, args.out_root, [args.split])
    rows = _read(spark, args.path, args.format)
    if not args.skip_preprocessing:
        rows = pairs.resolve(args.preprocessor)(rows)
    pairs.need(rows, "prompt", "response")
    sinks.write_shards(rows.select("prompt", "response"), args.out_root, args.split, args.shard_rows, args.compression)


def profile(spark: SparkSession, args) -> None:
    rows = _read(spark, args.path, args.format)
    if not args.order:
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
    ids = rows.select(F.col(args.order or "_row").alias("row"), _tokens(args, F.col("prompt")).alias("context"), _tokens(args, F.col("response")).alias("target"))
    inputs = collate.decoder_only(ids, args.length, 0, 2)
    print(sinks.markdown(packing.profile(inputs, "row", args.batch, args.length, packing.ratios(args.min, args.max, args.num, args.batch))))


def report(spark: SparkSession, args) -> None:
    found = runs.finished(runs.named(sources.runs(spark, args.path), args.project, tuple(args.filters)))
    lines = F.col("log_lines")
    found = found.withColumn("samples_per_sec", runs.last_match(lines, r"throughput/samples_per_sec: ([\d.]+)").try_cast("double")).withColumn("n_params", runs.first_match(lines, r"n_params: (\d+)").try_cast("double"))
    good, bad = runs.readable(found, ("samples_per_sec", "n_params", "seq_len", "gpu_num"))
    table = runs.largest_first(runs.utilisation(good)).drop("log_lines")
    sinks.write_csv(table, args.out) if args.out else print(sinks.markdown(table))
    for row in bad.select("name").limit(100).collect():
        print(f"left out, as figures are missing: {row['name']}")


def _settings(args) -> dict:
    given = config.from_dots(args.settings)
    return config.resolved(config.merged(sources.settings(args.config), given) if args.config else given)


def _put(table: DataFrame, out: str | None, name: str) -> None:
    sinks.write_csv(table, f"{out}/{name}") if out else print(sinks.markdown(table))


def scores(spark: SparkSession, args) -> None:
    """The table of all results and, with a ``gauntlet``, the leaderboard of its categories."""
    log, plan = _read(spark, args.path, args.format).select("model", "key", F.col("position").cast("long"), F.col("value").cast("double")), _settings(args)
    gauntlet = plan.get("gauntlet") or {}
    rows = [(c["name"], b["name"], str(b["num_fewshot"]), float(b.get("random_baseline") or 0.0)) for c in gauntlet.get("categories") or [] for b in c["benchmarks"]]
    benchmarks = spark.createDataFrame(rows, "category string, benchmark string, num_shot string, baseline double")
    _put(evalagg.result_table(log, benchmarks.groupBy("benchmark").agg(F.min("category").alias("category"))), args.out, "results")
    if rows:
        sizes = spark.createDataFrame([(k, int(v)) for k, v in (gauntlet.get("benchmark_sizes") or {}).items()], "name string, samples long")
        weighted = evalagg.weights(benchmarks, sizes if gauntlet.get("benchmark_sizes") else None, gauntlet.get("weighting", "EQUAL"))
        board = evalagg.gauntlet(log, weighted, gauntlet.get("subtract_baseline", True), gauntlet.get("rescale", True))
        _put(evalagg.leaderboard(board), args.out, "leaderboard")


def sweep(spark: SparkSession, args) -> None:
    """Runs of every model, length, batch, microbatch and number of GPUs that go together, with their names."""
    plan = _settings(args)
    if unknown := set(plan) - {"project", "models", "seq_len_exp", "batch_sizes", "batch_size_exp", "microbatch_sizes", "gpu_nums"}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    few = lambda name, kind, default: spark.createDataFrame([(x,) for x in plan.get(name) or default], f"{name} {kind}")
    low, high = plan.get("seq_len_exp") or (11, 11)
    batches = runs.batches(runs.sequence_lengths(spark, low, high), plan.get("batch_sizes") or [], *(plan.get("batch_size_exp") or (19, 19)))
    grid = runs.sweep(few("models", "string", ["base"]), batches, few("microbatch_sizes", "long", [1]), few("gpu_nums", "long", [8])).toDF("model", "seq_len", "global_batch", "micro_batch", "gpu_num")
    grid = grid.where("global_batch % gpu_num = 0 and (global_batch div gpu_num) % micro_batch = 0")
    named = grid.select(runs.run_name(F.lit(plan.get("project", "sweep")), *(F.col(c) for c in ("model", "gpu_num", "seq_len", "global_batch", "micro_batch"))).alias("name"), "*")
    _put(named.orderBy("model", "seq_len", "global_batch", "micro_batch", "gpu_num"), args.out, "sweep")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, function in (("convert", convert), ("pairs", convert_pairs), ("profile", profile), ("runs", report), ("scores", scores), ("sweep", sweep)):
        c = commands.add_parser(name)
        c.set_defaults(function=function)
        if name in ("scores", "sweep"):
            c.add_argument("--config")
            c.add_argument("--out", help="a folder for CSV tables; printed without one")
            c.add_argument("settings", nargs="*", help="key.key=value")
        if name == "sweep":
            continue
        c.add_argument("--path", required=True)
        c.add_argument("--format", default="json")
        c.add_argument("--order")
        c.add_argument("--tokenizer", help="a public vocabulary file; words are hashed without one")
        if name in ("convert", "pairs"):
            c.add_argument("--out-root", required=True)
            c.add_argument("--split", default="train")
            c.add_argument("--compression", default="zstd")
            c.add_argument("--shard-rows", type=int, default=100_000)
        if name == "convert":
            c.add_argument("--concat-tokens", type=int)
            c.add_argument("--bos-id", type=int, nargs="*", default=[])
            c.add_argument("--eos-id", type=int, nargs="*", default=[])
            c.add_argument("--no-wrap", action="store_true")
            c.add_argument("--truncate", type=int, help="only the first rows, as in a small split")
        if name == "pairs":
            c.add_argument("--preprocessor")
            c.add_argument("--skip-preprocessing", action="store_true")
        if name == "profile":
            c.add_argument("--min", type=float, default=1.5)
            c.add_argument("--max", type=float, default=10.0)
            c.add_argument("--num", type=int, default=10)
            c.add_argument("--batch", type=int, required=True)
            c.add_argument("--length", type=int, required=True)
        if name == "runs":
            c.add_argument("--project", required=True)
            c.add_argument("--filters", nargs="*", default=[])
            c.add_argument("--out")
    args = parser.parse_args(argv)
    with scope():
        args.function(SparkSession.builder.appName("corpusloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
