"""Problem 1: records of evaluation splits that also stand, exactly or almost, in training splits.

The hash of a record's word set (:func:`.nearsame.members`) joins evaluation with training records of the same words;
hashes alone cannot see edited records, so the near-same links between these classes extend that join. The canonical
hash, of the words in their order, then tells which pairs are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .nearsame import Near, links, members


def clean_split(split: Column) -> Column:
    """``./Val-Small/ `` -> ``val_small``; blank -> null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(split)), r"^[\s./\\]+|[\s./\\]+$", ""), r"[\s-]+", "_")
    return F.nullif(plain, F.lit(""))


def side(folder_split: Column, hf_split: Column) -> Column:
    """``train`` or ``eval``: the folder split decides, the hub's split where it is null; null where neither is known."""
    split = F.coalesce(clean_split(folder_split), clean_split(hf_split))
    return F.when(split.rlike("^train"), "train").when(split.rlike("^(val|test|eval|dev)"), "eval")


def records(examples: DataFrame) -> DataFrame:
    """(uid, source, split, side, text) of a finetuning table; other columns are not read."""
    return examples.select(
        F.col("example_id").alias("uid"),
        F.coalesce(F.trim("source"), F.lit("unknown")).alias("source"),
        F.coalesce(clean_split(F.col("folder_split")), clean_split(F.col("hf_split")), F.lit("unknown")).alias("split"),
        side(F.col("folder_split"), F.col("hf_split")).alias("side"),
        F.col("query").alias("text"),
    )


def overlaps(rows: DataFrame, p: Near = Near()) -> DataFrame:
    """Every pair of an ``eval`` and a ``train`` row whose texts are near-same, copies included.

    ``rows``: uid, source, split, side, text. Gives eval_uid, eval_source, eval_split, train_uid, train_source,
    train_split, exact (equal after normalisation, word by word in order). Rows with a null uid, side, or no words match nothing. The result
    holds every pair by definition; the search itself runs on classes of copies."""
    own = cut(members(rows.where("uid is not null and side is not null"), p, ordered=True))  # read on both sides
    found = links(rows.where("side is not null"), p)
    both = found.select("a", "b").unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    held = own.where("side = 'eval'").select(F.col("uid").alias("eval_uid"), F.col("source").alias("eval_source"), F.col("split").alias("eval_split"), "cls", F.col("seq").alias("eval_seq"))
    near = held.join(both, F.col("cls") == F.col("a")).select("eval_uid", "eval_source", "eval_split", F.col("b").alias("cls"), "eval_seq")
    trained = own.where("side = 'train'").select(F.col("uid").alias("train_uid"), F.col("source").alias("train_source"), F.col("split").alias("train_split"), "cls", F.col("seq").alias("train_seq"))
    return held.unionAll(near).join(trained, "cls").withColumn("exact", F.col("eval_seq") == F.col("train_seq")).drop("cls", "eval_seq", "train_seq")


def found(examples: DataFrame, p: Near = Near()) -> DataFrame:
    """p1_found: (id_a, id_b), the smaller id first."""
    pairs = overlaps(records(examples), p)
    return pairs.select(F.least("eval_uid", "train_uid").alias("id_a"), F.greatest("eval_uid", "train_uid").alias("id_b"))


def counts(examples: DataFrame, p: Near = Near()) -> DataFrame:
    """Per evaluation split and source: rows, rows found in training exactly and almost, pairs, and training sources met."""
    rows = records(examples)
    pairs = overlaps(rows, p)
    per_row = pairs.groupBy("eval_split", "eval_source", "eval_uid").agg(F.max("exact").alias("exact"), F.count("*").alias("n"))
    hit = per_row.groupBy("eval_split", "eval_source").agg(
        F.count_if("exact").alias("rows_exact"), F.count("*").alias("rows_overlapping"), F.sum("n").alias("pairs")
    )
    all_rows = rows.where("side = 'eval'").groupBy(F.col("split").alias("eval_split"), F.col("source").alias("eval_source")).agg(F.count("*").alias("eval_rows"))
    return all_rows.join(hit, ["eval_split", "eval_source"], "left").na.fill(0)
