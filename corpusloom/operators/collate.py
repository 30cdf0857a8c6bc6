"""Tokenised pairs to model inputs, batches of equal length, and trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import IGNORED, decoder_inputs, filled, padded, stripped, with_eos

RESERVED = {"input_ids", "labels", "attention_mask", "bidirectional_mask", "decoder_input_ids", "decoder_attention_mask", "sequence_id", "batch_id", "pos"}


def _long(*values: int) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def decoder_only(df: DataFrame, length: int, pad: int, eos: int, side: str = "left", separator: tuple[int, ...] = (), generation: bool = False, context: str = "context", target: str = "target") -> DataFrame:
    """Context and target joined, cut and padded to ``length``, with labels and masks.

    Rows whose context, separator included, fills the length are dropped. A target that is too long keeps its *last*
    tokens, the last of them replaced by the end id. For generation, input and labels stay apart and are padded with the
    pad id; labels are then as long as the target leaves room for."""
    c, t = F.col("_c"), F.col("_t")
    rows = df.withColumn("_c", stripped(context, pad)).withColumn("_t", with_eos(stripped(target, pad), eos))
    if separator:
        rows = rows.withColumn("_c", F.concat(c, _long(*separator)))
    rows = rows.where(F.size("_c") < length)
    room = F.lit(length) - F.size(c)
    long_ = F.size(t) > room
    rows = rows.withColumn("_t", F.when(long_, F.concat(F.slice(t, F.when(long_, F.size(t) - room + 1).otherwise(F.lit(1)), F.greatest(room - 1, F.lit(0))), _long(eos))).otherwise(t))
    kept = [x for x in df.columns if x not in (context, target)]
    if generation:
        inputs, labels = padded(c, length, pad, side), padded(t, length, pad, side)
        ones = F.array_repeat(F.lit(1), F.size(c))
        zeros = filled(F.lit(0), F.lit(length) - F.size(c))
        mask = F.concat(zeros, ones) if side == "left" else F.concat(ones, zeros)
        return rows.select(*kept, inputs.alias("input_ids"), labels.alias("labels"), mask.alias("attention_mask"), mask.alias("bidirectional_mask"))
    both = F.concat(c, t)
    gap = F.lit(length) - F.size(both)
    labels = F.concat(filled(F.lit(IGNORED).cast("long"), F.size(c)), t)
    ones, two = F.array_repeat(F.lit(1), F.size(both)), F.concat(F.array_repeat(F.lit(1), F.size(c)), F.array_repeat(F.lit(0), F.size(t)))

    def put(array: Column, value: Column) -> Column:
        return F.concat(filled(value, gap), array) if side == "left" else F.concat(array, filled(value, gap))

    return rows.select(
        *kept, put(both, F.lit(pad).cast("long")).alias("input_ids"), put(labels, F.lit(IGNORED).cast("long")).alias("labels"),
        put(ones, F.lit(0)).alias("attention_mask"), put(two, F.lit(0)).alias("bidirectional_mask"),
    )


def encoder_decoder(df: DataFrame, length: int, pad: int, eos: int, context: str = "context", target: str = "target") -> DataFrame:
    """Context as encoder input, target as labels; too long ones (a target of exactly ``length``, too) keep their first tokens and an end id."""
    cut = lambda a: F.concat(F.slice(a, 1, length - 1), _long(eos))
    c, t = F.col("_c"), F.col("_t")
    rows = df.withColumn("_c", stripped(context, pad)).withColumn("_t", with_eos(stripped(target, pad), eos))
    rows = rows.withColumn("_c", F.when(F.size(c) > length, cut(c)).otherwise(c)).withColumn("_t", F.when(F.size(t) >= length, cut(t)).otherwise(t))
    labels = padded("_t", length, IGNORED)
    kept = [x for x in df.columns if x not in (context, target)]
    rows = rows.select(*kept, padded("_c", length, pad).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size("_c")), filled(F.lit(0), F.lit(length) - F.size("_c"))).alias("attention_mask"), labels.alias("labels"))
    return rows.withColumn("decoder_input_ids", decoder_inputs("labels", pad)).withColumn("decoder_attention_mask", F.transform("labels", lambda x: (x != IGNORED).cast("int")))


def batched(df: DataFrame, order: str, size: int, drop_last: bool = False, dense: bool = False) -> DataFrame:
    """Adds batch_id and pos. With ``dense`` the order column already counts rows from 0; else rows are numbered with the
    two-level running count of :func:`.concat.running_offset`, so no window spans the table."""
    from .concat import running_offset

    rows = df.withColumn("_n", F.col(order)) if dense else running_offset(df, order, F.lit(1), name="_n")
    rows = rows.withColumn("batch_id", F.floor(F.col("_n") / size)).withColumn("pos", (F.col("_n") % size).cast("int")).drop("_n")
    if drop_last:
        rows = rows.withColumn("_in", F.count(F.lit(1)).over(Window.partitionBy("batch_id"))).where(F.col("_in") == size).drop("_in")
    return rows


def pad_to_longest(df: DataFrame, ids: str, pad: int, side: str = "left", batch: str = "batch_id") -> DataFrame:
    """Every row of a batch padded to its longest; ``n_tokens`` counts what isn't padding."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return df.withColumn("n_tokens", F.size(F.filter(ids, lambda t: t != pad))).withColumn("_longest", longest).withColumn(ids, padded(ids, F.col("_longest"), pad, side)).drop("_longest")


def trimmed(df: DataFrame, columns: tuple[str, ...], mask: str = "attention_mask", side: str = "left", multiple: int = 8, batch: str = "batch_id") -> DataFrame:
    """Cuts padding that a whole batch shares, to a multiple of 8 columns; the first batch keeps its full length, so that
    memory is reserved for the largest."""
    used = F.max(F.size(F.filter(mask, lambda m: m == 1))).over(Window.partitionBy(batch))
    keep = F.when(F.col(batch) > 0, F.least(F.ceil(F.col("_used") / multiple) * multiple, F.size(mask))).otherwise(F.size(mask)).cast("int")
    rows = df.withColumn("_used", used).withColumn("_keep", keep)
    cut = (lambda c: F.slice(F.col(c), F.size(c) - F.col("_keep") + 1, F.col("_keep"))) if side == "left" else (lambda c: F.slice(F.col(c), 1, F.col("_keep")))
    return rows.select(*(F.when(F.col("_keep") > 0, cut(c)).otherwise(F.slice(c, 1, 0)).alias(c) if c in columns else c for c in df.columns))


def with_metadata(df: DataFrame, **values) -> DataFrame:
    """Constant columns on every row of every batch; the names of model inputs are reserved."""
    if taken := RESERVED & values.keys():
        raise ValueError(f"reserved: {', '.join(sorted(taken))}")
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def separator_ids(separator: bool | tuple[int, ...], sep: int | None) -> tuple[int, ...]:
    """Ids between context and target: those given, the tokenizer's own for ``True``, none for ``False``."""
    if separator is True:
        if sep is None:
            raise ValueError("the tokenizer has no separator id")
        return (sep,)
    return separator or ()
