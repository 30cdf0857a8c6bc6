"""Structured Streaming forms of the operators whose state outlives a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def outliers(stream: DataFrame, by: str, step: str, value: str, delay: int, threshold: float) -> DataFrame:
    """Finite difference, delayed mean and outlier flag of each value as it comes.

    The state of a key is its last ``2 * delay`` values. Values of one micro-batch are taken in order of ``step``; a value
    that comes in a later micro-batch than greater steps is taken when it comes."""
    key_type = stream.schema[by].dataType
    state = T.StructType([T.StructField("held", T.ArrayType(T.DoubleType()))])
    out = T.StructType([T.StructField(by, key_type), T.StructField(step, T.LongType()), T.StructField(value, T.DoubleType()), T.StructField("fdiff", T.DoubleType()), T.StructField("mva", T.DoubleType()), T.StructField("outlier", T.BooleanType())])

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = list(group.get[0]) if group.exists else []
        rows = pd.concat(list(frames)).sort_values(step)
        result = []
        for s, x in zip(rows[step], rows[value]):
            past = held[-(2 * delay - 1) :][: max(0, min(delay, len(held) - delay + 1))] if len(held) >= delay else []
            mean = sum(past) / len(past) if past else None
            result.append((key[0], s, x, x - held[-1] if held else None, mean, bool(mean is not None and x > threshold * mean)))
            held = (held + [float(x)])[-2 * delay :]
        group.update((held,))
        yield pd.DataFrame(result, columns=out.fieldNames())

    rows = stream.select(F.col(by), F.col(step).cast("long").alias(step), F.col(value).cast("double").alias(value))
    return rows.groupBy(by).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def packed_sizes(stream: DataFrame, by: str, item: str, size: str, bins: int, capacity: int, leftovers: int) -> DataFrame:
    """First-fit packing of items as they come: each micro-batch of a key gives ``bins`` rows of items, the rest is held
    over to its next one, ``leftovers`` bins at most."""
    from ..operators.packing import Bin, first_fit

    state = T.StructType([T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("members", T.ArrayType(T.ArrayType(T.LongType())))])
    out = T.StructType([T.StructField(by, stream.schema[by].dataType), T.StructField("used", T.LongType()), T.StructField("members", T.ArrayType(T.LongType()))])

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        open_bins = [Bin(s, list(m)) for s, m in zip(*group.get)] if group.exists else []
        rows = pd.concat(list(frames)).sort_values(item)
        full, rest = first_fit([int(s) for s in rows[size]], [int(i) for i in rows[item]], bins, capacity, open_bins)
        rest = rest[:leftovers]
        group.update(([b.size for b in rest], [list(b.members) for b in rest]))
        yield pd.DataFrame([(key[0], b.size, list(b.members)) for b in full], columns=out.fieldNames())

    return stream.select(by, item, size).groupBy(by).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)
