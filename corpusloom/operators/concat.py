"""Token streams joined end to end and cut into chunks of fixed length."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def running_offset(df: DataFrame, order: str, size: Column, span: int = 10_000, name: str = "offset", by: tuple[str, ...] = (), keep_span: bool = False) -> DataFrame:
    """``df`` with the sum of ``size`` over all rows of lower ``order`` (ties: by all of one order value together), of the
    same ``by`` where given. ``keep_span`` leaves the column ``_span``.

    A prefix sum in two levels: rows are summed within spans of order values in parallel, and only the sums of spans,
    one row a span, go through one ordered window. No window runs over all rows. Spans are equal parts of the range of
    the order, each for about ``span`` rows, however sparse its values lie; reading the range and the number of rows
    takes one pass over the order column."""
    low, high, rows = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    wide = max(1, -(-(int(high) - int(low) + 1) * span // max(rows, 1))) if rows and low is not None else 1
    place = F.lit(0) if low is None else F.floor((F.col(order) - F.lit(int(low))) / wide)
    df = df.withColumn("_size", size.cast("long")).withColumn("_span", place)
    spans = df.groupBy(*by, "_span").agg(F.sum("_size").alias("_sum"))
    before = spans.select(*by, "_span", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(before, [*by, "_span"]).withColumn(name, F.col("_inside") + F.col("_before"))
    return out.drop("_inside", "_before", "_size", *(() if keep_span else ("_span",)))


def concat_chunks(df: DataFrame, tokens: str, order: str, length: int, bos: tuple[int, ...] = (), eos: tuple[int, ...] = (), span: int = 10_000) -> DataFrame:
    """(chunk_id, tokens): all rows' tokens, between ``bos`` and ``eos``, joined in order and cut every ``length``.

    The last, partial chunk is dropped. Each row is sliced where chunk borders cross it, so a chunk is put together from
    at most ``length`` slices. Null arrays count as empty; ``order`` is unique."""
    ids = lambda given: F.array(*(F.lit(i).cast("long") for i in given)) if given else F.expr("cast(array() as array<bigint>)")
    whole = F.concat(ids(bos), F.coalesce(F.col(tokens), F.expr("cast(array() as array<bigint>)")), ids(eos))
    rows = df.select(F.col(order).alias("_order"), whole.alias("_tokens"))
    rows = running_offset(rows, "_order", F.size("_tokens"), span, "_from")
    first, last = F.floor(F.col("_from") / length), F.floor((F.col("_from") + F.size("_tokens") - 1) / length)
    # a filter on the size would be pushed to the scan and compute the tokens once more
    rows = rows.select("_from", "_tokens", F.explode(F.when(F.size("_tokens") > 0, F.sequence(first, last))).alias("chunk_id"))
    begin = F.greatest(F.lit(0), F.col("chunk_id") * length - F.col("_from"))
    end = F.least(F.size("_tokens"), (F.col("chunk_id") + 1) * length - F.col("_from"))
    rows = rows.select("chunk_id", (F.col("_from") + begin).alias("at"), F.slice("_tokens", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    chunks = rows.groupBy("chunk_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("tokens"))
    return chunks.where(F.size("tokens") == length)


def _orbit(start: np.ndarray, first: int, length: int) -> list[int]:
    """Places in ``start`` where chunks begin from place ``first`` on: each where the one before has its ``length``."""
    after, out = np.searchsorted(start, start + length).tolist(), []
    while first < len(start):
        out.append(first)
        first = after[first]
    return out


def concat_chunks_no_wrap(df: DataFrame, tokens: str, order: str, length: int, bos: tuple[int, ...] = (), eos: tuple[int, ...] = (), stream: str | None = None, span: int = 10_000) -> DataFrame:
    """(stream, chunk_id, tokens): as ``concat_chunks``, but what is left over when a chunk fills is thrown away: the next
    chunk begins with the next row. Without ``stream`` the table is a single stream.

    Where a chunk begins hangs on where the one before did, but only by one number, the offset it reaches to. So spans of
    rows tell in parallel, for each row that a chunk could first begin with in them (those within ``length`` tokens of
    their start), to which offset their chunks reach and how many there are; one ordered pass over these few rows links
    the spans; then each span knows its chunks. Tokens go to their chunks in one shuffle, and no task folds a stream."""
    ids = lambda given: F.array(*(F.lit(i).cast("long") for i in given)) if given else F.expr("cast(array() as array<bigint>)")
    whole = F.concat(ids(bos), F.coalesce(F.col(tokens), F.expr("cast(array() as array<bigint>)")), ids(eos))
    key = F.col(stream) if stream else F.lit(0)
    rows = df.select(key.cast("long").alias("stream"), F.col(order).alias("_order"), whole.alias("_tokens"))
    rows = running_offset(rows, "_order", F.size("_tokens"), span, "_from", by=("stream",), keep_span=True).where(F.size("_tokens") > 0)
    starts = rows.select("stream", "_span", "_from")

    def entries(key, own):
        start = np.sort(own["_from"].to_numpy())
        few = min(len(start), int(np.searchsorted(start, start[0] + length)) + 1)
        orbits = [_orbit(start, i, length) for i in range(few)]
        return pd.DataFrame({"stream": key[0], "_span": key[1], "entry": start[:few], "reached": [int(start[o[-1]]) + length for o in orbits], "many": [len(o) for o in orbits]})

    def linked(batches):
        now, at, reached, n, found = None, None, 0, 0, None
        out = []
        for batch in batches:
            for one, place, entry, until, many in zip(*(batch.column(c).to_pylist() for c in ("stream", "_span", "entry", "reached", "many"))):
                if (one, place) != at:
                    if found:
                        out.append(found)
                    if one != now:
                        now, reached, n = one, None, 0
                    at, found = (one, place), [one, place, None, n, None if reached is None else reached - length]
                if found[2] is None and (reached is None or entry >= reached):
                    found[2], reached, n = entry, until, n + many
            if out:
                yield link_table(out)
                out = []
        if found:
            yield link_table([found])

    def link_table(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["stream", "_span", "entry", "before", "carried"])

    def begun(key, own, link):
        start, entry = np.sort(own["_from"].to_numpy()), link["entry"].iloc[0] if len(link) else None
        places = [] if entry is None or pd.isna(entry) else _orbit(start, int(np.searchsorted(start, int(entry))), length)
        first = int(link["before"].iloc[0]) if places else 0
        return pd.DataFrame({"stream": key[0], "_span": key[1], "_from": start[places], "chunk": np.arange(first, first + len(places))})

    few = starts.groupBy("stream", "_span").applyInPandas(entries, "stream long, _span long, entry long, reached long, many long")
    links = cut(few.repartition("stream").sortWithinPartitions("stream", "_span", "entry").mapInArrow(linked, "stream long, _span long, entry long, before long, carried long"))  # a row a span
    marks = starts.groupBy("stream", "_span").cogroup(links.groupBy("stream", "_span")).applyInPandas(begun, "stream long, _span long, _from long, chunk long")
    so_far = Window.partitionBy("stream", "_span").orderBy("_from").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(marks, ["stream", "_span", "_from"], "left").join(links.drop("entry"), ["stream", "_span"])
    placed = placed.withColumn("chunk_id", F.coalesce(F.last("chunk", ignorenulls=True).over(so_far), F.col("before") - 1)).withColumn("_begin", F.coalesce(F.last(F.when(F.col("chunk").isNotNull(), F.col("_from")), ignorenulls=True).over(so_far), "carried"))
    room = F.col("_begin") + length - F.col("_from")
    parts = placed.where(room > 0).select("stream", "chunk_id", F.col("_from").alias("at"), F.slice("_tokens", F.lit(1), F.least(F.size("_tokens").cast("long"), room).cast("int")).alias("part"))
    chunks = parts.groupBy("stream", "chunk_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("tokens"))
    return chunks.where(F.size("tokens") == length)


def to_bytes(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Token arrays as little-endian 64-bit bytes."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(tokens)
            yield batch.set_column(i, tokens, pa.array([None if x.as_py() is None else np.asarray(x.as_py(), "<i8").tobytes() for x in batch.column(i)], pa.binary()))

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == tokens else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)


def from_bytes(df: DataFrame, tokens: str = "tokens", length: int | None = None) -> DataFrame:
    """The arrays back, cut to ``length`` where given; they aren't padded."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(tokens)
            yield batch.set_column(i, tokens, pa.array([None if x.as_py() is None else np.frombuffer(x.as_py(), "<i8")[:length] for x in batch.column(i)], pa.list_(pa.int64())))

    schema = ", ".join(f"`{f.name}` {'array<long>' if f.name == tokens else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema)
