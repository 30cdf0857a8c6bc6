"""Packing short sequences of a batch into rows of fixed length: first fit, largest first, with leftovers carried on."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import IGNORED

COLUMNS = ("input_ids", "labels", "attention_mask", "bidirectional_mask", "sequence_id")
FILL = {"labels": IGNORED, "attention_mask": 0, "bidirectional_mask": 0, "sequence_id": -1}  # input ids are filled with the pad id


@dataclass
class Bin:
    size: int
    members: list = field(default_factory=list)


def first_fit(sizes: list[int], members: list, bins: int, capacity: int, open_bins: list[Bin]) -> tuple[list[Bin], list[Bin]]:
    """The ``bins`` fullest bins and the others, which stay open.

    Examples come largest first, equal ones in order. Each goes into the first bin that takes it, where bins stand in
    order of their last change; if none does, it opens one. As soon as the examples left are only as many as the bins
    still missing, each gets a bin of its own."""
    line = list(open_bins)
    queue = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for done, i in enumerate(queue):
        missing = max(0, bins - len(line))
        taker = None
        if len(queue) - done > missing:
            taker = next((k for k, b in enumerate(line) if b.size + sizes[i] <= capacity), None)
        if taker is None:
            line.append(Bin(sizes[i], [members[i]]))
        else:
            chosen = line.pop(taker)
            line.append(Bin(chosen.size + sizes[i], [*chosen.members, members[i]]))
    line.sort(key=lambda b: -b.size)
    return line[:bins], line[bins:]


def joined(examples: list[dict]) -> dict[str, np.ndarray]:
    """Examples one after another: each one's first label is ignored (nothing precedes it), sequences are numbered on."""
    out = {}
    for name in examples[0] if examples else ():
        parts = [np.asarray(e[name], np.int64) for e in examples]
        if name == "labels":
            parts = [np.concatenate([[IGNORED], p[1:]]) if k and len(p) else p for k, p in enumerate(parts)]
        if name == "sequence_id":
            start = 0
            for k, p in enumerate(parts):
                parts[k] = p + start
                start = int(parts[k].max()) + 1 if len(p) else start
        out[name] = np.concatenate(parts)
    return out


def check(length: int, size: int, leftovers: int | None, columns) -> int:
    """Validates the arguments; gives the number of leftovers that are kept at most."""
    if length < 1 or size < 1:
        raise ValueError("length and batch size must be positive")
    if leftovers is not None and leftovers < 0:
        raise ValueError("the number of leftovers can't be negative")
    if unknown := set(columns) - {*COLUMNS, "decoder_input_ids"}:
        raise ValueError(f"can't pack {sorted(unknown)}")
    if "decoder_input_ids" in columns:
        raise ValueError("encoder-decoder batches can't be packed")
    return 10 * size if leftovers is None else leftovers


def raw_batch(size: int, ratio: float | None, leftovers: int | None = None) -> int:
    """Rows that are read for a batch of ``size`` packed ones. A ratio of 1 or none means no packing."""
    if ratio is None or ratio == 1.0:
        if leftovers is not None:
            raise ValueError("leftovers need a packing ratio")
        return size
    if ratio < 1:
        raise ValueError("a packing ratio is 1 or more")
    return int(size * ratio)


def pack_batches(df: DataFrame, size: int, length: int, pad: int, side: str = "left", leftovers: int | None = None, batch: str = "batch_id", order: str = "pos", stream: str | None = None) -> DataFrame:
    """(stream, batch_id, pos, input columns, used, total_new): each batch's rows packed into at most ``size`` rows of ``length``.

    Padding (attention 0) is taken off first. What isn't packed is carried to the stream's next batch, up to the cap.
    Batches of a stream follow one another, as in one loader worker; streams run in parallel. A task reads its sorted
    partition in pieces and holds one batch and the leftovers."""
    columns = [c for c in COLUMNS if c in df.columns and c != "sequence_id"]
    most = check(length, size, leftovers, columns)
    rows = df.select((F.col(stream) if stream else F.lit(0)).cast("long").alias("stream"), F.col(batch).cast("long").alias("batch_id"), F.col(order).cast("long").alias("pos"), *columns)
    rows = rows.repartition("stream").sortWithinPartitions("stream", "batch_id", "pos")
    kinds = {c: "int" if c.endswith("mask") else "long" for c in columns}
    schema = "stream long, batch_id long, pos int, " + ", ".join(f"{c} array<{kinds.get(c, 'long')}>" for c in (*columns, "sequence_id")) + ", used int, total_new long"

    names = [*columns, "sequence_id"]

    def fold(batches):
        now, held, open_bins = None, [], []

        def packed():
            """Columns of the packed rows: flat values per input column, and the short ones."""
            nonlocal open_bins
            sizes = [len(e["input_ids"]) for e in held]
            full, rest = first_fit(sizes, held, size, length, open_bins)
            open_bins = rest[:most]
            flat = {}
            examples = [joined(b.members) for b in full]
            for name in names:
                rows_ = np.full((len(full), length), FILL.get(name, pad), np.int64)
                for i, example in enumerate(examples):
                    n = len(example[name])
                    rows_[i, length - n if side == "left" else 0 : length if side == "left" else n] = example[name]
                flat[name] = rows_
            return flat, [(*now, i, b.size, sum(sizes)) for i, b in enumerate(full)]

        def table(parts):
            short = [x for _, own in parts for x in own]
            offsets = pa.array(np.arange(len(short) + 1, dtype=np.int32) * length)
            wide = {n: np.concatenate([flat[n] for flat, _ in parts]).ravel().astype(np.int32 if kinds.get(n) == "int" else np.int64) for n in names}
            streams, ids, places, used, total = (list(x) for x in zip(*short))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(wide[n])) for n in names]
            return pa.RecordBatch.from_arrays([pa.array(streams, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32()), *lists, pa.array(used, pa.int32()), pa.array(total, pa.int64())], ["stream", "batch_id", "pos", *names, "used", "total_new"])

        for piece in batches:
            out = []
            lists = {c: (piece.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), piece.column(c).flatten().to_numpy(zero_copy_only=False)) for c in {*columns, "attention_mask"}}
            starts = {c: np.cumsum(n) - n for c, (n, _) in lists.items()}
            for i, key in enumerate(zip(piece.column("stream").to_pylist(), piece.column("batch_id").to_pylist())):
                if key != now:
                    if now is not None:
                        out.append(packed())
                        if now[0] != key[0]:
                            open_bins = []
                    now, held = key, []
                own = {c: lists[c][1][starts[c][i] : starts[c][i] + lists[c][0][i]] for c in lists}
                kept = own["attention_mask"] == 1
                held.append({c: own[c][kept] for c in columns} | {"sequence_id": np.zeros(int(kept.sum()), np.int64)})
            if any(short for _, short in out):
                yield table(out)
        if now is not None and (last := packed())[1]:
            yield table([last])

    return rows.mapInArrow(fold, schema)


def statistics(packed: DataFrame, length: int) -> DataFrame:
    """Over all batches: tokens packed and seen, the share wasted (what was dropped), and how full the rows are."""
    per = packed.groupBy("stream", "batch_id").agg(F.sum("used").alias("used"), F.max("total_new").alias("total"), F.count("*").alias("rows"))
    return per.agg(F.sum("used").alias("packed_tokens"), F.sum("total").alias("total_tokens"), F.sum("rows").alias("rows")).select(
        "packed_tokens", "total_tokens", "rows", (1 - F.try_divide("packed_tokens", "total_tokens")).alias("waste"), F.try_divide(F.col("packed_tokens"), F.col("rows") * length).alias("efficiency")
    )


def ratios(least: float, most: float, number: int, size: int) -> list[tuple[float, int]]:
    """Packing ratios to try, evenly spaced, to one decimal, one for each number of raw rows."""
    step = (most - least) / (number - 1) if number > 1 else 0.0
    out: dict[int, float] = {}
    for i in range(number):
        ratio = round(least + i * step, 1)
        out.setdefault(int(ratio * size), ratio)
    return [(ratio, raw) for raw, ratio in out.items()]


def profile(df: DataFrame, order: str, size: int, length: int, candidates: list[tuple[float, int]], leftovers: int | None = None, batches: int = 100) -> DataFrame:
    """(ratio, raw_rows, padding_percent, waste_percent) of each candidate over one draw of rows: the first in order, as
    many as ``batches`` raw batches of the greatest candidate have. Raw batches of fewer than ``size`` rows are left out.

    Only sizes are drawn, a bounded number of them, and candidates are tried side by side; no task sees the table."""
    most, drawn = check(length, size, leftovers, ()), max((raw for _, raw in candidates), default=0) * batches
    tokens = F.size(F.filter("attention_mask", lambda m: m == 1))
    sizes = np.array([r[0] for r in df.select(tokens.alias("n"), order).orderBy(order).limit(drawn).select("n").collect()], np.int64)

    def run(parts):
        for part in parts:
            out = []
            for ratio, raw in zip(part.column("ratio").to_pylist(), part.column("raw_rows").to_pylist()):
                open_bins, used, total, rows = [], 0, 0, 0
                for a in range(0, len(sizes), raw):
                    some = sizes[a : a + raw].tolist()
                    if len(some) >= size:
                        full, rest = first_fit(some, [None] * len(some), size, length, open_bins)
                        open_bins = rest[:most]
                        used, total, rows = used + sum(b.size for b in full), total + sum(some), rows + len(full)
                out.append((ratio, raw, round(100 * (1 - used / (rows * length)), 4) if rows else None, round(100 * (1 - used / total), 4) if total else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.float64(), pa.int64(), pa.float64(), pa.float64()))], ["ratio", "raw_rows", "padding_percent", "waste_percent"])

    rows = df.sparkSession.createDataFrame([(float(r), int(n)) for r, n in candidates], "ratio double, raw_rows long").repartition(max(1, len(candidates)), "raw_rows")
    return rows.mapInArrow(run, "ratio double, raw_rows long, padding_percent double, waste_percent double")
