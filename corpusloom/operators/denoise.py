"""Span and sequence corruption of token rows (the denoising mixtures of T5 and UL2)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import IGNORED, truncated
from ..functions.scalars import PRIME, draw, drawn, row_seed
from ..functions.tokenize import Tokenizer


@dataclass(frozen=True)
class Noiser:
    """Corrupts about ``ratio`` of a row's tokens, in spans of ``mean`` tokens; without a mean, one span at the end."""

    ratio: float
    mean: float | None
    prefix: tuple[int, ...] = ()


def ul2_prefix(ratio: float, mean: float | None) -> str:
    """The mark put before inputs of each kind of corruption."""
    if mean is None:
        return "[S2S]" if ratio < 1.0 else "[CLM]"
    return "[NLG]" if mean >= 12 or ratio >= 0.3 else "[NLU]"


def noisers(spans: list[tuple[float, float]] | None, sequence_ratios: list[float] | float | None, prefixes: dict[str, tuple[int, ...]] | None = None) -> list[Noiser]:
    """Validated: means not negative, span ratios between 0 and 1, sequence ratios above 0 up to 1; at least one noiser."""
    out = []
    for mean, ratio in spans or []:
        if mean < 0:
            raise ValueError("a mean span length can't be negative")
        if not 0 < ratio < 1:
            raise ValueError("a span ratio lies between 0 and 1")
        out.append((ratio, float(mean)))
    for ratio in [sequence_ratios] if isinstance(sequence_ratios, float) else sequence_ratios or []:
        if not 0 < ratio <= 1:
            raise ValueError("a sequence ratio lies above 0, up to 1")
        out.append((ratio, None))
    if not out:
        raise ValueError("no corruption is asked for")
    return [Noiser(r, m, (prefixes or {}).get(ul2_prefix(r, m), ())) for r, m in out]


def counts(length: int, ratio: float, mean: float) -> tuple[int, int]:
    """Tokens to corrupt and spans they lie in, of ``length`` tokens (at least 2 are assumed)."""
    length = max(length, 2)
    noise = min(max(int(np.rint(ratio * length)), 1), length - 1)
    return noise, max(int(np.rint(noise / mean)) if mean else noise, 1)


def longest_start(length: int, n: Noiser, decoder_only: bool, context_eos: bool) -> int:
    """Most raw tokens that still fit ``length`` once sentinels, prefix and end ids are added."""
    if n.mean is None:
        return length - len(n.prefix) - (2 if context_eos and decoder_only else 1)
    for raw in range(2 * length, 0, -1):
        noise, spans = counts(raw, n.ratio, n.mean)
        inputs, labels = max(raw, 2) - noise + spans + len(n.prefix) + context_eos, noise + spans + 1
        if (inputs + labels if decoder_only else max(inputs, labels)) <= length:
            return raw
    raise ValueError("no row fits this corruption")


def _parts(total: np.ndarray, spans: np.ndarray, seeds: np.ndarray, salt: int) -> np.ndarray:
    """Lengths of the ``spans`` parts that each row's ``total`` is cut into: cut at the places with the least draws, so all
    ways to cut it are alike."""
    n = len(total)
    many = total - 1
    row = np.repeat(np.arange(n), many)
    before = np.concatenate([[0], np.cumsum(many)])
    place = np.arange(before[-1]) - before[row] + 1
    order = np.lexsort((place, drawn(seeds[row], place, salt), row))
    picked = order[np.arange(before[-1]) - before[row] < (spans - 1)[row]]
    rows = np.concatenate([np.arange(n), row[picked], np.arange(n)])
    edges = np.concatenate([np.zeros(n, np.int64), place[picked], total])
    order = np.lexsort((edges, rows))
    return np.diff(edges[order])[rows[order][1:] == rows[order][:-1]]


def span_masks(lengths: np.ndarray, noise: np.ndarray, spans: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """True where a token of the rows, one after another, is corrupted. Kept and corrupted spans take turns, a kept one
    first; their lengths are uniform among all ways to cut the two totals into that many parts."""
    full = np.maximum(lengths, 2)
    parts = np.stack([_parts(full - noise, spans, seeds, 2), _parts(noise, spans, seeds, 3)], axis=1).ravel()
    mask = np.repeat(np.arange(len(parts)) % 2 == 1, parts)
    place = np.arange(len(mask)) - np.repeat(np.cumsum(full) - full, full)
    return mask[place < np.repeat(lengths, full)]


def span_mask(length: int, ratio: float, mean: float, seed: int) -> np.ndarray:
    """The mask of a single row."""
    noise, spans = counts(length, ratio, mean)
    spans = min(spans, noise, max(length, 2) - noise)
    return span_masks(*(np.array([x], np.int64) for x in (length, noise, spans, seed)))


def applied(tokens: np.ndarray, row: np.ndarray, rows: int, mask: np.ndarray, marked: np.ndarray, sentinels: np.ndarray, eos: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens outside the mask, and their rows; in ``marked`` rows each masked span leaves a sentinel, the last sentinel
    serving for all further spans. Rows that don't end with ``eos`` get one."""
    before = np.concatenate([[False], mask[:-1]]) & np.concatenate([[False], row[1:] == row[:-1]])[: len(row)]
    opens = mask & ~before
    count = np.cumsum(opens)
    base = np.concatenate([[0], count])[np.searchsorted(row, np.arange(rows))]
    number = np.clip(count - base[row] - 1, 0, len(sentinels) - 1)
    opens &= marked[row]
    kept = ~mask | opens
    out, of = np.where(opens, sentinels[number], tokens)[kept], row[kept]
    if eos is not None:
        last = np.searchsorted(of, np.arange(rows), "right") - 1
        lacking = np.flatnonzero(np.array([True] * rows) if not len(of) else (of[np.maximum(last, 0)] != np.arange(rows)) | (out[np.maximum(last, 0)] != eos))
        out, of = np.concatenate([out, np.full(len(lacking), eos)]), np.concatenate([of, lacking])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def corrupted(tokens: np.ndarray, lengths: np.ndarray, which: np.ndarray, seeds: np.ndarray, kinds: list[Noiser], t: Tokenizer, context_eos: bool) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Input and label tokens of all rows, each with the rows they belong to; every row has tokens."""
    n, full = len(lengths), np.maximum(lengths, 2)
    ratio = np.array([k.ratio for k in kinds])[which]
    spread = np.array([k.mean is not None for k in kinds])[which]
    mean = np.array([k.mean or 0.0 for k in kinds])[which]
    noise = np.minimum(np.maximum(np.rint(ratio * full), 1), full - 1).astype(np.int64)
    spans = np.maximum(np.rint(np.divide(noise, mean, out=noise.astype(np.float64), where=mean > 0)), 1).astype(np.int64)
    low, high = np.where(ratio <= 0.5, 0.0, 2 * ratio - 1), np.where(ratio <= 0.5, 2 * ratio, 1.0)
    tail = np.rint(1 + (low + (high - low) * (drawn(seeds, 0, 4) / PRIME)) * (lengths - 1)).astype(np.int64)
    noise = np.where(spread, noise, np.minimum(tail, full - 1))
    spans = np.where(spread, np.minimum(np.minimum(spans, noise), full - noise), 1)
    row = np.repeat(np.arange(n), lengths)
    mask = span_masks(lengths, noise, spans, seeds)
    sentinels = np.array([t.sentinel(i) for i in range(max(t.sentinels, 1))])
    inputs, of = applied(tokens, row, n, mask, spread, sentinels, t.eos if context_eos else None)
    prefix = [np.array(k.prefix, np.int64) for k in kinds]
    many = np.array([len(p) for p in prefix])[which]
    heads = np.concatenate([prefix[k] for k in which.tolist()]) if many.any() else np.zeros(0, np.int64)
    inputs, of = np.concatenate([heads, inputs]), np.concatenate([np.repeat(np.arange(n), many), of])
    order = np.argsort(of, kind="stable")
    return (inputs[order].astype(np.int64), of[order]), applied(tokens, row, n, ~mask, spread, sentinels, t.eos)


def denoised(df: DataFrame, tokens: str, key: str, length: int, kinds: list[Noiser], t: Tokenizer = Tokenizer().adapted(), decoder_only: bool = True, context_eos: bool | None = None, side: str = "left", seed: int = 0, most_raw: int | None = None) -> DataFrame:
    """Every row corrupted by one noiser, chosen and applied by seed and row key, padded to ``length``.

    Gives key, noiser, input_ids, labels, attention_mask and bidirectional_mask, or decoder_input_ids and
    decoder_attention_mask for encoder-decoder models (which pad right). Null and empty rows are left out."""
    context_eos = decoder_only if context_eos is None else context_eos
    starts = [min(longest_start(length, n, decoder_only, context_eos), most_raw or 1 << 60) for n in kinds]
    extra = ["bidirectional_mask"] if decoder_only else ["decoder_input_ids", "decoder_attention_mask"]
    names = ["noiser", "input_ids", "labels", "attention_mask", *extra]

    def laid(n: int, fill: int, parts: list[tuple], left: bool) -> np.ndarray:
        """n x ``length``: the parts (values, rows) of each row one after another, on one side."""
        of = np.concatenate([rows for _, rows in parts])
        order = np.argsort(of, kind="stable")
        of, values = of[order], np.concatenate([np.broadcast_to(v, len(rows)) for v, rows in parts])[order]
        size = np.bincount(of, minlength=n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + (np.repeat(length - size, size) if left else 0)
        out = np.full((n, length), fill, np.int64)
        out[of, place] = values
        return out

    def run(batches):
        for batch in batches:
            lengths = batch.column("_tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(lengths > 0))  # here, as a filter in the plan would compute the tokens twice
            if not batch.num_rows:
                continue
            n, lengths, which = batch.num_rows, lengths[lengths > 0], batch.column("_which").to_numpy()
            flat, most = batch.column("_tokens").flatten().to_numpy().astype(np.int64), np.minimum(lengths, np.array(starts)[which])
            place, size = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(lengths, lengths)
            flat = flat[place >= size - np.repeat(most, lengths) if side == "left" else place < np.repeat(most, lengths)]
            inputs, labels = corrupted(flat, most, which, batch.column("_seed").to_numpy(), kinds, t, context_eos)
            if decoder_only:
                left = side == "left"
                out = [laid(n, t.pad, [inputs, labels], left), laid(n, IGNORED, [(IGNORED, inputs[1]), labels], left), laid(n, 0, [(1, inputs[1]), (1, labels[1])], left), laid(n, 0, [(1, inputs[1]), (0, labels[1])], left)]
            else:
                first = np.concatenate([[True], labels[1][1:] != labels[1][:-1]])
                moved = np.where(first, t.pad, np.concatenate([[t.pad], labels[0][:-1]]))
                out = [laid(n, t.pad, [inputs], False), laid(n, IGNORED, [labels], False), laid(n, 0, [(1, inputs[1])], False), laid(n, t.pad, [(moved, labels[1])], False), laid(n, 0, [(1, labels[1])], False)]
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * length)
            wide = ("input_ids", "labels", "decoder_input_ids")
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel().astype(np.int64 if name in wide else np.int32))) for name, x in zip(names[1:], out)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(which.astype(np.int32)), *arrays], [key, *names])

    kept = F.col(tokens) if not starts else truncated(tokens, max(starts), "last" if side == "left" else "first")  # only what can be used goes to Python
    rows = df.select(key, kept.alias("_tokens"), (draw(row_seed(seed, key), F.lit(0), 1) % len(kinds)).cast("int").alias("_which"), row_seed(seed, key).alias("_seed"))
    kinds_of = {n: "array<long>" if n in ("input_ids", "labels", "decoder_input_ids") else "array<int>" for n in names[1:]}
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, noiser int, " + ", ".join(f"{n} {k}" for n, k in kinds_of.items()))
