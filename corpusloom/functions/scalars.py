"""Scalars of configuration and measurement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK_FLOPS = 312e12  # fixed value: an A100's bf16 operations per second


PRIME = (1 << 31) - 1


def row_seed(seed: int, key, *salt) -> Column:
    """28 bits of a row, from seed, key and salt; other engines get the same from md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), *(F.lit(str(x)) for x in salt))), 1, 7), 16, 10).cast("long")


def draw(row: Column, i: Column, salt: int = 0) -> Column:
    """0 to ``PRIME`` - 1 for place ``i`` of a row, scrambled by squares modulo a prime: whole numbers below 2^63 only, so
    any engine repeats it."""
    a = (row + i.cast("long") * 2_654_435 + salt * 40_503) % PRIME
    b = (a * a) % PRIME
    c = (b * 48_271 + a) % PRIME
    return (c * c + b) % PRIME


def drawn(row, i, salt: int = 0):
    """:func:`draw` over arrays of whole numbers below 2^31."""
    a = (row + i * 2_654_435 + salt * 40_503) % PRIME
    b = (a * a) % PRIME
    c = (b * 48_271 + a) % PRIME
    return (c * c + b) % PRIME


def to_bool(text: Column) -> Column:
    """true/t/1/yes/y and false/f/0/no/n in any case; anything else is an error."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "t", "1", "yes", "y"), True).when(low.isin("false", "f", "0", "no", "n"), False).when(low.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), low)).cast("boolean"))


def mfu(params, layers, width, seq, throughput, gpus) -> Column:
    """Model flops utilisation in percent; ``throughput`` in sequences per second."""
    return F.round(100.0 * (6.0 * seq * params + 12.0 * layers * width * seq * seq) * throughput / (gpus * PEAK_FLOPS), 2)


def hfu(params, layers, width, seq, throughput, gpus, checkpointing) -> Column:
    """Hardware flops utilisation: recomputed activations count, where they are recomputed."""
    again = F.round(100.0 * (8.0 * seq * params + 16.0 * layers * width * seq * seq) * throughput / (gpus * PEAK_FLOPS), 2)
    return F.when(checkpointing, again).otherwise(mfu(params, layers, width, seq, throughput, gpus))


def flops_per_batch(params, layers, width, seq, batch) -> Column:
    return (2 * params * seq + layers * 4 * width * seq * seq) * 3 * batch


def samples_estimate(samples, chars: Column, chars_per_token: Column, length: int) -> Column:
    """Chunks that a text dataset gives: whole divisions from left to right."""
    return F.floor(samples * F.floor(chars / chars_per_token) / F.lit(length)).cast("long")


def microbatches(batch, micro) -> Column:
    """Sizes of gradient accumulation: whole microbatches and a rest."""
    whole = F.array_repeat(micro.cast("long"), F.floor(batch / micro).cast("int"))
    rest = batch.cast("long") % micro.cast("long")
    return F.when(rest > 0, F.concat(whole, F.array(rest))).otherwise(whole)
