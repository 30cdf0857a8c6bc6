"""Token arrays as columns: padding, truncation, labels, masks and positions.

All functions take and give columns and stay in whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import PRIME, draw, row_seed

IGNORED = -100


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def filled(value, n) -> Column:
    """``n`` times ``value``; none where ``n`` is negative."""
    return F.array_repeat(_c(value), F.greatest(_c(n).cast("int"), F.lit(0)))


def truncated(ids, length: int, keep: str = "first") -> Column:
    """The first (or last) ``length`` elements."""
    ids = _c(ids)
    return F.slice(ids, 1, length) if keep == "first" else F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), length)


def padded(ids, length, value, side: str = "right") -> Column:
    """``ids`` padded to ``length``; longer arrays stay as they are."""
    ids = _c(ids)
    fill = filled(F.lit(value).cast("long") if not isinstance(value, Column) else value, _c(length) - F.size(ids))
    return F.concat(ids, fill) if side == "right" else F.concat(fill, ids)


def fitted(ids, length: int, pad: int) -> Column:
    """Truncated and padded to exactly ``length``."""
    return padded(truncated(ids, length), length, pad)


def stripped(ids, pad) -> Column:
    """Without the pad id; where pad and end id are one, every end id goes, too."""
    return F.filter(_c(ids), lambda t: t != _c(pad))


def with_eos(ids, eos: int) -> Column:
    """Ends with ``eos``: it is added unless it is there. An empty array becomes ``[eos]``."""
    ids = _c(ids)
    return F.when((F.size(ids) > 0) & (F.try_element_at(ids, F.lit(-1)) == eos), ids).otherwise(F.concat(ids, F.array(F.lit(eos).cast("long"))))


def running_sum(ids) -> Column:
    """Cumulative sum of an array in one pass; an accumulated array, as Catalyst has no scan function."""
    return F.aggregate(_c(ids), F.expr("array(0L)"), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.cast("long"))), lambda acc: F.slice(acc, 2, F.size(acc) - 1))


def sequence_id(ids, eos: int | None = None, bos: int | None = None) -> Column:
    """Number of each token's sequence, told by its begin or end ids; exactly one of both is given.

    A begin id belongs to the sequence it opens, an end id to the one it closes."""
    if (eos is None) == (bos is None):
        raise ValueError("give either an end id or a begin id")
    ids = _c(ids)
    if bos is not None:
        return running_sum(F.transform(ids, lambda t: (t == bos).cast("long")))
    ends = F.transform(ids, lambda t: (t == eos).cast("long"))
    return F.when(F.size(ids) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(running_sum(F.concat(F.expr("array(0L)"), F.slice(ends, 1, F.greatest(F.size(ids) - 1, F.lit(0))))))


def clm_labels(ids, pad) -> Column:
    return F.transform(_c(ids), lambda t: F.when(t == _c(pad), F.lit(IGNORED).cast("long")).otherwise(t))


def mlm(ids, key, probability: float, mask_id: int, vocabulary: int, seed: int = 0) -> tuple[Column, Column]:
    """Masked input and labels. Which positions are chosen, and what replaces them (80 % mask, 10 % random, 10 % kept),
    is a function of seed, row key and position."""
    ids = _c(ids)
    row = row_seed(seed, _c(key), "mlm")
    chosen = lambda i: draw(row, i, 1) < int(probability * PRIME)
    inputs = F.transform(
        ids,
        lambda t, i: F.when(~chosen(i), t).when(draw(row, i, 2) < int(0.8 * PRIME), F.lit(mask_id).cast("long")).when(draw(row, i, 2) < int(0.9 * PRIME), draw(row, i, 3) % vocabulary).otherwise(t),
    )
    return inputs, F.transform(ids, lambda t, i: F.when(chosen(i), t).otherwise(F.lit(IGNORED).cast("long")))


def next_targets(labels) -> Column:
    """Labels moved one to the left; the last has none."""
    labels = _c(labels)
    return F.when(F.size(labels) == 0, labels).otherwise(F.concat(F.slice(labels, 2, F.size(labels)), F.array(F.lit(IGNORED).cast("long"))))


def position_ids(mask) -> Column:
    """Positions that don't count masked-out places: ``max(i - masked so far, 0)``."""
    gaps = running_sum(F.transform(_c(mask), lambda m: (m == 0).cast("long")))
    return F.transform(gaps, lambda g, i: F.greatest(i.cast("long") - g, F.lit(0).cast("long")))


def attention(ids, pad) -> Column:
    return F.transform(_c(ids), lambda t: (t != _c(pad)).cast("int"))


def bidirectional(attention_mask, labels) -> Column:
    """Context places: attended, without a label."""
    return F.zip_with(_c(attention_mask), _c(labels), lambda a, x: ((a == 1) & (x == IGNORED)).cast("int"))


def decoder_inputs(labels, pad: int) -> Column:
    labels = _c(labels)
    moved = F.concat(F.array(F.lit(pad).cast("long")), F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))))
    return F.transform(moved, lambda t: F.when(t == IGNORED, F.lit(pad).cast("long")).otherwise(t))


def l2_norm(values) -> Column:
    return F.sqrt(F.aggregate(_c(values), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def rms_norm(values, eps: float = 1e-5) -> Column:
    values = _c(values)
    scale = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(values) + F.lit(eps))
    return F.transform(values, lambda x: x.cast("double") / scale)


def momentum(values, beta: float) -> Column:
    """Exponential moving average ``m = beta m + (1 - beta) x`` over an ordered array, from 0."""
    return F.aggregate(_c(values), F.lit(0.0), lambda m, x: m * beta + x.cast("double") * (1 - beta))


def z_loss(logits, weight: float) -> Column:
    """``weight * logsumexp(logits)^2``, with the largest logit taken out first."""
    total = _log_sum(logits)
    return total * total * weight


def _log_sum(logits) -> Column:
    top = F.array_max(_c(logits)).cast("double")
    return F.ln(F.aggregate(_c(logits), F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))) + top


def cross_entropy(logits, target) -> Column:
    """Of one prediction: the logarithm of the sum of exponentials less the target's own logit."""
    return _log_sum(logits) - F.get(_c(logits), _c(target).cast("int")).cast("double")


def argmax(logits) -> Column:
    """The first place of the largest value, from 0."""
    return F.array_position(_c(logits), F.array_max(_c(logits))) - 1
