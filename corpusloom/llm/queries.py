"""The queries of the problems; ``__spark_entry__`` adds them where this subpackage can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edited, leakage, mixing, neardup, nearsame, overlap, packing, pairs, splitting


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark, folder):
    return overlap.found(_table(spark, folder, "finetune_example"))


def p1_counts(spark, folder):
    return overlap.counts(_table(spark, folder, "finetune_example"))


def p2_found(spark, folder):
    return neardup.found(neardup.both_tables(_table(spark, folder, "finetune_example"), _table(spark, folder, "mc_items")))


def p2_groups(spark, folder):
    return neardup.groups(neardup.both_tables(_table(spark, folder, "finetune_example"), _table(spark, folder, "mc_items")))


def p2_recall(spark, folder):
    return nearsame.recall(neardup.both_tables(_table(spark, folder, "finetune_example"), _table(spark, folder, "mc_items")))


def p2_bags(spark, folder):
    return neardup.groups(neardup.both_tables(_table(spark, folder, "finetune_example"), _table(spark, folder, "mc_items")), nearsame.Near(bag=True))


def p3_found(spark, folder):
    return pairs.defects(_table(spark, folder, "tasks"))


def p3_report(spark, folder):
    return pairs.report(_table(spark, folder, "tasks"))


def _held_out(spark, folder):
    return leakage.held_out(_table(spark, folder, "copa"), _table(spark, folder, "lm_tasks"), _table(spark, folder, "finetune_example"))


def p4_found(spark, folder):
    return leakage.leaks(_table(spark, folder, "documents"), _held_out(spark, folder))


def p4_items(spark, folder):
    items = _held_out(spark, folder)
    return leakage.items_report(leakage.leaks(_table(spark, folder, "documents"), items), items)


def p4_edited(spark, folder):
    return edited.leaks(_table(spark, folder, "documents"), _held_out(spark, folder))


def _specs(spark, folder, purpose):
    """The few rows of ``length_specs``, checked to be few."""
    rows = _table(spark, folder, "length_specs").where(F.col("purpose") == purpose).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("length_specs has more than 1000 rows of a purpose")
    return {r["spec_id"]: (int(r["capacity"]), int(r["overlap"] or 0)) for r in rows}


def p5_pack(spark, folder):
    return packing.pack(_table(spark, folder, "documents"), {k: c for k, (c, _) in _specs(spark, folder, "pack").items()})


def p5_unused(spark, folder):
    return packing.unused(p5_pack(spark, folder), {k: c for k, (c, _) in _specs(spark, folder, "pack").items()})


def p6_draw(spark, folder):
    return mixing.draw(mixing.by_source(_table(spark, folder, "documents")), _table(spark, folder, "mix_targets"))


def p6_shares(spark, folder):
    return mixing.shares(p6_draw(spark, folder), _table(spark, folder, "mix_targets"))


def p7_pieces(spark, folder):
    return splitting.pieces(_table(spark, folder, "documents"), _specs(spark, folder, "split"))


def p7_found(spark, folder):
    return splitting.found(p7_pieces(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_groups, p2_recall, p2_bags, p3_found, p3_report, p4_found, p4_items, p4_edited, p5_pack, p5_unused, p6_draw, p6_shares, p7_found, p7_pieces)}


#: White space as Python and Unicode have it, for an engine whose own class knows ASCII only.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

P7_FOUND = f"""SELECT doc_id, spec_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '{WHITE}'), lambda w: octet_length(encode(w)))) > capacity THEN 'forced' ELSE 'natural' END AS cut
FROM documents JOIN length_specs ON purpose = 'split' AND octet_length(encode(text)) > capacity"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can say over whole tables; the others are tested against brute force."""
    return {"p7_found": P7_FOUND}
