"""Problem 5: filling containers of fixed capacity, by shortest-pack-first over the length histogram (Krell et al., 2021).

The plan is made from counts of sizes alone, at most ``capacity + 1`` a capacity, whatever the number of documents: sizes
are placed longest first, each into the emptiest containers that still take it. Instead of patterns and their counts
the plan keeps runs of container numbers that are filled alike, so each placing step is one row ``(size, first rank,
first container)``; documents find their container by their rank among equal sizes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_BITS = 40
MOST_SIZES = 5_000_000


def tokens(text: Column) -> Column:
    """Tokens of the public byte-level tokenizer: the UTF-8 bytes; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int]], int]:
    """Rows (size, first rank, first container) and the number of containers. Sizes are 1 to ``capacity``."""
    volume, free = sum(s * n for s, n in histogram.items()), 0  # still to be placed; left in open containers
    runs: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of containers (first, how many)
    spaces: list[int] = []  # a heap of the spaces in use, largest first
    steps, containers = [], 0

    def put(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in runs:
                runs[space] = []
                heapq.heappush(spaces, -space)
            runs[space].append((first, many))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            if spaces and -spaces[0] >= size:  # the shortest pack
                space = -spaces[0]
                first, many = runs[space].pop()
                if not runs[space]:
                    del runs[space]
                    heapq.heappop(spaces)
                used = min(left, many)
                put(space, first + used, many - used)
                free -= used * size
            else:  # as many new ones as the volume asks for, and as this size needs
                space, first = capacity, containers
                used = min(left, max(-(-left // (capacity // size)), -(-(volume - free) // capacity)))
                containers += used
                free += used * (capacity - size)
            volume -= used * size
            steps.append((size, rank, first))
            put(space - size, first, used)
            rank, left = rank + used, left - used
    return steps, containers


def pieces(documents: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(spec_id, doc_id, piece, start, size): every document once a capacity; those above it in pieces that fill it and a rest."""
    specs = F.array(*(F.struct(F.lit(int(k)).cast("long").alias("spec_id"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in sorted(capacities.items())))
    rows = documents.select("doc_id", tokens(F.col("text")).alias("tokens")).select("doc_id", "tokens", F.explode(specs).alias("spec")).select("doc_id", "tokens", "spec.*")
    last = F.greatest(F.expr("(tokens - 1) div capacity"), F.lit(0))
    rows = rows.select("spec_id", "doc_id", "tokens", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return rows.select("spec_id", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).alias("size"))


def pack(documents: DataFrame, capacities: dict[int, int], group_rows: int = 200_000) -> DataFrame:
    """(spec_id, doc_id, piece, start, size, container): the container of every document, or piece of a document above the capacity.

    ``documents``: doc_id, text. Blank and null texts have size 0 and stand in container 0. Repeated ids are packed as
    often as they come. Documents of equal size are ranked by the hash of their id. Sizes that more than ``group_rows``
    documents have are ranked in ranges of the hash, whose counts are added up, so no single task ranks a hot size and
    the ranks are those that one task would give. The histogram comes to the driver: ``MOST_SIZES`` bounds the sum of
    the capacities."""
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be positive")
    if sum(capacities.values()) > MOST_SIZES:
        raise ValueError(f"the capacities add up to more than {MOST_SIZES}")
    spark = documents.sparkSession
    items = pieces(documents, capacities)
    counts = items.groupBy("spec_id", "size").agg(F.count("*").alias("n")).collect()  # at most sum of (capacity + 1)
    held = {}
    for spec, capacity in capacities.items():
        steps, containers = plan({r["size"]: r["n"] for r in counts if r["spec_id"] == spec and r["size"] > 0}, capacity)
        key = np.array([(s << RANK_BITS) | r for s, r, _ in steps], np.int64)
        order = np.argsort(key)
        held[spec] = key[order], np.array([c for *_, c in steps], np.int64)[order], containers
    plans = spark.sparkContext.broadcast(held)
    hot = [(r["spec_id"], r["size"], (-(-r["n"] // group_rows) - 1).bit_length()) for r in counts if r["n"] > group_rows]
    items, order_by = items.withColumn("hash", F.xxhash64("doc_id", "piece")), ["hash", "doc_id", "piece"]
    if hot:
        hot_sizes = F.broadcast(spark.createDataFrame(hot, "spec_id long, size long, bits int"))  # rows / group_rows at most
        items = items.join(hot_sizes, ["spec_id", "size"], "left").withColumn("part", F.expr("case when bits > 0 then shiftright(hash, 64 - bits) else 0 end")).drop("bits")
        ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("spec_id", "size", "part").orderBy(*order_by)) - 1)
        parts = items.join(hot_sizes.drop("bits"), ["spec_id", "size"], "left_semi").groupBy("spec_id", "size", "part").agg(F.count("*").alias("n"))
        before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("spec_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["before"])
        ranked = ranked.join(before.drop("n"), ["spec_id", "size", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    else:
        ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("spec_id", "size").orderBy(*order_by)) - 1)

    def place(batches):
        for batch in batches:
            spec, size, rank = (batch.column(c).to_numpy() for c in ("spec_id", "size", "rank"))
            container = np.zeros(len(spec), np.int64)
            for one in np.unique(spec).tolist():
                keys, first, _ = plans.value[one]
                own = np.flatnonzero((spec == one) & (size > 0))
                if len(own):
                    at = np.searchsorted(keys, (size[own] << RANK_BITS) | rank[own], "right") - 1
                    container[own] = first[at] + rank[own] - (keys[at] & ((1 << RANK_BITS) - 1))
            yield batch.drop_columns(["rank"]).append_column("container", pa.array(container))

    kind = documents.schema["doc_id"].dataType.simpleString()
    chosen = ranked.select("spec_id", "doc_id", "piece", "start", "size", F.col("rank").cast("long").alias("rank"))
    return chosen.mapInArrow(place, f"spec_id long, doc_id {kind}, piece long, start long, size long, container long")


def unused(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Per capacity: containers, tokens in them, unused tokens, their share, and the fewest containers there could be."""
    specs = packed.sparkSession.createDataFrame([(int(k), int(c)) for k, c in capacities.items()], "spec_id long, capacity long")
    per = packed.where("size > 0").groupBy("spec_id", "container").agg(F.sum("size").alias("used"))
    whole = per.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    whole = whole.join(F.broadcast(specs), "spec_id")
    room = F.col("containers") * F.col("capacity")
    return whole.select("spec_id", "capacity", "containers", "tokens", "fullest", (room - F.col("tokens")).alias("unused"), ((room - F.col("tokens")) / room).alias("unused_share"), F.expr("(tokens + capacity - 1) div capacity").alias("fewest"))
