"""Problem 6: mixing sources to target shares of the total size, with capped repetition, by a min-cost flow.

Documents are aggregated by the set of a mix's sources they belong to (their pattern). The flow goes from patterns
through sources: a pattern holds its tokens once a repetition, the k-th repetition costs k - 1, and each source takes
its share of the largest total that all sources can reach. Patterns and sources are few, however many documents there
are. Documents are then laid on a line in seeded order, one line a pattern, and each source draws a stretch of it.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .packing import tokens

MOST_PATTERNS = 50_000
MOST_TARGETS = 20_000


def clean_source(source: Column) -> Column:
    """``Readme-Mirror `` -> ``readme_mirror``; blank -> null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_"), F.lit(""))


class Flow:
    """Min-cost flow by successive shortest paths with potentials; costs are whole and not negative."""

    def __init__(self):
        self.arcs: dict[object, list[list]] = defaultdict(list)

    def add(self, a, b, capacity: int, cost: int = 0) -> list:
        arc, back = [b, capacity, cost, None, capacity], [a, 0, -cost, None, 0]
        arc[3], back[3] = back, arc
        self.arcs[a].append(arc)
        self.arcs[b].append(back)
        return arc

    def run(self, start, end) -> int:
        total, height = 0, defaultdict(int)
        while True:
            far, came, queue, n = {start: 0}, {}, [(0, 0, start)], 0
            while queue:
                d, _, node = heapq.heappop(queue)
                if d > far[node]:
                    continue
                for arc in self.arcs[node]:
                    if arc[1] > 0 and (e := d + arc[2] + height[node] - height[arc[0]]) < far.get(arc[0], 1 << 62):
                        far[arc[0]], came[arc[0]] = e, arc
                        n += 1
                        heapq.heappush(queue, (e, n, arc[0]))
            if end not in far:
                return total
            for node in list(self.arcs):
                height[node] += far.get(node, far[end])
            most, node = 1 << 62, end
            while node != start:
                most, node = min(most, came[node][1]), came[node][3][0]
            node = end
            while node != start:
                came[node][1] -= most
                came[node][3][1] += most
                node = came[node][3][0]
            total += most


def solve(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """How much can flow in, at most, of ``total``, and the flow from each pattern to each source at least cost."""
    net, taken = Flow(), {}
    for pattern, size in patterns.items():
        for k in range(max(repeats[s] for s in pattern)):
            net.add("all", ("pattern", pattern), size, k)
        for source in pattern:
            taken[pattern, source] = net.add(("pattern", pattern), ("source", source), size * repeats[source])
    for source, share in shares.items():
        net.add(("source", source), "mix", int(share * total))
    flow = net.run("all", "mix")
    return flow, {k: arc[4] - arc[1] for k, arc in taken.items() if arc[4] > arc[1]}


def largest(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total at which every source can have its share."""
    if all(len(p) == 1 for p in patterns):
        return int(min(patterns[(s,)] * repeats[s] / share for s, share in shares.items()))
    low, high = 0, int(sum(size * max(repeats[s] for s in p) for p, size in patterns.items())) + 1
    while high - low > max(1, low >> 24):
        middle = (low + high) // 2
        wanted = sum(int(share * middle) for share in shares.values())
        low, high = (middle, high) if solve(patterns, shares, repeats, middle)[0] >= wanted else (low, middle)
    return low


def fitted(gap: int, sizes: np.ndarray, uses: np.ndarray, exact: int = 1 << 17) -> np.ndarray:
    """How often each of the ``sizes``, ascending, at most its ``uses``, so that their sum is as near to ``gap`` as can be.

    What is beyond ``exact`` goes to the largest sizes that fit; the rest is a bounded subset sum, so a gap up to
    ``exact`` is met as nearly as possible, and a larger one as nearly as the sizes left by then allow."""
    out = np.zeros(len(sizes), np.int64)
    left = uses.astype(np.int64).copy()
    for i in reversed(range(len(sizes))):
        if gap <= exact:
            break
        n = min(int(left[i]), max(0, gap - exact // 2) // int(sizes[i]))
        out[i], gap = n, gap - n * int(sizes[i])
        left[i] -= n
    gap = min(gap, 2 * exact)  # more than that isn't there to be drawn
    if gap <= 0:
        return out
    first = np.full(2 * gap + 1, -1, np.int64)  # the step that reached a sum first; beyond twice the gap none is of use
    first[0], steps, reached = 0, [(0, 0)], np.zeros(2 * gap + 1, bool)
    reached[0] = True
    for i in reversed(range(len(sizes))):
        size, many, k = int(sizes[i]), int(left[i]), 1
        while many > 0 and not reached[gap]:
            k = min(k, many)
            if k * size > 2 * gap:
                break
            new = np.zeros_like(reached)
            new[k * size :] = reached[: len(reached) - k * size]
            new &= ~reached
            first[new] = len(steps)
            steps.append((i, k))
            reached |= new
            many, k = many - k, 2 * k
        if reached[gap]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - gap))])
    while at:
        i, k = steps[first[at]]
        out[i] += k
        at -= k * int(sizes[i])
    return out


def draw(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, buckets: int = 1024, reserve: int = 1 << 16) -> DataFrame:
    """(mix_id, doc_id, source, tokens, repeats): the drawn documents of each mix.

    ``documents``: doc_id (unique), sources (an array of clean names), text. ``targets``: mix_id, source, target_share,
    max_repeats. Without ``total`` a mix is as large as exact shares allow; a larger ``total`` fills what it can. Null
    and blank texts and documents without a source of the mix are never drawn. A source without any tokens gets
    nothing and the others keep their proportions. The last ``reserve`` tokens of each stretch are fitted from all
    documents of the pattern that may be used once more, repeats and patterns of several sources included: a source
    misses its quota only by what no choice of documents of its patterns can make up."""
    spark = documents.sparkSession
    held = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).limit(MOST_TARGETS + 1).collect()
    if len(held) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    mixes = defaultdict(dict)
    for r in held:
        if (r["share"] or 0) > 0 and (r["most"] or 0) > 0:
            mixes[r["mix_id"]][r["source"]] = float(r["share"]), int(r["most"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"mix_id long, doc_id {kind}, source string, tokens long, repeats int")
    if not mixes:
        return nothing
    literal = F.array(*(F.struct(F.lit(int(m)).cast("long").alias("mix_id"), F.array(*(F.lit(s) for s in sorted(own))).alias("wanted")) for m, own in sorted(mixes.items())))
    rows = documents.select("doc_id", "sources", tokens(F.col("text")).alias("tokens")).where("tokens > 0 and doc_id is not null")
    rows = rows.select("doc_id", "tokens", "sources", F.explode(literal).alias("m")).select("m.mix_id", "doc_id", "tokens", F.array_sort(F.array_distinct(F.array_intersect("sources", "m.wanted"))).alias("pattern"))
    rows = rows.where(F.size("pattern") > 0).withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("order", 40), F.lit(buckets)))
    rows = cut(rows)
    parts = rows.groupBy("mix_id", "pattern", "bucket").agg(F.sum("tokens").alias("part"))
    sums = parts.groupBy("mix_id", "pattern").agg(F.sum("part").alias("tokens")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    stretches = []
    for mix, own in mixes.items():
        patterns = {tuple(r["pattern"]): r["tokens"] for r in sums if r["mix_id"] == mix}
        there = {s for p in patterns for s in p}
        whole = sum(own[s][0] for s in there)
        if not there:
            continue
        shares, repeats = {s: own[s][0] / whole for s in there}, {s: own[s][1] for s in there}
        _, flow = solve(patterns, shares, repeats, largest(patterns, shares, repeats) if total is None else total)
        at = defaultdict(int)
        for (pattern, source), much in sorted(flow.items()):
            stretches.append((mix, list(pattern), source, patterns[pattern], at[pattern], much, max(0, much - reserve), max(repeats[s] for s in pattern)))
            at[pattern] += much
    if not stretches:
        return nothing
    wanted = F.broadcast(spark.createDataFrame(stretches, "mix_id long, pattern array<string>, source string, whole long, at long, quota long, much long, most int"))  # at most patterns x sources of a pattern
    line = Window.partitionBy("mix_id", "pattern")
    offsets = parts.withColumn("before", F.sum("part").over(line.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["before"]).drop("part")
    inside = Window.partitionBy("mix_id", "pattern", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("c", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["mix_id", "pattern", "bucket"]).withColumn("c", F.col("c") + F.col("before"))
    drawn = placed.join(wanted, ["mix_id", "pattern"])
    # copies k with at <= c + k * whole and c + tokens + k * whole <= at + much
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("c")) / F.col("whole")))
    last = F.floor((F.col("at") + F.col("much") - F.col("tokens") - F.col("c")) / F.col("whole"))
    copies = F.greatest(F.lit(0), last - first + 1).cast("int")
    # one row a document and mix: the copies that each of its sources draws, and the uses that are left
    drawn = drawn.groupBy("mix_id", "pattern", "doc_id", "tokens", "order").agg(F.map_from_entries(F.collect_list(F.struct("source", copies))).alias("n"), F.max("most").alias("most"))
    uses = F.aggregate(F.map_values("n"), F.lit(0), lambda a, x: a + x)
    drawn = cut(drawn.withColumn("left", F.col("most") - uses))
    got = drawn.select("mix_id", "pattern", "tokens", F.explode("n").alias("source", "k")).groupBy("mix_id", "pattern", "source").agg(F.sum(F.col("tokens") * F.col("k")).alias("got"))
    gaps = wanted.join(got, ["mix_id", "pattern", "source"], "left").select("mix_id", "pattern", "source", (F.col("quota") - F.coalesce("got", F.lit(0))).alias("gap"))
    widest = gaps.groupBy("mix_id", "pattern").agg(F.sum("gap").alias("widest"))
    left = drawn.where(F.col("left") > 0).join(F.broadcast(widest), ["mix_id", "pattern"]).where(F.col("tokens") <= 2 * F.col("widest"))
    sizes = left.groupBy("mix_id", "pattern", "tokens").agg(F.sum("left").alias("uses"))

    def fit(key, pattern_gaps, pattern_sizes):
        own = pattern_sizes.sort_values("tokens")
        size, free, taken, out = own["tokens"].to_numpy(), own["uses"].to_numpy().copy(), np.zeros(len(own), np.int64), []
        for source, gap in sorted(zip(pattern_gaps["source"], pattern_gaps["gap"].tolist())):
            chosen = fitted(gap, size, free)
            for i in np.flatnonzero(chosen).tolist():
                out.append((pattern_gaps["mix_id"].iloc[0], list(pattern_gaps["pattern"].iloc[0]), source, int(size[i]), int(taken[i]), int(taken[i] + chosen[i])))
            free, taken = free - chosen, taken + chosen
        return pd.DataFrame(out, columns=["mix_id", "pattern", "source", "tokens", "from", "to"])

    key = F.array_join("pattern", "\x1f").alias("_p")
    fits = gaps.groupBy("mix_id", key).cogroup(sizes.groupBy("mix_id", key)).applyInPandas(fit, "mix_id long, pattern array<string>, source string, tokens long, `from` long, `to` long")
    fits = cut(fits)  # at most a row a size and stretch
    # the uses of equal documents stand on a line in seeded order; only as many documents as are needed are ranked
    needed = fits.groupBy("mix_id", "pattern", "tokens").agg(F.max("to").alias("needed"))
    equal = Window.partitionBy("mix_id", "pattern", "tokens").orderBy("order", "doc_id")
    most = needed.agg(F.max("needed")).first()[0] or 0  # a limit that each task applies to its equal documents before they are shuffled
    some = drawn.where(F.col("left") > 0).join(needed, ["mix_id", "pattern", "tokens"]).withColumn("i", F.row_number().over(equal)).where(F.col("i") <= most).where(F.col("i") <= F.col("needed"))
    some = some.withColumn("b", F.coalesce(F.sum("left").over(equal.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    extra = some.join(fits, ["mix_id", "pattern", "tokens"]).select("mix_id", "doc_id", "source", "tokens", (F.least("to", F.col("b") + F.col("left")) - F.greatest("from", "b")).cast("int").alias("repeats")).where("repeats > 0")
    result = drawn.select("mix_id", "doc_id", "tokens", F.explode("n").alias("source", "repeats")).where("repeats > 0").select("mix_id", "doc_id", "source", "tokens", "repeats")
    return result.unionAll(extra).groupBy("mix_id", "doc_id", "source", "tokens").agg(F.sum("repeats").cast("int").alias("repeats"))


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share, drawn tokens, documents and most repeats; sources without documents too."""
    per = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.count_distinct("doc_id").alias("documents"), F.max("repeats").alias("most_repeats"))
    all_ = targets.select("mix_id", "source", "target_share", "max_repeats").join(per, ["mix_id", "source"], "left").na.fill(0, ["drawn_tokens", "documents", "most_repeats"])
    whole = F.sum("drawn_tokens").over(Window.partitionBy("mix_id"))
    return all_.withColumn("actual_share", F.coalesce(F.try_divide(F.col("drawn_tokens"), whole), F.lit(0.0)))


def by_source(documents: DataFrame) -> DataFrame:
    """``documents`` of this project as (doc_id, sources, text): each belongs to its one source, cleanly spelt."""
    return documents.select("doc_id", F.array_compact(F.array(clean_source(F.col("source")))).alias("sources"), "text")
