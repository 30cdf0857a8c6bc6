"""Problems 5, 6 and 7."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import mixing, packing, queries, splitting


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_places_everything(histogram):
    steps, containers = packing.plan(histogram, 40)
    used, placed = Counter(), Counter()
    ends = defaultdict(dict)
    for size, rank, first in steps:
        ends[size][rank] = first
    for size, n in histogram.items():
        starts = sorted(ends[size])
        for rank in range(n):
            start = max(s for s in starts if s <= rank)
            used[ends[size][start] + rank - start] += size
            placed[size] += 1
    assert all(v <= 40 for v in used.values()) and placed == Counter(histogram) and len(used) == containers
    assert containers <= 2 * sum(s * n for s, n in histogram.items()) / 40 + 1


def checked(packed, sizes, capacity):
    held, seen = Counter(), defaultdict(list)
    for r in packed:
        held[r["container"]] += r["size"]
        seen[r["doc_id"]].append((r["piece"], r["start"], r["size"]))
    assert all(v <= capacity for v in held.values())
    for doc, size in sizes.items():
        at = 0
        for k, (piece, start, n) in enumerate(sorted(seen[doc])):
            assert (piece, start) == (k, at)
            at += n
        assert at == size and (len(seen[doc]) == 1 or size > capacity)
    return held


def test_packing_with_a_hot_size(spark):
    rng = random.Random(1)
    texts = {i: "x" * (7 if i % 3 == 0 else rng.randrange(0, 90)) for i in range(600)} | {600: None, 601: "ü" * 25, 602: "y" * 300}
    sizes = {k: len((v or "").encode()) for k, v in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    wide = packing.pack(df, {1: 50}).collect()
    hot = packing.pack(df.repartition(5), {1: 50}, group_rows=20).collect()
    assert checked(wide, sizes, 50).keys() == checked(hot, sizes, 50).keys()
    assert {tuple(r) for r in wide} == {tuple(r) for r in hot}  # a container doesn't hang on how a hot size is split
    total = sum(sizes.values())
    assert len({r["container"] for r in wide if r["size"]}) <= 1.05 * -(-total // 50) + 1
    assert packing.pack(df.limit(0), {1: 50}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, {1: 0})
    with pytest.raises(ValueError):
        packing.pack(df, {1: packing.MOST_SIZES + 1})


def test_p5(spark, folder):
    packed = queries.p5_pack(spark, folder).collect()
    sizes = {r["doc_id"]: len((r["text"] or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for spec, capacity in ((1, 2048), (2, 8192)):
        checked([r for r in packed if r["spec_id"] == spec], sizes, capacity)
    for r in queries.p5_unused(spark, folder).collect():
        assert r["containers"] * r["capacity"] - r["tokens"] == r["unused"] and r["fullest"] <= r["capacity"] and r["containers"] <= 1.05 * r["fewest"] + 1


def test_flow():
    patterns = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    shares, repeats = {"a": 0.5, "b": 0.5}, {"a": 2, "b": 2}
    total = mixing.largest(patterns, shares, repeats)
    assert 415 <= total <= 421
    flow, routes = mixing.solve(patterns, shares, repeats, 200)
    assert flow == 200 and sum(v for (p, s), v in routes.items() if s == "b") == 100
    assert all(sum(v for (q, _), v in routes.items() if q == p) <= size for p, size in patterns.items())  # first uses come before repetition
    assert mixing.largest({("a",): 100, ("b",): 10}, shares, repeats) == 40


def drawn_checked(spark, rows, targets):
    size = {r["doc_id"]: r["tokens"] for r in rows}
    most = {(t[0], t[1]): t[3] for t in targets}
    per, times = defaultdict(int), Counter()
    for r in rows:
        per[r["mix_id"], r["source"]] += r["tokens"] * r["repeats"]
        times[r["mix_id"], r["doc_id"]] += r["repeats"]
        assert 1 <= r["repeats"] <= most[r["mix_id"], r["source"]]
    assert len(times) == len(rows) and size
    return per


def test_mixture_shares(spark):
    rng = random.Random(5)
    docs = [(i, ["big"] if i % 3 else ["hot"], "x" * rng.randrange(1, 300)) for i in range(900)] + [(1000 + i, ["tiny"], "y" * 50) for i in range(4)] + [(2000, ["big"], None), (2001, [], "z"), (2002, None, "z"), (2003, ["other"], "z"), (2004, ["big"], "")]
    targets = [(1, "big", 0.5, 1), (1, "hot", 0.3, 2), (1, "tiny", 0.2, 3), (2, "big", 0.7, 2), (2, "absent", 0.3, 2)]
    df, t = spark.createDataFrame(docs, "doc_id long, sources array<string>, text string"), spark.createDataFrame(targets, "mix_id long, source string, target_share double, max_repeats int")
    per = drawn_checked(spark, mixing.draw(df, t).collect(), targets)
    whole = sum(v for (m, _), v in per.items() if m == 1)
    assert per[1, "tiny"] == 600
    for s, share in (("big", 0.5), ("hot", 0.3), ("tiny", 0.2)):
        assert abs(per[1, s] / whole - share) < 0.01
    assert per[2, "big"] == 2 * sum(len(x or "") for _, s, x in docs if s == ["big"])
    again = {tuple(r) for r in mixing.draw(df.repartition(7), t).collect()}
    assert again == {tuple(r) for r in mixing.draw(df, t).collect()}
    assert mixing.draw(df.limit(0), t).count() == 0 and mixing.draw(df, t.limit(0)).count() == 0


def test_overlapping_sources(spark):
    docs = [(i, ["a", "b"] if i % 2 else ["a"], "x" * (1 + i % 40)) for i in range(800)]
    targets = [(1, "a", 0.5, 1), (1, "b", 0.5, 2)]
    df, t = spark.createDataFrame(docs, "doc_id long, sources array<string>, text string"), spark.createDataFrame(targets, "mix_id long, source string, target_share double, max_repeats int")
    per, times = defaultdict(int), Counter()
    for r in mixing.draw(df, t).collect():
        per[r["source"]] += r["tokens"] * r["repeats"]
        times[r["doc_id"]] += r["repeats"]
    assert abs(per["a"] - per["b"]) <= 2 and max(times.values()) <= 2


def best_miss(quota, sizes, uses):
    """The least distance of any sum of the sizes from the quota."""
    bits, mask = 1, (1 << (2 * quota + 1)) - 1
    for size, n in zip(sizes, uses):
        for _ in range(n):
            more = bits | (bits << size) & mask
            if more == bits:
                break
            bits = more
    return min(abs(i - quota) for i in range(2 * quota + 1) if bits >> i & 1)


@pytest.mark.parametrize("seed", range(12))
def test_fitted(seed):
    rng = random.Random(seed)
    sizes = sorted(rng.sample(range(1, 400), rng.randrange(1, 12)))
    uses = [rng.randrange(0, 5) for _ in sizes]
    gap = rng.randrange(0, 1500)
    got = mixing.fitted(gap, np.array(sizes), np.array(uses))
    assert (got >= 0).all() and (got <= uses).all()
    assert abs(int((got * sizes).sum()) - gap) == best_miss(gap, sizes, uses)
    large = mixing.fitted(40_000, np.array(sizes), np.array(uses) * 1000, exact=500)
    assert (large <= np.array(uses) * 1000).all() and abs(int((large * sizes).sum()) - min(40_000, sum(u * 1000 * z for u, z in zip(uses, sizes)))) <= max(sizes)


def test_p6_is_as_near_as_can_be(spark, folder):
    """Where a source's whole quota is fitted, no choice of its documents comes nearer."""
    docs = mixing.by_source(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    held = defaultdict(list)
    for r in docs:
        for s in r["sources"]:
            if r["text"]:
                held[s].append(len(r["text"].encode("utf-8", "surrogatepass")))
    targets = spark.read.parquet(f"{folder}/mix_targets.parquet").collect()
    per = Counter()
    for r in queries.p6_draw(spark, folder).collect():
        per[r["mix_id"], r["source"]] += r["tokens"] * r["repeats"]
    for mix in {r["mix_id"] for r in targets}:
        own = {r["source"]: r for r in targets if r["mix_id"] == mix and held[r["source"]]}
        whole = sum(r["target_share"] for r in own.values())
        shares = {s: r["target_share"] / whole for s, r in own.items()}
        total = mixing.largest({(s,): sum(held[s]) for s in own}, shares, {s: r["max_repeats"] for s, r in own.items()})
        for s, r in own.items():
            quota = int(shares[s] * total)
            if quota <= 1 << 16:
                assert abs(per[mix, s] - quota) == best_miss(quota, held[s], [r["max_repeats"]] * len(held[s]))
            else:
                assert abs(per[mix, s] - quota) <= min(held[s])


def test_p6(spark, folder):
    targets = [tuple(r) for r in spark.read.parquet(f"{folder}/mix_targets.parquet").select("mix_id", "source", "target_share", "max_repeats").collect()]
    drawn_checked(spark, queries.p6_draw(spark, folder).collect(), targets)
    for r in queries.p6_shares(spark, folder).collect():
        assert r["most_repeats"] <= r["max_repeats"]


def assert_pieces(text, cuts, capacity, overlap):
    data = text.encode("utf-8", "surrogatepass")
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data)
    assert all(b - a <= capacity for a, b, _ in cuts)
    assert all(after[0] == before[1] - overlap for before, after in zip(cuts, cuts[1:]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\nü漢🙂", max_size=600), st.integers(16, 80), st.integers(0, 7))
def test_pieces_fit(text, capacity, overlap):
    cuts, longest = splitting.split(text, capacity, overlap)
    assert_pieces(text, cuts, capacity, overlap)
    assert longest == max((len(w.encode()) for w in re.split(r"\s+", text)), default=0)


def test_natural_cuts_where_there_are_any():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", ".", ".\n\n"]) for _ in range(4000))
    cuts, _ = splitting.split(text, 512, 32)
    assert_pieces(text, cuts, 512, 32)
    assert all(kind > splitting.FORCED for *_, kind in cuts)


def test_an_edit_alters_neighbours_only():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(9000)]
    text = " ".join(w + "." if i % 11 == 0 else w for i, w in enumerate(words))
    at = len(text) // 3
    other = text[:at] + "inserted some words " + text[at:]
    one = {text[a:b] for a, b, _ in splitting.split(text, 1024, 64)[0]}
    two = {other[a:b] for a, b, _ in splitting.split(other, 1024, 64)[0]}
    assert len(one - two) <= 0.3 * len(one)


def test_landmarks_hang_on_the_window_only():
    data = np.frombuffer(bytes(random.Random(2).randrange(256) for _ in range(500)), np.uint8)
    assert (splitting.landmarks(data)[100 + 32 :] == splitting.landmarks(data[100:])[32:]).all()


def test_p7(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    truth = {(i, s, "forced" if max(len(w.encode()) for w in re.split(r"\s+", t)) > c else "natural") for i, t in texts.items() for s, c in ((3, 4096), (4, 16384)) if t and len(t.encode()) > c}
    assert {tuple(r) for r in queries.p7_found(spark, folder).collect()} == truth
    per = defaultdict(list)
    for r in queries.p7_pieces(spark, folder).collect():
        per[r["doc_id"], r["spec_id"]].append((r["piece"], r["start"], r["stop"], r["text"]))
    for (doc, spec), own in per.items():
        own.sort()
        assert [k for k, *_ in own] == list(range(len(own)))
        assert_pieces(texts[doc], [(a, b, 0) for _, a, b, _ in own], {3: 4096, 4: 16384}[spec], {3: 256, 4: 1024}[spec])


def test_splitting_tables(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "z" * 5000, "c"), (None, "a b " * 300, "c"), (3, "z" * 5000, "c")], "doc_id long, text string, cut string")
    got = splitting.found(splitting.pieces(df, {9: (1000, 10)})).collect()
    assert sorted(map(tuple, got), key=repr) == [(3, 9, "forced"), (3, 9, "forced"), (None, 9, "natural")]
    assert splitting.pieces(df.limit(0), {9: (1000, 10)}).count() == 0
    with pytest.raises(ValueError):
        splitting.pieces(df, {9: (100, 50)})
