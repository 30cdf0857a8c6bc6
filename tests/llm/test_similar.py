"""Problems 1, 2 and 4 against brute force, and their edge cases."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bagminhash, leakage, neardup, nearsame, overlap, queries
from corpusloom.llm import edited as search
from corpusloom.llm.components import components
from corpusloom.llm.words import spelt


def near(a, b):
    a, b = set(spelt(a)), set(spelt(b))
    return bool(a | b) and 10 * len(a & b) >= 7 * len(a | b)


def groups_of(texts):
    root = dict.fromkeys(texts)
    for k in root:
        root[k] = k

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if near(texts[a], texts[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in texts if spelt(texts[k])}


def test_clean_splits(spark):
    rows = [("Train/", None), ("./train_small", "test"), (" VAL-small ", "train"), (None, "Validation"), (None, "valid"), (None, "TRAIN "), ("test", None), (None, None), ("", "val"), ("odd", None)]
    df = spark.createDataFrame(rows, "f string, h string").select(overlap.side(*map(__import__("pyspark").sql.functions.col, "fh")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["train", "train", "eval", "eval", "eval", "train", "eval", None, "eval", None]


def test_p1_found_equals_brute_force(spark, folder):
    rows = overlap.records(spark.read.parquet(f"{folder}/finetune_example.parquet")).collect()
    sides = defaultdict(list)
    for r in rows:
        sides[r["side"]].append((r["uid"], set(spelt(r["text"]))))
    truth = {(min(i, j), max(i, j)) for i, a in sides["eval"] for j, b in sides["train"] if a | b and 10 * len(a & b) >= 7 * len(a | b)}
    got = [tuple(r) for r in queries.p1_found(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == truth


def test_p1_counts_add_up(spark, folder):
    got = queries.p1_counts(spark, folder).collect()
    assert sum(r["pairs"] for r in got) == queries.p1_found(spark, folder).count()
    assert all(r["rows_exact"] <= r["rows_overlapping"] <= r["eval_rows"] for r in got)


def test_exact_means_the_same_words_in_order(spark):
    rows = [(1, "train", "a b c"), (2, "test", "A b, c"), (3, "test", "c b a"), (4, "test", "a b c c"), (5, "test", "x y")]
    df = spark.createDataFrame(rows, "example_id long, folder_split string, query string").selectExpr("*", "folder_split hf_split", "'s' source")
    exact = {r["eval_uid"]: r["exact"] for r in overlap.overlaps(overlap.records(df)).collect()}
    assert exact == {2: True, 3: False, 4: False}
    got = overlap.counts(df).first()
    assert (got["rows_exact"], got["rows_overlapping"], got["pairs"]) == (1, 3, 3)


def test_p2_found_equals_brute_force(spark, folder):
    rows = neardup.both_tables(spark.read.parquet(f"{folder}/finetune_example.parquet"), spark.read.parquet(f"{folder}/mc_items.parquet")).collect()
    groups = groups_of({r["uid"]: r["text"] for r in rows})
    truth = {(a, b) for a, b in itertools.combinations(sorted(groups), 2) if groups[a] == groups[b]}
    got = [tuple(r) for r in queries.p2_found(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == truth


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows are copies of one text; edited versions of it and chains of edits stand among the others."""
    rng = random.Random(4)
    hot = [f"hot{i}" for i in range(40)]
    texts = [" ".join(hot)] * 300 + [edited(rng, hot, 3) for _ in range(12)]
    for k in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(40)]
        texts.append(" ".join(words))
        for _ in range(3):
            words = edited(rng, words, 4).split()
            rng.shuffle(words)
            texts.append(" ".join(words))
    texts += [f"w{rng.randrange(4000)} " * 3 for _ in range(200)] + [None, "", "  ", "...", "one", "one", "One!"]
    rng.shuffle(texts)
    return {i: t for i, t in enumerate(texts)}


def test_groups_under_skew(spark, skewed):
    df = spark.createDataFrame(list(skewed.items()), "uid long, text string").repartition(6)
    truth = groups_of(skewed)
    got = {r["uid"]: r["group_id"] for r in neardup.groups(df).collect()}
    assert got.keys() == truth.keys()
    both = defaultdict(set)
    for uid, group in got.items():
        both[group].add(truth[uid])
    assert all(len(x) == 1 for x in both.values())  # never joins what isn't linked
    members = defaultdict(set)
    for uid, root in truth.items():
        members[root].add(got[uid])
    lost = sum(len(x) - 1 for x in members.values())
    assert lost <= 0.03 * len(members)


def test_links_have_their_figures(spark, skewed):
    df = spark.createDataFrame(list(skewed.items()), "uid long, text string")
    own = {r["cls"]: skewed[r["uid"]] for r in nearsame.members(df.select("uid", "text")).collect()}
    for r in nearsame.links(df).collect():
        a, b = set(spelt(own[r["a"]])), set(spelt(own[r["b"]]))
        assert (r["common"], r["either"]) == (len(a & b), len(a | b)) and r["a"] < r["b"] and 10 * r["common"] >= 7 * r["either"]


def test_links_between_edits_of_a_hot_text(spark):
    """A third of all different texts are edits of one: its words are common, but its links are links."""
    rng = random.Random(12)
    hot = [f"hot{i}" for i in range(42)]
    texts = [edited(rng, hot, 3) for _ in range(200)] + [" ".join(f"w{rng.randrange(4000)}" for _ in range(42)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").repartition(4)
    own = {r["uid"]: r["cls"] for r in nearsame.members(df).collect()}
    sets = [set(t.split()) for t in texts[:200]]
    truth = {tuple(sorted((own[a], own[b]))) for a, b in itertools.combinations(range(200), 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    got = {(r["a"], r["b"]) for r in nearsame.links(df.select("text")).collect()}
    assert got <= truth and len(got) >= 0.99 * len(truth)


@pytest.mark.parametrize("vocabulary, shared, own", [(60, 21, 4), (300, 20, 3), (1000, 20, 3), (5000, 20, 3)])
def test_links_of_common_words(spark, vocabulary, shared, own):
    """Pairs that share common words and differ in rare ones, as forms and frames do, are found like any others."""
    rng = random.Random(vocabulary)
    texts, truth = [], set()
    for k in range(1000):
        frame = rng.sample(range(vocabulary), shared)
        for side in "ab":
            texts.append(" ".join([f"c{w}" for w in frame] + [f"{side}{k}x{i}" for i in range(own - (side == "b" and shared == 21))]))
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").repartition(4)
    cls = {r["uid"]: r["cls"] for r in nearsame.members(df).collect()}
    truth = {tuple(sorted((cls[2 * k], cls[2 * k + 1]))) for k in range(1000)}
    got = {(r["a"], r["b"]) for r in nearsame.links(df.select("text")).collect()}
    assert len(got & truth) >= 0.99 * len(truth)


def bag_near(a, b):
    a, b = Counter(spelt(a)), Counter(spelt(b))
    return bool(a | b) and 10 * (a & b).total() >= 7 * (a | b).total()


def test_bags(spark):
    """Repeats count: against brute force over multisets, some with more repeats than a signature tells apart."""
    rng = random.Random(3)
    texts = []
    for k in range(60):
        words = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 60))] + [f"o{k}"] * rng.choice([1, 2, 90])
        texts += [" ".join(words)] + [" ".join(rng.sample(words, max(1, int(len(words) * share)))) for share in (0.65, 0.72, 0.8, 0.95)]
    texts += ["a a a b", "a b", "b a a a", "a " * 300 + "b", "a " * 299 + "b", "a " * 200]
    df, p = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").repartition(3), nearsame.Near(bag=True)
    cls = {r["uid"]: r["cls"] for r in nearsame.members(df, p).collect()}
    truth = {tuple(sorted((cls[i], cls[j]))) for i, j in itertools.combinations(range(len(texts)), 2) if cls[i] != cls[j] and bag_near(texts[i], texts[j])}
    assert all((cls[i] == cls[j]) == (Counter(spelt(texts[i])) == Counter(spelt(texts[j]))) for i, j in itertools.combinations(range(len(texts)), 2))
    got = {(r["a"], r["b"]) for r in nearsame.links(df.select("text"), p).collect()}
    assert got <= truth and len(got) >= 0.98 * len(truth)
    forced = {tuple(sorted((r["a"], r["b"]))) for r in nearsame.by_force(df.select("text"), df.select("uid").join(spark.createDataFrame(list(cls.items()), "uid long, cls long"), "uid"), p, block_words=500).collect()}
    assert forced == truth


def test_p2_recall(spark, folder):
    got = queries.p2_recall(spark, folder).collect()
    assert all(r["wrong"] == 0 and r["found"] == r["links"] for r in got)
    none = spark.createDataFrame([], "uid long, text string")
    assert nearsame.recall(none).count() == 0


def test_expected_recall_at_the_threshold():
    """Of the least similar links, by the bands' formula and by count; longer texts pass the sketch, too."""
    p = nearsame.Near()
    assert 1 - (1 - 0.7**p.rows) ** p.bands > 0.9998
    rng = np.random.default_rng(8)
    met = passed = 0
    for _ in range(20):
        words = rng.integers(1, 1 << 52, (200, 100)).astype(np.uint64)
        sides = []
        for own in (words[:, :85], words[:, 15:]):  # 70 common of 100
            flat, offsets = np.sort(own, axis=1).ravel(), np.arange(201) * 85
            signature = bagminhash.Signer(p.rows * p.bands).sign(bagminhash.weighted(flat), offsets)
            sides.append((bagminhash.bands(signature, p.rows, p.bands), *(x.view(np.uint64) for x in nearsame.sketches(flat, offsets, signature))))
        (a, c, e), (b, d, f) = sides
        met += (a == b).any(axis=1).sum()
        passed += (np.bitwise_count((c ^ d) << np.uint64(8)) + np.bitwise_count(e ^ f) <= p.apart).sum()
    assert met >= 3996 and passed >= 3999


def sides(rng, common, own, texts):
    """Two collections of texts as words and offsets: the n-th texts share ``common`` words and have ``own`` more each."""
    words = rng.integers(1, 1 << 52, (texts, common + 2 * own)).astype(np.uint64)
    return [(np.sort(x, axis=1).ravel(), np.arange(texts + 1) * (common + own)) for x in (words[:, : common + own], np.delete(words, np.s_[common : common + own], axis=1))]


def keys_of(words, offsets, p):
    signature = bagminhash.Signer(p.width * p.groups).sign(bagminhash.weighted(words), offsets)
    return nearsame.group_keys(signature, p, 0, p.groups)


def test_grouped_bands_meet_as_often_as_said():
    """Links at the threshold meet, texts that only share common words hardly ever do."""
    p, rng = nearsame.Near(), np.random.default_rng(9)
    assert p.recall(0.7) > 0.9998 and p.bands == p.groups * p.each
    met = 0
    for _ in range(10):
        (a, x), (b, y) = (keys_of(*own, p) for own in sides(rng, 70, 15, 400))
        met += (x == y).any(axis=(1, 2)).sum()
    assert met >= 3996
    (a, x), (b, y) = (keys_of(*own, p) for own in sides(rng, 16, 26, 4000))  # a common share of 0.235
    assert (x == y).sum() < 0.02 * len(x)  # bands of four components, 32 of them, had 0.098
    assert ((x == y).any(axis=2) <= (a == b)).all()  # a key is met where its group's component is


def test_rows_with_one_key_are_paired(monkeypatch):
    """Every pair once, in blocks of any size, with the condition that columns have."""
    monkeypatch.setattr(nearsame, "PAIRS", 7)
    p, rng = nearsame.Near(), np.random.default_rng(2)
    rows = np.zeros(300, nearsame._row(p))
    rows["cls"], key = rng.integers(-50, 50, 300), rng.integers(0, 30, 300).astype(np.uint32)
    rows["sketch"], rows["more"] = (rng.choice([20, 25, 30, 63, 64, 80, 255], 300).astype(np.uint64) << np.uint64(56)) | rng.integers(0, 1 << 12, 300).astype(np.uint64), rng.integers(0, 1 << 12, 300)
    limits = nearsame._limits(p)

    def near(x, y):
        a, b = int(x["sketch"]) >> 56, int(y["sketch"]) >> 56
        differ = ((int(x["sketch"]) ^ int(y["sketch"])) & ((1 << 56) - 1)).bit_count() + (int(x["more"]) ^ int(y["more"])).bit_count()
        alike = 17 * differ <= 3 * (a + b) if max(a, b) < 64 else differ <= p.apart if min(a, b) >= 64 else True
        return 10 * min(a, b) >= 7 * max(a, b) and alike

    truth = Counter(tuple(sorted((int(rows["cls"][i]), int(rows["cls"][j])))) for i, j in itertools.combinations(range(300), 2) if key[i] == key[j] and rows["cls"][i] != rows["cls"][j] and near(rows[i], rows[j]))
    got = Counter((int(a), int(b)) for x, y in nearsame._pairs(key, rows, limits) for a, b in zip(x, y))
    assert got == truth and truth
    assert list(nearsame._pairs(key[:0], rows[:0], limits)) == []


def test_rounds_give_the_same_links(spark, skewed, monkeypatch):
    df, found = spark.createDataFrame([(t,) for t in skewed.values()], "text string").repartition(5), []
    for rounds in (1, 3, 5):
        monkeypatch.setattr(nearsame, "ROUNDS", rounds)
        found.append({tuple(r) for r in nearsame.links(df).collect()})
    assert found[0] and found[0] == found[1] == found[2]


def test_sketches_turn_no_shorter_link_away(spark):
    rng = np.random.default_rng(6)
    pairs, sizes = [], rng.integers(1, 64, 800)
    for n in sizes.tolist():
        words = rng.integers(1, 1 << 52, 2 * n + 2).astype(np.uint64)
        for gone in range(n):  # as far apart as a link can be
            new = next((k for k in range(n, -1, -1) if 10 * (n - gone) >= 7 * (n + k)), None)
            if new is None:
                break
            last = (words[:n], np.concatenate([words[gone:n], words[n : n + new]]))
            if rng.random() < 0.3:
                pairs.append(last)
        pairs.append(last)
    signer = bagminhash.Signer(120)
    sides = []
    for own in zip(*pairs):
        words, offsets = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        sides += [x.tolist() for x in nearsame.sketches(words, offsets, signer.sign(bagminhash.weighted(words), offsets))]
    df = spark.createDataFrame(list(zip(*sides)), "a long, b long, c long, d long")
    assert df.where(~nearsame.may_be_near((F.col("a"), F.col("b")), (F.col("c"), F.col("d")), nearsame.Near())).count() == 0


def test_empty_and_null_tables(spark):
    none = spark.createDataFrame([], "uid long, text string")
    assert neardup.found(none).count() == 0 and neardup.groups(none).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, "a b"), (4, "a b")], "uid long, text string")
    assert [tuple(r) for r in neardup.found(nulls).collect()] == [(3, 4)]
    examples = spark.createDataFrame([(1, None, None, "train", "a b c", 7), (2, None, None, None, "a b c", 7), (None, None, "s", "test", "a b c", 7), (4, None, "s", "test", "A b, c", 7), (4, None, "s", "test", "A b, c", 7)], "example_id long, hf_split string, source string, folder_split string, query string, cls int")
    assert [tuple(r) for r in overlap.found(examples).collect()] == [(1, 4), (1, 4)]
    assert overlap.found(examples.limit(0)).count() == 0
    assert overlap.counts(examples.limit(0)).count() == 0


def test_very_long_text(spark):
    body = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, body), (2, body + " more"), (3, "x" * 2_000_000)], "uid long, text string")
    assert [tuple(r) for r in neardup.found(df).collect()] == [(1, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1060)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    links += [(5, 4), (7, 7), (None, 3)]
    rng.shuffle(links)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def leaks_by_hand(docs, items, window=12, shared=5):
    held = defaultdict(set)
    for table, item, text in items:
        w = spelt(text)
        for i in range(len(w) - window + 1):
            held[tuple(w[i : i + window])].add((table, item))
    out = set()
    for doc, text in docs:
        w = spelt(text)
        for i in range(len(w) - window + 1):
            own = held.get(tuple(w[i : i + window]), ())
            if len(own) < shared:
                out |= {(doc, *x) for x in own}
    return out


def test_p4_found_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = queries._held_out(spark, folder).collect()
    got = [tuple(r) for r in queries.p4_found(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == leaks_by_hand(docs, items)
    assert queries.p4_items(spark, folder).count() == 3


def test_leaks_at_the_edges(spark):
    w = [f"w{i}" for i in range(40)]
    items = [("t", 1, " ".join(w[:20])), ("t", 2, " ".join(w[25:36])), ("t", 3, " ".join(w[25:37])), ("t", None, " ".join(w)), ("t", 5, None), ("t", 6, "")]
    items += [("s", i, "frame " * 12 + f"own{i}") for i in range(5)]
    docs = [(1, " ".join(w[3:15])), (2, " ".join(w[3:14])), (3, "x " + " ".join(w[25:37]).upper()), (4, "frame " * 30), (5, None), (6, ""), (None, " ".join(w)), (7, "y " * 300_000 + " ".join(w[8:20])), (1, " ".join(w[3:15]))]
    df, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_table string, item_id long, text string")
    got = [tuple(r) for r in leakage.leaks(df, held).collect()]
    assert len(got) == len(set(got)) and set(got) == {(1, "t", 1), (3, "t", 3), (7, "t", 1)}
    assert leakage.leaks(df.limit(0), held).count() == 0 and leakage.leaks(df, held.limit(0)).count() == 0


def best_edits(window, told):
    """Least edits from ``window`` to a prefix of ``told``, the plain way."""
    row = list(range(len(told) + 1))
    for i, x in enumerate(window, 1):
        new = [i]
        for j, y in enumerate(told, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_banded_distances():
    rng = np.random.default_rng(5)
    for size, most in ((12, 1), (24, 2), (48, 4), (5, 0)):
        one = rng.integers(1, 4, (60, size)).astype(np.uint64)
        two = np.concatenate([one, rng.integers(1, 4, (60, most))], axis=1).astype(np.uint64)
        for i in range(60):
            for _ in range(rng.integers(0, most + 2)):
                at = rng.integers(0, size)
                kind = rng.integers(0, 3)
                if kind == 0:
                    two[i, at] = 9
                elif kind == 1:
                    two[i] = np.append(np.insert(two[i], at, 9), 0)[: size + most]
                else:
                    two[i] = np.append(np.delete(two[i], at), 9)
        got = search.within(one, two, most)
        assert got.tolist() == [min(best_edits(a.tolist(), b.tolist()), most + 1) for a, b in zip(one, two)]


def changed(rng, words, edits):
    """Words with so many of them replaced, left out, or others put in."""
    out = list(words)
    for _ in range(edits):
        kind, at = rng.choice("sid"), rng.randrange(len(out))
        if kind == "s":
            out[at] = f"n{rng.randrange(10**9)}"
        elif kind == "i":
            out.insert(at, f"n{rng.randrange(10**9)}")
        else:
            del out[at]
    return out


def leaks_with_edits(docs, items, p, every=1):
    """Every document and item whose id ``every`` divides, window by window."""
    numbers = {}
    number = lambda text: [numbers.setdefault(w, len(numbers) + 1) for w in spelt(text)]
    wanted, holders = [], defaultdict(set)
    for table, item, text in items:
        w = number(text)
        starts, _, sizes = search.item_starts(np.array([0, len(w)]), p)
        for a, size in zip(starts.tolist(), sizes.tolist()):
            holders[tuple(w[a : a + size])].add((table, item))
            wanted.append((table, item, tuple(w[a : a + size])))
    wanted = [x for x in wanted if len(holders[x[2]]) < p.shared and x[1] % every == 0]
    out = {}
    for doc, text in docs:
        told = number(text)
        index = defaultdict(list)
        for j, x in enumerate(told):
            index[x].append(j)
        for table, item, window in wanted:
            most, own = p.edits(len(window)), set()
            for i, x in enumerate(window):
                own |= {j - i + d for j in index.get(x, ()) for d in range(-most, most + 1)}
            if len(index.keys() & set(window)) < len(set(window)) - most:
                continue
            for a in own:
                if 0 <= a <= len(told) - len(window):
                    d = best_edits(window, told[a : a + len(window) + most])
                    if d <= most:
                        out[doc, table, item] = min(d, out.get((doc, table, item), d))
    return out


def test_edited_passages_are_found(spark):
    """Items of all sizes, each with as many changes, insertions and omissions as its windows may have, among other words."""
    rng = random.Random(9)
    items, docs, p = [], [], search.Edited(block_keys=4000)
    for i in range(240):
        w = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([12, 15, 24, 30, 48, 100]))]
        items.append(("t", i, " ".join(w)))
        size = max(s for s in p.sizes if s <= len(w))
        noise = [f"v{rng.randrange(3000)}" for _ in range(80)]
        docs.append((i, " ".join([*noise[:40], *changed(rng, w, p.edits(size)), *noise[40:]])))
    df, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_table string, item_id long, text string")
    truth = leaks_with_edits(docs, items, p)
    got = {(r["doc_id"], r["item_table"], r["item_id"]): r["edits"] for r in search.leaks(df, held, p).collect()}
    assert got.keys() <= truth.keys() and all(truth[k] <= v for k, v in got.items())
    assert len(truth) > 200 and len(got) >= 0.95 * len(truth)


def test_p4_edited_against_brute_force(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in queries._held_out(spark, folder).collect()]
    truth = leaks_with_edits(docs, items, search.Edited(), every=20)
    got = {(r["doc_id"], r["item_table"], r["item_id"]) for r in queries.p4_edited(spark, folder).collect() if r["item_id"] % 20 == 0}
    assert got <= truth.keys() and len(got) >= 0.9 * len(truth)


def test_edited_leaks_at_the_edges(spark):
    w = [f"w{i}" for i in range(60)]
    items = [("t", 1, " ".join(w[:20])), ("t", 2, " ".join(w[25:36])), ("t", None, " ".join(w)), ("t", 5, None), ("t", 6, "")] + [("s", i, "frame " * 12) for i in range(5)]
    docs = [(1, " ".join(w[:12])), (2, " ".join(w[:11])), (3, " ".join(w[:6] + ["x"] + w[6:20])), (4, "frame " * 30), (5, None), (6, ""), (None, " ".join(w)), (7, "y " * 200_000 + " ".join(w[8:20])), (1, " ".join(w[:12]))]
    df, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_table string, item_id long, text string")
    got = [tuple(r) for r in search.leaks(df.withColumn("key", F.lit(1)).withColumn("size", F.lit(1)), held.withColumn("words", F.lit("x"))).collect()]
    assert {x[0] for x in got} == {1, 3, 7} and len(got) == 3 and {x[:3]: x[3] for x in got}[1, "t", 1] == 0
    assert search.leaks(df.limit(0), held).count() == 0 and search.leaks(df, held.limit(0)).count() == 0
