import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bagminhash, cgk, words


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, []), ("", []), (" \n\t", []), ("Café déjà-vu!", ["cafe", "deja", "vu"]), ("Frоk", ["frok"]), ("ｂｅｓｔ Ｎ", ["best", "n"]),
        ("st​o⁠l­e", ["stole"]), ("<p>a <b>bold</b>&#160;x</p>", ["a", "bold", "x"]), ("&lt;b&gt;a&lt;/b&gt; &amp;amp; c", ["a", "c"]), ("in-\nserted, well-known", ["inserted", "well", "known"]),
        ("caf\\u00e9 a\\nb", ["cafe", "a", "b"]), ("x < y > z", ["x", "y", "z"]), ("Straße ﬁn", ["strasse", "fin"]), ("éte", ["ete"]), ("a%20b", ["a", "b"]), ("one😀two", ["one", "two"]), ("\ud800x", ["x"]),
    ],
)
def test_words(text, expected):
    assert words.spelt(text) == expected
    hashes, offsets = words.word_hashes([text, "tail"])
    assert offsets.tolist() == [0, len(expected), len(expected) + 1]
    assert hashes.tolist() == words.word_hashes([" ".join(expected), "tail"])[0].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_batches_equal_single_texts(texts):
    hashes, offsets = words.word_hashes(texts)
    for i, text in enumerate(texts):
        alone, _ = words.word_hashes([text])
        assert hashes[offsets[i] : offsets[i + 1]].tolist() == alone.tolist()
        assert len(alone) == len(words.spelt(text))
    sets, bounds = words.word_sets(texts)
    for i, text in enumerate(texts):
        own = sets[bounds[i] : bounds[i + 1]]
        assert len(own) == len(set(words.spelt(text))) and (np.diff(own.astype(np.float64)) > 0).all()


def test_long_texts_come_whole():
    body = "alpha beta gamma " * 120_000
    hashes, offsets = words.word_hashes(["x", body, None, "y" * 3_000_000, "z"])
    assert np.diff(offsets).tolist() == [1, 360_000, 0, 1, 1]
    assert len(np.unique(hashes[1:360_001])) == 3


def test_set_ids_dont_hang_on_order_or_repeats():
    sets, offsets = words.word_sets(["b a a", "a b", "a c", ""])
    ids = words.set_ids(sets, offsets)
    assert ids[0] == ids[1] != ids[2] and ids[3] == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    own = rng.integers(0, 2**52, 60).astype(np.uint64)
    one, two = rng.integers(0, 65, 60), rng.integers(0, 65, 60)
    least = []
    for levels in (one, two):
        points = bagminhash.first_points(own, levels, 6000)
        points[levels == 0] = np.inf
        least.append(points.min(0))
    assert abs((least[0] == least[1]).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum()) < 0.03


def test_signer_forgets_without_changing(monkeypatch):
    rng = np.random.default_rng(1)
    own = np.sort(rng.integers(0, 2**52, 400).astype(np.uint64))
    own, offsets = bagminhash.weighted(own, rng.integers(1, 65, 400)), np.arange(0, 401, 20)
    full = bagminhash.Signer(32).sign(own, offsets)
    monkeypatch.setattr(bagminhash, "CACHE_WORDS", 50)
    small = bagminhash.Signer(32)
    assert all((small.sign(own[a:b], np.array([0, b - a])) == full[i]).all() for i, (a, b) in enumerate(zip(offsets, offsets[1:])))


def walk(window, steps, repetition):
    out, at = [], 0
    seed = words.mixed(np.array([repetition + 1], np.uint64))[0]
    for j in range(steps):
        out.append(window[at] if at < len(window) else None)
        if at < len(window):
            bits = words.mixed(np.array([window[at]], np.uint64) ^ seed)[0]
            at += int((bits >> np.uint64(j)) & np.uint64(1))
    return out


def test_embedding_keys_agree_with_the_walk():
    rng = np.random.default_rng(2)
    own = rng.integers(1, 60, 400).astype(np.uint64)
    starts = np.arange(400 - 11)
    for repetition in (0, 3):
        keys = cgk.keys(own, starts, 12, 5, repetition)
        steps = cgk.sampled_steps(12, 5, repetition)
        sampled = [tuple(walk(own[s : s + 12].tolist(), 24, repetition)[j] for j in steps) for s in starts]
        groups = {}
        for key, sample in zip(keys.tolist(), sampled):
            assert groups.setdefault(key, sample) == sample
        assert len(groups) == len(set(sampled))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=8), st.lists(st.integers(0, 3), max_size=8), st.integers(0, 4))
def test_edit_distance(a, b, most):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            table[i][j] = i + j if not i * j else min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert cgk.edit_distance(a, b, most) == min(table[-1][-1], most + 1)
