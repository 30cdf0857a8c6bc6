"""Problem 3."""

import random
import time

import pytest

from corpusloom.llm import pairs, queries

ASK = "Why does the cache matter more than the queue?"


@pytest.mark.parametrize("response", [None, "", " \n", "​", "...", "n/a", "TODO", "<p></p>", "```\n```", "&nbsp;", "[no answer]", "''", "—", "{}"])
def test_empty(response):
    assert pairs.defect_of(ASK, response) == "empty"


@pytest.mark.parametrize(
    "prompt, response",
    [
        ("Which step was slow? If there was none, answer with None.", "None"), ("How many runs failed? Give the number only.", "0"), ("Is it supported? Answer yes or no.", "No"), (ASK, "It holds the hot rows."), (ASK, "So the answer depends on the cache"),
        ("Repeat the following text exactly: The cache holds rows.", "The cache holds rows."), ("Pick one.\nOptions:\n - the red box\n - the blue box\nAnswer: ", "the blue box"),
        ("Translate into German: The cache holds the rows of the table.", "Der Zwischenspeicher hält die Zeilen der Tabelle."), (ASK, ASK + " It keeps the hot rows close to the reader."), (ASK, "It is small :) and fast. (cache, queue)"),
        ("Write two lines of dialogue in which Ann refuses to lend the saw.", '"I am sorry, but I cannot help you with that," said Ann. "The saw stays in the barn."'), (ASK, "You cannot skip this: the cache holds the hot rows."),
        ("Draft a short apology to Ann for the bug.", "Dear Ann, I am sorry that I was not able to fix the bug in time. It will be gone tomorrow."), ("What does this say? \"Der Speicher ist voll und die Schlange ist lang.\"", "The memory is full and the queue is long."),
        ("List 2 facts about the cache.", "1. It is small.\n2. It is fast."), ("Write a function.", "```python\ndef f(x):\n    return [x]\n```"),
    ],
)
def test_sound(prompt, response):
    assert pairs.defect_of(prompt, response) is None


@pytest.mark.parametrize("response", ["It holds the hot rows because the", "It holds the hot rows. The note says: \"we", "It holds the rows. (see also the", "It holds rows and", "```python\ndef f(x):\n    return [x", "Two points remain:\n1."])
def test_truncated(response):
    assert pairs.defect_of(ASK, response) == "truncated"


def test_truncated_list():
    assert pairs.defect_of("List 3 facts about the cache.", "1. It is small.\n2. It is fast.") == "truncated"


@pytest.mark.parametrize("response", ["I’m sorry, but I can’t help with that.", "i cant answer that sorry", "Unfortunately, that is something I have to decline.", "Zu diesem Thema darf ich leider keine Auskunft geben.", "Je préfère ne pas répondre à cette question.", "Lo siento, pero no puedo ayudar con eso.", "Hello! My guidelines prevent me from writing about the cache."])
def test_refusal(response):
    assert pairs.defect_of(ASK, response) == "refusal"


@pytest.mark.parametrize("response", [ASK, ASK.upper(), "Q: " + ASK.rstrip("?"), f"<p>{ASK}</p>", ASK + " " + ASK])
def test_copied(response):
    assert pairs.defect_of(f"User: {ASK}\nAssistant:", response) == "copied"


@pytest.mark.parametrize("response", ["Der Speicher ist wichtiger, weil die Warteschlange auf ihn wartet.", "Sure, gladly. Según el informe, la memoria es más importante que la cola.", "ПОТОМУ ЧТО ОН БЫСТРЕЕ И МЕНЬШЕ."])
def test_other_language(response):
    assert pairs.defect_of(ASK, response) == "other_language"


def tiles_by_hand(left, right, least):
    """Greedy string tiling by trying all pairs of places, longest runs first."""
    one, two = [False] * len(left), [False] * len(right)
    while True:
        best = (0, 0, 0)
        for i in range(len(left)):
            for j in range(len(right)):
                n = 0
                while i + n < len(left) and j + n < len(right) and left[i + n] == right[j + n] and not one[i + n] and not two[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return one, two
        one[i : i + n], two[j : j + n] = [True] * n, [True] * n


def test_tiling():
    one, two = pairs.tiles("a b c x d e f".split(), "d e f a b c".split(), 3)
    assert sum(one) == 6 and sum(two) == 6
    one, _ = pairs.tiles("a b c a b c".split(), "a b c".split(), 3)
    assert sum(one) == 3


def test_tiling_against_all_pairs():
    """Windows of halving length may take a run before a longer one of the same order of length: nearly the same cover."""
    rng = random.Random(2)
    for letters, n in ((3, 30), (12, 40), (60, 50)):
        for _ in range(15):
            left = [str(rng.randrange(letters)) for _ in range(n)]
            right = left[rng.randrange(n) :] + [str(rng.randrange(letters)) for _ in range(n // 2)] + left[: rng.randrange(n)]
            one, two = pairs.tiles(left, right, 3)
            hand, _ = tiles_by_hand(left, right, 3)
            assert one.sum() == two.sum() and abs(one.sum() - sum(hand)) <= 0.15 * n


def test_tiling_of_long_repeats():
    began = time.perf_counter()
    for one, two in ((["a"] * 50_000, ["a"] * 50_000), (["a", "b"] * 25_000, ["b", "a", "c"] * 16_000)):
        pairs.tiles(one, two, 3)
    assert pairs.defect_of("a b " * 25_000, "a b " * 25_000) == "copied"
    assert time.perf_counter() - began < 3


@pytest.mark.parametrize(
    "response",
    [
        "Because hot rows stay near the reader", "Caching keeps frequently used rows close to readers so they never wait on disk", 'The rod is 5" long and fits the cache slot.', "Half-open intervals such as [0, 1) are common in code.",
        "Use f(x) where x is in [0, 1).", "I can't overstate it: I will not give more weight to the queue, since caches answer reads.", 'A 3" pipe and "a queue" differ.', 'The note says "5" and ends.',
    ],
)
def test_sound_without_knowing_the_table(response):
    assert pairs.defect_of(ASK, response) is None


@pytest.mark.parametrize(
    "response, defect",
    [
        ("A memória é mais importante porque guarda as linhas mais usadas e responde antes que a fila acabe.", "other_language"), ("De cache is belangrijker omdat hij de rijen bewaart die het meest worden gelezen.", "other_language"),
        ("Pamięć podręczna jest ważniejsza, ponieważ przechowuje najczęściej czytane wiersze i nie czeka na dysk.", "other_language"), ("La memoria è più importante perché conserva le righe che sono lette più spesso.", "other_language"),
        ("That's not a subject I'm willing to get into.", "refusal"), ("Sorry, this assistant does not provide answers on that subject.", "refusal"), ("Mi dispiace, ma non posso rispondere a questa domanda.", "refusal"),
        ("I'm not comfortable answering that.", "refusal"), ("We are unable to help with this request.", "refusal"), ("Não posso responder a essa pergunta.", "refusal"),
        ("[intentionally left blank]", "empty"), ("(your text goes here)", "empty"), ("<insert answer here>", "empty"),
    ],
)
def test_defects_of_other_kinds(response, defect):
    assert pairs.defect_of(ASK, response) == defect


def test_endings_decide(spark):
    """What the table goes on after is no end; beginnings of its words are no words; what it ends with is an end."""
    told = [(i, ASK, "The cache holds the rows of the scheduler. It asks the scheduler for the rows of the reader near the disk.") for i in range(30)]
    asked = [(100, ASK, "The cache holds the rows of the reader near the disk"), (101, ASK, "The cache holds the"), (102, ASK, "It holds rows. It asks the sched"), (103, ASK, "It asks the scheduler for the rows"), (104, ASK, "It keeps bananas"), (105, ASK, "It holds")]
    df = spark.createDataFrame(told + asked, "pair_id long, prompt string, response string")
    got = dict(map(tuple, pairs.defects(df).collect()))
    assert got == {101: "truncated", 102: "truncated", 103: "truncated", 105: "truncated"}


def test_pushdown():
    assert pairs.unfinished('a (b [c] "d"') == ["("]
    assert pairs.unfinished("1) one\n2) two :)") == []
    assert pairs.unfinished("```\nx = '('\n") == ["```", "("]
    assert pairs.unfinished("<ul><li>a</li>") == ["<ul>"]


def test_tables(spark, folder):
    rows = [(1, None, None, 1), (2, "Say x.", "x" * 100_000, 1), (None, ASK, "", 1), (4, ASK, "It holds rows. " * 20_000, 1), (4, ASK, None, 1)]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, response string, defect int")
    got = [tuple(r) for r in pairs.defects(df).collect()]
    assert (1, "empty") in got and (None, "empty") in got and (4, "empty") in got and all(i != 4 or d == "empty" for i, d in got)
    assert pairs.defects(df.limit(0)).count() == 0
    found = queries.p3_found(spark, folder)
    assert found.columns == ["pair_id", "defect"] and {r["defect"] for r in found.collect()} <= {"empty", "truncated", "refusal", "copied", "other_language"}
    assert queries.p3_report(spark, folder).count() > 0
