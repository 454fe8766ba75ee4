"""Bounds that hold one text against a block: they lose no pair, and leave few to the whole comparison."""

import difflib
import itertools
import random

import numpy as np
import pytest

from segmentry.functions import alike as A
from segmentry.functions import matching
from segmentry.operators import similarity


def reach(a, b, threshold):
    """Whether the longest common subsequence allows the threshold."""
    return 2 * A.common_length(*A.placed(a), b) >= threshold * (len(a) + len(b)) - 1e-9


def lines(rnd, n, letters, words):
    made = []
    while len(made) < n:
        t = " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(rnd.choice(words)))
        made.append(t)
        edited = list(t)
        for _ in range(max(1, int(len(t) * rnd.choice([0.01, 0.05, 0.12])))):
            edited[rnd.randrange(len(edited))] = rnd.choice(["", "x", "ab", rnd.choice(letters)])
        made.append("".join(edited) or "x")
    return list(dict.fromkeys(made))


@pytest.mark.parametrize("threshold", [0.95, 0.85, 0.5])
@pytest.mark.parametrize("letters, words", [("aab", [3, 20, 60]), ("etaoinshrdlu" * 3 + "cmfwypvbgkjqxz\U0001f600\u00e9", [1, 8, 60]), ("e", [150]), ("".join(map(chr, range(0x4E00, 0x4F80))), [5, 40])])
def test_bounds_lose_no_pair(monkeypatch, threshold, letters, words):
    monkeypatch.setattr(A, "FILL", 3)
    rows = list(enumerate(lines(random.Random(5), 16, letters, words)))
    for most in (1, 2, 8):
        # groups are asked however few texts are left
        monkeypatch.setattr(A, "WORDS", most)
        block = A.Block(rows, threshold)
        for one, text in rows:
            found = {block.rows[k][0] for k in block.may_reach(text, 0).tolist()}
            assert {b for b, other in rows if reach(text, other, threshold)} <= found


def test_common_length_is_no_less_than_what_matches():
    rnd = random.Random(2)
    for a, b in itertools.pairwise(lines(rnd, 60, "abcd", [2, 4])):
        matched = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert matched <= A.common_length(*A.placed(a), b) <= min(len(a), len(b))
    assert A.common_length(*A.placed("abcbdab"), "bdcaba") == 4


def test_few_pairs_are_compared_whole(monkeypatch):
    """lines of one language share most of their letters; each pair took a whole common subsequence."""
    rnd, asked = random.Random(3), []
    syllables = [rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") + rnd.choice(["", "n", "r", "s"]) for _ in range(60)]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(45, 50)))) for i in range(600)]
    whole = A.common_length
    monkeypatch.setattr(A, "common_length", lambda *x: asked.append(1) or whole(*x))
    assert A.alike(A.Block(rows, 0.85), None) == []
    assert len(asked) < 600 * 599 / 2 / 50


def test_blocks_meet_without_copies(spark):
    """each text was shuffled once for every block that its own meets, which took disk with the square."""
    texts = spark.createDataFrame([(i, f"text number {i} of many") for i in range(50)], "id long, text string")
    plan = similarity.similar_pairs(texts, 0.95)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_long_groups_equal_word_by_word(monkeypatch):
    """texts of several words lie side by side in one number, or are compared word by word: the same bounds."""
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice("aaabbc") for _ in range(rnd.randint(150, 400)))) for i in range(30)]
    block = A.Block(rows, 0.5)
    assert any(g.words > 1 for g in block.groups)
    found = np.arange(30)
    for _, text in rows[:5]:
        kinds = block.kinds.take(A.codes(text)).tolist()
        made = []
        for many in (1, 1_000):
            monkeypatch.setattr(A, "MANY", many)
            made.append([g.common(kinds, found).tolist() for g in block.groups])
        assert made[0] == made[1]


def test_common_lengths_of_many_equal_each():
    rnd = random.Random(9)
    texts = lines(rnd, 40, "abcd\U0001f600", [1, 5, 20])
    for text in texts[:8]:
        assert A.common_lengths(text, texts).tolist() == [A.common_length(*A.placed(text), t) for t in texts]


def test_few_texts_are_compared_in_few_calls(monkeypatch):
    """each pair that passed the bounds took a whole common subsequence of its own."""
    rnd, asked = random.Random(7), []
    base = "".join(rnd.choice("etaoinshrdlu ") for _ in range(300))
    rows = [(i, "".join(c if rnd.random() > 0.02 else "x" for c in base)) for i in range(20)]
    whole = A.common_length
    monkeypatch.setattr(A, "common_length", lambda *x: asked.append(1) or whole(*x))
    made = A.alike(A.Block(rows, 0.85), None)
    assert {m[:2] for m in made} == {(a, b) for a in range(20) for b in range(a + 1, 20)}
    assert len(asked) < 20


def test_a_text_meets_those_after_it():
    rows = [(i, "some text here" + "!" * (i % 3)) for i in (4, 1, 3, 2)]
    block = A.Block(rows, 0.5)
    assert sorted(m[:2] for m in A.alike(block, rows, after=True)) == list(itertools.combinations([1, 2, 3, 4], 2))


@pytest.mark.parametrize("letters", ["ab", "abcd", "a", "etaoin shrdlu"])
def test_runs_by_pieces_equal_the_automaton(letters):
    """strings that are nearly equal took an automaton for each run."""
    rnd = random.Random(10)
    for _ in range(400):
        a = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60)))
        b = list(a) if rnd.random() < 0.6 else [rnd.choice(letters) for _ in range(rnd.randint(1, 60))]
        for _ in range(rnd.randint(0, 4)):
            b[rnd.randrange(len(b))] = rnd.choice(["", "x", "ab"])
        b = "".join(b)
        bounds = 0, len(a), min(1, len(b)), len(b)
        got, want = matching._longest_text(a, b, *bounds), matching._longest(a, b, set(), *bounds)
        assert got is None or got == want or got[2] == want[2] == 0
