"""Cleaned scripts: both texts stay whole, what should go is gone, examples by hand."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators.cleanup import COST, _overlap, _taken_apart, cleaned
from palimpsest.operators.diff import edit_script


def walk(script, a, b):
    """The script leads from a to b, its agreements agree, and it is in normal form."""
    i = j = 0
    for op, n in script:
        assert n > 0
        if op == "=":
            assert a[i : i + n] == b[j : j + n]
        i += n * (op != "+")
        j += n * (op != "-")
    assert (i, j) == (len(a), len(b))
    pairs = [x + y for (x, _), (y, _) in zip(script, script[1:], strict=False)]
    assert not {"==", "--", "++", "+-"} & set(pairs)


texts = st.lists(st.sampled_from(["a", "b", "c", ".", "d"]), max_size=40)


@settings(max_examples=400, deadline=None)
@given(texts, texts, st.sampled_from([None, "semantic", "efficiency"]))
def test_texts_stay_whole(a, b, mode):
    walk(edit_script(a, b, mode), a, b)


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_no_costly_agreement_is_left(a, b):
    same, changes = _taken_apart(edit_script(a, b, "efficiency"))
    for n, p, q in zip(same[1:-1], changes, changes[1:], strict=False):
        sides = sum(x > 0 for x in (*p, *q))
        assert not (sides == 4 and n < COST or sides == 3 and 2 * n < COST)


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_overlap(a, b):
    want = max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k])
    assert _overlap(a, b) == want


@pytest.mark.parametrize(
    ("a", "b", "mode", "want"),
    [
        ("a b c", "d b e", "semantic", [("-", 3), ("+", 3)]),  # one chance agreement between changes of one each
        ("a b c d e", "x b c d y", "semantic", [("-", 1), ("+", 1), ("=", 3), ("-", 1), ("+", 1)]),  # longer than its neighbours
        ("a b c d e", "x b c d y", "efficiency", [("-", 5), ("+", 5)]),  # shorter than COST, and four sides
        ("a b c d e f", "x b c d e y", "efficiency", [("-", 1), ("+", 1), ("=", 4), ("-", 1), ("+", 1)]),
        ("a b c", "b y", "efficiency", [("-", 3), ("+", 2)]),  # three sides, one token
        ("a b c d", "b c y", "efficiency", [("-", 1), ("=", 2), ("-", 1), ("+", 1)]),  # three sides, two tokens
        ("the sea . the sun", "the sea . the sea . the sun", "semantic", [("=", 3), ("+", 3), ("=", 2)]),  # between signs, not within
        ("q w x y z", "x y z r s", "semantic", [("-", 2), ("=", 3), ("+", 2)]),
    ],
)
def test_by_hand(a, b, mode, want):
    a, b = a.split(), b.split()
    got = edit_script(a, b, mode)
    walk(got, a, b)
    assert got == want


def test_overlaps_become_agreements_again():
    a, b = "a b c x x x".split(), "x x x d e f".split()
    whole = [("-", 6), ("+", 6)]
    assert cleaned(whole, a, b, "semantic") == [("-", 3), ("=", 3), ("+", 3)]
    assert cleaned(whole, b, a, "semantic") == [("+", 3), ("=", 3), ("-", 3)]
    with pytest.raises(ValueError, match="no such cleanup"):
        cleaned(whole, a, b, "other")


def test_semantic_scripts_have_fewer_changes():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (rng.choices("abcdefgh", k=200) for _ in range(2))
        plain, semantic = edit_script(a, b), edit_script(a, b, "semantic")
        assert len(_taken_apart(semantic)[1]) <= len(_taken_apart(plain)[1])
