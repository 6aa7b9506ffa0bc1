"""Steps of substring dedup that work on many texts or states at once, against one by one."""

from __future__ import annotations

import random

from palimpsest.llm import substring_dedup as sd


def texts(rng, n):
    return [[b"w%d" % rng.randrange(7) for _ in range(rng.choice([13, 14, 20, 60]))] for _ in range(n)]


def test_anchors_of_many_texts_are_those_of_each():
    own = texts(random.Random(3), 40)
    alone = [(i, *x) for i, words in enumerate(own) for x in zip(*(c.tolist() for c in sd._anchored([words], 13, 5)[1:]), strict=True)]
    assert list(zip(*(c.tolist() for c in sd._anchored(own, 13, 5)), strict=True)) == alone
    # every window is of one stretch, and windows of a stretch have its anchor
    for i, words in enumerate(own):
        mine = [x for x in alone if x[0] == i]
        assert [s + k for _, _, s, n in mine for k in range(n)] == list(range(len(words) - 12))
        for _, anchor, s, n in mine:
            assert {sd._anchored([words[at : at + 13]], 13, 5)[1].tolist()[0] for at in range(s, s + n)} == {anchor}


def test_known_statistics_are_those_of_the_stream():
    rng = random.Random(9)
    own = texts(rng, 60)
    automaton = sd.Automaton()
    docs = [rng.randrange(30) for _ in own]
    states = [automaton.add(words, doc) for words, doc in zip(own, docs, strict=True)]
    automaton.close()
    known = automaton.known(6)
    for words, ends in zip(own, states, strict=True):
        stream = list(automaton.statistics(words, 6))
        assert [known[p] for p in ends[5:]] == [first for matched, first in stream if matched >= 6]
        for at in range(5, len(words)):
            window = words[at - 5 : at + 1]
            assert known[ends[at]] == min(d for w, d in zip(own, docs, strict=True) if any(w[k : k + 6] == window for k in range(len(w) - 5)))
