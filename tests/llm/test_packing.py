"""Packing: ids against the tokenizer itself, sequences against what a packing has to be, plans against bounds and brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string, task int, `offset` long, number int, n long"


def texts():
    rng = random.Random(2)
    words = ["the", "of", " and", "don't", "x's", "日本語", "é", "་", "12", "3.5", "́a", "A-b", "<|end", "\x1c", "᠎", "​", "\x00"]
    blanks = [" ", "  ", "\n", " \n", "\t", "\r\n", "\xa0", "  ", "\x85", "　", " ", "   \n\n ", "\x0b", "\x1f"]
    return ["".join(rng.choice(words) + rng.choice(blanks if rng.random() < 0.4 else [" ", ""]) for _ in range(rng.randrange(40))) for _ in range(400)]


def test_ids_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 500)
    tokenizer = Tokenizer.from_file(PATH)
    encoder = packing.Encoder(open(PATH, encoding="utf-8").read())
    every = texts() + ["", " ", "  ", "a<|endoftext|>b  c", "\n", " \n a", "a   b"]
    for at in range(0, len(every), 37):
        some = every[at : at + 37]
        for text, ids in zip(some, encoder.encode(some), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(("length", "want"), [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (21, [(0, 5), (5, 8), (13, 8)])])
def test_cut(length, want):
    assert packing.cut(length, 8) == want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    own = texts()
    out = [(i, t) for i, t in enumerate(own[:120])]
    out += [(200 + i, " ".join(rng.choices(["sea", "and", "sand", "sun"], k=rng.randrange(1, 90)))) for i in range(150)]
    out += [(400, "word " * 700), (None, "of no id"), (None, "of no id"), (5, own[5]), (401, None), (402, "")]
    return out + [(500 + i, "the same text in many copies, and so of one length") for i in range(130)]


@pytest.mark.parametrize("sequence", [16, 64, 1024])
def test_packed(spark, rows, sequence):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(*r, "p", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    pieces = packing.tokenize(docs, PATH, sequence=sequence, with_ids=True)
    packed = packing.pack(pieces, sequence)
    got = packed.collect()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (start, length) in enumerate(packing.cut(len(ids), sequence)):
            want[i, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()), tuple(ids[start : start + length])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= sequence
    # copies of one length may have no complement at all: no more sequences than plain best fit needs
    gaps: list[int] = []
    for length in sorted((r.length for r in got), reverse=True):
        at = min((i for i, g in enumerate(gaps) if g >= length), key=lambda i: gaps[i], default=None)
        if at is None:
            gaps.append(sequence - length)
        else:
            gaps[at] -= length
    assert -(-sum(r.length for r in got) // sequence) <= len(held) <= len(gaps)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert all(len(whole[s].ids) == sum(n for _, n in own) and len(whole[s].doc_ids) == len(own) for s, own in held.items())


def test_no_rows(spark):
    assert packing.pack(packing.tokenize(spark.createDataFrame([], SCHEMA), PATH)).count() == 0


def used(steps):
    out = Counter()
    for pattern, n in steps:
        for length in pattern:
            out[length] += n
    return out


def least_bins(counts, size):
    """Fewest bins by search over states."""
    lengths = sorted(counts, reverse=True)

    @lru_cache(None)
    def rest(state):
        first = next((i for i, n in enumerate(state) if n), None)
        if first is None:
            return 0
        best = sum(state)

        def fill(i, gap, left):
            nonlocal best
            for j in range(i, len(lengths)):
                if left[j] and lengths[j] <= gap:
                    fill(j, gap - lengths[j], (*left[:j], left[j] - 1, *left[j + 1 :]))
            best = min(best, 1 + rest(left))

        fill(first, size - lengths[first], (*state[:first], state[first] - 1, *state[first + 1 :]))
        return best

    return rest(tuple(counts[x] for x in lengths))


def test_plans_use_every_piece_and_are_close_to_the_least():
    rng = random.Random(8)
    more = 0
    for _ in range(120):
        counts = dict(Counter(rng.randrange(1, 17) for _ in range(rng.randrange(1, 9))))
        steps = packing.plan(counts, 16)
        assert used(steps) == counts and all(sum(p) <= 16 and n > 0 for p, n in steps)
        bins = sum(n for _, n in steps)
        least = least_bins(counts, 16)
        assert least <= bins <= least + 1
        more += bins - least
    assert more <= 3


def test_complements_of_one_two_and_three():
    assert packing.plan({600: 3, 424: 3}) == [((600, 424), 3)]
    assert sorted(packing.plan({700: 2, 200: 2, 124: 2})) == [((700, 200, 124), 2)]
    assert packing.plan({700: 1, 108: 3}) == [((700, 108, 108, 108), 1)]
    assert packing.plan({512: 5}) == [((512, 512), 2), ((512,), 1)]


def test_plans_do_not_grow_with_counts():
    rng = np.random.default_rng(1)
    counts = {int(k): int(v) * 10**9 for k, v in zip(*np.unique(rng.integers(1, 1025, 50_000), return_counts=True), strict=True)}
    steps = packing.plan(counts)
    assert used(steps) == counts and len(steps) < 5000
    # no two pieces of over half a sequence share one
    bound = max(sum(k * v for k, v in counts.items()) / 1024, sum(v for k, v in counts.items() if k > 512))
    assert sum(n for _, n in steps) < 1.002 * bound
    # a length that nothing complements, with most of the pieces
    steps = packing.plan({600: 10**12, 300: 10**6})
    assert used(steps) == {600: 10**12, 300: 10**6} and sum(n for _, n in steps) == 10**12
