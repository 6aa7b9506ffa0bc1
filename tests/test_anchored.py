"""Anchored alignment: the same cells as of whole pairs, texts whole, work in stretches."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import anchored
from palimpsest.operators.align import align
from palimpsest.operators.diff import edit_script, place
from palimpsest.operators.layout import long_rows, witness_rows


def edited(rng, words, vocabulary, every):
    out = []
    for w in words:
        x = rng.random()
        if x < 1 / every:
            continue
        out.append(rng.choice(vocabulary) if x < 2 / every else w)
        if x > 1 - 1 / every:
            out += rng.choices(vocabulary, k=rng.randrange(1, 4))
    return out


def pairs(n=600, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i} " for i in range(400)]
    rows = []
    for c in range(4):
        base = rng.choices(vocabulary, k=n * (c + 1) // 2)
        if c == 3:
            base = (["la "] * 50 + ["da "]) * 12  # no run is unique
        base.insert(3, "\n ")  # of empty norm
        witnesses = [base, edited(rng, base, vocabulary, 12), list(base), ["  "] + base[40:] + ["\t"], base[: len(base) // 2] + rng.choices(vocabulary, k=300) + base[len(base) // 2 :]]
        rows += [(c, i, w, [x.strip() for x in w]) for i, w in enumerate(witnesses)]
    return rows


SCHEMA = "collation_id int, witness_id int, tokens array<string>, norms array<string>"


def kept(rows):
    """Tokens that stand in a base token's cell and equal it."""
    return {(r.collation_id, r.witness_id, r.start) for r in rows}


@pytest.mark.parametrize(("stretch", "runs"), [(40, (6, 2)), (15, (3,)), (10**6, (12, 4))])
def test_cells_make_the_texts_and_keep_as_many_tokens(spark, stretch, runs):
    rows = pairs()
    arrays = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = anchored.place_long(arrays, run_lengths=runs, stretch=stretch).collect()
    want = place(arrays).collect()
    texts, base = {}, {(c, w): t for c, w, t, _ in rows}
    for r in sorted(got, key=lambda r: (r.collation_id, r.witness_id, r.start)):
        assert texts.get((r.collation_id, r.witness_id), "") == "".join(base[r.collation_id, r.witness_id])[: r.start]
        texts[r.collation_id, r.witness_id] = texts.get((r.collation_id, r.witness_id), "") + r.text
        assert r.end == r.start + len(r.text)
    assert texts == {k: "".join(t) for k, t in base.items()}
    assert len({(r.collation_id, r.witness_id, r.anchor, r.slot) for r in got}) == len(got)

    def agreements(rows_):
        return sum(r.slot == 0 and r.anchor >= 0 and r.text.strip() == base[r.collation_id, 0][r.anchor].strip() for r in rows_)

    # anchors are of minimal scripts here but for chance: hardly an agreement is lost
    assert agreements(got) >= 0.999 * agreements(want)
    if stretch == 10**6:
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_scripts_keep_the_longest_common_subsequence(spark):
    rng = random.Random(6)
    rows = []
    for c in range(20):
        base = [f"u{i}" if rng.random() < 0.5 else rng.choice("abc") for i in range(120)]
        rows += [(c, 0, base, base)] + [(c, 1, w, w) for w in [edited(rng, base, list("abcxyz"), 6)]]
    arrays = spark.createDataFrame(rows, SCHEMA)
    dealt = anchored.stretches(arrays.where("witness_id < 2"), run_lengths=(8, 5), stretch=10).where("witness_id = 1").collect()
    assert len(dealt) > 40
    same: dict[int, int] = {}
    for r in dealt:
        same[r.collation_id] = same.get(r.collation_id, 0) + sum(n for op, n in edit_script(list(r.base), list(r.norms)) if op == "=")
    lost = 0
    for c in range(20):
        a, b = rows[2 * c][3], rows[2 * c + 1][3]
        table = [0] * (len(b) + 1)
        for x in a:
            before = table[:]
            for j, y in enumerate(b):
                table[j + 1] = before[j] + 1 if x == y else max(before[j + 1], table[j])
        assert same[c] <= table[-1]
        lost += table[-1] - same[c]
    assert lost <= 2


def test_chain_is_the_longest():
    rng = random.Random(3)
    import numpy as np

    for _ in range(60):
        b = rng.sample(range(20), rng.randrange(9))
        found = anchored.chain(np.arange(len(b)), np.array(b, np.int64))
        assert all(x < y for x, y in zip(found, found[1:], strict=False)) and [b[i] for i in found] == sorted(b[i] for i in found)
        longest = max((k for k in range(len(b) + 1) for c in combinations(b, k) if list(c) == sorted(c)), default=0)
        assert len(found) == longest


def test_two_texts_of_half_a_million_tokens(spark):
    rng = random.Random(9)
    vocabulary = [f"{a}{b} " for a in "bcdfghjklmnprstvwz" for b in ("a", "e", "i", "o", "u", "an", "or", "ist", "ung")]
    base = rng.choices(vocabulary, k=500_000)
    other = edited(rng, base, vocabulary, 300)
    witnesses = spark.createDataFrame([(0, 0, "".join(base)), (0, 1, "".join(other))], "collation_id int, witness_id int, text string")
    placed = align(witnesses, merged=False, aligner=anchored.place_long)
    cells = long_rows(placed)
    texts = {r.witness_id: r.text for r in witness_rows(cells.where("text is not null")).select("witness_id", F.array_join(F.transform("cells", lambda c: c["text"]), "").alias("text")).collect()}
    assert texts == {0: "".join(base), 1: "".join(other)}
    assert cells.where("witness_id = 1 and text is not null").count() == len(other)
    dealt = spark.createDataFrame([(0, 0, base, base), (0, 1, other, other)], SCHEMA)
    # a text that equals its base needs no script and is not cut
    assert anchored.stretches(dealt).where("witness_id = 1").agg(F.max(F.size("norms"))).first()[0] < 3 * anchored.STRETCH
