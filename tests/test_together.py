"""Collations aligned where they meet, against the same by rows."""

from __future__ import annotations

import random
from itertools import product

import pytest

from palimpsest.operators.align import align
from palimpsest.operators.diff import _greedy, _only_own


def witnesses():
    rng = random.Random(11)
    rows = []
    for c in range(40):
        base = [rng.choice(["a ", "b ", "C ", "d, ", "e\n", " ", "f", "."]) for _ in range(rng.choice([0, 1, 5, 30, 120]))]
        for w in range(rng.randrange(1, 6)):
            own = [rng.choice(["x ", "y", "", t + t, " "]) if rng.random() < 0.2 else t for t in base]
            rows.append((c, w, rng.choice(["".join(own), "".join(base), None]) if w else "".join(own)))
    return [*rows, (90, 1, "no base"), (91, 0, "alone here"), (92, 0, ""), (92, 1, " "), (93, 0, None), (94, 0, "a"), (94, 2, "b"), (94, 5, "a")]


@pytest.mark.parametrize(("merged", "cleanup", "together"), [(True, None, 1 << 21), (False, None, 1 << 21), (True, "semantic", 1 << 21), (True, None, 60)])
def test_rows_are_the_same_either_way(spark, merged, cleanup, together):
    frame = spark.createDataFrame(witnesses(), "collation_id long, witness_id int, text string").repartition(5)
    got, want = (sorted(map(repr, align(frame, merged=merged, cleanup=cleanup, together=n).collect())) for n in (together, 0))
    assert len(want) > 100
    assert got == want


def test_scripts_of_sequences_that_differ_in_own_tokens_only_are_the_minimal_ones():
    told = 0
    for n, m in product(range(6), range(6)):
        for seed in range(30):
            rng = random.Random(f"{n} {m} {seed}")
            a, b = [rng.choice("abcd") for _ in range(n)], [rng.choice("cdef") for _ in range(m)]
            steps = _only_own(a, b)
            if steps is not None:
                told += 1
                assert sorted(steps) == sorted(_greedy(a, b, n + m))
    assert told > 200


def test_the_texts_of_a_collation_move_once(spark):
    frame = spark.createDataFrame(witnesses(), "collation_id long, witness_id int, text string")
    plan = align(frame)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") == 1


def test_weights_of_cells_are_told_without_a_sort(spark):
    from palimpsest.plans import catalog

    plan = catalog.queries()["weighted_mean"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Window" not in physical
    assert "Sort [" not in physical
