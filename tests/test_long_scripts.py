"""Edit scripts beyond MAX_EDITS where no token is unique: still minimal."""

from __future__ import annotations

import random

from palimpsest.operators.diff import MAX_EDITS, edit_script


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_repetitive_texts_get_minimal_scripts():
    for seed, kinds, n in ((1, 4, 1200), (2, 12, 900), (3, 40, 700)):
        rng = random.Random(seed)
        tokens = [f"t{i}" for i in range(kinds)]
        a, b = rng.choices(tokens, k=n), rng.choices(tokens, k=n + 50)
        script = edit_script(a, b)
        kept = sum(k for op, k in script if op == "=")
        assert len(a) + len(b) - 2 * kept > MAX_EDITS and kept == lcs(a, b)
        i = j = 0
        for op, k in script:
            if op == "=":
                assert a[i : i + k] == b[j : j + k]
            i, j = i + k * (op != "+"), j + k * (op != "-")
        assert (i, j) == (len(a), len(b))


def test_long_random_texts_get_minimal_scripts():
    for seed, kinds in ((4, 20), (5, 50), (6, 200), (7, 5000)):
        rng = random.Random(seed)
        a, b = ([rng.randrange(kinds) for _ in range(1500)] for _ in range(2))
        assert sum(k for op, k in edit_script(a, b) if op == "=") == lcs(a, b)
