"""Collations aligned over numbers, against cells placed, laid out and folded one by one."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.operators import held, ordered
from palimpsest.operators.anchored import _segmented, segment_cuts
from palimpsest.operators.diff import _greedy, middle_steps, placed_cells
from palimpsest.operators.merge import folded


def by_cells(norms, tokens, merged):
    """Rows of cells (start, end, incr, text), null where a text has a gap."""
    placed = [placed_cells(norms[0], n, t) for n, t in zip(norms, tokens, strict=True)]
    need: dict[int, int] = {}
    for anchors, slots, *_ in placed:
        for a, s in zip(anchors, slots, strict=True):
            need[a] = max(need.get(a, 0), -s if s < 0 else s + 1)
    first, at = {}, 0
    for a in sorted(need):
        first[a], at = at, at + need[a]
    rows = [[None] * len(tokens) for _ in range(at)]
    for d, columns in enumerate(placed):
        for a, s, *cell in zip(*columns, strict=True):
            rows[first[a] + (need[a] + s if s < 0 else s)][d] = dict(zip(("start", "end", "incr", "text"), cell, strict=True))
    if not merged:
        return rows
    islands: list[list] = []
    for row in rows:
        if not islands or None not in row and len({c["text"] for c in row}) == 1:
            islands.append([])
        islands[-1].append(row)
    return [x for island in islands for x in folded(island)]


def collations(seed, most):
    rng = random.Random(seed)
    known = {"a": "a", "b": "b", "ab": "c", "ba": "a", "aa ": "aa", " ": "", "c": "c", "cc": "c", "é": "b"}
    for _ in range(rng.randrange(1, 5)):
        base = [rng.choice(list(known)) for _ in range(rng.randrange(most))]
        texts = [base] + [[rng.choice(list(known)) if rng.random() < 0.4 else x for x in base if rng.random() < 0.9] for _ in range(rng.randrange(4))]
        yield texts, known


@pytest.mark.parametrize("merged", [True, False])
def test_rows_are_those_of_cells_one_by_one(merged):
    told = 0
    for seed in range(400):
        some = list(collations(seed, 12))
        lists = pa.array([t for t, _ in some], pa.list_(pa.list_(pa.string())))
        words = [sorted({x for t in texts for x in t}) for texts, _ in some]
        norms = [[known[x] for x in w] for w, (_, known) in zip(words, some, strict=True)]
        rows = held.Rows(lists, *(pa.array(x, pa.list_(pa.string())) for x in (words, norms)), merged)
        want = [row for texts, known in some for row in by_cells([[known[x] for x in t] for t in texts], texts, merged)]
        # every witness once, and the base again as the last one
        members = pa.array([[*range(len(t)), 0] for t, _ in some], pa.list_(pa.int32()))
        got = [row for _, _, sizes, at in rows.slices(members) for row in rows.cells(sizes, at).to_pylist()]
        assert got == [[*row, row[0]] for row in want]
        told += len(got)
    assert told > 2000


def test_groups_and_batches_that_go_out_are_bounded(monkeypatch):
    monkeypatch.setattr(held, "GROUP", 10)
    monkeypatch.setattr(held, "CELLS", 8)
    words = [f"w{i} " for i in range(30)]
    each = [["a ", "b "], ["c "] * 7, words, ["d "] * 4]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(4)), pa.array([[0, 0]] * 4, pa.list_(pa.int32())), pa.array([[x] for x in each]), *(pa.array([list(dict.fromkeys(x)) for x in each]) for _ in range(2))],
        ["collation_id", "of", "tokens", "words", "norms"],
    )
    assert [x.num_rows for x in held.groups(iter([batch]))] == [2, 1, 1]
    out = list(held.aligned(True, None, ["collation_id", "row_id", "cells"])(iter([batch])))
    assert max(x.num_rows for x in out) <= 4
    rows = [r for x in out for r in x.to_pylist()]
    assert [(r["collation_id"], r["row_id"]) for r in rows] == [(c, i) for c, x in enumerate(each) for i in range(len(x))]
    assert [[c["text"] for c in r["cells"]] for r in rows] == [[t, t] for x in each for t in x]


def test_texts_of_many_tokens_take_numbers_not_steps():
    """A million tokens of three editions: some 0.5 s, where a step a token took over ten."""
    import time

    n = 330_000
    base = [f"w{i} " for i in range(n)]
    texts = [base, [f"x{i} " if i % 7 == 3 else t for i, t in enumerate(base)], [f"y{i} " if i % 11 == 5 else t for i, t in enumerate(base)]]
    words = list(dict.fromkeys(x for t in texts for x in t))
    lists = pa.array([texts], pa.list_(pa.list_(pa.string()))), pa.array([words]), pa.array([words])
    began = time.process_time()
    rows = held.Rows(*lists)
    assert time.process_time() - began < 5
    assert int(np.sum(~rows.plain)) > n // 7


def test_numbers_and_texts_go_in_one_pass():
    names = ["collation_id", "text"]
    rows = [(0, 0, "a", None), (0, 1, "b(", ")"), (0, 1, "c(", ")"), (1, 1, "d(", ")"), (2, 0, "e", None), (2, 1, "f(", ")!")]
    for size in range(1, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(x)) if i != 3 else pa.array(list(x), pa.string()) for i, x in enumerate(zip(*rows[a : a + size], strict=True))], ["k", "n", "a", "z"]) for a in range(0, len(rows), size)]
        got = [r for x in ordered._joined(names, True)(iter(batches)) for r in x.to_pylist()]
        assert got == [{"collation_id": 0, "text": "ab(1)c(2)"}, {"collation_id": 1, "text": "d(1)"}, {"collation_id": 2, "text": "ef(1)!"}]


def test_scripts_of_a_text_without_some_of_its_tokens_are_those_of_the_search():
    told = 0
    for seed in range(600):
        rng = random.Random(seed)
        a = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
        b = [x for x in a if rng.random() < 0.7]
        for x, y in ((a, b), (b, a)):
            if x != y:
                told += 1
                assert middle_steps(x, y) == _greedy(x, y, 100)
    assert told > 800


def test_a_long_text_without_its_asides_takes_linear_time():
    """10,000 of 40,000 tokens gone from one stretch: some 0.05 s, where the search and then the halving took over ten."""
    import time

    rng = random.Random(5)
    base = rng.choices("abcdefgh", k=40_000)
    own = [x for x in base if rng.random() < 0.75]
    began = time.process_time()
    steps = middle_steps(base, own)
    assert time.process_time() - began < 2
    assert steps.count("=") == len(own) and "+" not in steps


def test_pairs_are_cut_at_equal_tokens():
    rng = random.Random(8)
    words = [f"w{i} " for i in range(300)]
    base = rng.choices(words, k=5000)
    own = [x for x in base if rng.random() < 0.97]
    own[2000:2000] = rng.choices(words, k=300)
    known = {x: i for i, x in enumerate([*words, "\n"])}
    base[700:700] = own[650:650] = ["\n"] * 3
    live = np.array([x != "\n" for x in known])
    a, b = (np.array([known[x] for x in t]) for t in (base, own))
    found = segment_cuts(a, b, live, (6, 2), 100)
    assert len(found) > 15
    assert all(a[x] == b[y] and a[x + 1] == b[y + 1] and live[a[x]] for x, y in found)
    assert all(x < p and y < q for (x, y), (p, q) in zip(found, found[1:], strict=False))
    assert segment_cuts(a, b, live, (6, 2), 10**6) == []


@pytest.mark.parametrize("merged", [True, False])
def test_rows_of_stretches_are_those_of_the_whole(merged):
    rng = random.Random(4)
    words = [f"w{i} " for i in range(60)] + ["W1 ", "w1"]
    base = [" "] + rng.choices(words, k=1500)
    own = [rng.choice([*words, "\n "]) if rng.random() < 0.02 else x for x in base if rng.random() < 0.98]
    each = list(dict.fromkeys([*base, *own]))
    norms = [x.lower().strip() for x in each]
    batch = [pa.array([7]), pa.array([[0, 1, 0]], pa.list_(pa.int32())), pa.array([[base, own]]), pa.array([each]), pa.array([norms])]
    names = ["collation_id", "segment", "of", "tokens", "words", "norms", "chars"]
    cut = list(_segmented(names, (5, 3), 40)(iter([pa.RecordBatch.from_arrays(batch, [x for x in names if x not in ("segment", "chars")])])))
    assert len(cut) > 15
    rows = [row for x in held.nested(merged, None, ["collation_id", "segment", "rows"])(iter(cut)) for r in x.to_pylist() for row in r["rows"]]
    # scripts are minimal within stretches, so compared with each stretch's cells at its place in the whole
    want, at = [], [0, 0]
    known = dict(zip(each, norms, strict=True))
    texts = [[], []]
    for x in cut:
        own_rows = by_cells([[known[t] for t in text] for text in x.column(3)[0].as_py()], x.column(3)[0].as_py(), False)
        for row in own_rows:
            want.append([{**c, "start": c["start"] + at[d], "end": c["end"] + at[d]} if c else None for d, c in enumerate(row)])
        for d, text in enumerate(x.column(3)[0].as_py()):
            texts[d] += text
            at[d] += sum(map(len, text))
    assert texts == [base, own]
    if merged:
        islands: list[list] = []
        for row in want:
            if not islands or None not in row and row[0]["text"] == row[1]["text"]:
                islands.append([])
            islands[-1].append(row)
        want = [x for island in islands for x in folded(island)]
    assert rows == [[*row, row[0]] for row in want]
