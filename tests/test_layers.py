"""Annotation layers: looked up by reference, projected onto the voted text as a search over all rows does it."""

from __future__ import annotations

import random

from palimpsest.operators import layers


def test_projection_against_all_rows(spark):
    rng = random.Random(5)
    cells, voted, spans, want = [], [], [], []
    for c in range(4):
        n = rng.randrange(1, 30)
        texts = [["".join(rng.choices("ab ", k=rng.randrange(4))) if rng.random() < 0.8 else None for _ in range(3)] for _ in range(n)]
        readings = [rng.choice([t or "" for t in row]) for row in texts]
        voted += [(c, r, x) for r, x in enumerate(readings)]
        for w in range(3):
            at, own = 0, []
            for r in range(n):
                size = len(texts[r][w] or "")
                cells.append((c, r, w, at if size else 0, texts[r][w]))
                if size:
                    own.append((at, at + size, r))
                at += size
            for k in range(12):
                start = rng.randrange(at + 1)
                end = rng.randrange(start, at + 3)
                one = (c, w, start, end, f"p{k % 10}")
                spans.append(one)
                if own:
                    row = lambda x, own=own: [r for s, _, r in own if s <= x][-1]
                    a, b = row(start), row(max(end - 1, start))
                    want.append((c, w, sum(map(len, readings[:a])), sum(map(len, readings[: b + 1])), f"p{k % 10}"))
    spans.append(spans[0])
    want.append(want[0])
    got = layers.project(
        spark.createDataFrame(spans, "collation_id long, witness_id int, start int, end int, reference string"),
        spark.createDataFrame(cells, "collation_id long, row_id int, witness_id int, start int, text string"),
        spark.createDataFrame(voted, "collation_id long, row_id int, voted string"),
    ).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_lookups(spark):
    notes = spark.createDataFrame([("v1", "1a", 5, 9, 0.5), ("v1", "1a", 2, 4, 0.7), ("v1", None, 0, 1, 0.1), ("v2", "1a", 7, 8, 0.2)], "witness_id string, reference string, start int, end int, confidence double")
    wanted = spark.createDataFrame([("v1", "1a"), ("v1", "1a"), ("v1", "9z"), ("v2", None)], "witness_id string, reference string")
    assert [tuple(r) for r in layers.of_reference(notes, wanted).collect()] == [("v1", "1a", 2, 4, 0.7)]
    ours = spark.createDataFrame([("e1", "b1"), ("e1", "b2")], "edition string, base_id string")
    theirs = spark.createDataFrame([("e1", "b1"), ("e2", "b1"), ("e3", "b1"), ("e2", "b3")], "edition string, base_id string")
    assert sorted(map(tuple, layers.comparable_bases(ours, theirs).collect())) == [("e1", "b1", "e2", "b1"), ("e1", "b1", "e3", "b1")]
