"""Near copies against brute-force Jaccard similarity of 5-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
from palimpsest.llm.simhash import fingerprint, near_copies


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def texts():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeghiklmnoprst", k=rng.randrange(2, 9))) for _ in range(900)]
    out = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randrange(3, 250))
        out.append(" ".join(base))
        for edits in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return [*out, None, "", " \n"]


def components(rows):
    sets, name = [shingled(t) for _, t, *_ in rows], [i for i, *_ in rows]
    moved = True
    while moved:
        moved = False
        for a in range(len(rows)):
            for b in range(a):
                if name[a] != name[b] and similar(sets[a], sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
                    moved = True
    return {i: n for (i, *_), n in zip(rows, name, strict=True)}


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = components(rows)
    assert {r.doc_id: r.component_id for r in near_copies(frame).collect()} == want
    prints = {i: fingerprint(t) for i, t in rows}
    assert sum(prints[i].__xor__(prints[n]).bit_count() > 3 for i, n in want.items()) > 40  # edits that 3 bits do not reach


def test_ids_and_rows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text), (5, text), (None, text + " end"), (7, "other"), (7, text), (None, "alone"), (3, text.replace("w50", "x"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_copies(frame).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (None, 3), (7, 7), (7, 3), (None, None), (3, 3)], key=str)
    assert near_copies(frame.limit(0)).count() == 0


def test_one_large_group(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in near_copies(frame).collect()} == {0}


def test_a_group_beyond_a_block_is_dealt_in_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):  # a chain: each step edits one word more, so its ends are far apart
        if i % 3 == 0:
            words[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join([*words, f"x{i}"])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = components(rows)
    for block in (1 << 24, 4000):
        assert {r.doc_id: r.component_id for r in near_copies(frame, block_bytes=block).collect()} == want


def test_stage_drops_edited_copies(spark):
    words = [f"w{i}" for i in range(200)]
    edited = [w if i not in (20, 90, 150) else "x" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 9), (2, " ".join(edited), "en", "s", 9), (3, "apart", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert (fingerprint(" ".join(words)) ^ fingerprint(" ".join(edited))).bit_count() > 3
    assert {r.doc_id for r in pipeline.near_copies(spark, docs, "").collect()} == {1, 3}
