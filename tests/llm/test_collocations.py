"""Phrase collocations against brute force over all phrases of small texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import collocations

SCHEMA = "doc_id long, text string, lang string, path string, n long, run int, words string, a long"


def rows():
    rng = random.Random(5)
    out = []
    for i in range(150):
        words = rng.choices(["The", "of", "sea", "é", "日本", "a\x00b", "a", "A\xa0b", "x\x1fy", "İ"], [9, 8, 3, 2, 2, 1, 4, 1, 1, 1], k=rng.randrange(60))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = ["once", "upon", "a", "time", "There", "was"][rng.randrange(3) :]
        text = "".join(w + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\r\n", "\x0b", "!?"] if rng.random() < 0.3 else [" "]) for w in words)
        out.append((i, text, rng.choice(["en", "en", "fr", None, ""]), "p", 1, 2, "w", 3))
    return out + [(7, None, "en", "p", 1, 2, "w", 3), (None, "", "xx", "p", 1, 2, "w", 3), (8, "  .. \n", None, "p", 1, 2, "w", 3), (9, "the " * 3000, "en", "p", 1, 2, "w", 3)] + [out[3]] * 5


def by_hand(rows, least, longest, top):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        listed = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "top", "shard"), [(3, 5, 2000, 1 << 21), (2, 5, 40, 50), (10, 3, 5, 700), (1, 2, 2000, 300)])
def test_against_brute_force(spark, least, longest, top, shard, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_WORDS", 60)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 200)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = collocations.top_phrases(docs, least=least, longest=longest, top=top, shard_words=shard).collect()
    want = by_hand(rows(), least, longest, top)
    assert len(want) > 10 and sorted(map(tuple, got)) == want


def test_no_rows_and_no_words(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collocations.top_phrases(none).count() == 0
    blank = spark.createDataFrame([(1, " . ", "en", "p", 1, 2, "w", 3)], SCHEMA)
    assert collocations.top_phrases(blank).count() == 0


def test_bitmap_has_what_was_put_in(spark):
    hashes = spark.range(5000).select(F.xxhash64(F.lit("lang"), F.col("id").cast("string")).alias("h"))
    bits = collocations.bitmap(hashes, 5000)
    own = collocations._word_hashes("lang", list(map(str, range(20_000))))
    known = collocations._known(bits, own)
    assert known[:5000].all() and known[5000:].mean() < 0.15
    assert len(collocations.bitmap(hashes, 5000, bits=1 << 15)) == 4096


def test_trie_is_in_order_of_paths():
    codes = np.array([0, 1, 0, 1, 2, -1, 0, 1, 0], np.int32)
    alive = np.array([1, 1, 1, 1, 0, 0, 1, 1], bool)
    path, n = collocations.trie(codes, alive, 3)
    assert path.tolist() == [[0, 1, -1], [0, 1, 0], [0, 1, 2], [1, 0, -1], [1, 0, 1], [1, 2, -1]]
    assert n.tolist() == [3, 2, 1, 2, 1, 1]
    path, n = collocations.trie(codes, alive, 3, np.array([1, 0, 0, 0, 0, 0, 1], bool))
    assert path.tolist() == [[0, 1, -1], [0, 1, 0], [1, 0, -1], [1, 2, -1]] and n.tolist() == [3, 2, 2, 1]


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, left = 900_000_000_007, 800_000_000_000_003, 3_000_000_000_077
    phrases = spark.createDataFrame([("en", ["x"], left, []), ("en", ["y"], left + 5, []), ("en", ["x", "y"], a, [left])], "lang string, path array<string>, a long, left array<long>")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    held = [collocations.materialize(x, "test") for x in (phrases, totals)]
    got = collocations.score_cuts(*held).first()
    assert got.score == 1000 * a * n // (left * (left + 5))
