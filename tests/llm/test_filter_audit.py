"""The filter audit against brute force, one document and one order at a time."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from palimpsest.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask int, part string, `key` string, row int, length int"
LABELS = "doc_id long, quality int, toxic int"


def rows():
    rng = random.Random(11)
    say = lambda n, v: " ".join(rng.choice("abcdefgh") + rng.choice("ijklmno") * rng.randrange(1, v) for _ in range(n))
    long = say(5000, 30)  # several blocks
    texts = [say(rng.choice([0, 3, 199, 200, 300]), rng.choice([2, 40])) for _ in range(60)]
    texts += [long, long + "x", long[:-1] + "y", long[:3000] + "Z" + long[3001:], long, "x" + long[1:], long]
    texts += [t + s for t in texts[:5] for s in ("#", " UPPER CASE WORDS", "|")] + [None, "", None, " x\xa0y " * 120, "é" * 600, "é" * 600, "e" * 600]
    texts += [texts[3]] * 30
    out = [(i * 7 % 1009, t, rng.choice(["a", "b", None, ""]), 1, "p", "k", 2, 3) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out + [(out[0][0], out[0][1], "a", 1, "p", "k", 2, 3)] * 2 + [(None, out[1][1], "b", 1, "p", "k", 2, 3)] * 2 + [(None, "of no id alone", "b", 1, "p", "k", 2, 3)]


def by_hand(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    docs = []
    for i, t, source, *_ in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = "".join(
            x
            for x, bad in zip(
                "ABCDE",
                (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(set(t) & set("#$%&*|")), t in least and (i is None or least[t] < i)),
                strict=True,
            )
            if bad
        )
        docs.append((source or "", fails, i in good and i is not None, i in toxic and i is not None))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for k, x in enumerate(order):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                failing = [d for d in docs if d[0] == part and x in d[1]]
                out[part, order, k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == x for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


@pytest.mark.parametrize("first", [4, filter_audit.FIRST_BLOCK])
def test_against_brute_force(spark, first):
    docs = rows()
    labels = [(r[0], (r[0] or 0) % 3 % 2, 1 if (r[0] or 0) % 5 == 0 else None) for r in docs[::2]] + [(docs[4][0], 1, 0), (docs[4][0], 0, 1), (None, 1, 1), (99999, 1, 1)]
    found = filter_audit.masks(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS), first_block=first)
    assert found.count() == len(docs)
    got = filter_audit.audit(found).collect()
    want = by_hand(docs, labels)
    assert len(got) == len(want) == 600 * 3
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(filter_audit.masks(none, spark.createDataFrame([], LABELS))).count() == 0


def test_blocks_double_and_cover_the_text():
    text = "".join(map(chr, range(300, 1100)))
    assert [len(filter_audit.block_hashes(text[:n], 4)) for n in (0, 1, 4, 5, 8, 9, 16, 17)] == [0, 1, 1, 2, 2, 3, 3, 4]
    for at in (0, 3, 4, 9, 799):
        other = text[:at] + "!" + text[at + 1 :]
        assert filter_audit.block_hashes(text, 4) != filter_audit.block_hashes(other, 4)
