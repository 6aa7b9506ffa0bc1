"""Groups of texts alike against all pairs, whatever the order of the prefix, the blocks and the rounds."""

from __future__ import annotations

import random
from itertools import combinations

import duckdb
import pytest

from palimpsest.operators import similar
from palimpsest.sources.witnesses import near_copies

FOLDER = "/root/testdata/sf0.1"


def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    shared = rng.choices(words, k=40)
    out = []
    for i in range(60):
        base = rng.choices(words, k=rng.choice([0, 1, 3, 6, 30, 80]))
        if i % 3 == 0:
            base = base + shared
        out.append(base)
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(copy + rng.choices(words, k=rng.randrange(3)))
    chain = rng.choices(words, k=100)
    for k in range(12):  # each like the one before it, the ends unlike
        out.append(list(chain))
        chain[k * 8 : k * 8 + 2] = [f"new{k}a", f"new{k}b"]
    texts = [rng.choice([" ", "\t", "\n "]).join(x) for x in out] + [None, "", "  ", "two\x85words", "w1 w2"] + ["w1 w2"] * 20
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


def by_hand(rows, shingle, similarity):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if w:
            sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    roots = {i: root(i) for i in sets}
    return {i: r for i, r in roots.items() if sum(x == r for x in roots.values()) > 1}


@pytest.mark.parametrize(("shingle", "similarity", "block", "one_task", "sample"), [(5, 0.8, 16 << 20, 1 << 18, 4000), (5, 0.8, 900, 1, 0), (3, 0.6, 2000, 5, 30)])
def test_against_all_pairs(spark, monkeypatch, shingle, similarity, block, one_task, sample):
    monkeypatch.setattr(similar, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(similar, "components", lambda e, f=similar.components: f(e, one_task))
    docs = spark.createDataFrame(rows(), "id long, text string").repartition(3)
    got = {r.id: r.group for r in similar.similar_groups(docs, shingle, similarity, block).collect()}
    assert got == by_hand(rows(), shingle, similarity)


def test_no_rows_and_no_copies(spark):
    assert similar.similar_groups(spark.createDataFrame([], "id long, text string")).count() == 0
    assert similar.similar_groups(spark.createDataFrame([(1, "a b"), (2, "c d"), (3, None)], "id long, text string")).count() == 0


@pytest.mark.parametrize("one_task", [1 << 18, 1, 0])
def test_components_of_chains_stars_and_loops(spark, one_task):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (202, 202), (300, 299), (299, 298), (298, 300)]
    got = {r.node: r.component for r in similar.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 298: 298, 299: 298, 300: 298}
    assert got == want


def test_no_pair_of_the_corpus_is_missed(spark):
    """Every pair of sf0.1 at an exact Jaccard similarity of 0.8 shares a collation: recall 1."""
    got = {r.doc_id: r.collation_id for r in near_copies(spark.read.parquet(f"{FOLDER}/documents.parquet")).select("doc_id", "collation_id").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text FROM '{FOLDER}/documents.parquet'")
    # shingles that one document alone has tell nothing but sizes
    pairs = con.execute(
        r"""WITH x AS (SELECT doc_id, len(w) AS n, unnest(w) AS t, unnest(range(len(w))) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)),
        z AS (SELECT doc_id, n, p, hash(concat_ws(' ', t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o)) AS s FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        s AS (SELECT DISTINCT doc_id, s FROM z WHERE p <= greatest(n - 5, 0)), m AS (SELECT doc_id, count(*) AS m FROM s GROUP BY doc_id),
        f AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1), r AS (SELECT s.* FROM s JOIN f USING (s)),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM r AS a JOIN r AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)
        SELECT i.a, i.b FROM i JOIN m AS x ON x.doc_id = i.a JOIN m AS y ON y.doc_id = i.b WHERE 5 * same >= 4 * (x.m + y.m - same)"""
    ).fetchall()
    assert len(pairs) > 500
    assert all(got.get(a) == got.get(b) is not None for a, b in pairs)


@pytest.mark.parametrize(("hot", "sample"), [(0, 4000), (2, 0), (3, 4000), (1000, 0)])
def test_pairs_and_chains_against_all_pairs(spark, monkeypatch, hot, sample):
    """All of the links may come of pairs, all of chains, or some of each."""
    monkeypatch.setattr(similar, "SAMPLE_ROWS", sample)
    docs = spark.createDataFrame(rows(), "id long, text string").repartition(3)
    for shingle, similarity in ((5, 0.8), (2, 0.5)):
        got = {r.id: r.group for r in similar.similar_groups(docs, shingle, similarity, 3000, hot).collect()}
        assert got == by_hand(rows(), shingle, similarity)


def test_texts_that_share_a_few_rare_words_are_no_family(spark):
    """Texts in a chain, each with a passage of the one before it, at no similarity: nothing to compare."""
    texts = [(i, " ".join([f"s{i}{k}" for k in range(12)] + [f"u{i}x{k}" for k in range(80)] + [f"s{i + 1}{k}" for k in range(12)])) for i in range(200)]
    docs = spark.createDataFrame(texts, "id long, text string")
    own = docs.select("id", "text").mapInArrow(similar._signed(5, 0.8, spark.sparkContext.broadcast(similar._counts(docs, 5))), "id long, key long, size int, prefix array<long>")
    links, _ = similar._links(own, 0.8, similar.HOT)
    assert links.count() == 0
    assert similar.similar_groups(docs).count() == 0
