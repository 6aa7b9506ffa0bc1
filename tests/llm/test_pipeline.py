"""The pipeline stage by stage against brute force, each judged on its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from palimpsest.llm.common import materialize
from tests.llm.test_near_copies import components
from tests.llm.test_operators import leaks_by_hand, lines_by_hand, mixed_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(12)
    words = ["".join(rng.choices("abcdeghiklmnoprst", k=rng.randrange(2, 9))) for _ in range(900)]
    say = lambda n: " ".join(rng.choices(words, k=n)) + "."
    item = say(40)
    rows, labels = [], []
    for i in range(300):
        good = i % 6 != 5
        text = "\n".join(say(rng.randrange(8, 30)) for _ in range(rng.randrange(1, 6)))
        if not good:
            text = " ".join(w + "%%%" for w in text.split())
        if i % 10 == 1:
            text += "\nAll of this is licensed under a long license line."
        if i % 50 == 2:
            text += "\n" + item
        if i % 25 == 3:
            text = rows[0][1] + f" x{i}"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 2 == 0 or not good:
            labels.append((i, int(good), 0))
    rows += [(1000, rows[0][1], "en", None, len(rows[0][1])), (1001, None, None, None, None), (1002, "", "en", "s1", 0)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, item), (1, say(30))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in pipeline.STAGES:
        after[name] = materialize(stage(spark, docs, folder), "test")
        before, docs = docs, after[name]
        rows = [tuple(r) for r in before.select(COLUMNS).collect()]
        got = {r.doc_id: r for r in docs.collect()}
        assert len(got) == docs.count()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
        if name == "quality classifier":
            junk = {i for i, t, *_ in rows if t and "%%%" in t}
            assert not junk & set(got) and len(got) > 230
        if name == "line dedup":
            for i, stay, _ in lines_by_hand(rows):
                text = next(r[1] for r in rows if r[0] == i)
                want = None if text is None else "\n".join(x for x, s in zip(text.split("\n"), stay, strict=True) if s)
                assert got[i].text == want and (want is None or got[i].n_chars == len(want))
        if name == "SimHash near-dedup":
            assert set(got) == set(components(rows).values())
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert set(got) == {r[0] for r in rows} - {x["doc_id"] for x in leaks_by_hand(rows, items)} and len(got) < len(rows)
    last = docs.collect()
    want = {r["doc_id"]: r for r in mixed_by_hand(rows) if r["taken"]}
    assert {r.doc_id: (r.size, r.source_size, r.taken) for r in last} == {i: (r["size"], r["source_size"], r["taken"]) for i, r in want.items()}
    assert all(0 < r.taken <= 2 * r.size and r.copies == -(-r.taken // r.size) for r in last)
    whole = {r[0]: r[1] for r in rows}
    assert all(r.text == (whole[r.doc_id] if r.taken >= r.size else " ".join(whole[r.doc_id].split()[: r.taken])) for r in last)


def test_run_agrees_with_itself(spark, folder):
    once, again = ([tuple(r) for r in pipeline.run(spark, folder).orderBy("doc_id").collect()] for _ in range(2))
    assert once == again and once


def say(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghiklmnoprst", k=rng.randrange(3, 9))) for _ in range(n))


#: null and repeated ids, equal rows, null and empty texts, and columns named as helpers are
ODD = "doc_id long, text string, lang string, source string, n_chars int, size int, taken string, finish double, _null int, `a.b` string, score int, _row int, _rank int, w int, `key` int, `row` int, doc int"
EXTRA = (1, "t", 0.5, 2, "dot", 3, 4, 5, 6, 7, 8, 9)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    copy, item = say(1, 60), say(2, 30)
    texts = [(None, copy), (None, say(3, 50)), (7, copy), (7, say(4, 50)), (8, say(5, 40)), (8, say(5, 40)), (9, item + " " + say(6, 20)), (9, say(7, 45)), (None, item), (10, None), (None, None), (11, ""), (12, "one two")]
    rows = [(i, t, "en", ("s", None)[k % 2], len(t or "")) + EXTRA for k, (i, t) in enumerate(texts)]
    out = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, ODD).repartition(2).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, item), (1, "one two"), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), texts


def kept(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stages_keep_unique_texts_of_null_and_repeated_ids(spark, odd):
    folder, texts = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by_name = dict(pipeline.STAGES)
    assert kept(by_name["quality classifier"](spark, docs, folder)) == sorted(texts, key=str)  # no label, no rule
    assert kept(by_name["line dedup"](spark, docs, folder)) == sorted(texts, key=str)
    one = by_name["SimHash near-dedup"](spark, docs, folder)
    empty = [(10, None)]  # of the texts without a word
    assert kept(one) == sorted([(7, texts[0][1]), texts[1], texts[3], texts[4], texts[6], texts[7], texts[8], *empty, texts[12]], key=str)
    clean = by_name["benchmark decontamination"](spark, docs, folder)
    assert kept(clean) == sorted([x for k, x in enumerate(texts) if k not in (6, 8, 12)], key=str)
    mixed = by_name["mixing sources"](spark, docs, folder)
    want = sorted(((r["doc_id"], r["size"], r["taken"]) for r in mixed_by_hand([(i, t, "en", ("s", None)[k % 2]) for k, (i, t) in enumerate(texts)]) if r["taken"]), key=str)
    assert sorted(((r.doc_id, r["size"], r.taken) for r in mixed.collect()), key=str) == want
    for name, frame in (("lines", by_name["line dedup"](spark, docs, folder)), ("near", one), ("clean", clean)):
        assert frame.columns == docs.columns, name
        first = frame.where("doc_id = 8").first()
        assert (first["a.b"], first["_null"], first["size"], first["row"]) == ("dot", 2, 1, 8)
    assert [c for c in mixed.columns if c in docs.columns and c not in ("size", "taken", "finish")] == [c for c in docs.columns if c not in ("size", "taken", "finish")]
    assert mixed.first()["a.b"] == "dot"


def test_whole_run_on_odd_rows_and_on_none(spark, odd, tmp_path):
    folder, _ = odd
    assert pipeline.run(spark, folder).count() > 4
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    nothing = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name
    assert pipeline.run(spark, str(tmp_path)).count() == 0
