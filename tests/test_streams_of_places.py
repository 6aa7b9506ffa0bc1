"""Places carried through filters, milestones put into rows, long islands folded, tokenizers that are functions."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import preprocess
from palimpsest.functions import tokens as tok
from palimpsest.operators.align import align
from palimpsest.operators.apparatus import golden, stone_rows
from palimpsest.operators.layout import long_rows, witness_rows
from palimpsest.operators.merge import fold, folded, merge_rows
from palimpsest.plans.collation import common_spelling


def replaced(text, pattern, replacement):
    """Filtered text, and for each of its places the place before."""
    out, back, at = "", [], 0
    for m in re.finditer(pattern, text):
        gap = text[at : m.start()]
        new = m.expand(re.sub(r"\$(\d)", r"\\\1", replacement))
        back += [at + k for k in range(len(gap))]
        kept = min(len(new), m.end() - m.start())
        back += [m.start() + k for k in range(kept)] + [m.start() + kept - 1 for _ in range(len(new) - kept)]
        out += gap + new
        at = m.end()
    back += [at + k for k in range(len(text) - at + 1)]
    return out + text[at:], back


CASES = [
    ("one, two,three, four", r"(?<=,) ", ""),
    ("ab12 cd345 ef6", r"(?<![0-9])([0-9])([0-9]*)", "$2<$1"),
    ("tsa tsha tsa.", r"ts(?=a)", "c"),
    ("aXbXc", r"X(?=b)|(?<=b)X", "yz"),
    ("no match", r"q", "w"),
    ("", r"q", "w"),
    ("﷐ a, b", r", ", ","),
]


@pytest.mark.parametrize(("text", "pattern", "replacement"), CASES)
def test_filters_see_what_is_around(spark, text, pattern, replacement):
    f = preprocess.apply_pattern(F.col("t"), pattern, replacement)
    row = spark.createDataFrame([(text,)], "t string").select(f.alias("f")).first().f
    want, back = replaced(text, pattern, replacement)
    assert row.text == want
    places = np.array([p.pos for p in row.map], np.int64), np.array([p.diff for p in row.map], np.int64)
    assert all(x < y for x, y in zip(places[0], places[0][1:], strict=False))
    assert preprocess.moved(np.arange(len(want) + 1), [places]).tolist() == back


def test_a_chain_of_patterns_and_own_filters(spark):
    texts = ["a, b-c, d", "", "x--y, z", "plain"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    upper = lambda text: F.struct(F.upper(text).alias("text"), F.expr("cast(array() as array<struct<pos:int,diff:int>>)").alias("map"))
    chain = [(r"(?<=,) ", ""), preprocess.translate_filter("b-", "q"), upper, ("Z", "ZZ")]
    got = {r.i: r for r in preprocess.filter_chain(rows, "text", chain).select("i", "filtered", "maps").collect()}
    for i, text in enumerate(texts):
        one, b1 = replaced(text, r"(?<=,) ", "")
        two, b2 = replaced(one.replace("b", "q"), "-", "")
        three, b3 = replaced(two.upper(), "Z", "ZZ")
        assert got[i].filtered == three
        maps = [(np.array([p.pos for p in m]), np.array([p.diff for p in m])) for m in got[i].maps]
        assert preprocess.moved(np.arange(len(three) + 1), maps).tolist() == [b1[b2[k]] for k in b3]


def test_rows_and_tokens_are_moved_alike(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["a", "b", ", ", "tion", " "], k=60)) for _ in range(6)] + ["", None]
    rows = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts)], "collation_id long, witness_id int, text string")
    found = preprocess.filter_chain(rows, "text", [("tion", "x"), ("(?<=,) ", ""), ("b", "bbb")])
    filtered = found.select("collation_id", "witness_id", F.col("filtered").alias("text"), "maps")
    want = tok.tokens(filtered, maps="maps").select("collation_id", "witness_id", "pos", "start", "end")
    plain = tok.tokens(filtered).select("collation_id", "witness_id", "pos", "start", "end")
    got = preprocess.corrected_rows(plain, filtered.select("collation_id", "witness_id", "maps"), ("start", "end"), ("collation_id", "witness_id"))
    assert got.columns == plain.columns
    by = lambda df: sorted(map(tuple, df.collect()))
    slow = plain.join(filtered, ["collation_id", "witness_id"]).select("collation_id", "witness_id", "pos", *(preprocess.corrected_chain(F.col(c), F.col("maps")).alias(c) for c in ("start", "end")))
    assert by(got) == by(want) == by(slow) and want.count() > 100


def test_offsets_of_a_text_of_a_megabyte_take_time_in_proportion(spark):
    seconds = []
    for n in (60_000, 240_000):
        rows = spark.createDataFrame([(0, 0, "ab, " * n)], "collation_id long, witness_id int, text string")
        found = preprocess.filter_chain(rows, "text", [("b", "")]).select("collation_id", "witness_id", F.col("filtered").alias("text"), "maps")
        began = time.time()
        last = tok.tokens(found, maps="maps").agg(F.max("end").alias("e"), F.count("*").alias("n")).first()
        seconds.append(time.time() - began)
        assert last.e == 4 * n
    assert seconds[1] < 12 * seconds[0] + 20


def test_common_spelling_keeps_places_before_filters(spark):
    rows = spark.createDataFrame([(0, 0, "a  b, c"), (0, 1, "a b,  d")], "collation_id long, witness_id int, text string")
    cells = common_spelling(rows, [(" +", " "), ("(?<=,) ", "")], bo=False)
    ends = {(r.witness_id): r.e for r in cells.groupBy("witness_id").agg(F.max("end").alias("e")).collect()}
    assert ends == {0: 7, 1: 7}


def test_stones_take_the_last_row_that_begins_before_them(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 1, 4), (0, 2, 4), (0, 3, 9), (0, 4, 9), (1, 0, 0)], "collation_id long, row_id int, base_start int")
    stones = spark.createDataFrame([(0, o, f"[{o}]") for o in (0, 3, 4, 8, 9, 50)] + [(1, 7, "[x]"), (2, 0, "[none]")], "collation_id long, offset int, tag string")
    got = {(r.collation_id, r.tag): (r.row_id, r.at) for r in stone_rows(rows, stones).collect()}
    assert got == {(0, "[0]"): (0, 0), (0, "[3]"): (0, 3), (0, "[4]"): (2, 0), (0, "[8]"): (2, 4), (0, "[9]"): (4, 0), (0, "[50]"): (4, 41), (1, "[x]"): (0, 7)}


def test_ten_thousand_stones_in_one_base(spark):
    n = 10_000
    base = "".join(f"w{i:05d} " for i in range(n))
    rows = spark.createDataFrame([(0, i, [base[7 * i : 7 * i + 7]], 7 * i, 7 * i + 7) for i in range(n)], "collation_id long, row_id int, segs array<string>, base_start int, base_end int")
    rows = rows.withColumns({"note_no": F.lit(None).cast("int"), "cut": F.lit(None).cast("int")})
    stones = spark.createDataFrame([(0, 7 * i + i % 8, f"[{i}]") for i in range(n)], "collation_id long, offset int, tag string")
    began = time.time()
    got = golden(rows, stones).first().golden
    want, at = "", 0
    parts = []
    for place, tag in sorted((7 * i + i % 8, i) for i in range(n)):
        parts += [base[at:place], f"[{tag}]"]
        at = place
    want = "".join(parts) + base[at:]
    assert len(got) == len(want) and re.sub(r"\[\d+\]", "", got) == base and time.time() - began < 60
    assert sorted(re.findall(r"\[\d+\]", got)) == sorted(re.findall(r"\[\d+\]", want))


CELLS = "array<array<struct<start:int,end:int,incr:int,text:string>>>"


def island(rng, n, gaps=0.3):
    rows = [[("a" if rng.random() < 0.7 else "ab") for _ in range(3)] if i else ["x", "x", "x"] for i in range(n)]
    return [[None if i and rng.random() < gaps else {"start": i, "end": i + 1, "incr": 1, "text": t} for t in row] for i, row in enumerate(rows)]


def test_folds_agree(spark):
    rng = random.Random(7)
    islands = [island(rng, rng.randrange(1, 30), g) for g in (0, 0.1, 0.3, 0.9) for _ in range(25)]
    islands.append([[{"start": 0, "end": 1, "incr": 1, "text": "a"}, {"start": 0, "end": 2, "incr": 1, "text": "ab"}], [{"start": 1, "end": 2, "incr": 1, "text": "b"}, None], [{"start": 2, "end": 3, "incr": 1, "text": "c"}, {"start": 2, "end": 3, "incr": 1, "text": "d"}]])
    frame = spark.createDataFrame(list(enumerate(islands)), f"i int, rows {CELLS}").select("i", fold(F.col("rows")).alias("r"))
    for r in frame.collect():
        assert [[c.asDict() for c in row] for row in r.r] == folded(islands[r.i])
    assert len(folded(islands[-1])) == 2  # what is joined may agree again


def test_an_island_of_a_hundred_thousand_rows(spark):
    rng = random.Random(3)
    rows = island(rng, 100_000, 0.2)
    began = time.time()
    want = folded(rows)
    assert time.time() - began < 60
    wide = spark.createDataFrame([(0, i, r) for i, r in enumerate(rows)], f"collation_id long, row_id int, cells {CELLS.removeprefix('array<').removesuffix('>')}")
    got = [[c.text for c in r.cells] for r in merge_rows(wide).orderBy("row_id").collect()]
    assert got == [[c["text"] for c in row] for row in want]
    assert "".join(r[0] for r in got) == "".join(r[0]["text"] for r in rows if r[0])


def test_the_longest_words_of_a_list(spark):
    words = ["bod", "bod skad", "skad", "kyi", "rgyal po"]
    trie = tok.Trie(words)
    assert trie.tokens("bod skad kyi bod dpe rgyal", " ") == ["bod skad ", "kyi ", "bod ", "dpe rgyal"]
    rng = random.Random(1)
    texts = ["".join(rng.choices([*words, " ", "x", "sk"], k=12)) for _ in range(50)] + ["", None]
    cut = tok.longest_match(words, " ")
    rows = spark.createDataFrame([(i // 2, i % 2, t) for i, t in enumerate(texts)], "collation_id long, witness_id int, text string")
    table = tok.tokens(rows, cut).collect()
    for i, t in enumerate(texts):
        own = sorted((r.pos, r.start, r.end, r.token) for r in table if (r.collation_id, r.witness_id) == (i // 2, i % 2))
        assert "".join(x[3] for x in own) == (t or "") and all((t or "")[s:e] == x for _, s, e, x in own)
        for _, s, _, x in own:
            known = [w for w in words if t.startswith(w, s)]
            assert not known or x.rstrip(" ") == max(known, key=len)
    cells = witness_rows(long_rows(align(rows, cut))).select("collation_id", "witness_id", F.array_join(F.transform("cells", lambda c: c["text"]), "").alias("text"))
    got = {2 * r.collation_id + r.witness_id: r.text for r in cells.collect()}
    assert all(got.get(i, "") == (t or "") for i, t in enumerate(texts))


def test_offsets_of_many_texts_come_in_small_batches():
    import pyarrow as pa

    from palimpsest.functions import tokens as tok

    lists = pa.array([["ab", "c"], [], [""], ["def"]] * 100, pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), lists], ["doc_id", "tokens"])
    parts = list(tok._placed(False)([batch]))
    assert max(x.num_rows for x in parts) <= tok.AT_ONCE < 400
    got = pa.Table.from_batches(parts).to_pydict()
    assert got["doc_id"] == list(range(400))
    assert got["ends"] == [[2, 3], [], [0], [3]] * 100
    assert got["starts"] == [[0, 2], [], [0], [0]] * 100
