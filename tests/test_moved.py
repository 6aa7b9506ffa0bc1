"""How much queries move: texts are dealt once, and cells not at all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palimpsest.functions.tokens import GENERIC
from palimpsest.operators import annotations, layers
from palimpsest.operators.layout import held_positions, held_witnesses
from palimpsest.tables import discard, spread_once


def shuffled(spark) -> int:
    """Bytes of shuffles written since the session began."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    stages = store.stageList(spark._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """300 documents of long random words, which nothing compresses well, and copies of some."""
    rng = random.Random(2)
    texts = [" ".join("%0100x" % rng.getrandbits(400) for _ in range(30)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:20])]
    at = str(tmp_path_factory.mktemp("moved"))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


def moved(spark, name, folder) -> float:
    """Bytes shuffled by a query, as a multiple of the characters of all texts, which have half a byte of chance each."""
    before = shuffled(spark)
    rows = entry.queries()[name](spark, folder).toArrow()
    assert len(rows)
    return (shuffled(spark) - before) / (320 * 30 * 101)


def test_the_search_for_near_copies_deals_texts_once(spark, folder):
    assert moved(spark, "near_copies", folder) < 2


def test_a_scan_dealt_once_is_read_without_a_shuffle(spark, folder):
    scan = spark.read.parquet(f"{folder}/documents.parquet")
    table = spread_once(scan, "once")
    before = shuffled(spark)
    assert table.where("length(text) > 0").count() == 320
    assert sorted(table.toArrow().to_pylist(), key=str) == sorted(scan.toArrow().to_pylist(), key=str)
    assert shuffled(spark) - before < 10_000
    discard(table, scan)


@pytest.mark.parametrize("name", ["transpose", "confidence_min", "page_spans"])
def test_cells_stay_where_texts_met(spark, folder, name):
    assert moved(spark, name, folder) < 1.5


def test_transposed_rows_leave_gaps_and_absent_witnesses_out(spark):
    texts = spark.createDataFrame([(0, 0, "a b c"), (0, 3, "d"), (1, 1, ""), (2, 0, "e f")], "collation_id long, witness_id int, text string")
    found = held_witnesses(held_positions(texts, GENERIC)).collect()
    assert sorted((r.collation_id, r.witness_id, "|".join(c.text for c in r.cells)) for r in found if r.cells) == [(0, 0, "a |b |c"), (0, 3, "d"), (2, 0, "e |f")]


def test_confidences_of_overlapping_cells_and_null_texts(spark):
    rng = random.Random(8)
    cells, marks = [], []
    for key in [*"abcdefg", None]:
        for _ in range(40):
            at = rng.randrange(200)
            cells.append((key, at, at + rng.randrange(30), rng.choice(["x", "x", "x", None])))
        marks += [(key, rng.randrange(-5, 240), rng.choice([None, 0.0, 0.29, 0.5, 1.0, 1.2])) for _ in range(rng.choice([0, 5, 60]))]
    got = annotations.confidence_min(
        spark.createDataFrame(cells, "key string, start int, end int, text string"), spark.createDataFrame(marks, "key string, start int, confidence double"), ("key",), gap=7
    )
    want = []
    for key, start, end, text in cells:
        own = [int(c * 100) for k, at, c in marks if key is not None and k == key and c is not None and start < at <= end]
        want.append((key, start, end, text, min(own, default=100) if text else 7))
    assert got.columns == ["key", "start", "end", "text", "confidence"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_spans_projected_in_order_equal_those_projected_in_any(spark):
    rng = random.Random(5)
    rows, spans = [], []
    for collation in range(6):
        cells = [[rng.choice([None, "", "a", "bcd", "efghij"]) for _ in range(3)] for _ in range(rng.choice([1, 5, 400]))]
        own = [(w, f"p{i}", at, at + rng.choice([0, 1, 9])) for w in range(4) for i, at in enumerate(rng.choices(range(60), k=20))]
        own += own[:3]
        spans += [(collation, *x) for x in own]
        rows += [(collation, i, [(t,) for t in x], x[1], own if i == 0 else None) for i, x in enumerate(cells)]
    kinds = "collation_id long, row_id int, cells array<struct<text:string>>, voted string, spans array<struct<witness_id:int,page:string,start:int,end:int>>"
    held = spark.createDataFrame(rows, kinds).coalesce(1)
    long = held.select("collation_id", "row_id", F.posexplode("cells").alias("witness_id", "c")).select("collation_id", "row_id", "witness_id", "c.text")
    size = F.length(F.coalesce("text", F.lit("")))
    long = long.withColumn("start", (F.sum(size).over(Window.partitionBy("collation_id", "witness_id").orderBy("row_id")) - size).cast("int"))
    table = spark.createDataFrame(spans, "collation_id long, witness_id int, page string, start int, end int")
    want = layers.project(table, long, held.select("collation_id", "row_id", "voted"))
    got = layers.project_ordered(held)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
