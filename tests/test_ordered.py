"""Rows of collations that stay where they are: results as by deals and sorts, and plans without these."""

from __future__ import annotations

import pytest

from palimpsest.operators import serialize
from palimpsest.plans import catalog, collation

ROWS = [
    (0, 0, "[1a] bod skad ' kyi/ a b [x]"), (0, 1, "bod skad ' ni/ a c"), (0, 2, "bod ska ' kyi/ a b"),
    (1, 0, "one two three"), (1, 1, "one 2 three"), (2, 0, ""), (2, 1, " "), (3, 1, "no base"), (4, 0, "x' y"), (4, 2, "x ' z"), (4, 5, "x' y"),
]


def frame(spark):
    return spark.createDataFrame(ROWS, "collation_id long, witness_id int, text string").repartition(3)


def same(a, b):
    a, b = (sorted(map(repr, x.select(sorted(x.columns)).collect())) for x in (a, b))
    assert a == b
    assert a


@pytest.mark.parametrize("plan", [collation.apparatus, collation.golden_text])
def test_apparatus_is_the_same_in_tasks_and_by_rows(spark, plan):
    same(plan(frame(spark)), plan(frame(spark), together=0))


def test_serialised_votes_are_the_same_in_order_and_dealt_anew(spark):
    rows = serialize.voted_rows(collation.spelling_rows(frame(spark)))
    dealt = serialize.voted_rows(collation.common_spelling(frame(spark), bo=False))
    for f in (serialize.markdown, serialize.hfml, serialize.md_notes, serialize.hfml_notes):
        same(f(rows, ordered=True), f(dealt))
    same(rows, serialize.voted_rows(collation.spelling_rows(frame(spark), together=0)))


@pytest.mark.parametrize("name", ["edition_golden", "edition_markdown", "edition_hfml", "edition_notes", "md_notes", "hfml_notes", "voted_text"])
def test_rows_are_neither_sorted_nor_dealt_after_texts_have_met(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") == 1
    assert "Window" not in physical
    assert "Sort [" not in physical


def test_a_matrix_by_position_deals_texts_and_not_tokens(spark):
    plan = catalog.queries()["count_weights"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "regexp_extract_all" not in physical[physical.index("Exchange hashpartitioning") :]


def test_only_readings_go_to_functions_of_batches_without_a_bound(spark):
    """A batch of a scalar function holds 10,000 rows whatever their size, so no row of a whole collation goes there."""
    plan = collation.apparatus(frame(spark))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("ArrowEvalPython [_trimmed(") == physical.count("ArrowEvalPython [") == 1
    assert physical.count("MapInArrow") == 2
    votes = serialize.hfml(collation.spelling_votes(frame(spark)), ordered=True)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in votes
