"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def arrow(result):
    return result.to_arrow_table() if hasattr(result, "to_arrow_table") else result.fetch_arrow_table()


def counted(table, columns):
    return Counter(map(repr, zip(*(table[c].to_pylist() for c in columns), strict=True)))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    want = arrow(oracle.execute(entry.oracle_sql()[name]))
    assert sorted(want.column_names) == columns
    assert counted(frame.toArrow(), columns) == counted(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    """Two documents of the smallest corpus may agree wholly, and so have no notes."""
    frame = entry.queries()[name](spark, FOLDER)
    assert len(frame.toArrow()) > 0 or name == "apparatus_notes"


def test_syllables_with_a_chungs_equal_their_sql(spark, tmp_path):
    texts = ["a ' b", "' a", "' ' a", "a ' ' ' b '", "don't 'tis it's", "'", "' '", "", None, "ཀ་འ་ཁ འ འ", "x_'_y|z/'", "plain text", "a'b' ' 'c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()["display_syllables"](spark, str(tmp_path)).toArrow()
    want = arrow(con.execute(entry.oracle_sql()["display_syllables"]))
    assert counted(got, ["doc_id", "n", "joined"]) == counted(want, ["doc_id", "n", "joined"])
