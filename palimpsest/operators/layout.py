"""From placed cells to numbered rows: slot widths, prefix sums, the matrix before the merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from palimpsest.functions.tokens import token_array
from palimpsest.shipping import ship


def slot_widths(placed: DataFrame) -> DataFrame:
    """collation_id, anchor, width, first: how many rows each anchor takes, and the first of them.

    One row an anchor reaches the running sum, whatever the number of witnesses.
    """
    need = F.when(F.col("slot") < 0, -F.col("slot")).otherwise(F.col("slot") + 1)
    widths = placed.groupBy("collation_id", "anchor").agg(F.max(need).alias("width"))
    upto = F.sum("width").over(Window.partitionBy("collation_id").orderBy("anchor"))
    return widths.withColumn("first", (upto - F.col("width")).cast("int"))


def layout(placed: DataFrame) -> DataFrame:
    """collation_id, row_id, witness_id, start, end, incr, text: one row a token; gaps are absent rows."""
    at = F.col("first") + F.when(F.col("slot") < 0, F.col("width") + F.col("slot")).otherwise(F.col("slot"))
    rows = placed.join(slot_widths(placed), ["collation_id", "anchor"])
    return rows.select("collation_id", at.cast("int").alias("row_id"), "witness_id", "start", "end", "incr", "text")


def wide_rows(cells: DataFrame, n_witnesses: DataFrame | None = None) -> DataFrame:
    """collation_id, row_id, cells: array over witnesses (witness_id = index), null where a witness has a gap.

    n_witnesses: collation_id, n; without it, the largest witness of each collation's cells.
    """
    if n_witnesses is None:
        n_witnesses = cells.groupBy("collation_id").agg((F.max("witness_id") + 1).alias("n"))
    rows = cells.groupBy("collation_id", "row_id").agg(F.map_from_entries(F.collect_list(F.struct("witness_id", F.struct("start", "end", "incr", "text")))).alias("m"))
    rows = rows.join(n_witnesses, "collation_id")
    return rows.select("collation_id", "row_id", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at("m", i.cast(dict(cells.dtypes)["witness_id"]))).alias("cells"))


@F.arrow_udf(from_arrow_type(pa.list_(pa.list_(pa.struct([("text", pa.string())])))))
def _by_position(witnesses: pa.Array, lists: pa.Array) -> pa.Array:
    out = [pa.array([], pa.list_(pa.list_(pa.struct([("text", pa.string())]))))]
    for ids, own in zip((x.values.to_numpy() for x in witnesses), (x.values for x in lists), strict=True):
        lengths = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, first = np.zeros((2, ids.max() + 1), np.int64)
        sizes[ids], first[ids] = lengths, np.cumsum(lengths) - lengths
        rows = np.arange(sizes.max())[:, None]
        put = pa.array((rows + first).reshape(-1), pa.int64(), mask=(rows >= sizes).reshape(-1))
        texts = pa.StructArray.from_arrays([own.flatten().take(put)], ["text"])
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(sizes), pa.int32()), texts)
        out.append(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), cells))
    return pa.concat_arrays(out)


def held_positions(witnesses: DataFrame, pattern: str, each: tuple[str, ...] = ()) -> DataFrame:
    """collation_id, rows (arrays of cells with text) by token position, of witnesses(collation_id, witness_id, text); where a text has ended, null.

    The texts meet once, by collation; everything that follows by collation moves no row.  A witness that is not there has gaps.
    each: columns of witnesses, of which all witnesses' values are kept, as arrays, in no order.
    """
    # the filter keeps all; without it the optimizer takes the function below for a part of the aggregation
    ship(witnesses.sparkSession)
    met = witnesses.groupBy("collation_id").agg(F.collect_list(F.struct(F.col("witness_id").cast("int").alias("w"), F.col("text").alias("text"), *each)).alias("w")).where(F.size("w") > 0)
    tokens = F.transform(F.col("w.text"), lambda t: token_array(t, pattern))
    return met.select("collation_id", *(F.col("w")[c].alias(c) for c in each), _by_position("w.w", tokens).alias("rows"))


@F.arrow_udf(from_arrow_type(pa.list_(pa.struct([("witness_id", pa.int32()), ("cells", pa.list_(pa.struct([("text", pa.string())])))]))))
def _transposed(lists: pa.Array) -> pa.Array:
    kind = pa.struct([("text", pa.string())])
    out = [pa.array([], pa.list_(pa.struct([("witness_id", pa.int32()), ("cells", pa.list_(kind))])))]
    for rows in (x.values for x in lists):
        flat = rows.flatten()
        width = len(flat) // len(rows) if len(rows) else 0
        texts = pc.struct_field(flat, "text")
        order = np.arange(len(flat)).reshape(-1, width).T.reshape(-1) if width else np.zeros(0, np.int64)
        # places in order of witnesses, without the gaps
        there = texts.is_valid().to_numpy(zero_copy_only=False)[order]
        sizes = there.reshape(width, -1).sum(axis=1) if width else np.zeros(0, np.int64)
        own = pa.StructArray.from_arrays([texts.take(pa.array(order[there]))], fields=kind.fields)
        cells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), own)
        each = pa.StructArray.from_arrays([pa.array(np.arange(width), pa.int32()), cells], ["witness_id", "cells"])
        out.append(pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), each))
    return pa.concat_arrays(out)


def held_witnesses(held: DataFrame) -> DataFrame:
    """collation_id, witness_id, cells (text): the rows of held_positions() transposed where they are, each witness's cells in row order, without gaps."""
    ship(held.sparkSession)
    return held.select("collation_id", F.inline_outer(_transposed("rows"))).where("witness_id is not null")


def each_row(held: DataFrame, *names: str, rows: str | Column = "rows") -> DataFrame:
    """collation_id, the columns named, row_id, cells: a row each of a collation's rows, in order."""
    # the outer form, as the optimizer would otherwise work all rows out once more to see if there are any
    return held.select("collation_id", *names, F.posexplode_outer(rows).alias("row_id", "cells")).where("row_id is not null")


def position_rows(witnesses: DataFrame, pattern: str) -> DataFrame:
    """collation_id, row_id, cells (text) of held_positions(), in order."""
    return each_row(held_positions(witnesses, pattern))


def long_rows(wide: DataFrame) -> DataFrame:
    """The inverse of wide_rows(); gaps stay as rows of null text."""
    cells = wide.select("collation_id", "row_id", F.posexplode("cells").alias("witness_id", "c"))
    return cells.select("collation_id", "row_id", "witness_id", "c.start", "c.end", "c.incr", "c.text")


def witness_rows(cells: DataFrame) -> DataFrame:
    """collation_id, witness_id, cells: the matrix transposed, each witness's cells in row order."""
    rows = cells.groupBy("collation_id", "witness_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "start", "end", "incr", "text"))).alias("cells"))
    return rows
