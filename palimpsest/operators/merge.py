"""Merging of consecutive differing rows.

Rows are scanned with the last output row in mind: a row joins it if both differ, or if the row has a gap; else it
starts a new one.  A row whose cells are all there and equal always starts a new row and forgets what was before, so
the rows of a collation fall into islands that begin at such rows; islands are numbered by a running count and folded
independently: short ones by an expression, which joins texts row by row; long ones in Arrow batches, in time linear in
their text.  There a step composes what it needs to know of the joined texts, their lengths and hashes, and the texts are
put together once at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.shipping import ship

#: Islands of more rows are folded in Arrow batches.
SHORT = 48
_PRIME = (1 << 61) - 1

_CELLS = "array<struct<start:int,end:int,incr:int,text:string>>"


def differs(cells: Column) -> Column:
    """Not all cells have the same text; a gap counts as an empty one."""
    return F.size(F.array_distinct(F.transform(cells, lambda c: F.coalesce(c["text"], F.lit(""))))) > 1


def complete_equal(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: c.isNull()) & ~differs(cells)


def islands(wide: DataFrame) -> DataFrame:
    """wide with a column island: how many complete equal rows there are up to each."""
    order = Window.partitionBy("collation_id").orderBy("row_id")
    return wide.withColumn("island", F.sum(complete_equal(F.col("cells")).cast("int")).over(order))


def fold(rows: Column) -> Column:
    """The output rows of one island's rows (array of arrays of cells) in order; no gap survives.

    A step copies what is done only where a new row starts, which within an island is rare.
    """
    empty = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(1).alias("incr"), F.lit("").alias("text"))
    start = F.struct(F.expr(f"cast(array() as array<{_CELLS}>)").alias("done"), F.expr(f"cast(null as {_CELLS})").alias("last"))

    def joined(p: Column, c: Column) -> Column:
        more = F.struct(p["start"].alias("start"), c["end"].alias("end"), c["incr"].alias("incr"), F.concat(p["text"], c["text"]).alias("text"))
        return F.when(c.isNull(), p).otherwise(more)

    def finished(s: Column) -> Column:
        return F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"])))

    def step(s: Column, row: Column) -> Column:
        joins = s["last"].isNotNull() & (F.exists(row, lambda c: c.isNull()) | differs(s["last"]) & differs(row))
        merged = F.struct(s["done"].alias("done"), F.zip_with(s["last"], row, joined).alias("last"))
        fresh = F.struct(finished(s).alias("done"), F.transform(row, lambda c: F.coalesce(c, empty)).alias("last"))
        return F.when(joins, merged).otherwise(fresh)

    return F.aggregate(rows, start, step, finished)


class _Joined:
    """The cells of an output row while rows join it: parts of each text, and a length and hash that tell if texts are equal."""

    def __init__(self, row: list[dict | None]) -> None:
        self.spans = [[c["start"], c["end"], c["incr"]] if c else [0, 0, 1] for c in row]
        self.parts = [[c["text"] or ""] if c else [""] for c in row]
        self.prints = [self._print(p[0]) for p in self.parts]

    @staticmethod
    def _print(text: str) -> tuple[int, int]:
        # a text is a number of its bytes modulo a prime: that of two texts joined follows from theirs
        own = text.encode()
        return len(own), int.from_bytes(own, "big") % _PRIME

    def differs(self) -> bool:
        return any(x != self.prints[0] for x in self.prints)

    def join(self, row: list[dict | None]) -> None:
        for i, cell in enumerate(row):
            if cell:
                text = cell["text"] or ""
                size, value = self._print(text)
                self.spans[i][1:] = [cell["end"], cell["incr"]]
                self.parts[i].append(text)
                n, h = self.prints[i]
                self.prints[i] = n + size, (h * pow(256, size, _PRIME) + value) % _PRIME

    def cells(self) -> list[dict]:
        return [{"start": s, "end": e, "incr": k, "text": "".join(p)} for (s, e, k), p in zip(self.spans, self.parts, strict=True)]


def folded(rows: list[list[dict | None]]) -> list[list[dict]]:
    """As fold(), of one island's rows, in time linear in their text."""
    out: list[_Joined] = []
    for row in rows:
        texts = {(c["text"] or "") if c else "" for c in row}
        if out and (any(c is None for c in row) or len(texts) > 1 and out[-1].differs()):
            out[-1].join(row)
        else:
            out.append(_Joined(row))
    return [x.cells() for x in out]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows = pa.array([folded(batch.column(2)[i].as_py())], batch.schema.field(2).type)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), rows], batch.schema.names)


def merge_rows(wide: DataFrame, short: int = SHORT) -> DataFrame:
    """collation_id, row_id, cells: the merged matrix, rows numbered anew from 0; every cell is there."""
    ship(wide.sparkSession)
    grouped = islands(wide).groupBy("collation_id", "island").agg(F.array_sort(F.collect_list(F.struct("row_id", "cells"))).alias("r"))
    rows = grouped.withColumn("rows", F.transform("r", lambda x: x["cells"]))
    # most islands are a single complete row: those need no fold
    alone = (F.size("rows") == 1) & complete_equal(F.get("rows", F.lit(0)))
    rows = rows.select("collation_id", "island", "rows", alone.alias("alone"))
    whole = rows.where(F.size("rows") <= short).select("collation_id", "island", F.when(F.col("alone"), F.col("rows")).otherwise(fold(F.col("rows"))).alias("rows"))
    long = rows.where(F.size("rows") > short).select("collation_id", "island", "rows")
    rows = whole.unionByName(long.mapInArrow(_folded, long.schema)).select("collation_id", "island", F.posexplode("rows").alias("at", "cells"))
    number = F.row_number().over(Window.partitionBy("collation_id").orderBy("island", "at")) - 1
    return rows.select("collation_id", number.cast("int").alias("row_id"), "cells")
