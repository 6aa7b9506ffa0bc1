"""Weights of cells, their combination, and the vote."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.valid_syllable import valid_weight
from palimpsest.operators import cells
from palimpsest.shipping import ship

ROW = ("collation_id", "row_id")


@dataclass(frozen=True)
class Weigher:
    """weight: 0 to 100 or null, over a cell's columns.  share: its part in the mean.  relative: it scales the others."""

    weight: Column
    share: int = 1
    relative: bool = False


def count_weight() -> Column:
    """Percent of the row's cells that have this text, rounded down; a gap is an empty text.  Over long cells."""
    row = Window.partitionBy(*ROW)
    same = Window.partitionBy(*ROW, F.coalesce("text", F.lit("")))
    share = F.count(F.lit(1)).over(same).cast("double") / F.count(F.lit(1)).over(row)
    return F.floor(share * 100).cast("int")


def syllable_weight(invalid: int = 70, nontibetan: int | None = None, gap: int | None = None) -> Column:
    return F.when(F.col("text").isNull(), F.lit(gap).cast("int")).otherwise(valid_weight(F.col("text"), invalid, nontibetan))


def _mean(weighers: list[Weigher]) -> Column:
    total = sum((F.coalesce(w.weight, F.lit(0)) * w.share for w in weighers), F.lit(0))
    shares = sum((F.when(w.weight.isNotNull(), w.share).otherwise(0) for w in weighers), F.lit(0))
    return F.when(shares > 0, F.floor(total / shares).cast("int"))


def combined(weighers: list[Weigher]) -> Column:
    """One weigher: its weight.  More: the mean of the absolute ones, scaled by the mean of the relative ones in percent.

    Null where no absolute weigher has a weight; relative weights that sum to 0 scale nothing.
    """
    if len(weighers) == 1:
        return weighers[0].weight
    absolute, relative = _mean([w for w in weighers if not w.relative]), _mean([w for w in weighers if w.relative])
    some = sum((F.coalesce(w.weight, F.lit(0)) * w.share for w in weighers if w.relative), F.lit(0)) > 0
    return F.when(some & absolute.isNotNull(), F.floor(absolute * relative / 100).cast("int")).otherwise(absolute)


def weigh(long: DataFrame, weighers: list[Weigher], skip_identical_rows: bool = False) -> DataFrame:
    """Long cells with a column weight; null where nothing applies."""
    names = [f"_w{i}" for i in range(len(weighers))]
    rows = long.withColumns({n: w.weight for n, w in zip(names, weighers, strict=True)})
    weight = combined([Weigher(F.col(n), w.share, w.relative) for n, w in zip(names, weighers, strict=True)])
    if skip_identical_rows:
        row = Window.partitionBy(*ROW)
        same = (F.count("text").over(row) == F.count(F.lit(1)).over(row)) & (F.min("text").over(row) == F.max("text").over(row))
        weight = F.when(~same, weight)
    return rows.withColumn("weight", weight).drop(*names)


def weigh_rows(wide: DataFrame, *keep: str) -> DataFrame:
    """collation_id, row_id, columns to keep, cells (witness_id, text, weight) of wide rows (cells with text): weighed by count_weight(), within the row."""
    ship(wide.sparkSession)
    return wide.select(*ROW, *keep, cells.by_count(F.transform("cells", lambda c: F.struct(c["text"].alias("text")))).alias("cells"))


def weighed_cells(weighted: DataFrame) -> DataFrame:
    """collation_id, row_id, cells (witness_id, text, weight) by witness: of long weighted cells, or of such rows themselves."""
    if "cells" in weighted.columns:
        return weighted
    return weighted.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("witness_id", "text", "weight"))).alias("cells"))


def vote(weighted: DataFrame, *keep: str) -> DataFrame:
    """collation_id, row_id, columns to keep (of weighed rows), top (witness), voted, of long cells or weighed rows: the greatest weight, the least witness at a tie."""
    ship(weighted.sparkSession)
    rows = weighed_cells(weighted)
    return rows.select(*ROW, *keep, cells.best("cells").alias("b")).select(*ROW, *keep, F.col("b.top").alias("top"), F.col("b.text").alias("voted"))
