"""Layers of annotations of the witnesses, looked up by reference and projected onto the text that was voted from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.ordered import starts
from palimpsest.shipping import ship

_TEXT = ("collation_id", "witness_id")


def of_reference(annotations: DataFrame, references: DataFrame, base: str = "witness_id") -> DataFrame:
    """The first annotation, by start and end, of each of references(base, reference) in its base; those without one are left out."""
    met = annotations.where("reference is not null").join(references.select(base, "reference").distinct(), [base, "reference"])
    first = F.min(F.struct("start", "end", *(c for c in annotations.columns if c not in (base, "reference", "start", "end")))).alias("a")
    return met.groupBy(base, "reference").agg(first).select(base, "reference", "a.*")


def comparable_bases(bases: DataFrame, others: DataFrame) -> DataFrame:
    """edition, base_id, other, other_base: bases(edition, base_id) with the bases of others(edition, base_id) that have the same id."""
    theirs = others.select(F.col("edition").alias("other"), F.col("base_id").alias("other_base"))
    return bases.select("edition", "base_id").join(theirs, (F.col("base_id") == F.col("other_base")) & (F.col("edition") != F.col("other")))


def project(annotations: DataFrame, cells: DataFrame, voted: DataFrame) -> DataFrame:
    """annotations(collation_id, witness_id, start, end, any others) with start and end in the voted text.

    cells: collation_id, row_id, witness_id, start, text (long, gaps null or empty); voted: collation_id, row_id, voted.  A span
    reaches from the begin of the row of its first character to the end of that of its last; an empty span has the row
    of the character after it.  Cells and ends of spans go by in one order, and an end takes the last cell that begins at its
    place or before: time is that of sorting both.  Spans of a witness without cells are left out.
    """
    order = Window.partitionBy("collation_id").orderBy("row_id")
    end = F.sum(F.length(F.coalesce("voted", F.lit("")))).over(order)
    rows = voted.select("collation_id", "row_id", (end - F.length(F.coalesce("voted", F.lit("")))).cast("int").alias("_start"), end.cast("int").alias("_end"))
    held = cells.where(F.coalesce("text", F.lit("")) != "").select(*_TEXT, "row_id", "start").join(rows, ["collation_id", "row_id"])
    spans = annotations.withColumn("_span", F.struct(*annotations.columns)).select(*_TEXT, "_span")
    kind = spans.schema["_span"].dataType
    starts = held.select(*_TEXT, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct("_start", "_end").alias("_row"), F.lit(None).cast(kind).alias("_span"))
    none = F.lit(None).cast(starts.schema["_row"].dataType)
    edges = [
        spans.select(*_TEXT, place.cast("int").alias("_at"), F.lit(side).alias("_kind"), none.alias("_row"), "_span")
        for side, place in ((1, F.col("_span.start")), (2, F.greatest(F.col("_span.end") - 1, F.col("_span.start"))))
    ]
    both = starts.unionByName(edges[0]).unionByName(edges[1])
    upto = Window.partitionBy(*_TEXT).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_met", F.last("_row", ignorenulls=True).over(upto)).where("_kind > 0 and _met is not null")
    # both edges of a span meet again; equal spans are told apart by their count, and stay as many
    edge = met.groupBy(*_TEXT, "_span").agg(F.min("_met._start").alias("s"), F.max("_met._end").alias("e"), F.count_if(F.col("_kind") == 1).cast("int").alias("n"))
    told = edge.select("_span", "s", "e", F.explode(F.sequence(F.lit(1), "n")))
    return told.select(*(F.col({"start": "s", "end": "e"}[c]).alias(c) if c in ("start", "end") else F.col("_span").getField(c).alias(c) for c in annotations.columns))


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """collation_id and the fields of spans, of batches of collation_id, voted and sizes (lengths), spans, by row in order."""
    key, voted, sizes, spans = None, [], [], []

    def told() -> pa.RecordBatch:
        own = pa.concat_arrays(spans)
        names = [f.name for f in own.type.fields]
        columns = dict(zip(names, own.flatten(), strict=True))
        witness, begin, end = (columns[c].to_numpy(zero_copy_only=False) for c in ("witness_id", "start", "end"))
        upto = np.cumsum(np.concatenate(voted).astype(np.int64))
        after = np.r_[0, upto]
        lengths = np.concatenate(sizes).astype(np.int64).reshape(len(upto), -1)
        s, e = np.full(len(own), -1, np.int64), np.full(len(own), -1, np.int64)
        for w in np.unique(witness[(witness >= 0) & (witness < lengths.shape[1])]).tolist():
            rows = np.flatnonzero(lengths[:, w])
            at = np.cumsum(lengths[rows, w]) - lengths[rows, w]
            mine = np.flatnonzero((witness == w) & (begin >= 0) & (len(rows) > 0))
            # the row of the last cell that begins at a span's edge or before
            if len(mine):
                first, last = (rows[np.searchsorted(at, x, side="right") - 1] for x in (begin[mine], np.maximum(end[mine] - 1, begin[mine])))
                s[mine], e[mine] = after[first], upto[last]
        columns["start"], columns["end"] = pa.array(s, pa.int32()), pa.array(e, pa.int32())
        keys = key.take(pa.array(np.zeros(len(own), np.int64)))
        return pa.RecordBatch.from_arrays([keys, *columns.values()], ["collation_id", *names]).filter(pa.array(s >= 0))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, edges = batch.column(0), starts(batch.column(0))
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
            if key is None or keys[a].as_py() != key[0].as_py():
                if key is not None:
                    yield told()
                key, voted, sizes, spans = keys[a : a + 1], [], [], []
            voted.append(batch.column(1)[a:z].to_numpy(zero_copy_only=False))
            sizes.append(batch.column(2)[a:z].flatten().to_numpy(zero_copy_only=False))
            spans.append(batch.column(3)[a:z].flatten())
    if key is not None:
        yield told()


def project_ordered(rows: DataFrame) -> DataFrame:
    """As project(), of rows of whole collations in order (operators.ordered): nothing is dealt or sorted.

    rows: collation_id, voted, cells (with text, a cell a witness), spans (witness_id, start, end, any others; an array in any
    of a collation's rows, null elsewhere).  collation_id and the spans' fields come back.
    """
    ship(rows.sparkSession)
    sizes = F.transform("cells", lambda c: F.length(F.coalesce(c["text"], F.lit(""))))
    found = rows.select("collation_id", F.length(F.coalesce("voted", F.lit(""))).alias("voted"), sizes.alias("sizes"), "spans")
    spans = found.schema["spans"].dataType.elementType
    kinds = [T.StructField(f.name, T.IntegerType() if f.name in ("start", "end") else f.dataType) for f in spans.fields]
    return found.mapInArrow(_projected, T.StructType([found.schema["collation_id"], *kinds]))
