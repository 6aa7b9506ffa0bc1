"""Annotated segments: interval scans, and confidences of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.shipping import ship


def segment(text, start, end):
    """[start, end) of a base layer."""
    return F.substring(text, start + 1, end - start)


def scan_layer(annotations: DataFrame, segments: DataFrame, key: str = "witness_id") -> DataFrame:
    """Annotations(key, start, end, confidence, ord) that touch the segment(key, seg_start, seg_end), ends included.

    Of those with one start the last by ord stays.
    """
    met = annotations.join(segments, key).where((F.col("end") >= F.col("seg_start")) & (F.col("start") <= F.col("seg_end")))
    last = met.groupBy(key, "seg_start", "seg_end", "start").agg(F.max_by(F.struct("end", "confidence"), "ord").alias("x"))
    return last.select(key, "seg_start", "seg_end", "start", "x.end", "x.confidence")


def _least(starts: np.ndarray, ends: np.ndarray, at: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each span the least c with start < at <= end, 100 if none; at is sorted.  Linear where spans do not overlap."""
    first, last = (np.searchsorted(at, x, side="right") for x in (starts, ends))
    out = np.full(len(starts), 100, np.int32)
    some = last > first
    if some.any():
        edges = np.stack([first[some], last[some]], 1).reshape(-1)
        out[some] = np.minimum.reduceat(np.r_[c, 100], edges)[::2]
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def least_confidence(starts: pa.Array, ends: pa.Array, marks: pa.Array) -> pa.Array:
    """confidence_min() of texts that have their spans, arrays of starts and ends, and marks(at, c) beside them; nothing is moved."""
    out = [np.zeros(0, np.int32)]
    for s, e, m in zip(starts, ends, marks, strict=True):
        at, c = (m.values.field(i).to_numpy() for i in (0, 1))
        order = np.argsort(at, kind="stable")
        out.append(_least(s.values.to_numpy(), e.values.to_numpy(), at[order], c[order]))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in out]), pa.int32()), pa.array(np.concatenate(out)))


def _met(keys: int):
    """Rows by text, its marks in order before its cells, in; the row of each cell and the least confidence out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.r_[True, np.zeros(batch.num_rows - 1, bool)]
            for k in batch.columns[:keys]:
                new[1:] |= pc.fill_null(pc.not_equal(k[1:], k[:-1]), True).to_numpy(zero_copy_only=False)
            kind, start, end, c = (pc.fill_null(batch.column(keys + i), 0).to_numpy(zero_copy_only=False) for i in range(4))
            least = np.full(batch.num_rows, 100, np.int32)
            edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                own = [k[a].as_py() for k in batch.columns[:keys]]
                if own != text or None in own:
                    text, held = own, []
                m = a + int(np.searchsorted(kind[a:z], 1))
                if m > a:
                    held.append((end[a:m], c[a:m]))
                if z > m and held:
                    held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    least[m:z] = _least(start[m:z], end[m:z], *held[0])
            cells = pa.array(kind == 1)
            yield pa.RecordBatch.from_arrays([batch.column(keys + 4).filter(cells), pa.array(least).filter(cells)], ["_row", "_least"])

    return run


def confidence_min(cells: DataFrame, annotations: DataFrame, keys: tuple[str, ...] = ("collation_id", "witness_id"), gap: int | None = None) -> DataFrame:
    """cells with a column confidence: the least int(100 c) of annotations with start < annotation.start <= end; 100 if none.

    Cells and annotations are dealt by text (keys) once, and go by in one order: a text's annotations are held, and its cells
    find theirs by binary search.  gap: the confidence of a cell without text.
    """
    ship(cells.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in cells.columns)).alias("_row")
    own = cells.select(*keys, F.lit(1).alias("_kind"), F.col("start").cast("long").alias("_start"), F.col("end").cast("long").alias("_end"), F.lit(None).cast("int").alias("_c"), row)
    at = F.col("start").cast("long")
    marks = annotations.dropna(subset=[*keys, "start", "confidence"]).select(
        *keys, F.lit(0).alias("_kind"), at.alias("_start"), at.alias("_end"), F.floor(F.col("confidence") * 100).cast("int").alias("_c"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row")
    )
    both = own.unionByName(marks).repartition(*keys).sortWithinPartitions(*keys, "_kind", "_end")
    found = both.mapInArrow(_met(len(keys)), T.StructType([own.schema["_row"], T.StructField("_least", T.IntegerType())]))
    return found.select("_row.*", F.when(F.col("_row.text").isNull(), F.lit(gap).cast("int")).otherwise(F.col("_least")).alias("confidence"))


def confidence_layer(voted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two output tables of voted(collation_id, row_id, voted, confidence, page): base texts, and annotation spans.

    Voted readings are put together, pages end in two line ends; spans of confidence and of pages come as kind, start,
    end, confidence, reference.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("collation_id").orderBy("row_id")
    rows = voted.withColumn("ends", F.col("page").isNotNull() & ~F.col("page").eqNullSafe(F.lead("page").over(order)))
    rows = rows.withColumn("piece", F.concat(F.coalesce("voted", F.lit("")), F.when(F.col("ends"), "\n\n").otherwise("")))
    upto = F.sum(F.length("piece")).over(order)
    rows = rows.withColumn("start", (upto - F.length("piece")).cast("int")).withColumn("end", (F.col("start") + F.length(F.coalesce("voted", F.lit("")))).cast("int"))
    base = rows.groupBy("collation_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "piece"))).alias("r"))
    base = base.select("collation_id", F.array_join(F.transform("r", lambda x: x["piece"]), "").alias("base"))
    spans = rows.where(F.col("confidence").isNotNull() & (F.col("voted") != "")).select("collation_id", F.lit("ocr_confidence").alias("kind"), "start", "end", (F.col("confidence") / 100).alias("confidence"), F.lit(None).cast("string").alias("reference"))
    pages = rows.where("page is not null").groupBy("collation_id", "page").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    pages = pages.select("collation_id", F.lit("pagination").alias("kind"), "start", "end", F.lit(None).cast("double").alias("confidence"), F.col("page").cast("string").alias("reference"))
    return base, spans.unionByName(pages)
