"""Rows of collations that come in order: numbered, and put together, as they go by.

Where a collation's rows come of one row of the collation (align() in tasks, position_rows()), they follow each other in one
task, by row_id; sums over them and texts of them need no sort then and move nothing.  ordered=False, everywhere, is for rows
in any order: these are dealt by collation and sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.shipping import ship


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of any order as they are wanted here."""
    return rows.repartition("collation_id").sortWithinPartitions("collation_id", "row_id")


def starts(keys: pa.Array) -> np.ndarray:
    """The places where another key begins, 0 included."""
    if len(keys) < 2:
        return np.arange(len(keys))
    return np.r_[0, np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1]


def _running(names: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carried = None, [0] * n
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            at = starts(keys)
            lengths = np.diff(np.r_[at, batch.num_rows])
            sums = []
            for k in range(n):
                upto = np.cumsum(batch.column(batch.num_columns - n + k).to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.r_[0, upto][at]
                if keys[0].as_py() == key:
                    before[0] -= carried[k]
                upto -= np.repeat(before, lengths)
                carried[k] = int(upto[-1])
                sums.append(pa.array(upto, pa.int32()))
            key = keys[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - n], *sums], names)

    return run


def running(rows: DataFrame, sums: dict[str, Column], ordered: bool = False) -> DataFrame:
    """rows with running sums (int) of numbers over the rows of their collation, in order, their own included."""
    if not ordered:
        upto = Window.partitionBy("collation_id").orderBy("row_id")
        return rows.withColumns({name: F.sum(x).over(upto).cast("int") for name, x in sums.items()})
    ship(rows.sparkSession)
    found = rows.select("collation_id", *(F.col(c) for c in rows.columns if c != "collation_id"), *(x.cast("int").alias(name) for name, x in sums.items()))
    return found.mapInArrow(_running(found.columns, len(sums)), T.StructType(found.schema.fields))


def _joined(names: list[str], counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [[] for _ in names[1:]], 0

        def told(keys: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, *(pa.array(["".join(x)], pa.string()) for x in held)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, columns = batch.column(0), batch.columns[1:]
            at = starts(keys)
            goes_on = key is not None and keys[0].as_py() == key[0].as_py()
            if counted:
                flags = columns.pop(0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(flags)
                first = (upto - flags)[at]
                first[0] -= n if goes_on else 0
                upto -= np.repeat(first, np.diff(np.r_[at, batch.num_rows]))
                n = int(upto[-1])
                # a piece and, where a row is counted, its number and what follows
                numbers = pa.array(upto, mask=flags == 0).cast(pa.string())
                columns = [pc.coalesce(pc.binary_join_element_wise(a, numbers, z, ""), a) for a, z in zip(columns[::2], columns[1::2], strict=True)]
            offsets = pa.array(np.r_[at, batch.num_rows], pa.int32())
            pieces = [pc.binary_join(pa.ListArray.from_arrays(offsets, x), "").to_pylist() for x in columns]
            for i, a in enumerate(at.tolist()):
                if key is not None and not (goes_on and i == 0):
                    yield told(key)
                    held = [[] for _ in held]
                key = keys[a : a + 1]
                for own, more in zip(held, pieces, strict=True):
                    own.append(more[i])
        if key is not None:
            yield told(key)

    return run


def joined(rows: DataFrame, pieces: dict[str, Column], ordered: bool = False) -> DataFrame:
    """collation_id and, by name, the texts that a collation's pieces make in order of its rows; a piece is not null."""
    return _texts(rows, list(pieces), list(pieces.values()), False, ordered)


def numbered(rows: DataFrame, counts: Column, pieces: dict[str, tuple[Column, Column]], ordered: bool = False) -> DataFrame:
    """As joined(); where counts is true, the first of a row's two pieces is followed by the row's number among such and by the second.

    Elsewhere the second is null.
    """
    return _texts(rows, list(pieces), [F.coalesce(counts, F.lit(False)).cast("int"), *(x for both in pieces.values() for x in both)], True, ordered)


def _texts(rows: DataFrame, names: list[str], columns: list[Column], counted: bool, ordered: bool) -> DataFrame:
    ship(rows.sparkSession)
    if ordered:
        parts = rows.select("collation_id", *(x.alias(f"_{i}") for i, x in enumerate(columns)))
    else:
        parts = in_order(rows.select("collation_id", "row_id", *(x.alias(f"_{i}") for i, x in enumerate(columns)))).drop("row_id")
    kind = T.StructType([parts.schema["collation_id"], *(T.StructField(name, T.StringType()) for name in names)])
    return parts.mapInArrow(_joined(kind.names, counted), kind)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """collation_id, golden, of batches of collation_id, base, cut (of a note's mark or null), stones."""
    key, parts, puts, stones, size = None, [], [], [], 0

    def told(keys: pa.Array) -> pa.RecordBatch:
        text, out, at = "".join(parts), [], 0
        # at one place marks come before milestones, in order of rows; milestones by place and tag
        own = sorted([(a, 0, n, f"[^{n}]") for n, a in enumerate(puts, 1)] + [(s["offset"], 1, s["offset"], s["tag"]) for s in stones])
        for a, _, _, put in own:
            out += [text[at : max(a, at)], put]
            at = min(max(a, at), len(text))
        return pa.RecordBatch.from_arrays([keys, pa.array(["".join([*out, text[at:]])], pa.string())], ["collation_id", "golden"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, base, cuts, own = batch.columns
        at = starts(keys)
        ends = np.r_[at[1:], batch.num_rows]
        upto = np.r_[0, np.cumsum(pc.utf8_length(base).to_numpy(zero_copy_only=False).astype(np.int64))]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, batch.num_rows], pa.int32()), base), "").to_pylist()
        noted = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
        places = upto[noted] + cuts.take(pa.array(noted)).to_numpy(zero_copy_only=False)
        first, last = np.searchsorted(noted, at), np.searchsorted(noted, ends)
        stony = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
        for i, (a, z, x, y) in enumerate(zip(at.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True)):
            if key is None or i or keys[a].as_py() != key[0].as_py():
                if key is not None:
                    yield told(key)
                key, parts, puts, stones, size = keys[a : a + 1], [], [], [], 0
            puts += (places[x:y] + (size - upto[a])).tolist()
            for j in stony[np.searchsorted(stony, a) : np.searchsorted(stony, z)].tolist():
                stones += own[j].as_py()
            parts.append(texts[i])
            size += int(upto[z] - upto[a])
    if key is not None:
        yield told(key)


def marked(rows: DataFrame) -> DataFrame:
    """collation_id, golden: the bases of ordered rows with numbered marks at a place of their own base (null: none), and the collation's milestones.

    rows: collation_id, row_id, base, cut, stones (offset, tag; of any of a collation's rows, null elsewhere).
    """
    ship(rows.sparkSession)
    found = rows.select("collation_id", "base", "cut", "stones")
    return found.mapInArrow(_marked, T.StructType([found.schema["collation_id"], T.StructField("golden", T.StringType())]))
