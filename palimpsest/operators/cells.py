"""What cells of a row say together, told for a batch of rows at once: columns over cells, arrays of structs, by witness."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

_WEIGHED = pa.struct([("witness_id", pa.int32()), ("text", pa.string()), ("weight", pa.int32())])
_GROUP = pa.struct([("reading", pa.string()), ("codes", pa.list_(pa.string()))])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many cells each row has, the row of each cell, and the cells; rows are not null."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _field(cells: pa.StructArray, name: str) -> pa.Array:
    """A field of structs, null where they are."""
    return pc.struct_field(cells, name)


def _texts(cells: pa.StructArray) -> pa.Array:
    return pc.fill_null(_field(cells, "text"), "")


def _codes(rows: np.ndarray, texts: pa.Array) -> np.ndarray:
    """A number a cell: cells have equal ones if they are of one row and have the same text."""
    found = texts.dictionary_encode()
    return rows * max(1, len(found.dictionary)) + found.indices.to_numpy(zero_copy_only=False)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())


def counted(lists: pa.Array) -> pa.Array:
    """cells (witness_id, text, weight) of cells with text: percent of the row's cells that have this text, rounded down; a gap is an empty text."""
    sizes, rows, cells = _flat(lists)
    _, at, same = np.unique(_codes(rows, _texts(cells)), return_inverse=True, return_counts=True)
    weight = np.floor(same[at].astype(np.float64) / sizes[rows] * 100)
    first = np.cumsum(sizes) - sizes
    own = [pa.array(np.arange(len(rows)) - first[rows], pa.int32()), _field(cells, "text"), pa.array(weight.astype(np.int32))]
    return pa.ListArray.from_arrays(_offsets(sizes), pa.StructArray.from_arrays(own, fields=_WEIGHED.fields))


@F.arrow_udf(from_arrow_type(pa.list_(_WEIGHED)))
def by_count(lists: pa.Array) -> pa.Array:
    """As counted()."""
    return counted(lists)


def _winner(sizes: np.ndarray, rows: np.ndarray, cells: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The winning cell of each row (-1: none): the greatest weight, the least witness at a tie; all weights and witnesses."""
    weights = pc.fill_null(_field(cells, "weight"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    witnesses = _field(cells, "witness_id").to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((witnesses, -weights, rows))
    best = np.full(len(sizes), -1, np.int64)
    best[sizes > 0] = order[(np.cumsum(sizes) - sizes)[sizes > 0]]
    return best, weights, witnesses


@F.arrow_udf(from_arrow_type(pa.struct([("top", pa.int32()), ("text", pa.string())])))
def best(lists: pa.Array) -> pa.Array:
    """The winner of weighed cells and its text: the greatest weight, the least witness at a tie."""
    sizes, rows, cells = _flat(lists)
    at, _, witnesses = _winner(sizes, rows, cells)
    put = pa.array(at, mask=at < 0)
    return pa.StructArray.from_arrays([pa.array(witnesses, pa.int32()).take(put), _texts(cells).take(put)], ["top", "text"])


def votes(lists: pa.Array, codes: pa.Array | None) -> pa.Array:
    """voted, differs, groups, as voted() and voted_by() have them."""
    sizes, rows, cells = _flat(lists)
    texts = _texts(cells)
    at, _, witnesses = _winner(sizes, rows, cells)
    _, first, of = np.unique(_codes(rows, texts), return_index=True, return_inverse=True)
    differs = np.bincount(rows[first], minlength=len(sizes)) > 1
    if codes is None:
        names = pc.binary_join_element_wise("V", pa.array(witnesses + 1).cast(pa.string()), "")
        shown = differs[rows]
    else:
        names = codes.flatten()
        shown = differs[rows] & names.is_valid().to_numpy(zero_copy_only=False)
    # the readings of shown cells in order of their first shown one, and the codes of each
    seen = np.flatnonzero(shown)
    _, lead, group, many = np.unique(of[seen], return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(lead)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    held = seen[np.argsort(rank[group], kind="stable")]
    leads = seen[lead[order]]
    lists_ = pa.ListArray.from_arrays(_offsets(many[order]), names.take(pa.array(held)))
    groups = pa.StructArray.from_arrays([texts.take(pa.array(leads)), lists_], fields=_GROUP.fields)
    counts = np.bincount(rows[leads], minlength=len(sizes))
    ends = np.r_[0, np.cumsum(counts)]
    each = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.r_[~differs, False]), groups)
    return pa.StructArray.from_arrays([texts.take(pa.array(at, mask=at < 0)), pa.array(differs), each], ["voted", "differs", "groups"])


VOTED = pa.struct([("voted", pa.string()), ("differs", pa.bool_()), ("groups", pa.list_(_GROUP))])
_VOTED = from_arrow_type(VOTED)


@F.arrow_udf(_VOTED)
def voted(lists: pa.Array) -> pa.Array:
    """The vote of weighed cells, if their texts differ, and then their readings in order of first witness with the witnesses V1, V2, ... that have each."""
    return votes(lists, None)


@F.arrow_udf(_VOTED)
def voted_by(lists: pa.Array, codes: pa.Array) -> pa.Array:
    """As voted(), with the codes of the cells; a cell without one is not shown."""
    return votes(lists, codes)
