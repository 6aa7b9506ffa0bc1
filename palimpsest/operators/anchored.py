"""Alignment of long pairs over many tasks: unique runs of tokens as anchors, the stretches between them as rows.

Of a text and its base alone (segments(), by which align() puts such pairs together), anchors are told where the pair is, over
numbers, and stretches become rows of cells with no further move.  Of more texts (place_long()):

1. Runs of k tokens are rows; one that each text of a pair has once is an anchor.
2. The longest chain of anchors that ascend in both texts is found over numbers alone (thinned by their hashes to some
   THIN a pair, so memory is bounded).
3. The pair is cut where a chain's anchor begins, every STRETCH tokens or more; each stretch is a row, dealt to any task.
4. A stretch still too long is cut again, by shorter runs: what is unique in it need not be so in the pair.

Every stretch but the first begins with equal tokens, so its script is independent of its neighbours', and cells keep their
places by the stretch's first token and character.  Scripts are minimal within stretches.  What no anchor cuts (a text of
few distinct tokens) is one stretch, and takes the memory and time that a pair does in operators.diff.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from palimpsest.operators import held
from palimpsest.operators.diff import CELL_NAMES, cell_lists, placed_cells
from palimpsest.shipping import ship
from palimpsest.tables import discard, written

RUNS = (12, 4)
STRETCH = 2000
THIN = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAIR = ("collation_id", "witness_id", "stretch")


def runs(norms: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (of tokens whose norm is not empty) and signed hashes of all runs of k such tokens."""
    at = np.array([i for i, x in enumerate(norms) if x != ""], np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(norms[i].encode(), 3) for i in at), np.uint64, len(at))
    n = len(h) - k + 1
    if n <= 0:
        return at[:0], np.zeros(0, np.int64)
    sums = np.full(n, k, np.uint64)
    for j in range(k):
        sums = (sums ^ h[j : j + n]) * _ODD
        sums ^= sums >> np.uint64(31)
    return at[:n], sums.view(np.int64)


def _anchors(k: int):
    """A row a run: pair, side (0: base), place, hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for side in (0, 1):
                    at, h = runs(batch.column(3 + side)[i].as_py(), k)
                    for j in range(0, len(h), 100_000):
                        n = len(h[j : j + 100_000])
                        same = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(n, np.int64))) for c in range(3)]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(n, side, np.int32)), pa.array(at[j : j + n].astype(np.int32)), pa.array(h[j : j + n])], [*_PAIR, "side", "at", "h"])

    return run


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the points (a ascending) make the longest chain that ascends in b too."""
    ends: list[int] = []
    last: list[int] = []
    before = np.full(len(b), -1, np.int64)
    for i, x in enumerate(b.tolist()):
        k = bisect_left(ends, x)
        before[i] = last[k - 1] if k else -1
        if k == len(ends):
            ends.append(x)
            last.append(i)
        else:
            ends[k], last[k] = x, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = int(before[i])
    return np.array(out[::-1], np.int64)


def cuts(a: np.ndarray, b: np.ndarray, stretch: int) -> list[tuple[int, int]]:
    """Chained anchors, each `stretch` tokens or more of either text after the one before."""
    out: list[tuple[int, int]] = []
    i = j = 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if max(x - i, y - j) >= stretch and x > i and y > j:
            out.append((x, y))
            i, j = x, y
    return out


def _once(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that occur once, in order, and their places."""
    found, first, many = np.unique(h, return_index=True, return_counts=True)
    return found[many == 1], first[many == 1]


def _mixed(codes: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(codes) - k + 1)
    sums = np.full(n, k, np.uint64)
    for j in range(k):
        sums = (sums ^ (codes[j : j + n].astype(np.uint64) * _ODD)) * _ODD
        sums ^= sums >> np.uint64(31)
    return sums


def shared_runs(a: np.ndarray, b: np.ndarray, live: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b, both ascending, of the longest chain of runs of k tokens that each has once; live: of each number, is it a token with a norm?

    A run begins with two tokens that have a norm, so that its first cell is its first token.
    """
    (h, x), (g, y) = _once(_mixed(a, k)), _once(_mixed(b, k))
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    x, y = x[i], y[j]
    kept = (a[x] == b[y]) & (a[x + 1] == b[y + 1]) & live[a[x]] & live[a[x + 1]]
    order = np.argsort(x[kept])
    x, y = x[kept][order], y[kept][order]
    if not (np.diff(y) > 0).all():
        some = chain(x, y)
        x, y = x[some], y[some]
    return x, y


def segment_cuts(a: np.ndarray, b: np.ndarray, live: np.ndarray, run_lengths: tuple[int, ...] = RUNS, stretch: int = STRETCH) -> list[tuple[int, int]]:
    """Where a pair of texts, as numbers of their tokens, is cut: every `stretch` tokens or more, at equal tokens."""
    if not run_lengths or max(len(a), len(b)) <= 2 * stretch:
        return []
    marks = cuts(*shared_runs(a, b, live, run_lengths[0]), stretch)
    out = []
    for (x, y), (p, q) in zip([(0, 0), *marks], [*marks, (len(a), len(b))], strict=True):
        # what is unique in a stretch need not be so in the pair
        out += [(x, y)] + [(x + i, y + j) for i, j in segment_cuts(a[x:p], b[y:q], live, run_lengths[1:], stretch)]
    return out[1:]


def _segmented(names: list[str], run_lengths: tuple[int, ...], stretch: int):
    """collation_id, segment, of, tokens, words, norms, chars, of batches of collation_id, of, tokens (one list or two), words, norms."""
    lists = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, of, tokens, words, norms = (c.slice(i, 1) for c in batch.columns)
                texts = [x.values if x.values is not None else pa.array([], pa.string()) for x in tokens.flatten()]
                # numbers of tokens are those of words
                known, norm = words.flatten(), norms.flatten()
                own = [pc.index_in(x, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64) for x in texts]
                live = pc.fill_null(pc.not_equal(norm, ""), True).to_numpy(zero_copy_only=False)
                marks = segment_cuts(own[0], own[-1], live, run_lengths, stretch)
                marks = [m[: len(texts)] for m in marks]
                at = [np.r_[0, np.cumsum(pc.utf8_length(x).to_numpy(zero_copy_only=False), dtype=np.int64)] for x in texts]
                spans = zip([(0,) * len(texts), *marks], [*marks, tuple(map(len, texts))], strict=True)
                for n, (begin, end) in enumerate(spans):
                    used = pa.array(np.unique(np.concatenate([x[a:z] for x, a, z in zip(own, begin, end, strict=True)])))
                    part = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([z - a for a, z in zip(begin, end, strict=True)])], pa.int32()), pa.concat_arrays([x.slice(a, z - a) for x, a, z in zip(texts, begin, end, strict=True)]))
                    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), part)
                    row = [ids, pa.array([n], pa.int32()), of, whole, *(pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), x.take(used)).cast(lists) for x in (known, norm))]
                    yield pa.RecordBatch.from_arrays([*row, pa.array([[int(x[a]) for x, a in zip(at, begin, strict=True)]], pa.list_(pa.int32()))], names)

    return run


def segments(met: DataFrame, merged: bool = True, cleanup: str | None = None, run_lengths: tuple[int, ...] = RUNS, stretch: int = STRETCH) -> DataFrame:
    """collation_id, segment, rows (lists of cells by witness): a row a stretch of collations of one distinct text or two, with its rows in order.

    met: collation_id, of, tokens, words, norms, as align.met() has them.  A stretch but the first begins with a row of two equal
    cells, which begins an output row whatever stood before, so rows of stretches are those of the whole.
    """
    ship(met.sparkSession)
    rows = met.select("collation_id", "of", "tokens", "words", "norms")
    many, numbers = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
    kind = T.StructType([met.schema["collation_id"], *(T.StructField(n, t) for n, t in (("segment", T.IntegerType()), ("of", numbers), ("tokens", T.ArrayType(many)), ("words", many), ("norms", many), ("chars", numbers)))])
    dealt = rows.mapInArrow(_segmented(kind.names, run_lengths, stretch), kind).repartition("collation_id", "segment")
    out = T.StructType([kind["collation_id"], kind["segment"], T.StructField("rows", from_arrow_type(pa.list_(pa.list_(held.CELL))))])
    return dealt.mapInArrow(held.nested(merged, cleanup, out.names), out)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows = batch.column(2)[i].values
            if rows is None or not len(rows):
                continue
            cells = pc.fill_null(pc.struct_field(rows.flatten(), "text"), "")
            width = len(cells) // len(rows)
            # the cells of each witness one after the other, each witness's as one
            order = np.arange(len(cells)).reshape(-1, width).T.reshape(-1)
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(width + 1) * len(rows), pa.int32()), cells.take(pa.array(order))), "")
            same = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(width, np.int64))) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(width), pa.int32()), whole], ["collation_id", "segment", "witness_id", "text"])


def segment_texts(found: DataFrame) -> DataFrame:
    """collation_id, segment, witness_id, text: what each witness has in the cells of segments(), put together in order of rows."""
    ship(found.sparkSession)
    kind = T.StructType([found.schema["collation_id"], found.schema["segment"], T.StructField("witness_id", T.IntegerType()), T.StructField("text", T.StringType())])
    return found.select("collation_id", "segment", "rows").mapInArrow(_texts, kind)


def _chained(stretch: int, thin: int):
    def run(keys: tuple, table: pa.Table) -> pa.Table:
        a, b, h = (table.column(c).to_numpy() for c in ("a", "b", "h"))
        by = -(-len(h) // thin)
        if by > 1:
            some = h.view(np.uint64) % np.uint64(by) == 0
            a, b = a[some], b[some]
        order = np.argsort(a)
        kept = order[chain(a[order], b[order])]
        found = cuts(a[kept], b[kept], stretch)
        lists = pa.array([[{"a": x, "b": y} for x, y in found]], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.table([*(pa.array([k.as_py()], table.schema.field(c).type) for c, k in zip(_PAIR, keys, strict=True)), lists], [*_PAIR, "cuts"])

    return run


_COLUMNS = [*_PAIR, "base", "norms", "tokens", "first", "base_first", "chars"]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pairs or stretches with their cuts, as stretches: numbered in order within what they were cut from."""
    for batch in batches:
        at = {c: batch.column(batch.schema.get_field_index(c)) for c in (*_COLUMNS, "cuts")}
        for i in range(batch.num_rows):
            base, norms, tokens = (at[c][i].values for c in ("base", "norms", "tokens"))
            sizes = np.r_[0, np.cumsum(pc.utf8_length(tokens).to_numpy(zero_copy_only=False), dtype=np.int64)]
            first, base_first, chars = (at[c][i].as_py() for c in ("first", "base_first", "chars"))
            marks = [(x["a"], x["b"]) for x in at["cuts"][i].as_py() or []]
            spans = zip([(0, 0), *marks], [*marks, (len(base), len(norms))], strict=True)
            for n, ((x, y), (p, q)) in enumerate(spans):
                row = [at["collation_id"].slice(i, 1), at["witness_id"].slice(i, 1), pa.array([at["stretch"][i].as_py() * 1_000_003 + n], pa.int64())]
                row += [pa.ListArray.from_arrays(pa.array([0, len(z)], pa.int32()), z) for z in (base.slice(x, p - x), norms.slice(y, q - y), tokens.slice(y, q - y))]
                row += [pa.array([first + y], pa.int32()), pa.array([base_first + x], pa.int32()), pa.array([int(chars + sizes[y])], pa.int32())]
                yield pa.RecordBatch.from_arrays(row, _COLUMNS)


def _stretch_cells(cleanup: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in _COLUMNS}
            for i in range(batch.num_rows):
                cells = placed_cells(at["base"][i].as_py(), at["norms"][i].as_py(), at["tokens"][i].as_py(), cleanup)
                base_first, chars = at["base_first"][i].as_py(), at["chars"][i].as_py()
                for name, move in (("anchor", base_first), ("start", chars), ("end", chars)):
                    column = CELL_NAMES.index(name)
                    cells[column] = [x + move for x in cells[column]]
                yield pa.RecordBatch.from_arrays([at["collation_id"].slice(i, 1), at["witness_id"].slice(i, 1), cell_lists([cells])], ["collation_id", "witness_id", "cells"])

    return run


def stretches(arrays: DataFrame, run_lengths: tuple[int, ...] = RUNS, stretch: int = STRETCH, thin: int = THIN) -> DataFrame:
    """A table of the pairs of arrays(collation_id, witness_id, norms, tokens) with their base, cut by anchors.

    collation_id, witness_id, stretch, base, norms, tokens, first (its first token), base_first, chars (its first character).
    """
    ship(arrays.sparkSession)
    kinds = dict(arrays.dtypes)
    ids = f"collation_id {kinds['collation_id']}, witness_id {kinds['witness_id']}, stretch long"
    base = arrays.where("witness_id = 0").select("collation_id", F.col("norms").alias("base"))
    zero = [F.lit(0).alias(c) for c in ("first", "base_first", "chars")]
    rows = arrays.join(base, "collation_id").select("collation_id", "witness_id", F.lit(0).cast("long").alias("stretch"), "base", "norms", "tokens", *zero)
    rows = written(rows, "pairs")
    for k in run_lengths:
        long = F.greatest(F.size("base"), F.size("norms")) > 2 * stretch
        found = rows.where(long & (F.col("base") != F.col("norms"))).select(*_PAIR, "base", "norms").mapInArrow(_anchors(k), f"{ids}, side int, at int, h long")
        once = found.groupBy(*_PAIR, "h").agg(F.count_if(F.col("side") == 0).alias("m"), F.count_if(F.col("side") == 1).alias("n"), F.max(F.when(F.col("side") == 0, F.col("at"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("b"))
        once = once.where("m = 1 and n = 1").select(*_PAIR, "a", "b", "h")
        marks = written(once.groupBy(*_PAIR).applyInArrow(_chained(stretch, thin), f"{ids}, cuts array<struct<a:int,b:int>>"), "cuts")
        schema = f"{ids}, base array<string>, norms array<string>, tokens array<string>, first int, base_first int, chars int"
        cut = written(rows.join(marks, list(_PAIR), "left").mapInArrow(_cut, schema), "stretches")
        discard(rows, marks)
        rows = cut
    return rows


def place_long(arrays: DataFrame, cleanup: str | None = None, run_lengths: tuple[int, ...] = RUNS, stretch: int = STRETCH) -> DataFrame:
    """As operators.diff.place(), with a pair's work dealt over tasks; an aligner for align()."""
    kinds = dict(arrays.dtypes)
    dealt = stretches(arrays, run_lengths, stretch)
    dealt = dealt.repartition("collation_id", "witness_id", "stretch")
    cell = "array<struct<" + ",".join(f"{c}:{'string' if c == 'text' else 'int'}" for c in CELL_NAMES) + ">>"
    rows = dealt.mapInArrow(_stretch_cells(cleanup), f"collation_id {kinds['collation_id']}, witness_id {kinds['witness_id']}, cells {cell}")
    return rows.select("collation_id", "witness_id", F.inline("cells"))
