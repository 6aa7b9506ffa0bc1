"""Line dedup: hashes range-partitioned with secondary sort by document, streamed; keep bitmaps come back, not texts.

Only (128-bit hash, document, line) rows are sorted, by hash and falling document id, so the first document of a run is
the one that keeps its lines.  A stream decides every run inside its partition at once, and holds two documents of a
run at most.  Since the document is part of the range key, a line that a third of the corpus holds spreads over many
partitions; of such a run each partition leaves only its first documents undecided, and a small window over those few
rows adds up the counts and settles them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import materialize, named
from palimpsest.shipping import ship

_LAST = 2**63 - 1
_NAMES = ["h1", "h2", "o", "th", "pos", "lead", "docs"]
_SCHEMA = "h1 long, h2 long, o long, th long, pos long, lead long, docs long"


def line_keys(text: Column) -> Column:
    """Array of the keys of the lines: ends stripped of ASCII blanks, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda x: F.translate(F.btrim(x, F.lit(" \t\n\x0b\x0c\r")), upper, upper.lower()))


def _streamed(min_docs: int):
    """Lines to drop (docs 0), and the undecided rows of runs at a partition's ends, with the run's documents in it."""

    def told(x: np.ndarray, docs: int = 0) -> pa.RecordBatch:
        lead = np.zeros(x.shape[1], np.int64)
        lead[:1] = docs > 0
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in x), pa.array(lead), pa.array(np.full(x.shape[1], docs, np.int64))], _NAMES)

    def ended(run: np.ndarray, edge: bool) -> Iterator[pa.RecordBatch]:
        o = run[2]
        docs = 1 + int((o[1:] != o[:-1]).sum())
        if docs >= min_docs:
            if edge:
                yield told(run[:, o == o[0]], docs)
            yield told(run[:, o != o[0]])
        elif edge:
            yield told(run, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        flow: np.ndarray | None = None  # hash of a run known to have enough documents: what still comes of it goes
        edge = True
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            if flow is not None:
                same = (x[0] == flow[0]) & (x[1] == flow[1])
                n = len(same) if same.all() else int(same.argmin())
                if n:
                    yield told(x[:, :n])
                x = x[:, n:]
                if not x.shape[1]:
                    continue
                flow = None
            if held is not None:
                x = np.concatenate([held, x], 1)
                held = None
            if not x.shape[1]:
                continue
            new = np.r_[True, (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])]
            starts = np.flatnonzero(new)
            if edge and len(starts) > 1:
                yield from ended(x[:, : starts[1]], True)
                x, new, edge = x[:, starts[1] :], new[starts[1] :], False
                starts = starts[1:] - starts[1]
            end = starts[-1]
            if end:
                run_no = np.cumsum(new[:end]) - 1
                doc = new[:end] | np.r_[True, x[2, 1:end] != x[2, : end - 1]]
                docs = np.bincount(run_no, doc).astype(np.int64)
                ordinal = np.cumsum(doc)
                later = ordinal > ordinal[starts[:-1]][run_no]
                pick = later & (docs[run_no] >= min_docs)
                if pick.any():
                    yield told(x[:, :end][:, pick])
            held = x[:, end:]
            o = held[2]
            if 1 + int((o[1:] != o[:-1]).sum()) >= min_docs:
                yield from ended(held, True)
                flow, held, edge = held[:2, 0], None, False
        if held is not None:
            yield from ended(held, True)

    return run


def _bitmaps(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dropped, kept = [], [], []
            texts = batch.column(3).to_pylist() if with_text else [None] * batch.num_rows
            for n, drop, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, strict=True):
                stays = np.ones(n, bool)
                stays[drop or []] = False
                keep.append(zlib.compress(np.packbits(stays).tobytes()))
                dropped.append(int(n - stays.sum()))
                if with_text:
                    kept.append(text if not drop else "\n".join(x for x, y in zip((text or "").split("\n"), stays, strict=True) if y))
            columns = [batch.column(0), batch.column(1), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())]
            if with_text:
                columns += [pa.array(kept, pa.string()), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "keep", "kept", "row"][: len(columns)])

    return run


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_lines long, n_dropped long, keep (zlib of the packed bits, first line first).

    Lines whose key has min_chars code points or more and is held by min_docs documents or more go, but for those in the
    document of the largest id.  with_text adds kept string (lines that stay; null for a null text) and row (struct of the other columns).
    Null text: as empty, one empty line.  Null id: one document, larger than all others.  Rows of one id are one
    document; repeated rows have equal results; ids are integers.  Other columns, of any name, are left out or inside row.  No rows: none.
    """
    ship(docs.sparkSession)
    own = docs.select(
        named(doc_id).alias("doc_id"), F.coalesce(named(doc_id).cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(named(text)).alias("th"), named(text).alias("text"),
        F.struct(*(named(c) for c in docs.columns if c != text)).alias("row"))
    lines = own.select("o", "th", F.posexplode(line_keys(F.col("text"))).alias("pos", "key")).where(F.length("key") >= min_chars)
    lines = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "o", "th", F.col("pos").cast("long").alias("pos"))
    order = [F.col("h1"), F.col("h2"), F.col("o").desc()]
    ran = materialize(lines.repartitionByRange(*order).sortWithinPartitions(*order, "th", "pos").mapInArrow(_streamed(min_docs), _SCHEMA), "line-runs")
    one = Window.partitionBy("h1", "h2")
    late = ran.where("docs > 0").withColumns({"total": F.sum(F.col("lead") * F.col("docs")).over(one), "top": F.max("o").over(one)})
    drops = ran.where("docs = 0").select("o", "th", "pos").unionByName(late.where(f"total >= {int(min_docs)} and o <> top").select("o", "th", "pos"))
    drops = drops.groupBy("o", "th").agg(F.collect_set("pos").alias("drops"))
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines")
    whole = own.join(drops.hint("shuffle_hash"), ["o", "th"], "left").select("doc_id", n, "drops", *(["text", "row"] if with_text else []))
    kinds = [("doc_id", whole.schema["doc_id"].dataType), ("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("keep", T.BinaryType())]
    kinds += [("kept", T.StringType()), ("row", own.schema["row"].dataType)] if with_text else []
    return whole.mapInArrow(_bitmaps(with_text), T.StructType([T.StructField(*x) for x in kinds]))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what keep_bitmaps(with_text=True) returns."""
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
