"""Interaction of quality filters: what each removes, alone and after others, over every order in which they may run.

Five filters judge a text: A under 200 words, B under half of its words distinct, C over 2 % capitals A-Z, D one of #$%&*|,
E identical to the text of a document of smaller id.  Which of them a document fails is a mask of five bits; all figures
follow from counts of masks, so the 120 orders cost nothing of the corpus.

E comes by partition refinement.  All documents are one class, which is split by their texts' code-point length, then by
the hashes of successive blocks, each twice as long as all before it (so there are as many rounds as the logarithm of
the longest text); documents alone in their class drop out after each split.  Only survivors' full texts are compared.
Splits see rows of numbers; a class with a third of all rows is counted before it is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, materialize, named, numbered, small
from palimpsest.shipping import ship

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
FIRST_BLOCK = 512
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = re.compile("[#$%&*|]")


def failed(text: str) -> int:
    """The mask of A to D (bits 0 to 3)."""
    own = text.encode()
    words = own.split()  # at blanks and \t to \r, as bytes have no others
    capitals = len(own) - len(own.translate(None, _CAPITALS))
    told = (len(words) < 200, 2 * len(set(words)) < len(words), 100 * capitals > 2 * len(text), _SIGNS.search(text) is not None)
    return sum(1 << i for i, x in enumerate(told) if x)


def block_hashes(text: str, first: int = FIRST_BLOCK) -> list[int]:
    """Signed 64-bit hashes of text[:first], text[first:2 * first], text[2 * first:4 * first], ..., to the text's end."""
    out, start, end = [], 0, first
    while start < len(text):
        out.append(xxhash.xxh64_intdigest(text[start:end].encode(), 3) - (1 << 63))
        start, end = end, 2 * end
    return out


def _judged(first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [x or "" for x in part.column("text").to_pylist()]
                told = [
                    pa.array([failed(x) for x in texts], pa.int32()),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([block_hashes(x, first) for x in texts], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("row", "id", "part", "doc")] + told, ["row", "id", "part", "doc", "mask", "length", "blocks"])

    return run


def duplicates(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """row: those of rows(row, id, length, blocks) whose text is that of a smaller id too; texts(row, text) are the whole ones.

    An id is a struct, ordered by its fields.
    """
    # rounds split by one block each; as many as the longest text has
    alive, depth = rows.select("row", "id", "length", "blocks"), 0
    most = rows.agg(F.max(F.size("blocks"))).first()[0] or 0
    written = None
    while True:
        split = ["length"] if not depth else ["key", "block"]
        if depth:
            # what is one class so far is one key: splitting it further needs the next block alone
            alive = alive.withColumn("block", F.get("blocks", F.lit(depth - 1)))
        classes = alive.groupBy(*split).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # a class keeps its name for good: the hash of what has split it so far
        name = F.xxhash64(*split)
        classes = materialize(classes.select(*split, name.alias("next")), "classes")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in split]
        kept = alive.alias("a").join(small(classes).alias("c"), on=same[0] if len(same) == 1 else same[0] & same[1])
        found = materialize(kept.select("a.row", "a.id", F.col("c.next").alias("key"), "a.blocks"), "survivors")
        discard(classes, *([written] if written is not None else []))
        alive = written = found
        depth += 1
        if depth > most:
            break
    # equal texts meet whole, combined before they are shuffled; the least id of each is the one that is no duplicate
    held = texts.join(small(alive).select("row", "key", "id"), "row")
    groups = held.groupBy("key", "text").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups.select("key", F.sha2("text", 256).alias("whole"), "first"), "groups", "zstd")
    told = held.select("row", "id", "key", F.sha2("text", 256).alias("whole"))
    found = told.join(small(groups), ["key", "whole"]).where(F.col("id") > F.col("first")).select("row")
    found = materialize(found, "duplicates")
    discard(alive, groups)
    return found


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", first_block: int = FIRST_BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, part, mask (bits 0 to 4: A to E), good, toxic (boolean).

    Null text: empty, as an empty one, which fails A and, but for the least id, E.  Null source: the part of the empty
    string.  Null ids come after all others, and no label is theirs; rows of one id and text are judged alike: none is
    of a smaller id.  An id of several labels is good (toxic) if one says so; null labels say nothing.  Other columns,
    of any name, are left out.  No rows: none.
    """
    ship(docs.sparkSession)
    docs_, row = numbered(docs)
    key = F.struct(named(doc_id).isNull().alias("none"), named(doc_id).alias("value"))
    own = docs_.select(named(row).alias("row"), key.alias("id"), F.coalesce(named(source).cast("string"), F.lit("")).alias("part"), named(doc_id).alias("doc"), F.coalesce(named(text), F.lit("")).alias("text"))
    kinds = dict(own.dtypes)
    rows = own.mapInArrow(_judged(first_block), f"row {kinds['row']}, id {kinds['id']}, part string, doc {kinds['doc']}, mask int, length long, blocks array<long>")
    rows = materialize(rows, "judged")
    again = materialize(duplicates(rows, own.select("row", "text")), "again")
    marked = rows.select("row", "part", "doc", "mask").join(small(again).withColumn("e", F.lit(16)), "row", "left")
    marked = marked.select("part", F.col("doc").alias("doc_id"), (F.col("mask") + F.coalesce("e", F.lit(0))).alias("mask"))
    says = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "bad"))]
    told = labels.where(named(doc_id).isNotNull()).groupBy(named(doc_id).alias("_id")).agg(*says)
    # ids that are null meet no label, and would all be dealt to one task
    named_ = marked.where("doc_id is not null").join(told, F.col("doc_id") == F.col("_id"), "left")
    none = F.lit(None).cast("boolean")
    columns = ["doc_id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("toxic")]
    return named_.select(*columns).unionByName(marked.where("doc_id is null").withColumns({"good": none, "bad": none}).select(*columns))


def _effects() -> dict[str, np.ndarray]:
    """For each order and step (600 rows) and mask (32): is a document of that mask kept, removed there, failed but gone before, failing that filter only."""
    mask = np.arange(32)
    bit = {x: 1 << i for i, x in enumerate(FILTERS)}
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
    for order in ORDERS:
        gone = np.zeros(32, bool)
        for x in order:
            fails = (mask & bit[x]) > 0
            out["removed"].append(fails & ~gone)
            out["redundant"].append(fails & gone)
            gone = gone | fails
            out["kept"].append(~gone)
            out["unique_fails"].append(mask == bit[x])
    return {k: np.array(v, np.int64) for k, v in out.items()}


_FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in _FIGURES)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's counts by mask (all, good, toxic) to its 600 rows."""
    effects = _effects()
    orders, steps = [o for o in ORDERS for _ in FILTERS], list(range(1, 6)) * len(ORDERS)
    filters = np.array([FILTERS.index(x) for o in ORDERS for x in o])
    for batch in batches:
        parts = batch.column(0).to_pylist()
        counts = [batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, 32) for i in (1, 2, 3)]
        for i, part in enumerate(parts):
            n, good, toxic = (c[i] for c in counts)
            told = {k: v @ n for k, v in effects.items()} | {"good_lost": effects["removed"] @ good, "toxic_lost": effects["removed"] @ toxic}
            told["shapley"] = np.array([told["removed"][filters == f].sum() for f in range(5)])[filters]
            columns = [pa.array([part] * len(orders), pa.string()), pa.array(orders), pa.array(steps, pa.int32()), *(pa.array(told[x], pa.int64()) for x in _FIGURES)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *_FIGURES])


def audit(found: DataFrame) -> DataFrame:
    """600 rows per part of masks(): part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    kept: after the step; removed: by it; redundant: what its filter fails but an earlier one removed; unique_fails: what fails
    its filter alone; good_lost, toxic_lost: of the removed, by label; shapley: what its filter removes, summed up over
    all orders.  No rows: none.
    """
    counted = found.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))

    def by_mask(column: str):
        held = F.map_from_entries(F.collect_list(F.struct("mask", F.col(column))))
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda m: F.coalesce(F.try_element_at(held, m), F.lit(0).cast("long"))).alias(column)

    return counted.groupBy("part").agg(*map(by_mask, ("n", "good", "toxic"))).mapInArrow(_spread, _AUDIT)
