"""Best-fit packing of tokenized documents into sequences, by exact complements over lengths.

A plan needs the number of pieces of each length and nothing else, and there are as many lengths as a sequence has places,
whatever the corpus: the driver plans over those counts.  From the longest length down, the gap that a piece leaves is
looked up among lengths, sums of pairs and sums of triples of lengths that are still available, and a combination that
fills it exactly completes the sequence.  A gap without one takes the piece that fits best, the longest, and what is left
of it is looked up again.  Each pattern so found is used as often as counts allow, which uses up one of its lengths: there
are some thousand patterns at any size.

Pieces are told apart within their length by a number: how many pieces of that length there are in earlier tasks (a
prefix sum over the tasks' counts), plus a running count within the task that tokenized them.  A piece then finds its
sequence by binary search in the plan; no piece moves for it.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, materialize, named, prefix_sums, small
from palimpsest.shipping import ship

SEQUENCE = 1024
END_ID = 2
SLICE_CHARS = 1 << 19
CACHE = 1 << 20
# What the tokenizer's pattern takes for white space, and letters of one block that has no other characters.
_BLANK = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Stretches that end where a token has to end: words, numbers and signs that the next character does not go on with; else
#: all up to the next blank; white space but its last character; what is left of it.
_SPLIT = "|".join(
    [
        rf"\x20?[{_LETTER}]++(?![^\W\d_])",
        r"(?:\x20[!-/:-@\[-`{-~]++|(?!')[!-/:-@\[-`{-~]++)(?=[A-Za-z0-9\s]|\Z)",
        rf"\x20?[0-9]++(?=[{_LETTER}]|\W|_|\Z)",
        rf"\x20?[^{_BLANK}]++",
        rf"[{_BLANK}]+(?![^{_BLANK}])",
        rf"[{_BLANK}]+",
    ]
)


class _Numbers(dict):
    """Numbers strings in order of their first use; `new` has those since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class Encoder:
    """A tokenizer's ids of texts, remembered for stretches that no token reaches across.

    Stretches are cut at places where the tokenizer's own pattern always cuts, so a text's ids are those of its stretches.
    The first CACHE stretches are remembered, others looked up again.  Texts with the name of a special token in them are
    left to the tokenizer whole.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.stretches = re.compile(_SPLIT).findall
        self.known = _Numbers()
        self.sizes = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)

    def _learnt(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes and starts in the pool of ids by number, and the pool, the new stretches among them."""
        new = self.known.new
        if not new:
            return self.sizes, self.starts, self.pool
        found = [x.ids for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        every = np.r_[self.sizes, sizes], np.r_[self.starts, len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes], np.r_[self.pool, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))]
        if len(self.known) <= CACHE:
            self.sizes, self.starts, self.pool = every
        else:
            for x in new:
                del self.known[x]
        self.known.new = []
        return every

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [self.special is not None and self.special.search(t) is not None for t in texts]
        flat: list[str] = []
        ends = []
        for text, w in zip(texts, whole, strict=True):
            if not w:
                flat += self.stretches(text)
            ends.append(len(flat))
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int32, len(flat))
        sizes, starts, pool = self._learnt()
        each = sizes[codes]
        upto = np.r_[0, np.cumsum(each, dtype=np.int64)]
        ids = pool[np.arange(upto[-1]) + np.repeat(starts[codes] - upto[:-1], each)]
        parts = np.split(ids, upto[ends[:-1]])
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if w else part for t, w, part in zip(texts, whole, parts, strict=True)]


_encoders: dict[str, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """One for each definition and Python worker, which goes on to the worker's next tasks."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def cut(length: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, and before them what is left over."""
    first = length % sequence or min(length, sequence)
    return [(0, first), *((at, sequence) for at in range(first, length, sequence))]


def _pieces(definition, end_id: int, sequence: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        task = TaskContext.get().partitionId()
        seen = np.zeros(sequence + 1, np.int64)

        def told(ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
            rows: list[tuple] = []
            for i, own in enumerate(found):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(own), sequence)):
                    some = own[start : start + length]
                    rows.append((i, k, start, length, zlib.crc32(some), task, int(seen[length]), *([some] if with_ids else ())))
                    seen[length] += 1
            which, k, *more = zip(*rows, strict=True)
            columns = [ids.take(pa.array(which)), pa.array(k, pa.int32()), *(pa.array(c, pa.int64()) for c in more[:5])]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in more[5]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            at = size = 0
            for j, text in enumerate(texts):
                size += len(text)
                if size >= SLICE_CHARS or j == len(texts) - 1:
                    yield told(batch.column(0).slice(at, j + 1 - at), encoder.encode(texts[at : j + 1]))
                    at, size = j + 1, 0

    return run


def tokenize(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row a piece, written: doc_id, piece int, start, length, ids_crc32, task, nth (long), and ids (array of long) if asked for.

    A document's ids are those of its text by the tokenizer's file, without special ones, and end_id.  Longer ones than a
    sequence are cut into whole sequences from their end; the first piece may be shorter.  The file is read by the
    driver; its text is broadcast.  task and nth number a length's pieces.  Null text: empty, end_id alone.  Null ids and
    repeated rows: pieces of their own.  Other columns, of any name, are left out.  No rows: none.
    """
    spark = ship(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, piece int, start long, length long, ids_crc32 long, task long, nth long" + ", ids array<long>" * with_ids
    own = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    return materialize(own.mapInArrow(_pieces(definition, end_id, sequence, with_ids), schema), "pieces")


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that fit a sequence, and how many sequences have each; together they use every counted piece once."""
    have = np.zeros(sequence + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    steps: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> bool:
        """As often as counts allow; not at all where they do not."""
        lengths, times = np.unique(pattern, return_counts=True)
        n = int((have[lengths] // times).min())
        if n:
            have[lengths] -= n * times
            steps.append((pattern, n))
        return n > 0

    def pair(gap: int, most: int) -> tuple[int, int] | None:
        """Two lengths, the larger one at most `most`, that add up to the gap and are available."""
        a = np.arange((gap + 1) // 2, min(gap - 1, most) + 1)
        if len(a):
            b = gap - a
            ok = np.flatnonzero((have[a] > 0) & (have[b] > 0) & ((a != b) | (have[a] > 1)))
            if len(ok):
                return int(a[ok[-1]]), int(b[ok[-1]])
        return None

    def triple(gap: int) -> tuple[int, int, int] | None:
        for a in np.flatnonzero(have[: gap - 1])[::-1] if gap > 2 else ():
            have[a] -= 1
            two = pair(gap - int(a), int(a))
            have[a] += 1
            if two is not None:
                return int(a), *two
        return None

    def filled(length: int) -> list[int]:
        """The length and what fills its gap; as long as no combination does so exactly, the longest that fits goes in first."""
        pattern, gap = [], sequence
        more: tuple[int, ...] | None = (length,)
        while more:
            pattern += more
            have[list(set(more))] -= [more.count(x) for x in set(more)]
            gap -= sum(more)
            if not gap:
                break
            more = (gap,) if have[gap] else pair(gap, gap) or triple(gap)
            if more is None:
                fits = np.flatnonzero(have[: gap + 1])
                more = (int(fits[-1]),) if len(fits) else None
        for x in pattern:
            have[x] += 1
        return pattern

    for length in range(sequence, 0, -1):
        while have[length]:
            use(tuple(filled(length)))
    return steps


def slots(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first number of each run of pieces, the sequence that its first piece goes to, and the offset there."""
    used: dict[int, int] = defaultdict(int)
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern, n in steps:
        offset = 0
        for length in pattern:
            found[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for length, rows in found.items()}


def _assigned(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                first, to, at = table[int(x)]
                rows = np.flatnonzero(length == x)
                k = np.searchsorted(first, number[rows], side="right") - 1
                sequence[rows] = to[k] + number[rows] - first[k]
                offset[rows] = at[k]
            kept = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """pieces, a table of tokenize(), with sequence_id long and offset long, gapless from 0 in each sequence."""
    spark = ship(pieces.sparkSession)
    counts = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(plan(lengths, sequence)))
    before = materialize(prefix_sums(counts, "task", "n", by="length").select("length", "task", "before"), "piece-numbers")
    numbered = pieces.join(small(before), ["length", "task"]).withColumn("number", F.col("before") + F.col("nth"))
    columns = [c for c in pieces.columns if c not in ("task", "nth")]
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    discard(counts)
    return numbered.select(*columns, "number").mapInArrow(_assigned(table), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: the sequences themselves, of pack(tokenize(..., with_ids=True)); doc_ids is a document a piece."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("r"))
    return rows.select("sequence_id", F.flatten(F.transform("r", lambda x: x["ids"])).alias("ids"), F.transform("r", lambda x: x["doc_id"]).alias("doc_ids"))


def digest(packed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
