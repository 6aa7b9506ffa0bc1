"""Substring dedup: suffix automata of reference shards, and matching statistics of the texts streamed through them.

A corpus that is its own reference has no automaton small enough to broadcast whole, and streaming all documents
through one broadcast shard after another would cost documents times shards.  So shards are dealt by content instead:

1. Every window of min_words words has an anchor, its least-hashed word 5-gram.  Equal windows have equal anchors, so a
   window needs no other shard than its anchor's.
2. Anchors are partitioned with secondary sort by document and streamed; those of two documents or more stay.  Those
   that a bounded sample shows in too many documents for one task are told beforehand: they pass, spread by document.
3. Of their windows alone the words are cut out, as stretches of windows that share an anchor; equal stretches are
   combined to one with its first document before any of them is sorted, so copies by the thousand cost one row.
   An anchor held more than HOT times deals its windows one by one, each to a shard of its own words.  (An anchor is
   dealt one way in the whole corpus: either it is told beforehand, or all its rows are in one stream.)
4. Anchors are dealt into shards of about SHARD_BYTES of distinct stretches.  A shard makes one generalised suffix
   automaton, whose states know their first document; its stretches are streamed through it, and where the matching
   statistics reach min_words the state tells which document has that window first.
5. The verdicts return to the documents, which drop the words of maximal spans.

Every step moves rows of windows that repeat, not the corpus; no group of unbounded size meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, materialize, named
from palimpsest.shipping import ship

GRAM = 5
HOT = 1000
#: Words of a shard's distinct stretches; an automaton takes some hundred times the bytes.
SHARD_BYTES = 128 << 10
#: Documents sampled for anchors held too often, by their hash; a fixed number finds any held by a thousandth of the corpus.
SAMPLE = 5000
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
_LAST = 2**63 - 1
_MARKS = pa.list_(pa.struct([("s", pa.int32()), ("mask", pa.int64())]))


def _rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MIX ^ hashes[j : j + n]
        out ^= out >> _SHIFT
    return out * _MIX


def _anchored(words: list[list[bytes]], size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, anchor, first window and number of windows of each stretch of windows that share an anchor, of texts of size words at least.

    All texts are hashed and rolled as one; grams and windows that reach from one into the next are left out.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(lengths) - lengths
    grams = _rolled(np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(lengths.sum())), gram)
    n = len(grams) - (size - gram)
    least, at = grams[:n].copy(), np.arange(n)
    for k in range(1, size - gram + 1):
        less = np.flatnonzero(grams[k : k + n] < least)
        least[less], at[less] = grams[less + k], less + k
    of = np.repeat(np.arange(len(words)), lengths)[:n]
    whole = np.arange(n) + size <= (begin + lengths)[of]
    first = np.flatnonzero(whole & (np.diff(at, prepend=-1) != 0))
    # a text's first window begins a stretch whatever the one before it has
    first = np.union1d(first, begin)
    # windows that reach over a text's end belong to none
    upto = np.minimum(np.append(first[1:], n), (begin + lengths - size + 1)[of[first]])
    return of[first], least[first].view(np.int64), (first - begin[of[first]]).astype(np.int32), (upto - first).astype(np.int32)


def _anchors(size: int, gram: int, frequent: np.ndarray):
    """Rows a, o, th, s, n, route; route 1 for the frequent anchors (a sorted array)."""
    names = ["a", "o", "th", "s", "n", "route"]

    def batched(words: list[list[bytes]], o: list[int], th: list[int]) -> pa.RecordBatch:
        of, anchor, first, n = _anchored(words, size, gram)
        route = np.zeros(len(anchor), np.int32)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, anchor), len(frequent) - 1)
            route[frequent[at] == anchor] = 1
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, np.array(o, np.int64)[of], np.array(th, np.int64)[of], first, n, route)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own, hashes, held = [], [], [], 0
        for batch in batches:
            for o, th, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = text.encode().split() if text else []
                if len(found) < size:
                    continue
                words.append(found)
                own.append(o)
                hashes.append(th)
                held += len(found)
                if held > 200_000:
                    yield batched(words, own, hashes)
                    words, own, hashes, held = [], [], [], 0
        if held:
            yield batched(words, own, hashes)

    return run


_ANCHORS = "a long, o long, th long, s int, n int, route int"


def _frequent(own: DataFrame, size: int, hot: int) -> np.ndarray:
    """Anchors that more than `hot` documents, by estimate from about SAMPLE documents, hold (three of those at least)."""
    total = own.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, total))
    picked = own.where(F.pmod(F.xxhash64("o", "th"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("o", "th", "text")
    least = max(3.0, hot * min(1.0, SAMPLE / max(1, total)))
    found = picked.mapInArrow(_anchors(size, GRAM, np.zeros(0, np.int64)), _ANCHORS).groupBy("a").agg(F.count_distinct("o").alias("n")).where(F.col("n") >= least)
    return np.sort(found.select("a").toArrow()["a"].to_numpy().astype(np.int64))


def _repeated(hot: int):
    """Rows sorted by anchor and document in; those of route 1 pass, of the others those whose anchor two documents hold.

    A run of more than `hot` rows is turned to route 1; no more than `hot` rows and a batch are held.
    """
    names = ["a", "o", "th", "s", "n", "route"]

    def told(x: np.ndarray, route: int) -> pa.RecordBatch:
        whole = [pa.array(np.ascontiguousarray(c)) for c in x[:3]]
        return pa.RecordBatch.from_arrays([*whole, *(pa.array(c.astype(np.int32)) for c in x[3:5]), pa.array(np.full(x.shape[1], route, np.int32))], names)

    def ended(run: np.ndarray) -> Iterator[pa.RecordBatch]:
        if run[1, 0] != run[1, -1]:
            yield told(run, int(run.shape[1] > hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        flowing: int | None = None  # anchor of a run known to be hot: its rows pass as they come
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            sure = x[5] == 1
            if sure.any():
                yield told(x[:, sure], 1)
                x = x[:, ~sure]
            if flowing is not None and x.shape[1]:
                same = x[0] == flowing
                n = len(same) if same.all() else int(same.argmin())
                if n:
                    yield told(x[:, :n], 1)
                x = x[:, n:]
                if x.shape[1]:
                    flowing = None
            if not x.shape[1]:
                continue
            if held is not None:
                x = np.concatenate([held, x], 1)
            starts = np.flatnonzero(np.r_[True, x[0, 1:] != x[0, :-1]])
            if len(starts) > 1:
                sizes, ends = np.diff(starts), starts[1:] - 1
                many = x[1, starts[:-1]] != x[1, ends]
                for route, pick in ((0, many & (sizes <= hot)), (1, many & (sizes > hot))):
                    if pick.any():
                        yield told(x[:, : starts[-1]][:, np.repeat(pick, sizes)], route)
            held = x[:, starts[-1] :]
            if held.shape[1] > hot and held[1, 0] != held[1, -1]:
                yield told(held, 1)
                flowing, held = held[0, 0], None
        if held is not None:
            yield from ended(held)

    return run


def _stretches(size: int):
    """The words of each marked stretch, or of each of its windows, as slices of the text with single blanks."""
    names = ["key", "sh", "seg", "o", "th", "s", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        held = 0
        for batch in batches:
            own, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            marks = batch.column(3)
            bounds = marks.offsets.to_numpy() - marks.offsets[0].as_py()
            first, n_windows, anchor, route = (marks.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("s", "n", "a", "route"))
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = text.encode().split()
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.r_[0, ends[:-1] + 1]
                here = slice(bounds[i], bounds[i + 1])
                s, n, a, one_by_one = first[here], n_windows[here], anchor[here], route[here] > 0
                single = n[one_by_one]
                each = np.repeat(s[one_by_one], single) + np.arange(single.sum()) - np.repeat(np.cumsum(single) - single, single)
                at = np.concatenate([s[~one_by_one], each])
                k = np.concatenate([n[~one_by_one], np.ones(len(each), n.dtype)])
                whole = b" ".join(words)
                segs = [whole[x:y] for x, y in zip(starts[at].tolist(), ends[at + size + k - 2].tolist(), strict=True)]
                sh = np.fromiter(map(xxhash.xxh3_64_intdigest, segs), np.uint64, len(segs)).view(np.int64)
                key = np.fromiter((xxhash.xxh3_64_intdigest(x, 1) for x in segs[len(segs) - len(each) :]), np.uint64, len(each)).view(np.int64)
                row = (np.concatenate([a[~one_by_one], key]), sh, segs, np.full(len(at), own[i]), np.full(len(at), th[i]), at.astype(np.int32), k.astype(np.int32))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
                held += len(at)
                if held > 50_000:
                    yield _batch(out, names)
                    out, held = [[] for _ in names], 0
        if held:
            yield _batch(out, names)

    return run


def _batch(columns: list[list], names: list[str]) -> pa.RecordBatch:
    joined = [pa.array([y for x in c for y in x], pa.binary()) if name == "seg" else pa.array(np.concatenate(c)) for c, name in zip(columns, names, strict=True)]
    return pa.RecordBatch.from_arrays(joined, names)


class Automaton:
    """Generalised suffix automaton over words; each state knows the least document that holds its sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [_LAST]

    def _state(self, length: int, link: int, moves: dict, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A state for p's longest sequence and word, taken out of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), _LAST)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], doc: int) -> list[int]:
        """Take in a sequence; the states of its prefixes, which stay theirs whatever comes after."""
        moves, link, length, first = self.next, self.link, self.length, self.first
        p, states = 0, []
        for word in words:
            q = moves[p].get(word)
            if q is not None:
                p = q if length[q] == length[p] + 1 else self._split(p, word, q)
            else:
                new = len(length)
                moves.append({})
                length.append(length[p] + 1)
                link.append(0)
                first.append(_LAST)
                while p >= 0 and (q := moves[p].get(word)) is None:
                    moves[p][word] = new
                    p = link[p]
                if p >= 0:
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                p = new
            if doc < first[p]:
                first[p] = doc
            states.append(p)
        return states

    def close(self) -> None:
        """Hand the first documents down to the suffixes, longest states first."""
        link, first = np.array(self.link), np.array(self.first, np.int64)
        for level in reversed(self._levels()):
            np.minimum.at(first, link[level], first[level])
        self.first = first.tolist()

    def _levels(self) -> list[np.ndarray]:
        """The states but the first, by length."""
        length = np.array(self.length)
        order = np.argsort(length, kind="stable")[1:]
        return np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []

    def known(self, size: int) -> np.ndarray:
        """Of each state, the first document of the last `size` words of its longest sequence.

        The statistics of a sequence that was added are its own prefixes, cut to size: their states, from add(), tell where
        its words match, and this what the match says.  Shorter states have the least number for none.
        """
        length, link, first = np.array(self.length), np.array(self.link), np.array(self.first, np.int64)
        found = np.full(len(length), -1, np.int64)
        for level in self._levels():
            if length[level[0]] >= size:
                up = link[level]
                found[level] = np.where(length[up] >= size, found[up], first[level])
        return found

    def statistics(self, words: list[bytes], size: int) -> Iterator[tuple[int, int]]:
        """For each word, the length of the longest known sequence that ends there, at most size, and its first document."""
        v = matched = 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if word in self.next[v]:
                v, matched = self.next[v][word], matched + 1
            while v and self.length[self.link[v]] >= size:
                v = self.link[v]
            matched = min(matched, size)
            yield matched, self.first[v]


def _judged(size: int):
    """Per distinct stretch, the first document of each of its windows; rows come by shard key."""

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        automaton = Automaton()
        ends = [automaton.add(seg.split(), first)[size - 1 :] for _, _, seg, first, _, _ in rows]
        automaton.close()
        counts = np.fromiter(map(len, ends), np.int64, len(ends))
        upto = np.cumsum(counts)
        firsts = automaton.known(size)[np.fromiter(chain.from_iterable(ends), np.int64, int(upto[-1]))]
        least = np.minimum.reduceat(firsts, upto - counts)
        later = np.fromiter((last for _, _, _, _, last, _ in rows), np.int64, len(rows)) > least
        for i in np.flatnonzero(later).tolist():
            yield rows[i][0], rows[i][1], firsts[upto[i] - counts[i] : upto[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held, out = None, [], 0, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for row in zip(*columns, strict=True):
                if held >= SHARD_BYTES and row[0] != key:  # equal windows have equal keys, which a shard has whole
                    out += shard(rows)
                    rows, held = [], 0
                key = row[0]
                rows.append(row)
                held += len(row[2])
            if len(out) > 20_000:
                yield _verdicts(out)
                out = []
        if rows:
            out += shard(rows)
        if out:
            yield _verdicts(out)

    return run


def _verdicts(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "sh", "firsts"])


def _removed(size: int):
    """Drop the words that marked windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, kept = [], [], []
            marks = batch.column(2)
            bounds = np.r_[0, np.cumsum(pc.fill_null(marks.value_lengths(), 0).to_numpy())]
            first, mask = (marks.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("s", "mask"))
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.encode().split() if text else []
                n_words.append(len(words))
                if bounds[i] == bounds[i + 1]:
                    spans.append([])
                    kept.append(b" ".join(words).decode())
                    continue
                # the marked windows of each mask, bit by bit, of all marks at once
                own = slice(bounds[i], bounds[i + 1])
                mark, bit = np.nonzero(np.unpackbits(mask[own].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                at = first[own][mark] + bit
                cover = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + size, minlength=len(words) + 1)
                edges = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(cover) > 0).astype(np.int8)]))
                edges = [*edges, len(words)] if len(edges) % 2 else [*edges]
                ends = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
                stay, at = [], 0
                for a, b in ends:
                    stay += words[at:a]
                    at = b
                spans.append([{"start": a, "end": b} for a, b in ends])
                kept.append(b" ".join(stay + words[at:]).decode())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "spans", "kept"])

    return run


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 13, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_words long, spans (start, end in words; removed, maximal), kept string.

    A word goes if a window of min_words words covers it whose words also start somewhere in a document of smaller id.
    hot: anchors held more often deal their windows one by one.
    Null text: no words, kept is empty.  Null id: larger than all others.  Rows of one id never remove each other's
    words; repeated rows have equal results.  A document under min_words words loses nothing.  min_words is 5 to 60; ids
    are integers.
    Other columns, of any name, are left out.  No rows: none.
    """
    ship(docs.sparkSession)
    if not GRAM <= min_words <= 60:
        raise ValueError("min_words must be 5 to 60")
    # rows of one id are told apart by a hash of the text; where ids are unique it is left out of what is shuffled
    ids = docs.groupBy(named(doc_id).alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    th = F.lit(0).cast("long") if ids.isEmpty() else F.xxhash64(named(text))
    own = docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(doc_id).cast("long"), F.lit(_LAST)).alias("o"), th.alias("th"), named(text).alias("text"))
    anchors = own.select("o", "th", "text").mapInArrow(_anchors(min_words, GRAM, _frequent(own, min_words, hot)), _ANCHORS)
    dealt = anchors.repartition(F.when(F.col("route") == 1, F.xxhash64("o", "s")).otherwise(F.col("a")))
    # anchors are told apart by the sort's first eight bytes; the route, first, would leave all to compare
    repeated = dealt.sortWithinPartitions("a", "o").mapInArrow(_repeated(hot), _ANCHORS)
    marks = repeated.groupBy("o", "th").agg(F.collect_set(F.struct("s", "n", "a", "route")).alias("marks"))
    marks = materialize(marks, "marks", "zstd")
    cut = own.select("o", "th", "text").join(marks.hint("shuffle_hash"), ["o", "th"]).select("o", "th", "text", "marks")
    cut = materialize(cut.mapInArrow(_stretches(min_words), "key long, sh long, seg binary, o long, th long, s int, n int"), "stretches", "zstd")
    discard(marks)

    distinct = cut.groupBy("key", "sh", "seg").agg(F.min("o").alias("first"), F.max("o").alias("last"), F.max("n").alias("n"))
    shards = distinct.select("key", "sh", "seg", "first", "last", "n").repartition("key").sortWithinPartitions("key", "first", "sh")
    verdicts = materialize(shards.mapInArrow(_judged(min_words), "key long, sh long, firsts array<long>"), "verdicts")

    mask = F.aggregate(F.transform("firsts", lambda m, i: F.when(m < F.col("o"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    covered = cut.select("key", "sh", "o", "th", "s").join(verdicts, ["key", "sh"]).select("o", "th", "s", mask.alias("mask")).where("mask <> 0")
    covered = materialize(covered.groupBy("o", "th").agg(F.collect_set(F.struct("s", "mask")).alias("marks")), "covered")
    discard(cut)
    discard(verdicts)
    whole = own.join(covered.hint("shuffle_hash"), ["o", "th"], "left").select("doc_id", "text", "marks")
    return whole.mapInArrow(_removed(min_words), "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what dedup_substrings() returns."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + (s["end"] - s["start"]).cast("long"))
    return found.select("doc_id", "n_words", n.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
