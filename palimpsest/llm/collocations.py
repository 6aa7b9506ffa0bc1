"""Phrase collocations: depth-limited count tries per shard, merged by prefix range, cut by walks and suffix links.

1. Each task turns its texts into shards: a sorted dictionary of words, and the words' places in it (-1 between pieces).
2. Words are counted, and word pairs (as hashes) of words frequent enough; both leave a bitmap of at most 16 MB, which is
   broadcast.  Triples of such pairs are counted in 2^24 counters that each task fills and sends as blocks; they leave a
   bitmap of 2 MB.  A phrase is as frequent as its rarest part at most, so a trie may end a path at a part that the bitmaps
   lack.  What else a bit lets pass (all, where a corpus has some 10^9 triples of frequent pairs) costs rows and no result.
3. Each shard counts its phrases in a trie of depth 5, level by level, and serialises it in order of paths, cut into blocks
   by range of the (hashed) prefix of two words: sorted runs.
4. A range's runs are merged k ways; equal paths add up.  As the merge goes on in the order of paths it is a walk of the
   trie below its prefixes: the counts of the nodes above are on its stack, and those are the left parts.  The first word's
   own count is joined.
5. A node's suffix link leads to its path without the first word; k links lead to the right part after k words.  All links
   are followed in one join of the nodes with themselves.

Nothing is estimated: counts, scores and the list are exact at any size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, materialize, named, small
from palimpsest.shipping import ship

SHARD_WORDS = 1 << 20
SLICE_BYTES = 1 << 20
MOST_BITS = 1 << 27
COUNTERS = 1 << 24
BLOCK = 1 << 12
RANGE_WORDS = 500_000
CURSOR_ROWS = 256
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_END = b"."  # no word has one
_SHARD = "lang string, words array<string>, counts array<long>, n long, codes binary"


def words_of(texts: list[str]) -> list[bytes]:
    """The words of the texts, A to Z in lower case, with a full stop between pieces."""
    return "\n".join(texts).encode().lower().translate(_ENDS).replace(b"\n", b" . ").split()


def _shards(shard_words: int):
    def written(lang: str, parts: list[pa.Array]) -> pa.RecordBatch | None:
        coded = pa.chunked_array(parts).unify_dictionaries().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        known = coded.dictionary.cast(pa.string())
        order = pc.sort_indices(known).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        codes = place[coded.indices.to_numpy(zero_copy_only=False)]
        words = known.take(pa.array(order))
        end = pc.index(words, _END.decode()).as_py()
        if end >= 0:
            codes = np.where(codes == end, -1, codes - (codes > end)).astype(np.int32)
            words = pa.concat_arrays([words[:end], words[end + 1 :]])
        if not len(words):
            return None
        counts = np.bincount(codes[codes >= 0], minlength=len(words))
        whole = pa.array([0, len(words)], pa.int32())
        row = [pa.array([lang]), pa.ListArray.from_arrays(whole, words), pa.ListArray.from_arrays(whole, pa.array(counts, pa.int64())), pa.array([int(counts.sum())]), pa.array([codes.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(row, ["lang", "words", "counts", "n", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}

        def take(lang: str, texts: list[str]) -> Iterator[pa.RecordBatch]:
            words = pa.array([*words_of(texts), _END], pa.binary()).dictionary_encode()
            held.setdefault(lang, []).append(words)
            sizes[lang] = sizes.get(lang, 0) + len(words)
            while sizes and (max(sizes.values()) >= shard_words or sum(sizes.values()) >= 2 * shard_words):
                yield from give(max(sizes, key=sizes.get))

        def give(lang: str) -> Iterator[pa.RecordBatch]:
            del sizes[lang]
            row = written(lang, held.pop(lang))
            if row is not None:
                yield row

        for batch in batches:
            waiting: dict[str, list[str]] = {}
            size = 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(text)
                size += len(text)
                if size >= SLICE_BYTES:
                    for x, texts in waiting.items():
                        yield from take(x, texts)
                    waiting, size = {}, 0
            for x, texts in waiting.items():
                yield from take(x, texts)
        for lang in list(sizes):
            yield from give(lang)

    return run


def bitmap(hashes: DataFrame, most: int, bits: int = MOST_BITS) -> np.ndarray:
    """A bit for each of hashes(h long), of which there are `most` at most: bytes, at most bits / 8 of them, least bit first."""
    size = 1 << 15
    while size < min(bits, 16 * most):
        size *= 2
    at = F.pmod("h", F.lit(size)) + 1
    rows = hashes.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in rows.collect():
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _word_hashes(lang: str, words: list[str]) -> np.ndarray:
    """As Spark's xxhash64(lang, word)."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def _pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for batch in batches:
        lang, words, codes = (batch.column(batch.schema.get_field_index(c)) for c in ("lang", "words", "codes"))
        for i in range(batch.num_rows):
            yield lang[i].as_py(), words[i].values, np.frombuffer(codes[i].as_buffer(), np.int32)


def _both(codes: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Places of pairs of living words."""
    ok = np.zeros(len(codes), bool)
    ok[codes >= 0] = alive[codes[codes >= 0]]
    return np.flatnonzero(ok[:-1] & ok[1:])


def _pairs(frequent):
    """The tries of depth two, as hashes of pairs with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes in _rows(batches):
            h = _word_hashes(lang, words.to_pylist())
            at = _both(codes, _known(frequent.value, h))
            keys, n = np.unique(codes[at].astype(np.int64) * len(h) + codes[at + 1], return_counts=True)
            found = _pair_hashes(h[keys // len(h)], h[keys % len(h)]).view(np.int64)
            for i in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["h", "n"])

    return run


def _living_pairs(h: np.ndarray, codes: np.ndarray, frequent: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Does the pair at each place (all but the last) live, and its hash where both words do."""
    at = _both(codes, _known(frequent, h))
    told, alive = np.zeros(max(0, len(codes) - 1), np.uint64), np.zeros(max(0, len(codes) - 1), bool)
    told[at] = _pair_hashes(h[codes[at]], h[codes[at + 1]])
    alive[at] = _known(pairs, told[at])
    return alive, told


def _triples(frequent, pairs):
    """Counters of a task's triples of living pairs, in blocks: places in the block, then counts of up to 65535, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.uint16)
        for lang, words, codes in _rows(batches):
            h = _word_hashes(lang, words.to_pylist())
            alive, told = _living_pairs(h, codes, frequent.value, pairs.value)
            at = np.flatnonzero(alive[:-1] & alive[1:])
            where, n = np.unique(_pair_hashes(told[at], h[codes[at + 2]]) & np.uint64(COUNTERS - 1), return_counts=True)
            where = where.astype(np.int64)
            counters[where] = np.minimum(counters[where] + n, 65535)
        blocks = counters.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        for k in range(0, len(used), 256):
            some = used[k : k + 256]
            at = [np.flatnonzero(blocks[b]).astype(np.uint16) for b in some]
            packed = [x.tobytes() + blocks[b][x].tobytes() for b, x in zip(some, at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], ["block", "counts"])

    return run


def _summed(least: int):
    """Of rows sorted by block, the bits of each block's counters that reach `least` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(BLOCK, np.int64)

        def told() -> pa.RecordBatch:
            bits = np.packbits(total >= min(least, 65535), bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != at:
                    if at is not None:
                        yield told()
                    at, total = block, np.zeros(BLOCK, np.int64)
                where, n = np.frombuffer(counts.as_buffer(), np.uint16).reshape(2, -1)
                total[where] += n
        if at is not None:
            yield told()

    return run


def trie(codes: np.ndarray, alive: np.ndarray, depth: int, triples: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Paths (nodes x depth, -1 beyond a path's end) and counts of a trie of codes, in order of paths, from depth two on.

    alive: does the pair that begins at each place (all but the last) live?  triples: does the triple (all but the last
    two)?  A path ends before a pair or triple that does not.
    """
    if triples is None:
        triples = alive[:-1] & alive[1:]
    at = np.flatnonzero(alive)
    node = codes[at].astype(np.int64)
    paths, counts = [], []
    for d in range(2, depth + 1):
        if d > 2:
            more = at + d - 3 < len(triples)
            more[more] = triples[at[more] + d - 3]
            at, node = at[more], node[more]
        if not len(at):
            break
        # a node is its parent and a word: the place of one of its phrases tells the path
        _, first, node, n = np.unique(node * (int(codes.max()) + 2) + codes[at + d - 1], return_index=True, return_inverse=True, return_counts=True)
        path = np.full((len(n), depth), -1, np.int32)
        path[:, :d] = codes[at[first][:, None] + np.arange(d)]
        paths.append(path)
        counts.append(n)
    if not paths:
        return np.empty((0, depth), np.int32), np.empty(0, np.int64)
    path, n = np.concatenate(paths), np.concatenate(counts)
    order = np.lexsort(path.T[::-1])
    return path[order], n[order].astype(np.int64)


def _tries(frequent, pairs, triples, depth: int, ranges: int):
    """Each shard's trie as a row for each range of prefixes it has: paths in order, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes in _rows(batches):
            h = _word_hashes(lang, words.to_pylist())
            alive, told = _living_pairs(h, codes, frequent.value, pairs.value)
            three = alive[:-1] & alive[1:]
            at = np.flatnonzero(three)
            three[at] = _known(triples.value, _pair_hashes(told[at], h[codes[at + 2]]))
            path, n = trie(codes, alive, depth, three)
            if not len(n):
                continue
            place = (_pair_hashes(h[path[:, 0]], h[path[:, 1]]) >> np.uint64(20)) % np.uint64(ranges)
            order = np.argsort(place, kind="stable")
            path, n, place = path[order], n[order], place[order].astype(np.int32)
            blocks = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1, len(n)].astype(np.int32)
            inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((path >= 0).sum(1))].astype(np.int32)), words.take(pa.array(path[path >= 0])))
            lists = [pa.ListArray.from_arrays(pa.array(blocks), x) for x in (inner, pa.array(n))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(blocks) - 1), pa.string()), pa.array(place[blocks[:-1]]), *lists], ["lang", "range", "paths", "counts"])

    return run


def _cursor(lang: str, paths: pa.Array, counts: pa.Array) -> Iterator[tuple[str, list[str], int]]:
    """A block's nodes in order; only CURSOR_ROWS of them are Python values at a time."""
    for at in range(0, len(paths), CURSOR_ROWS):
        for path, n in zip(paths.slice(at, CURSOR_ROWS).to_pylist(), counts.slice(at, CURSOR_ROWS).to_pylist(), strict=True):
            yield lang, path, n


def walked(nodes: Iterator[tuple[str, list[str], int]], least: int) -> Iterator[tuple[str, list[str], int, list[int | None]]]:
    """Of merged nodes in order of paths those counted `least` times or more: lang, path, count, counts of the nodes above.

    A node above that is not among the nodes counts as None.
    """
    stack: list[tuple[str, int]] = []  # the current path's words and counts, None where a node above is missing
    lang = path = None
    total = 0

    def told() -> Iterator[tuple]:
        nonlocal stack
        if path is None:
            return
        same = 0
        while same < min(len(stack), len(path) - 1) and stack[same][0] == path[same]:
            same += 1
        stack = stack[:same] + [(w, None) for w in path[same:-1]] + [(path[-1], total)]
        if total >= least:
            yield lang, path, total, [n for _, n in stack[:-1]]

    for x, p, n in nodes:
        if p == path and x == lang:
            total += n
            continue
        yield from told()
        if x != lang:
            stack = []
        lang, path, total = x, p, n
    yield from told()


def _merged(least: int):
    """Of blocks sorted by range the merged nodes of each range."""
    kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64())]

    def told(blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = walked(heapq.merge(*(_cursor(*x) for x in blocks)), least)
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], ["lang", "path", "a", "left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = None, []
        for batch in batches:
            lang, place, paths, counts = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                if place[i].as_py() != at:
                    yield from told(blocks)
                    at, blocks = place[i].as_py(), []
                blocks.append((lang[i].as_py(), paths[i].values, counts[i].values))
        yield from told(blocks)

    return run


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Tables of all phrases of one to `longest` words counted `least` times or more, and of the words of each language.

    The first: lang, path array of words, a long, left array of long (the counts of path's first 1, 2, ... words); the second:
    lang, n long.
    Null text: empty; null lang: und.  Repeated rows count each.  Other columns, of any name, are left out.  No rows: none.
    """
    spark = ship(docs.sparkSession)
    own = docs.select(F.coalesce(named(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(named(text), F.lit("")).alias("text"))
    shards = materialize(own.mapInArrow(_shards(shard_words), _SHARD), "shards", "zstd")
    totals = materialize(shards.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    words = shards.select("lang", F.inline(F.arrays_zip(F.col("words").alias("w"), F.col("counts").alias("n"))))
    words = materialize(words.groupBy("lang", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words")
    frequent = spark.sparkContext.broadcast(bitmap(words.select(F.xxhash64("lang", "w").alias("h")), total // least))
    codes = shards.select("lang", "words", "codes")
    both = codes.mapInArrow(_pairs(frequent), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")
    both = materialize(both, "pairs")
    pairs = spark.sparkContext.broadcast(bitmap(both, total // least))
    blocks = codes.mapInArrow(_triples(frequent, pairs), "block int, counts binary").repartition("block").sortWithinPartitions("block")
    bits = np.zeros((COUNTERS // BLOCK, BLOCK // 8), np.uint8)
    for r in blocks.mapInArrow(_summed(least), "block int, bits binary").collect():
        bits[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    triples = spark.sparkContext.broadcast(bits.ravel())
    # more ranges than tasks, so that tasks get about as much
    ranges = max(1, -(-total // RANGE_WORDS), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "lang string, range int, paths array<array<string>>, counts array<long>"
    tries = materialize(codes.mapInArrow(_tries(frequent, pairs, triples, longest, ranges), schema), "tries", "zstd")
    dealt = tries.repartition("range").sortWithinPartitions("range", "lang")
    nodes = materialize(dealt.mapInArrow(_merged(least), "lang string, path array<string>, a long, left array<long>"), "nodes")
    discard(shards, both, tries)
    one = words.select(F.col("lang").alias("_lang"), F.col("w").alias("_w"), F.col("n").alias("_n"))
    first = nodes.join(_small(one, words), (F.col("lang") == F.col("_lang")) & (F.get("path", F.lit(0)) == F.col("_w")))
    left = F.transform("left", lambda n, i: F.when(i == 0, F.col("_n")).otherwise(n))
    none = F.expr("cast(array() as array<long>)").alias("left")
    whole = first.select("lang", "path", "a", left.alias("left")).unionByName(words.select("lang", F.array("w").alias("path"), F.col("n").alias("a"), none))
    whole = materialize(whole, "phrases")
    discard(nodes, words)
    for held in (frequent, pairs, triples):
        held.unpersist()
    return whole, totals


def score_cuts(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Each phrase of two words or more with its lowest-scoring cut: lang, path, a, k, l, r, n, score (all long but path), absorbed boolean.

    score: floor(1000 a n / (l r)), exact.  absorbed: a phrase of one word more, begun or ended by this one, is as frequent.
    """
    cuts = phrases.where(F.size("path") > 1).select("lang", "path", "a", F.posexplode("left").alias("i", "l"))
    cuts = cuts.select("lang", "path", "a", (F.col("i") + 1).alias("k"), "l", F.slice("path", F.col("i") + 2, F.size("path")).alias("rest"))
    ends = phrases.select(F.col("lang").alias("rl"), F.col("path").alias("rp"), F.col("a").alias("r"))
    linked = cuts.join(_small(ends, phrases), (F.col("lang") == F.col("rl")) & (F.col("rest") == F.col("rp"))).drop("rl", "rp")
    linked = linked.join(small(totals), "lang")
    whole = "cast(a as decimal(19,0)) * cast(n as decimal(18,0)) * 1000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    linked = materialize(linked.withColumn("score", F.expr(whole)), "cuts")
    before = linked.where((F.col("k") == F.size("path") - 1) & (F.col("l") == F.col("a"))).select("lang", F.slice("path", 1, F.col("k")).alias("path"))
    after = linked.where((F.col("k") == 1) & (F.col("r") == F.col("a"))).select("lang", F.col("rest").alias("path"))
    inside = before.unionByName(after).where(F.size("path") > 1).distinct().withColumn("absorbed", F.lit(True))
    best = linked.groupBy("lang", "path").agg(F.min(F.struct("score", F.col("k").cast("long").alias("k"), "l", "r", "a", "n")).alias("b"))
    found = best.join(inside, ["lang", "path"], "left")
    return found.select("lang", "path", *(F.col(f"b.{c}").alias(c) for c in ("a", "k", "l", "r", "n", "score")), F.coalesce("absorbed", F.lit(False)).alias("absorbed"))


def _small(view: DataFrame, table: DataFrame) -> DataFrame:
    """A view of a table of materialize(), broadcast if small() would."""
    return F.broadcast(view) if small(table) is not table else view


def top_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each language's first `top` phrases: lang, rank long, phrase, a, l, r, n, score (long).  Rows as count_phrases() takes them."""
    phrases, totals = count_phrases(docs, text, lang, least, longest, shard_words)
    found = score_cuts(phrases, totals).where("not absorbed").withColumn("phrase", F.array_join("path", " "))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's list is that of its 64 parts' lists
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = parts.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
