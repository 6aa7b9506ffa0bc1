"""SimHash near-dedup by multi-index hashing, in two forms.

near_duplicates(): fingerprints of 64 bits are linked at 3 or fewer differing bits.  Two 32-bit segments leave one of them with at most
one differing bit, so each distinct fingerprint enumerates the Hamming ball of radius 1 around each segment (setting
one zero bit; the partner with the bit set keeps its own segment) and fetches the table rows of those segment values.
Probes whose value no fingerprint has are dropped by a semi-join.  What meets in a value is a set of distinct
fingerprints, compared by complete distance; of the links in it only a spanning forest is returned, so a group of
thousands of near copies gives thousands of links and not millions.  Components of those links are found in Spark.

near_copies(): texts are linked at a Jaccard similarity of their word shingles.  As many edits move more than 3 of 64
bits, its fingerprints have 16 segments of 32 bits, each with its table; a fingerprint is entered under the Hamming ball of
radius 1 around each segment (again by setting one zero bit), so that segments meet which differ in one bit, or in two
either way.  Links of up to 106 differing bits of all 512 are candidates only.  A bit of a short text turns easily, so
texts of up to 80 shingles have a further table, of as many of their least shingle hashes as no pair at the similarity can
all miss.  A set of candidates that hang together is dealt the shingle sets of its texts once, in blocks of bounded bytes,
and exact similarity decides, again by spanning forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import connected_components, discard, materialize, named
from palimpsest.shipping import ship

BITS = 3
SHINGLE = 3
#: The fingerprints of near_copies(), and how many of their bits a candidate link may miss.
SEGMENTS, WIDTH, REACH = 16, 32, 106
#: Texts of so many shingles have all their near copies found by the further table.
BRIEF = 80
#: Shingle sets of so many bytes are compared in one task; larger sets of candidates are dealt as pairs of such blocks.
BLOCK_BYTES = 16 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the XXH64 (seed 42) of the shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _printed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp long (the 64 bits)."""
    ship(docs.sparkSession)
    own = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    return own.mapInArrow(_printed(shingle), f"doc_id {own.schema[0].dataType.simpleString()}, fp long")


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each fingerprint: segment number, segment value, and whether the value is its own."""
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(whole), 20_000):
            fp = whole[at : at + 20_000]
            for segment in (0, 1):
                value = ((fp >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                bits = np.int64(1) << np.arange(32, dtype=np.int64)
                row, bit = np.nonzero((value[:, None] & bits) == 0)
                keys = np.concatenate([value, value[row] | bits[bit]])
                own = np.r_[np.ones(len(fp), bool), np.zeros(len(row), bool)]
                yield pa.RecordBatch.from_arrays([pa.array(keys * 2 + segment), pa.array(np.concatenate([fp, fp[row]]).view(np.int64)), pa.array(own)], ["key", "fp", "own"])


def _forest(bits: int):
    """Links between the fingerprints that meet in a segment value: one search per component, none between all pairs.

    A search compares a fingerprint with those not yet reached, and only what it reaches is searched from, so a group of
    near copies is left after a few steps; 8 bytes a fingerprint are held.
    """

    def links(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = np.arange(len(fp))
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = np.bitwise_count(fp[left] ^ fp[at]) <= bits
                if near.any():
                    reached = left[near]
                    yield np.full(len(reached), fp[at]), fp[reached]
                    queue.extend(reached)
                    left = left[~near]

    def group(fp: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if own.any():
            yield from links(np.unique(fp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, (fp, own) in _grouped(batches, 2):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            found = [p for a, b in zip(starts, [*starts[1:], len(keys)], strict=True) if b - a > 1 for p in group(fp[a:b].view(np.uint64), own[a:b])]
            if found:
                yield _pairs(found)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Keys and n columns of rows sorted by key, a key's rows all at once; what is held is joined only where a key ends."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n + 1)]
        if not len(x[0]):
            continue
        last = int(np.searchsorted(x[0], x[0][-1]))
        if held and (last or held[-1][0][-1] != x[0][0]):
            held.append([c[:last] for c in x])
            keys, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
            yield keys, rest
            held = []
        elif last:
            yield x[0][:last], [c[:last] for c in x[1:]]
        held.append([c[last:] for c in x])
    if held:
        keys, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
        yield keys, rest


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in found]).view(np.int64)) for i in (0, 1)], ["a", "b"])


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: pairs of distinct fingerprints of prints(fp) that link up all that are within bits (0 to 3) of each other."""
    ship(prints.sparkSession)
    if not 0 <= bits <= 3:
        raise ValueError("two segments serve 3 differing bits at most")
    probes = materialize(prints.select("fp").mapInArrow(_probes, "key long, fp long, own boolean"), "probes")
    met = probes.where("not own").join(probes.where("own").select("key").distinct(), "key", "left_semi").unionByName(probes.where("own"))
    return met.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_forest(bits), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fp long, fingerprint string (16 hexadecimal digits), component_id.

    component_id is the least doc_id among the documents reachable over links, itself included.
    Null or empty text: fingerprint zero, linked as any other.  Null id: never a component's name unless no document of
    it has an id.  Repeated rows: a row each.  Other columns, of any name, are left out.  No rows: none.
    """
    own = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    told = _placed(nodes, connected_components(links(nodes, bits)).withColumnRenamed("node", "fp"), "fp")
    discard(nodes)
    return _told(own, told, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def shingles(h: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of hashed words; fewer words than that are one shingle."""
    if not len(h):
        return np.empty(0, np.uint64)
    n = max(1, len(h) - shingle + 1)
    sums = np.full(n, min(len(h), shingle), np.uint64)
    for k in range(min(len(h), shingle)):
        sums = _mixed((sums ^ h[k : k + n]) * _ODD)
    return np.unique(sums)


def segments(h: np.ndarray) -> np.ndarray:
    """SEGMENTS numbers of WIDTH bits: of the distinct words, a bit is set if over half of their hashes have it."""
    h = np.unique(h)
    ones = np.zeros(SEGMENTS * WIDTH, np.int64)
    for at in range(0, len(h), 4096):  # bounded memory for very long texts
        part = h[at : at + 4096]
        each = np.stack([_mixed(part + np.uint64((i + 1) * int(_ODD) % 2**64)) for i in range(SEGMENTS // 2)], 1)
        ones += np.unpackbits(each.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<i4")


def _set_key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 7)


def _list(columns: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, columns)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(columns) if columns else [], kind))


def _signed(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, briefs = [], [], []
            for text in batch.column(1).to_pylist():
                h = word_hashes(text)
                own = shingles(h, shingle)
                keys.append(_set_key(own))
                parts.append(segments(h))
                least = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if 0 < len(own) <= BRIEF else 0
                briefs.append(own[:least].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), _list(parts, pa.int32()), _list(briefs, pa.int64())], ["doc_id", "key", "parts", "brief"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each node is entered: under its segments, under them with a zero bit set, and under its least shingles (below zero)."""
    bits = np.int64(1) << np.arange(WIDTH, dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            keys = batch.column(0).slice(at, 2000).to_numpy(zero_copy_only=False)
            parts = batch.column(1).slice(at, 2000).flatten().to_numpy(zero_copy_only=False).reshape(-1, SEGMENTS).view(np.uint32).astype(np.int64)
            row, segment, bit = np.nonzero((parts[:, :, None] & bits) == 0)
            brief = batch.column(2).slice(at, 2000)
            least = brief.flatten().to_numpy(zero_copy_only=False)
            places = [(parts * SEGMENTS + np.arange(SEGMENTS)).ravel(), (parts[row, segment] | bits[bit]) * SEGMENTS + segment, least | np.int64(-(2**63))]
            whose = [np.repeat(keys, SEGMENTS), keys[row], np.repeat(keys, brief.value_lengths().to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), pa.array(np.concatenate(whose))], ["at", "key"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by place those of places that two nodes have."""
    for at, (keys,) in _grouped(batches, 1):
        new = np.r_[True, at[1:] != at[:-1]]
        alone = new & np.r_[new[1:], True]
        yield pa.RecordBatch.from_arrays([pa.array(at[~alone]), pa.array(keys[~alone])], ["at", "key"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of what meets in a table's value within REACH bits, by complete distance."""
    for at, (keys, prints) in _lists(batches):
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        a, b = [], []
        for i, j in zip(starts, [*starts[1:], len(at)], strict=True):
            k, first = np.unique(keys[i:j], return_index=True)
            x, left = prints[i:j][first], np.arange(len(k))
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    one = queue.pop()
                    near = np.bitwise_count(x[left] ^ x[one]).sum(1) <= REACH
                    if near.any():
                        a.append(np.full(int(near.sum()), k[one]))
                        b.append(k[left[near]])
                        queue.extend(left[near])
                        left = left[~near]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    def rows() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, SEGMENTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(parts[:, i])) for i in range(SEGMENTS))], ["at", "key", *map(str, range(SEGMENTS))])

    for at, (keys, *parts) in _grouped(rows(), 1 + SEGMENTS):
        yield at, (keys, np.stack(parts, 1).view(np.uint32))


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [shingles(word_hashes(x), shingle) for x in batch.column(0).slice(at, 1000).to_pylist()]
                keys = np.array([_set_key(x) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "own"])

    return run


def _similar(keys: list[int], sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs at the similarity or above: each search compares with what is not yet reached."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(codes, np.cumsum(sizes)[:-1])
    held = np.zeros(codes.max() + 1, bool)
    left = np.arange(len(keys))
    flat, starts = codes, np.r_[0, np.cumsum(sizes)[:-1]]

    def keep(some: np.ndarray) -> None:
        nonlocal left, flat, starts
        flat = flat[np.repeat(some, sizes[left])]
        left = left[some]
        starts = np.r_[0, np.cumsum(sizes[left])[:-1]] if len(left) else left

    while len(left) > 1:
        queue = [left[0]]
        keep(left != queue[0])
        while queue and len(left):
            at = queue.pop()
            held[parts[at]] = True
            both = np.add.reduceat(held[flat], starts, dtype=np.int64)
            held[parts[at]] = False
            near = both >= similarity * (sizes[left] + sizes[at] - both)
            if near.any():
                yield from ((keys[at], keys[x]) for x in left[near])
                queue.extend(left[near])
                keep(~near)


def _verified(similarity: float):
    def told(keys: list[int], sets: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(keys) > 1:
            found = list(_similar(keys, [np.frombuffer(x, np.uint64) for x in sets], similarity))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sets = None, [], []
        for batch in batches:
            for g, k, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if g != group:
                    yield from told(keys, sets)
                    group, keys, sets = g, [], []
                keys.append(k)
                sets.append(x)
        yield from told(keys, sets)

    return run


def near_links(nodes: DataFrame) -> DataFrame:
    """a, b: candidate links between the nodes(key long, parts) of different texts, from the tables of all segments."""
    ship(nodes.sparkSession)
    entered = nodes.select("key", "parts", "brief").mapInArrow(_entries, "at long, key long")
    met = materialize(entered.repartition("at").sortWithinPartitions("at").mapInArrow(_met, "at long, key long"), "met")
    dealt = met.join(nodes.select("key", "parts"), "key").select("at", "key", "parts")
    return dealt.repartition("at").sortWithinPartitions("at").mapInArrow(_candidates, "a long, b long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, component_id, the least doc_id among those reachable over pairs of the similarity.

    similarity: Jaccard, of the sets of word shingles; a text of fewer words is one shingle.  doc_id may be of any type
    that has an order, structs included.  Null or empty texts are copies of each other.  Null id: never a component's
    name unless no document of it has an id.  Repeated rows: a row each.  Other columns, of any name, are left out.  No
    rows: none.  A pair of texts over 80 shingles is missed only if its fingerprints differ too much in all 16 segments; the
    README has the measured recall.
    """
    ship(docs.sparkSession)
    kind = docs.select(named(doc_id)).schema[0].dataType.simpleString()
    texts = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    own = materialize(texts.mapInArrow(_signed(shingle, similarity), f"doc_id {kind}, key long, parts array<int>, brief array<long>"), "signatures")
    nodes = materialize(own.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("parts").alias("parts"), F.first("brief").alias("brief")), "nodes")
    near = materialize(near_links(nodes), "near")
    families = materialize(connected_components(near).withColumnRenamed("node", "key").withColumnRenamed("component", "family"), "families")
    some = families.join(nodes.select("key", "least"), "key").select(F.col("least").alias("_least")).distinct()
    again = texts.join(some, texts["doc_id"].eqNullSafe(some["_least"]), "left_semi").select("text")
    sets = materialize(again.mapInArrow(_sets(shingle), "key long, own binary").join(families, "key").dropDuplicates(["key"]), "sets")
    # a family beyond block_bytes is cut into blocks, and each pair of blocks is a group of its own: all pairs of texts meet
    blocks = F.ceil(F.sum(F.length("own").cast("long")) / F.lit(block_bytes)).cast("int")
    sized = sets.groupBy("family").agg(F.greatest(blocks, F.lit(1)).alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")

    def pair(j: Column) -> Column:
        return F.xxhash64("family", F.least("mine", j), F.greatest("mine", j))

    dealt = sets.join(sized, "family").withColumn("mine", mine).select("key", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("group"))
    links = dealt.select("group", "key", "own").repartition("group").sortWithinPartitions("group", "key").mapInArrow(_verified(similarity), "a long, b long")
    told = _placed(nodes, connected_components(links).withColumnRenamed("node", "key"), "key")
    discard(near, families, sets, nodes)
    return _told(own, told, "key").select("doc_id", "component_id")


def _placed(nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Of each node (key, least) the least id of its component."""
    placed = nodes.select(key, "least").join(roots, key, "left").withColumn("root", F.coalesce("component", key))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(placed.select(key, "root").join(least, "root").select(key, "component_id"), "components")


def _told(own: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """own(doc_id, key) with component_id; a key that a third of the corpus has is dealt to many tasks by salt."""
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(told, [key, "salt"])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what near_duplicates() returns."""
    return found.select("doc_id", "fingerprint", "component_id")
