"""Groups of texts alike: an exact set-similarity self-join with a prefix filter, and its components.

A text's set holds the hashes of its word shingles.  Any order of all hashes makes a prefix filter: of two sets at the
similarity or above, both have a common hash among their first n - ceil(similarity n) + 1.  Rare hashes come first here
(as counters that hashes share tell, which changes the cost and no result), so passages that many texts share are in no
prefix.  Of a hash that at most HOT sets have in their prefixes each pair is counted, and pairs with so many common hashes
there that the similarity can be reached are linked.  Rows of other hashes are put in order of size, and neighbours are
linked while their sizes allow the similarity: so many links as rows, however often a hash occurs; a pair that has such a
hash in common hangs together by these.  What hangs together by links is a family; the sets of a family meet in
one task, or in pairs of blocks where they are too many for one, and are compared as a search does: each set with those
not yet reached.  Equal sets count once throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.shipping import ship
from palimpsest.tables import discard, own_shuffles, small, spread_once, written

#: Hashes of about so many texts at most are counted, in so many counters.
SAMPLE_ROWS = 1 << 22
COUNTERS = 1 << 22
_CHUNK = 1 << 16
HOT = 32
BLOCK_BYTES = 16 << 20
#: So many links are put together in one task; more by rounds over tables.
ONE_TASK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `shingle` words; fewer words are one run, none give no hash."""
    words = text.encode().split()
    h = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(len(h), shingle)
    sums = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        sums = (sums ^ h[k : k + len(sums)]) * _ODD
        sums ^= sums >> np.uint64(29)
    return np.unique(sums)


def _set_key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 5) - (1 << 63)


def _each(batch: pa.RecordBatch, shingle: int, at_once: int = 500) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for at in range(0, batch.num_rows, at_once):
        part = batch.slice(at, at_once)
        yield part, [shingle_set(x or "", shingle) for x in part.column(part.num_columns - 1).to_pylist()]


def _counters(shingle: int):
    """A task's counters, in chunks that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(COUNTERS, np.int64), [np.zeros(0, np.uint64)]
        for batch in batches:
            for _, sets in _each(batch, shingle):
                held += sets
                if sum(map(len, held)) > COUNTERS // 4:
                    total += np.bincount(_counter(np.concatenate(held)), minlength=COUNTERS)
                    held = held[:1]
        total += np.bincount(_counter(np.concatenate(held)), minlength=COUNTERS)
        for i, part in enumerate(np.minimum(total, (1 << 16) - 1).astype(np.uint16).reshape(-1, _CHUNK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(part.as_buffer(), np.uint16)
            sums[i] = sums[i] + own if i in sums else own.astype(np.uint32)
    for i, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "counts"])


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)


def _signed(shingle: int, similarity: float, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for part, sets in _each(batch, shingle):
                prefixes = []
                for own in sets:
                    n = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
                    prefixes.append(own[np.lexsort((own, often[_counter(own)]))[:n]].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_set_key(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), lists], ["id", "key", "size", "prefix"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _each(batch, shingle):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in sets], pa.binary())], ["family", "key", "own"])

    return run


def forest(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Links that connect what pairs at the similarity or above connect: each search compares with the sets not yet reached."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(codes, np.cumsum(sizes)[:-1])
    held = np.zeros(int(codes.max()) + 1, bool)
    left = np.arange(len(sets))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            # sizes alone rule most out
            fits = (sizes[left] >= similarity * sizes[at]) & (sizes[at] >= similarity * sizes[left])
            some = left[fits]
            if not len(some):
                continue
            held[own[at]] = True
            both = np.add.reduceat(held[np.concatenate([own[x] for x in some])], np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
            held[own[at]] = False
            near = some[both >= similarity * (sizes[some] + sizes[at] - both) - 1e-9]
            yield from ((int(at), int(x)) for x in near)
            queue.extend(near)
            left = np.setdiff1d(left, near, assume_unique=True)


def _verified(similarity: float):
    def told(keys: list[int], sets: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(keys) > 1:
            found = [(keys[a], keys[b]) for a, b in forest([np.frombuffer(x, np.uint64) for x in sets], similarity)]
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


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (its least node), a table, of edges(a long, b long); nodes without an edge are left out.

    Beyond one_task edges: each node points at its least neighbour, pointers are followed until they stand, and the edges
    go on between where they point; each round at least halves what is left of a component.
    """
    ship(edges.sparkSession)
    live = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known = None
    while (n := live.count()) > one_task:
        ends = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("up")), "pointers")
        while True:
            next_ = to.select(F.col("node").alias("up"), F.col("up").alias("above"))
            moved = written(to.join(next_, "up").select("node", F.col("above").alias("up"), (F.col("above") != F.col("up")).alias("moved")), "pointers")
            discard(to)
            to = moved
            if to.where("moved").isEmpty():
                break
        step = to.select("node", "up")
        if known is None:
            whole = written(step, "components")
        else:
            further = step.select(F.col("node").alias("up"), F.col("up").alias("above"))
            whole = written(known.join(further, "up", "left").select("node", F.coalesce("above", "up").alias("up")), "components")
            discard(known)
        known = whole
        a, b = (step.select(F.col("node").alias(x), F.col("up").alias(f"r{x}")) for x in "ab")
        rest = live.join(a, "a").join(b, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        last, live = live, written(rest, "links")
        discard(last, to)
    last = live.coalesce(1).mapInArrow(_joined, "node long, component long")
    if known is None:
        found = written(last, "components")
    elif n:
        further = last.select(F.col("node").alias("up"), "component")
        found = written(known.join(further, "up", "left").select("node", F.coalesce("component", "up").alias("component")), "components")
        discard(known)
    else:
        found = written(known.withColumnRenamed("up", "component"), "components")
        discard(known)
    discard(live)
    return found


def _counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How often hashes occur, all hashes of one counter together: an array of COUNTERS, summed by chunks."""
    some = texts.sample(min(1.0, SAMPLE_ROWS / max(1, texts.count())), 7) if SAMPLE_ROWS else texts.limit(0)
    each = some.select("text").mapInArrow(_counters(shingle), "chunk int, counts binary")
    with own_shuffles(texts.sparkSession):
        found = each.repartition("chunk").mapInArrow(_summed, "chunk int, counts binary").toArrow()
    out = np.zeros((COUNTERS // _CHUNK, _CHUNK), np.uint32)
    for i, part in zip(found["chunk"].to_pylist(), found["counts"].to_pylist(), strict=True):
        out[i] = np.frombuffer(part, np.uint32)
    return out.reshape(-1)


def _links(nodes: DataFrame, similarity: float, hot: int) -> tuple[DataFrame, DataFrame]:
    """a, b: links of nodes(key, size, prefix) by which all pairs at the similarity hang together, and the table they read."""
    rows = nodes.select("key", "size", F.size("prefix").alias("own"), F.explode("prefix").alias("h"))
    shared = written(rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("m > 1"), "shared")
    order = Window.partitionBy("h").orderBy("size", "key")
    fits = F.col("smaller") >= similarity * F.col("size") - 1e-9
    near = shared.where(F.col("m") > hot).select("key", "size", F.lag("key").over(order).alias("b"), F.lag("size").over(order).alias("smaller"))
    near = near.where(fits).select(F.col("key").alias("a"), "b")
    one = shared.where(F.col("m") <= hot)
    before = F.collect_list(F.struct(F.col("key").alias("b"), F.col("size").alias("smaller"), F.col("own").alias("others"))).over(order.rowsBetween(-hot, -1))
    pairs = one.withColumn("before", before).select(F.col("key").alias("a"), "size", "own", F.inline("before")).where(fits)
    # common hashes are those counted, and some of what one of both has after its prefix
    common = F.count(F.lit(1)) + F.greatest(F.first("size") - F.first("own"), F.first("smaller") - F.first("others"))
    least = similarity / (1 + similarity) * (F.first("size") + F.first("smaller")) - 1e-6
    counted = pairs.groupBy("a", "b").agg((common >= least).alias("reaches")).where("reaches").select("a", "b")
    return near.unionByName(counted), shared


def similar_groups(documents: DataFrame, shingle: int = 5, similarity: float = 0.8, block_bytes: int = BLOCK_BYTES, hot: int | None = None) -> DataFrame:
    """id, group: a table of the documents(id, text) that have a partner; group is the least id of its component.

    Linked: equal sets of word shingles, or a Jaccard similarity of at least that.  Every such pair of texts is in one
    group.  Ids are distinct and not null.  Texts without a word (null, empty) have no partner.
    """
    spark = ship(documents.sparkSession)
    kind = dict(documents.dtypes)["id"]
    # texts are read three times; a scan that is to be dealt out is dealt once
    texts = spread_once(documents.select("id", F.coalesce("text", F.lit("")).alias("text")), "texts")
    counts = spark.sparkContext.broadcast(_counts(texts, shingle))
    own = written(texts.mapInArrow(_signed(shingle, similarity, counts), f"id {kind}, key long, size int, prefix array<long>").where("size > 0"), "prefixes")
    nodes = own.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    nodes = written(nodes, "nodes")
    near, shared = _links(nodes, similarity, HOT if hot is None else hot)
    hanging = components(near)
    families = hanging.select(F.col("node").alias("key"), F.col("component").alias("family"))
    members = written(families.join(nodes.select("key", F.col("least").alias("id")), "key"), "members")
    # the texts of one document a set are read again
    again = texts.join(small(members), "id").select("family", "key", "text")
    sets = written(again.mapInArrow(_sets(shingle), "family long, key long, own binary"), "sets")
    discard(texts, shared)
    blocks = F.ceil(F.sum(F.length("own").cast("long")) / F.lit(block_bytes)).cast("int")
    sized = written(sets.groupBy("family").agg(F.greatest(blocks, F.lit(1)).alias("blocks")), "families")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")

    def pair(j: Column) -> Column:
        return F.xxhash64("family", F.least("mine", j), F.greatest("mine", j))

    dealt = sets.join(small(sized), "family").withColumn("mine", mine).select("key", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("group"))
    links = dealt.select("group", "key", "own").repartition("group").sortWithinPartitions("group", "key").mapInArrow(_verified(similarity), "a long, b long")
    linked = components(links)
    roots = nodes.select("key", "least", "n").join(linked.withColumnRenamed("node", "key"), "key", "left").where("component is not null or n > 1")
    roots = written(roots.withColumn("root", F.coalesce("component", "key")), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("group"))
    told = written(roots.join(least, "root").select("key", "group"), "groups")
    # a set that very many documents have is dealt to many tasks
    salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    found = own.select("id", "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(salted, ["key", "salt"]).select("id", "group")
    found = written(found, "similar")
    discard(own, nodes, hanging, members, sets, sized, linked, roots, told)
    return found
