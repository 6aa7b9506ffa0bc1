"""Mixing sources to target weights by weighted fair queueing.

Targets: sources share the budget by weight, none above `repeats` times its size, the excess shared anew (water level,
found in closed form over one row per source).  Each source's documents are shuffled by a hash of their id and queued
`repeats` times; each copy's virtual finish time is the words of its source up to its end, over the source's target.  The
copies of all sources are put in order of finish time, words are summed up in that order over all sources, and the queue
is cut at the total budget, the sum of the targets' whole words.  The copy in which a source reaches its target
(virtual time 1) is queued as two packets, cut there, so that each source gets its target to the word and not to the
document.

Neither running sum is one window over all rows, or over a source that may have a third of them: both orders are cut
into blocks of about BLOCK rows (ranges of the hash, ranges of the finish time), blocks are summed up, runs of blocks
next, and each block is sorted by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, discard, materialize, named, prefix_sums

BLOCK = 1024
CYCLE = (3, 1, 2)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, repeats: int = 2, weights: Column | None = None) -> DataFrame:
    """sizes(source, source_size long) -> with target double.

    weights: an expression over source; by default sources weigh CYCLE in order of code points, null last.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = weights if weights is not None else F.element_at(F.array(*map(F.lit, CYCLE)), (rank % len(CYCLE) + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    everything = Window.partitionBy()
    s = s.withColumns({"budget": F.sum("source_size").over(everything) * F.lit(share), "all_weight": F.sum("weight").over(everything), "full_at": F.col("cap") / F.col("weight")})
    earlier = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"cap_before": F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))})
    # a source is full if the level of all that are not full before it lies above it; full ones come first in this order
    s = s.withColumn("full", F.col("full_at") < (F.col("budget") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    s = s.withColumns({"cap_full": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything), "weight_left": F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)})
    level = F.col("weight") * (F.col("budget") - F.col("cap_full")) / F.col("weight_left")
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, repeats: int = 2, weights: Column | None = None, seed: str = "mix", row: str | None = None) -> DataFrame:
    """One row per row of docs, range-sorted by finish: doc_id, source, size, source_size long, target double,
    taken long (words, repeats counted), finish double (virtual finish time of the first copy; null without a target).

    taken sums to floor(target) for each source; no document exceeds repeats times its size.  Reruns agree.
    row: a column that tells all rows apart, returned as row.
    Null text: size 0.  Null source: a source of its own, last.  Null id: shuffled by the text.  Rows of one id follow
    each other, in order of their sizes and hashes of their texts (one id's rows have to fit one task); repeated rows: a
    row each.  Other columns, of any name, are left out.  No rows: none.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(named(doc_id).cast("string"), F.concat(F.lit(":"), F.xxhash64(named(text)).cast("string")))).cast("binary"))
    whole = docs.select(named(doc_id).alias("doc_id"), named(source).alias("source"), n_words(named(text)).alias("size"), key.alias("key"), F.xxhash64(named(text)).alias("th"), (named(row) if row else F.lit(None)).alias("row"))
    own = materialize(whole.withColumn("no", F.monotonically_increasing_id()), "sizes")
    n = own.count()
    blocks = max(1, -(-n // BLOCK))
    hashed = own.withColumn("block", F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * blocks, 28))
    sums = materialize(hashed.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    aims = materialize(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), share, repeats, weights), "targets")
    null_safe = [F.col("l.source").eqNullSafe(F.col("r.source"))]
    sums = prefix_sums(sums, "block", "words", "source").alias("l").join(aims.alias("r"), null_safe).select("l.source", "block", F.col("before").alias("words_before"), "source_size", "target")
    placed = hashed.alias("l").join(sums.alias("r"), [*null_safe, F.col("l.block") == F.col("r.block")]).select("no", "doc_id", "row", "l.source", "l.block", "size", "key", "th", "words_before", "source_size", "target")
    upto = F.col("words_before") + F.sum("size").over(Window.partitionBy("source", "block").orderBy("key", "doc_id", "size", "th", "no").rowsBetween(Window.unboundedPreceding, 0))
    placed = materialize(placed.withColumn("upto", upto).drop("words_before", "block", "th"), "queue")

    # packets: each copy, cut where its source reaches its target
    copies = placed.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    end = F.col("upto") + F.col("copy") * F.col("source_size")
    room = F.floor("target").cast("long")
    cut = F.greatest(end - F.col("size"), F.least(end, room))
    parts = F.array(F.struct((cut - end + F.col("size")).alias("words"), cut.alias("end")), F.struct((end - cut).alias("words"), end.alias("end")))
    packets = copies.select("no", "source", "key", "copy", "target", F.explode(parts).alias("p")).where("p.words > 0")
    packets = packets.select("no", "source", "key", "copy", F.col("p.words").alias("words"), (F.col("p.end") / F.col("target")).alias("finish"))
    packets = packets.withColumn("block", F.floor(F.col("finish") * F.lit(float(max(1, -(-3 * n // (2 * BLOCK)))))).cast("long"))
    served = prefix_sums(materialize(packets.groupBy("block").agg(F.sum("words").alias("words")), "served"), "block", "words").select("block", "before")
    order = Window.partitionBy("block").orderBy("finish", "source", "key", "no", "copy").rowsBetween(Window.unboundedPreceding, 0)
    packets = packets.join(served, "block").withColumn("before", F.col("before") + F.sum("words").over(order) - F.col("words"))
    budget = aims.agg(F.coalesce(F.sum(room), F.lit(0)).alias("n")).first().n
    got = packets.where(F.col("before") < budget).withColumn("got", F.least("words", F.lit(budget) - F.col("before")))
    taken = got.groupBy("no").agg(F.sum("got").alias("taken"))
    finish = F.when(F.col("target") > 0, F.col("upto") / F.col("target"))
    mixed = placed.join(taken, "no", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), finish.alias("finish"), *(["row"] if row else []))
    mixed = materialize(mixed, "mixed")
    discard(own, placed)
    return mixed.repartitionByRange("finish", "source", "doc_id").sortWithinPartitions("finish", "source", "doc_id")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what mix() returns."""
    return found.select("doc_id", "size", "source_size", "target", "taken")
