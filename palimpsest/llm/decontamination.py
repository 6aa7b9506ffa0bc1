"""Benchmark decontamination: size-partitioned MinHash containment search.  DataFrame functions only.

Items are partitioned by size class (powers of two of their shingle count).  An item's signature is the bottom of its
shingles in a random order (MinHash values of one permutation); a class has the signature length at which containment
of the threshold in a document of any length leaves no way to miss all of it, so no candidate is lost.  Documents look
up each of their shingles in the signatures; the candidates alone are verified, by containment of exact shingles.
Items of fewer words than a shingle make the smallest classes: their one shingle is the whole item, looked up among the
word sequences of its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, named, numbered, small

SHINGLE = 5


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(at: Column, make, k: int) -> Column:
    """at: a column that is computed already, as it is read for each shingle."""
    some = F.transform(F.sequence(F.lit(0), F.size(at) - k), lambda i: make(*(F.get(at, i + j) for j in range(k))))
    return F.when(F.size(at) >= k, some)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, shingle: int = SHINGLE) -> DataFrame:
    """One row per document and item: doc_id, item_id, n_shingles, n_found (long), containment double >= threshold.

    containment is the share of the item's distinct word shingles that the document holds; an item of fewer words than a
    shingle is one shingle, found where its words follow each other.  doc_id and item_id may be of any type.
    Null or empty texts and items without a word: no row.  Null ids: as any other id.  Repeated rows, of documents or
    items, give a pair once; rows of one doc_id count as one by the text that holds most.  Other columns, of any name,
    are left out.  No rows: none.
    """
    hashed, exact = (lambda *w: F.xxhash64(*w)), (lambda *w: F.concat_ws(" ", *w))
    bench = items.select(named(item_id).alias("item_id"), words(named(item_text)).alias("w")).where(F.size("w") > 0)
    whole = F.when(F.size("w") < shingle, F.array(F.array_join("w", " "))).otherwise(F.array_distinct(_shingles(F.col("w"), exact, shingle)))
    bench = bench.select("item_id", F.least(F.size("w"), F.lit(shingle)).alias("length"), whole.alias("s")).distinct()
    bench = bench.withColumn("item", F.xxhash64("item_id", "length", F.array_join("s", "|")))
    size = F.size("s").cast("double")
    upper = F.pow(F.lit(2.0), F.floor(F.log2(size)) + 1) - 1  # the largest size of the class
    k = F.least(size, F.floor(F.lit(1 - threshold + 1e-9) * upper) + 1).cast("int")
    bench = materialize(bench.select("item_id", "item", "length", "s", F.size("s").cast("long").alias("n_shingles"), k.alias("k")), "items")

    parts = F.transform("s", lambda x: F.split(x, " "))
    hashes = F.transform("parts", lambda w: F.xxhash64(*(F.get(w, F.lit(j)) for j in range(shingle))))
    order = F.array_sort(F.transform(hashes, lambda h: F.struct(F.xxhash64(F.lit(7), h).alias("rank"), h.alias("h"))))
    long = bench.where(F.col("length") == shingle).withColumn("parts", parts)
    signatures = materialize(long.select("item", F.explode(F.slice(order, 1, F.col("k"))).alias("x")).select("item", F.col("x.h").alias("h")), "item-signatures")
    shingled = materialize(bench.where(F.col("length") == shingle).select("item", F.explode("s").alias("shingle")), "item-shingles")

    docs, row = numbered(docs)
    own = docs.select(named(doc_id).alias("doc_id"), named(row).alias("row"), words(named(text)).alias("w"))
    probes = own.select("row", F.explode(_shingles(F.col("w"), hashed, shingle)).alias("h"))
    candidates = materialize(probes.join(small(signatures), "h").select("row", "item").distinct(), "candidates")

    # exact containment, in the candidates' documents alone, which are few enough to be told to all tasks, or else joined
    asked = materialize(candidates.select("row").distinct(), "asked")
    held = own.join(small(asked), "row", "left_semi").select("doc_id", "row", F.explode(F.array_distinct(_shingles(F.col("w"), exact, shingle))).alias("shingle"))
    held = held.join(small(materialize(shingled.select("shingle").distinct(), "shingles")), "shingle", "left_semi")
    pairs = candidates.join(small(shingled), "item").select("row", "item", "shingle")
    met = held.join(pairs, ["row", "shingle"])
    found = met.groupBy("doc_id", "row", "item").agg(F.count(F.lit(1)).alias("n_found"))
    for length in sorted(r.length for r in bench.where(F.col("length") < shingle).select("length").distinct().collect()):
        brief = materialize(bench.where(F.col("length") == length).select("item", F.get("s", F.lit(0)).alias("shingle")), "brief-items")
        there = own.select("doc_id", "row", F.explode(F.array_distinct(_shingles(F.col("w"), exact, length))).alias("shingle"))
        found = found.unionByName(there.join(small(brief), "shingle").select("doc_id", "row", "item", F.lit(1).cast("long").alias("n_found")))
    found = found.join(small(bench), "item").withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= threshold)
    top = F.max(F.struct("containment", "n_shingles", "n_found")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "x.n_shingles", "x.n_found", "x.containment")
