"""Corpus pipeline: documents in, a mixed training set out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows as
Parquet into the shared folder and reads them again.  Stages keep the columns of documents, of any name and type; the
last adds its own, which replace columns of the same names.

Stages decide about rows, not ids.  In all of them:
* a null id is an id like any other, and rows that share an id (or have none) are judged one by one;
* a null or empty text is a text without words;
* rows that are equal in all columns are judged alike, except where one of several copies stays (near copies);
* a table without rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, line_dedup, mixing, quality_classifier, simhash
from palimpsest.llm.common import WORD, fresh, materialize, named, numbered, table

KEEP_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fit on the labelled ones, scores under KEEP_SCORE go.

    Where the labels are none, or of one kind, there is no rule to go by and all documents stay.  Equal texts score alike.
    """
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    if not model.rules:
        return docs
    name = fresh(docs, "_score")
    return quality_classifier.score(docs, model, name=name).where(F.col(name) >= KEEP_SCORE).select(*map(named, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three documents or more stay in the largest id's only; no document goes.

    Rows of one id are one document in the count, as are rows without an id, which come after all ids; equal rows lose the
    same lines.  A null text stays null.  n_chars follows the text where lines went.
    """
    found = line_dedup.keep_bitmaps(docs, with_text=True)

    def column(name: str) -> Column:
        if name == "text":
            return F.col("kept").alias(name)
        old = F.col("row").getField(name)
        now = F.length("kept").cast(docs.schema[name].dataType) if name == "n_chars" else old
        return F.when(F.col("n_dropped") > 0, now).otherwise(old).alias(name)

    return found.select(*map(column, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at a 5-word Jaccard similarity of 0.8 or more one row stays.

    It is the row of the least id (rows without one come last), of equal ids the first in its file.  All texts without a word
    are one group.
    """
    docs_, row = numbered(docs)
    rank = fresh(docs_, "_rank")
    ranked = docs_.withColumn(rank, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), named(row).alias("row")))
    found = simhash.near_copies(ranked, doc_id=rank)
    firsts = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id.row").alias(row))
    return docs_.join(firsts, row, "left_semi").select(*map(named, docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains four fifths or more of a benchmark item's shingles go."""
    docs_, row = numbered(docs)
    leaks = decontamination.find_leaks(docs_, table(spark, sf_dir, "benchmark"), doc_id=row).select(F.col("doc_id").alias(row)).distinct()
    return docs_.join(leaks, row, "left_anti").select(*map(named, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, with size, source_size, target, taken (words, repeats counted), copies and virtual finish time.

    A row of which the mix takes fewer words than it has is cut to them, n_chars with it.  Rows without a word go, as nothing
    of them is taken.  A null source is a source of its own.  Of equal rows that queue one after the other one may be cut.
    """
    docs_, row = numbered(docs)
    added = ["size", "source_size", "target", "taken", "copies", "finish"]
    taken = mixing.mix(docs_, row=row).where("taken > 0").select(F.struct("size", "source_size", "target", "taken", F.ceil(F.col("taken") / F.col("size")).alias("copies"), "finish").alias("_mix"), F.col("row").alias(row))
    held = docs_.select(F.struct(*map(named, docs.columns)).alias("_doc"), named(row).alias(row)).join(taken, row)
    text = F.col("_doc").getField("text")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("_mix.taken").cast("int")), " ")
    held = held.withColumn("_text", F.when(F.col("_mix.taken") < F.col("_mix.size"), part).otherwise(text))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("_text").alias(name)
        old = F.col("_doc").getField(name)
        return F.when(F.col("_mix.taken") < F.col("_mix.size"), F.length("_text").cast(docs.schema[name].dataType)).otherwise(old).alias(name) if name == "n_chars" else old.alias(name)

    return held.select(*(column(c) for c in docs.columns if c not in added), *(F.col("_mix").getField(c).alias(c) for c in added))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mix),
]

#: XXH64 fingerprints and the fitted classifier have no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
