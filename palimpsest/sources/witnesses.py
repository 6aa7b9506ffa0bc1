"""Witness tables: from text files, from a folder of versions, from a corpus of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.similar import similar_groups
from palimpsest.tables import small, written


def read_versions(spark: SparkSession, path: str, collation: str = "versions") -> DataFrame:
    """collation_id, witness_id, name, text of the UTF-8 files of a folder; witnesses are numbered by sorted name.

    As versions are prepared for a vote: the tsheg after a shad and a blank becomes a shad, so lengths stay.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1).alias("name"), F.col("value").alias("text"))
    return number(files.withColumn("collation_id", F.lit(collation)).withColumn("text", replace_shad_tsheg(F.col("text"))))


def replace_shad_tsheg(text):
    return F.replace(text, F.lit("\u0f0d \u0f0b"), F.lit("\u0f0d \u0f0d"))


def read_upload(spark: SparkSession, base: str, *comparisons: str, sigla: tuple[str, ...] = ("BX1", "GX1", "GB1")) -> DataFrame:
    """collation_id, witness_id, siglum, name, text of a base file and any number of comparison files."""
    rows = None
    for i, path in enumerate((base, *comparisons)):
        one = spark.read.text(path, wholetext=True).select(F.lit(0).alias("collation_id"), F.lit(i).alias("witness_id"), F.lit(sigla[i] if i < len(sigla) else f"W{i}").alias("siglum"), F.regexp_extract(F.input_file_name(), "([^/]*)$", 1).alias("name"), F.col("value").alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def number(versions: DataFrame, exemplar: str | None = None) -> DataFrame:
    """versions(collation_id, name, text) with witness_id by sorted name; the exemplar, if named, comes first, once."""
    first = (F.col("name") != exemplar) if exemplar is not None else F.lit(False)
    order = Window.partitionBy("collation_id").orderBy(first, "name")
    return versions.withColumn("witness_id", (F.row_number().over(order) - 1).cast("int")).select("collation_id", "witness_id", "name", "text")


def read_substitutions(spark: SparkSession, path: str) -> DataFrame:
    """form, lemma of comma-separated files; of repeated forms the last row counts, rows of one field do not.

    The last row is that of the last file by name, and of the greatest place in it.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n", -1)).alias("at", "line"))
    rows = files.select("file", "at", F.from_csv("line", "form string, lemma string").alias("x")).where("x.lemma is not null")
    return rows.groupBy("x.form").agg(F.max_by("x.lemma", F.struct("file", "at")).alias("lemma"))


def blocks(documents: DataFrame, size: int = 3) -> DataFrame:
    """Every `size` documents of neighbouring ids as one collation, by position."""
    return documents.select((F.floor(F.col("doc_id") / size)).cast("long").alias("collation_id"), (F.col("doc_id") % size).cast("int").alias("witness_id"), F.coalesce("text", F.lit("")).alias("text"))


def near_copies(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Near copies as collations: collation_id (the base's id, the least), witness_id, doc_id, text.

    Witnesses of a collation hang together by pairs whose sets of word shingles are equal or have that Jaccard similarity;
    no such pair is missed.  Fewer words are one shingle; a document without a word, or without an id, is no witness.
    Ids are distinct.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    groups = similar_groups(docs.select(F.col("doc_id").alias("id"), "text"), shingle, similarity)
    # ranks are told over ids alone, and texts read again for what has a place
    rank = F.row_number().over(Window.partitionBy("group").orderBy("id")) - 1
    places = written(groups.select(F.col("group").alias("collation_id"), rank.cast("int").alias("witness_id"), F.col("id").alias("doc_id")), "places")
    return docs.join(small(places), "doc_id").select("collation_id", "witness_id", "doc_id", "text")
