"""Serialised collations as files: one folder a format, one row a collation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import serialize


def write_texts(texts: DataFrame, column: str, path: str) -> None:
    """A text column by collation, partitioned by collation_id, as Spark writes texts (no line end is added within)."""
    texts.select("collation_id", F.col(column).alias("value")).repartition("collation_id").write.partitionBy("collation_id").option("lineSep", "\n").text(path)


def write_csv(weighted: DataFrame, path: str) -> None:
    """csv lines of each collation in row order."""
    lines = serialize.csv_lines(weighted).repartition("collation_id").sortWithinPartitions("collation_id", "row_id")
    lines.select("collation_id", F.col("line").alias("value")).write.partitionBy("collation_id").text(path)


def write_layers(base: DataFrame, spans: DataFrame, path: str) -> None:
    """Base texts and annotation layers as two tables."""
    base.write.parquet(f"{path}/base")
    spans.write.partitionBy("kind").parquet(f"{path}/annotation")
