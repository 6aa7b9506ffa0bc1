"""Collations that arrive over time: each micro-batch of whole collations is collated and appended.

A collation must arrive in one batch, base included; a batch that is retried overwrites what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.apparatus import notes
from palimpsest.options import Options
from palimpsest.plans.collation import apparatus


def stream_notes(witnesses: DataFrame, path: str, checkpoint: str, o: Options = Options()) -> StreamingQuery:  # noqa: B008
    """Write the notes of a stream of witnesses(collation_id, witness_id, text) as Parquet, a folder a batch."""

    def collate(batch: DataFrame, number: int) -> None:
        notes(apparatus(batch, o)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return witnesses.writeStream.foreachBatch(collate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
