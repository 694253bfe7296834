"""Extension: memories from streams, and recall rates over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.api import MemoryStore
from lorekeep.operators.lineage import cut
from lorekeep.operators.segment import preview


def ingest_stream(texts: DataFrame, store: MemoryStore, checkpoint: str):
    """Starts a query that remembers a stream of (text, scope, ...): each micro-batch is one upsert.

    A batch that is run again merges into what it made the first time.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        found = preview(batch.withColumn("_text", F.monotonically_increasing_id()))
        ordered = found.orderBy("_text", "seq").withColumn("seq", F.monotonically_increasing_id()).drop("_text")
        store.remember_all(cut(ordered))  # numbers are dealt once

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def access_rates(log: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Recalls by id and window of a stream of (id, at)."""
    return log.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "id").agg(F.count("*").alias("n")).select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
