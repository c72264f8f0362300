"""Streams of anchors against a fixed target index, and running token counts; beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.blocking import candidates
from matchloom.operators.keys import keys
from matchloom.operators.records import prepared, with_codes


def match_batch(batch: DataFrame, target_keys: DataFrame, cap: int = 3000, k: int = 25) -> DataFrame:
    """Candidates of one batch of raw anchor records."""
    anchors = prepared(with_codes(batch)).withColumn("anchor", F.col("id"))
    return candidates(keys(anchors, carry=("anchor",)), target_keys, cap, k)


def match_stream(anchors: DataFrame, target_keys: DataFrame, out: str, checkpoint: str, cap: int = 3000, k: int = 25):
    """Writes the candidates of every batch to a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        match_batch(batch, target_keys, cap, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return anchors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Events by window and type; late ones beyond the watermark are left out when run as a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
