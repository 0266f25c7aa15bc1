"""Weak facts as a stream: deliveries counted per graph and window, late repeats dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.tables import CALL_OBSERVATIONS

STREAM_SCHEMA = f"graph_name string, snapshot_id string, {CALL_OBSERVATIONS}, ingested_at timestamp"


def observation_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(STREAM_SCHEMA).parquet(folder)


def delivery_counts(stream: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(window, graph_name, reason, n): a row delivered twice within the lateness counts once."""
    keys = ["graph_name", "snapshot_id", "source", "display_target", "reason", "source_file", "span"]
    fresh = stream.withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(keys)
    return fresh.groupBy(F.window("ingested_at", window), "graph_name", "reason").agg(F.count(F.lit(1)).alias("n"))
