"""The last snapshot of every graph, each row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.pipeline.reconcile import last_snapshots
from lodegraph.pipeline.snapshot_changes import small_enough
from lodegraph.tables import load


def current(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """Distinct (graph_name, columns) of the newest snapshots; only these columns are read."""
    snapshots = load(spark, d, "snapshots")
    last = last_snapshots(snapshots)
    last = F.broadcast(last) if small_enough(snapshots) else last
    df = load(spark, d, name).select("graph_name", "snapshot_id", *columns)
    return df.join(last, ["graph_name", "snapshot_id"], "left_semi").drop("snapshot_id").distinct()
