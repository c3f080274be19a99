"""Sinks: month-partitioned decisions, keyed snapshots, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Append decisions under month partitions.

    Rows are gathered by month; where a month outgrows the advisory partition size, the adaptive
    plan splits it by the tasks that made its rows, and it merges small months.
    """
    dated = decisions.withColumn("month", F.date_format("ts", "yyyy-MM"))
    dated.hint("rebalance", F.col("month")).write.mode("append").partitionBy("month").parquet(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    alerts.withColumn("raised_at", F.current_timestamp()).write.mode("append").parquet(path)


def snapshot_path(root: str, version: int) -> str:
    return f"{root}/snapshot={version}"


def read_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame | None:
    """A stored snapshot; None only before the first one.

    A missing snapshot is an error, and so is a first batch beside later snapshots: carrying on
    would start the keyed state anew and fork whatever is chained to it.
    """
    if version >= 0:
        return spark.read.parquet(snapshot_path(root, version))
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(folder):
        names = {f.getPath().getName() for f in files.listStatus(folder)}
        if later := {n for n in names if n.startswith("snapshot=")} - {"snapshot=0"}:
            raise RuntimeError(f"{root} holds {len(later)} later snapshots; a first batch would start it anew")
    return None


def upsert_snapshot(updates: DataFrame, root: str, version: int, keys: list[str], order: list[str]) -> None:
    """Keyed upsert as a new snapshot: the latest row per key of the previous one and the updates.

    Writing ``version`` again with the same input gives the same snapshot, so a retried
    micro-batch is harmless, and readers of the previous snapshot are never disturbed.
    """
    previous = read_snapshot(updates.sparkSession, root, version - 1)
    merged = updates if previous is None else previous.unionByName(updates)
    rest = [c for c in updates.columns if c not in keys]
    latest = merged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    latest.select(*keys, "_row.*").write.mode("overwrite").parquet(snapshot_path(root, version))
