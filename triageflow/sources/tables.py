"""Readers for the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


#: Rows of a scan that one task of per-row work takes at most.
TASK_ROWS = 250_000


def spread_small_input(df: DataFrame, min_partitions: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Round-robin a scan whose rows lie in fewer tasks than the cluster has cores,
    or in very large ones.

    A parquet row group is read by one task, whatever the number of splits, so its
    whole downstream pipeline (text assembly, JSON parsing, scoring) would run there;
    the splits without a row group's middle stay empty. The rows of each task
    come from a count that reads the files' footers alone. A scan that is already
    even is never shuffled for this.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    per_task = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    largest, rows = per_task.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(target, -(-rows // task_rows))
    if largest * parts > 2 * rows or df.rdd.getNumPartitions() < target:
        return df.repartition(parts)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               spread: bool = False) -> DataFrame:
    """Parquet scan; ``columns`` keeps ReadSchema narrow even before Catalyst prunes.
    ``spread`` applies :func:`spread_small_input` (for fact tables that feed
    per-row CPU work)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return spread_small_input(df) if spread else df
