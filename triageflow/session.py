"""Session construction and the runtime confs every job relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# SQL confs the jobs need; applied to any session handed to us (runtime-settable).
RUNTIME_CONFS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Shuffled answers and texts compress many times over: the default of 64 MB
    # would put over a million rows into one task's sort.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Python's json keeps the last of duplicate keys; Spark's variant parser
    # returns null for the whole document unless this is on.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL confs (idempotent)."""
    for key, value in RUNTIME_CONFS.items():
        try:
            if spark.conf.get(key, None) != value:
                spark.conf.set(key, value)
        except Exception:  # a locked conf in a managed session
            if key == "spark.sql.variant.allowDuplicateKeys":
                raise  # JSON results would change silently without it
    return spark


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "triageflow", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, ``getOrCreate`` returns the existing one."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRIAGEFLOW_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised stages and checkpoints.

    The cluster names it in ``spark.checkpoint.dir`` (the SparkContext picks it
    up at start). Only when it is unset and the master is a local one (tests) a
    fresh scratch folder is created and registered with ``setCheckpointDir``; on
    a cluster a machine-local folder would be another one on every executor, so
    the job is refused.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir is not set and {sc.master!r} is not a local master: "
                               "name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="triageflow-ckpt-", dir="/tmp")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root.rstrip("/")


def materialize(spark: SparkSession, df, name: str, partition_by: list[str] | None = None):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage at a stage boundary that several later jobs reuse (the
    split corpus, stored model answers): downstream jobs scan columnar files
    with pushdown instead of recomputing joins, and a lost executor costs a
    re-read, not a recomputation of everything upstream.

    ``partition_by`` writes one directory per value of those (low-cardinality)
    columns, so a later filter on them prunes whole directories at planning time
    instead of scanning every file. Column order is kept as in ``df``.
    """
    import uuid
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path).select(*df.columns)
