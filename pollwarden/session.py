"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "pollwarden", cores: int | None = None, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's own setting; a temporary one is for a local master without the setting."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="pollwarden-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def sized(df: DataFrame) -> DataFrame:
    """Run a small aggregate once and keep it, so the planner joins it by its real size.

    Spark's estimate for an aggregate is the size of its input, which makes it shuffle the fact table for
    a three-row lookup. A materialised cache carries measured statistics: below the broadcast threshold
    the join becomes a broadcast, above it a shuffle join. Lost blocks are recomputed from lineage.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise once, reliably: later jobs re-read the rows instead of recomputing them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
