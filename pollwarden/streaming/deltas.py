"""Counter deltas of a live feed: the last row of every key is a table, and a micro-batch is one window over that table and its rows.

All work is in the JVM and is that of the batch operators, so a hot key is cut into time chunks here as there. Batch n reads the table
that batch n - 1 left and overwrites its own two folders: a batch that is run again after a failure writes the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.operators.telemetry import FLOW_STATE_KEY, PORT_STATE_KEY, flow_deltas, keep_last, port_deltas
from pollwarden.schemas import PORT_COUNTERS
from pollwarden.session import ensure_checkpoint_dir
from pollwarden.sources.sinks import remove_path

FLOW_COLUMNS = ["flow_id", "timestamp", *FLOW_STATE_KEY, "packet_count", "byte_count"]
PORT_COLUMNS = ["row_id", "timestamp", *PORT_STATE_KEY, *PORT_COUNTERS]


def _write(feed: DataFrame, base: str, columns: list[str], keys: list[str], tie_break: str, deltas: Callable[[DataFrame], DataFrame], idle_sec: int,
           options: dict | None):
    spark = feed.sparkSession
    rows = feed.select(*columns)
    empty = spark.createDataFrame([], rows.schema)
    # An ended feed without a row leaves a table without a row, not a missing folder.
    deltas(empty).write.mode("overwrite").parquet(f"{base}/rows/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        before = here.read.schema(rows.schema).parquet(f"{base}/last/{number - 1}") if number else here.createDataFrame([], rows.schema)
        both = batch.withColumn("_old", F.lit(False)).unionByName(before.withColumn("_old", F.lit(True))).persist(StorageLevel.MEMORY_AND_DISK)
        deltas(both).where(~F.col("_old")).drop("_old").write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        newest = both.agg(F.max("timestamp")).first()[0]
        last = keep_last(both, keys, ["timestamp", tie_break]).drop("_old")
        if newest is not None:
            last = last.where(F.col("timestamp") >= F.lit(newest) - F.make_dt_interval(secs=F.lit(idle_sec)))
        last.write.mode("overwrite").parquet(f"{base}/last/{number}")
        both.unpersist()
        # Batch n is not run again once batch n + 1 runs, so what it read may go.
        if number > 1:
            remove_path(here, f"{base}/last/{number - 2}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(**(options or {"availableNow": True})).start()


def write_flow_deltas(feed: DataFrame, base: str, idle_sec: int = 3600, trigger: dict | None = None):
    """Start the stream of flow deltas into the folder `base`; read them with `read_deltas`.

    A key silent for `idle_sec` of event time leaves the table and starts anew. A row older than its key's last row of an earlier batch is
    measured against the rows of its own batch alone, and a row without a time has no delta and no successor across batches.
    """
    return _write(feed, base, FLOW_COLUMNS, FLOW_STATE_KEY, "flow_id", flow_deltas, idle_sec, trigger)


def write_port_deltas(feed: DataFrame, base: str, idle_sec: int = 3600, trigger: dict | None = None):
    """The same for port counters, each clamped at zero on its own."""
    return _write(feed, base, PORT_COLUMNS, PORT_STATE_KEY, "row_id", port_deltas, idle_sec, trigger)


def read_deltas(spark: SparkSession, base: str) -> DataFrame:
    """All rows written so far, each with its delta columns."""
    return spark.read.parquet(f"{base}/rows").drop("batch")


def drain(feed: DataFrame, write, idle_sec: int = 3600) -> DataFrame:
    """Run one of the writers over what the feed holds now, in a folder of its own below the checkpoint folder."""
    base = f"{ensure_checkpoint_dir(feed.sparkSession)}/deltas-{uuid.uuid4().hex}"
    write(feed, base, idle_sec).awaitTermination()
    return read_deltas(feed.sparkSession, base)
