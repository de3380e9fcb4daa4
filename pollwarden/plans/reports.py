"""Reports that put several protocols side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_protocols(rows: DataFrame, protocols: dict[str, str], metric: str, by: str = "model",
                      column: str = "protocol") -> DataFrame:
    """One row per model with a metric per protocol and the gap between the first two; absent counts as 0."""
    names = list(protocols.values())
    wide = rows.groupBy(by).agg(*[
        F.max(F.when(F.col(column) == k, F.col(metric))).alias(n) for k, n in protocols.items()])
    first, second = (F.coalesce(F.col(n), F.lit(0.0)) for n in names[:2])
    return wide.withColumn("gap", first - second)
