"""What the vector operators share: which rows take part, and vectors as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """True where the vector is not null, not empty and holds finite entries only."""
    ok = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(column) > 0) & ok, F.lit(False))


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with a finite vector of the table's dimension: the length that most such rows have, of equally frequent ones the larger."""
    good = df.where(finite(column))
    lengths = good.groupBy(F.size(column).alias("d")).count()
    first = lengths.agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    return good.where(F.size(column) == (first["d"] if first else 0))


def scaled(column: str, factor: int) -> Column:
    """floor(factor * entry) of every entry, as longs."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(factor))))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's list<long> column of one length as a matrix of int64."""
    flat = np.asarray(column.flatten(), dtype=np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
