"""What the operators of this folder share: reading, case folding, folds, and Arrow row mapping."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def folded(column: str | Column = "text") -> Column:
    """The text with A-Z lower-cased and nothing else changed."""
    return F.translate(whole_text(column), UPPER, LOWER)


def fold_of(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def fold_of_id(doc_id: int | None, parts: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def map_text(df: DataFrame, columns: list[str], text: str, schema: str | T.StructType,
             rows: Callable[[list[str]], list[tuple]], setup: Callable[[], Callable] | None = None,
             batch_chars: int = 8_000_000) -> DataFrame:
    """Pass columns through and add what `rows` returns for each text; one pass over the partition, no shuffle.

    `setup`, if given, is called once for each task and returns the function that then takes the place of
    `rows`. Batches are cut so that at most `batch_chars` characters (or one text) are held as Python strings.
    """
    added = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    base = df.select(*columns, whole_text(text).alias("__text"))
    out_schema = T.StructType([*base.schema.fields[:-1], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(out_schema)
        fn = setup() if setup else rows
        for batch in batches:
            for part in slices(batch, batch_chars):
                got = fn(part.column(part.num_columns - 1).to_pylist())
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                new = list(zip(*got)) if got else [()] * len(added)
                cols += [pa.array(list(v), type=want.field(len(columns) + i).type) for i, v in enumerate(new)]
                yield pa.RecordBatch.from_arrays(
                    [c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, want)], schema=want)

    return base.mapInArrow(run, out_schema)


def slices(batch: pa.RecordBatch, chars: int, column: int = -1) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of one slice stay within a number of bytes; a longer text is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    column = column % batch.num_columns
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + chars, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop
