"""Embedding whitening from an exact characteristic polynomial.

The scatter matrix of the distinct scaled vectors is summed in whole numbers. Its characteristic polynomial is computed modulo
many primes (one small task each) and put together by Chinese remainders; its largest roots are isolated to 200
bits by sign changes, and each root's components come from inverse iteration in fixed point, again one task for each root. Only matrices of the
vectors' dimension reach the driver; rows are read, never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pollwarden.llm.common import table
from pollwarden.llm.exact_spectrum import eigenvectors, from_residues, largest_roots, primes_for, residue_polynomial
from pollwarden.llm.vectors import matrix, scaled, usable
from pollwarden.session import cut_lineage

SCALE, COMPONENTS = 64, 16
#: Rows of a block inside a task.
BLOCK = 16_384


@dataclass
class Whitening:
    """n fit rows, their sums, the components as columns, variances and shares of the total variance, falling."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: list[float]
    shares: list[float]


def products(y: np.ndarray) -> np.ndarray:
    """y^T y in whole numbers of any size; through doubles or longs where these hold every sum exactly."""
    top = int(max(abs(int(y.max())), abs(int(y.min())))) if y.size else 0
    if len(y) * top * top < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if len(y) * top * top < 2**63:
        return (y.T @ y).astype(object)
    y = y.astype(object)
    return y.T.dot(y)


def scatter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task: (i, j, v) for products, (-1, j, v) for entries and (-1, -1, v) for rows."""
    n, total, sums = 0, None, None
    for batch in batches:
        y = matrix(batch.column(0))
        if not len(y):
            continue
        for at in range(0, len(y), BLOCK):
            part = y[at:at + BLOCK]
            own, line = products(part), part.astype(object).sum(axis=0)
            total, sums = (own, line) if total is None else (total + own, sums + line)
        n += len(y)
    if n:
        d = len(sums)
        rows = [(i, j, Decimal(int(total[i, j]))) for i in range(d) for j in range(i, d)]
        rows += [(-1, j, Decimal(int(sums[j]))) for j in range(d)] + [(-1, -1, Decimal(n))]
        i, j, v = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.decimal128(38, 0))], ["i", "j", "v"])


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, n * sum y y^T - S S^T) over the column y; d * d / 2 numbers come to the driver."""
    sums = fit.select("y").mapInArrow(scatter_rows, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    got = {(r.i, r.j): int(r.v) for r in sums.collect()}
    n = got.get((-1, -1), 0)
    d = sum(i == -1 for i, _ in got) - 1
    line = [got[-1, j] for j in range(max(d, 0))]
    m = np.empty((len(line), len(line)), dtype=object)
    for i in range(len(line)):
        for j in range(i, len(line)):
            m[i, j] = m[j, i] = n * got[i, j] - line[i] * line[j]
    return n, line, m


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Model of the rows of `fit` (y array<long>, all of one length). Directions without variance give no component."""
    spark = fit.sparkSession
    n, sums, m = scatter(fit)
    trace = sum(int(m[i, i]) for i in range(len(m)))
    if not trace:
        return Whitening(n, sums, np.zeros((len(sums), 0)), [], [])
    unit = gcd(*[int(x) for x in m.ravel()])
    small = np.vectorize(lambda x: int(x) // unit, otypes=[object])(m)
    primes = primes_for(small)

    def polynomials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array([residue_polynomial(small, p) for p in ps], pa.list_(pa.int64()))], ["p", "f"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, root, shift, many in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                v = eigenvectors(small, int(root), shift, many)
                yield pa.RecordBatch.from_arrays([pa.array([k] * many, pa.int32()), pa.array(range(many), pa.int32()),
                                                  pa.array(v.T.tolist(), pa.list_(pa.float64()))], ["k", "c", "v"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    residues = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(polynomials, "p long, f array<long>").collect()
    f = from_residues([r.p for r in residues], [r.f for r in residues])
    roots = largest_roots(f, components)
    dealt = spark.createDataFrame([(k, str(r), shift, many) for k, (r, shift, many) in enumerate(roots)], "k int, root string, shift int, many int")
    found = sorted(dealt.repartition(len(roots), "k").mapInArrow(vectors, "k int, c int, v array<double>").collect())[:components]
    values = [Fraction(roots[r.k][0], 1 << roots[r.k][1]) * unit for r in found]
    return Whitening(n, sums, np.array([r.v for r in found]).T, [float(v / n**2) for v in values], [float(v / trace) for v in values])


def centred(y: np.ndarray, model: Whitening) -> np.ndarray:
    """n * y - S in whole numbers: longs where they hold it, else Python integers."""
    top = max(abs(int(y.max())), abs(int(y.min())), 1) if y.size else 1
    exact = np.int64 if model.n * top + max(map(abs, model.sums), default=0) < 2**62 else object
    return y.astype(exact) * model.n - np.array(model.sums, dtype=exact)


def whitened(z: np.ndarray, model: Whitening) -> np.ndarray:
    return (z / model.n).astype(np.float64) @ model.components / np.sqrt(np.array(model.variances))


def deviations(z: np.ndarray) -> list[int | None]:
    """Sum of squares of every row, exact; null beyond the range of a long."""
    top = max(abs(int(z.max())), abs(int(z.min()))) if z.size else 0
    if z.shape[1] * top * top < 2**63:
        return (z.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (int(sum(int(v) ** 2 for v in row)) for row in z)]


def covariance_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit rows' covariance less the identity."""
    k = len(model.variances)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, line = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y = matrix(batch.column(0))
            for at in range(0, len(y), BLOCK):
                w = whitened(centred(y[at:at + BLOCK], model), model)
                total, line = total + w.T @ w, line + w.sum(axis=0)
        values = np.vstack([line, total])
        i, j = np.indices(values.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel() - 1, pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(values.ravel())], ["i", "j", "v"])

    got = {(r.i, r.j): r.v / model.n for r in fit.select("y").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    return max(abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i in range(k) for j in range(k))


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, column: str = "embedding", keys: list[str] | None = None) -> DataFrame:
    """One row for each usable vector and component: keys, component from 1, n, deviation, whitened, explained, identity_error.

    Usable are vectors that are neither null nor empty nor hold a null or non-finite entry, of the length most of them have. Every distinct scaled
    vector is fitted once, so copies weigh once and are whitened alike; repeated rows give repeated results and null keys stay null.
    Directions without variance give no component: equal vectors only, one row, or an empty table give no rows. deviation is null
    beyond the range of a long. Other columns are not read.
    """
    keys = keys or ["vec_id"]
    good = cut_lineage(usable(rows.select(*keys, column), column).select(*keys, scaled(column, scale).alias("y")))
    fit = cut_lineage(good.select("y").distinct())
    model = fit_whitening(fit, components)
    added = T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")
    schema = T.StructType([*good.select(*keys).schema.fields, *added.fields])
    k = len(model.variances)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    error = covariance_error(fit, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                z = centred(matrix(batch.column(len(keys))), model)
                each = pa.array(np.repeat(np.arange(len(z)), k))
                cols = [batch.column(i).take(each) for i in range(len(keys))]
                cols += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array(np.full(len(z) * k, model.n, np.int64)),
                         pa.array(deviations(z), pa.int64()).take(each), pa.array(whitened(z, model).ravel()),
                         pa.array(np.tile(model.shares, len(z))), pa.array(np.full(len(z) * k, error))]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return good.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))
