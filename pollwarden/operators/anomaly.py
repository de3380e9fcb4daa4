"""One-class detectors: isolation forest and reconstruction error, trained and scored in parallel."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwarden.operators.augment import hashed_draws, uniform
from pollwarden.operators.metrics import threshold_sweep
from pollwarden.operators.percentiles import exact_percentiles
from pollwarden.session import ensure_checkpoint_dir


def _vector(features: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


# --- isolation forest (Liu, Ting, Zhou 2008) -------------------------------------------------------

def mean_path(n: float) -> float:
    """Expected depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n <= 2 else 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, rng: np.random.Generator) -> tuple[list, list, list, list]:
    """Random axis-parallel splits down to single rows or the usual depth; flat arrays, leaf = feature -1."""
    limit = max(1, math.ceil(math.log2(max(len(points), 2))))
    feature, cut, child, depth = [], [], [], []

    def add(rows: np.ndarray, level: int) -> int:
        node = len(feature)
        feature.append(-1)
        cut.append(0.0)
        child.append(-1)
        depth.append(level + mean_path(len(rows)))
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if level < limit and len(rows) > 1 and len(open_):
            f = int(rng.choice(open_))
            at = float(rng.uniform(low[f], high[f]))
            left = rows[:, f] < at
            if left.any() and not left.all():
                feature[node], cut[node] = f, at
                add(rows[left], level + 1)
                child[node] = add(rows[~left], level + 1)
        return node

    add(points, 0)
    return feature, cut, child, depth


@dataclass
class IsolationForest:
    features: list[str]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sample_size: int
    threshold: float | None = None

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Anomaly score in (0, 1); the forest is bounded by trees x sample size, so it is broadcast."""
        shared = df.sparkSession.sparkContext.broadcast((self.trees, mean_path(self.sample_size)))

        @F.pandas_udf("double")
        def path_score(x: pd.Series) -> pd.Series:
            trees, norm = shared.value
            points = np.array(x.to_list(), dtype=float).reshape(len(x), -1)
            total = np.zeros(len(points))
            rows = np.arange(len(points))
            for feature, cut, child, depth in trees:
                node = np.zeros(len(points), dtype=np.int64)
                inner = feature[node] >= 0
                while inner.any():
                    at = node[inner]
                    f = feature[at]
                    node[inner] = np.where(points[rows[inner], f] < cut[at], at + 1, child[at])
                    inner = feature[node] >= 0
                total += depth[node]
            return pd.Series(np.exp2(-total / len(trees) / max(norm, 1e-12)))

        return df.withColumn(out, path_score(_vector(self.features)))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """-1 for an anomaly, 1 for a normal row."""
        return self.score(df).withColumn(out, F.when(F.col("score") > F.lit(self.threshold), -1).otherwise(1))


def _draw(rows: DataFrame, trees: int, size: int, n: int) -> DataFrame:
    """(tree, u, x) blocks, packed: every tree's candidates for its `size` smallest draws among n rows (h, x).

    A row's draw for a tree is a hash of both. The `size` smallest of n draws lie below (size + 6 sqrt(size) + 8) / n but for a chance of
    about 1e-9, so only rows below travel: some `size` rows a tree, whatever n is, and a row is held once, not once for each tree.
    """
    share = min(1.0, (size + 6.0 * math.sqrt(size) + 8.0) / n)

    def pick(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            h, x = pdf["h"].to_numpy().astype(np.int64).view(np.uint64), np.array(pdf["x"].to_list(), dtype=float)
            found = [(t, u, np.nonzero(u < share)[0]) for t, u in ((t, hashed_draws(h, t)) for t in range(trees))]
            yield pd.DataFrame([(t, u[rows].tobytes(), x[rows].tobytes()) for t, u, rows in found if len(rows)], columns=["tree", "u", "x"])

    return rows.mapInPandas(pick, "tree int, u binary, x binary")


def fit_isolation_forest(normal: DataFrame, row_id: str, features: list[str], trees: int = 200, max_samples: int = 256,
                         contamination: float = 0.05, seed: int = 42) -> IsolationForest:
    """Trees grow in parallel, each on the rows with the smallest of its own hashed draws; one rule for any number of rows.

    The threshold is the exact quantile of the training scores.
    """
    n = normal.count()
    if n == 0:
        raise RuntimeError("no normal rows to fit an isolation forest on")
    size = min(max_samples, n)
    rows = normal.select(F.xxhash64(F.lit(seed), row_id).alias("h"), _vector(features).alias("x"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        u = np.concatenate([np.frombuffer(b) for b in pdf["u"]])
        x = np.concatenate([np.frombuffer(b).reshape(-1, len(features)) for b in pdf["x"]])
        first = np.lexsort((*x.T[::-1], u))[:size]
        parts = grow_tree(x[first], np.random.default_rng([seed, tree]))
        return pd.DataFrame([[tree, *parts]], columns=["tree", "feature", "cut", "child", "depth"])

    grown = _draw(rows, trees, size, n).groupBy("tree").applyInPandas(
        build, "tree int, feature array<int>, cut array<double>, child array<int>, depth array<double>")
    flat = [(np.array(r["feature"]), np.array(r["cut"]), np.array(r["child"]), np.array(r["depth"]))
            for r in grown.orderBy("tree").collect()]
    forest = IsolationForest(features, flat, size)
    scores = forest.score(normal.select(*features)).select("score")
    forest.threshold = score_quantiles(scores, [1.0 - contamination])[0]
    return forest


# Fixed contamination settings of the sweep.
CONTAMINATIONS = [0.001, 0.005, 0.01, 0.05]


def contamination_sweep(forest: IsolationForest, normal: DataFrame, labelled: DataFrame,
                        settings: list[float] = CONTAMINATIONS) -> DataFrame:
    """Metrics per contamination: the forest stays, only the threshold moves; one scoring pass per table."""
    scores = forest.score(normal.select(*forest.features)).select("score")
    limits = score_quantiles(scores, [1.0 - c for c in settings])
    return threshold_sweep(forest.score(labelled).select("y", "score"), "score", "y", limits)


def score_quantiles(scores: DataFrame, probs: list[float], column: str = "score") -> list[float]:
    """Exact quantiles of a score column, as numbers for the driver."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    row = exact_percentiles(scores.persist(StorageLevel.MEMORY_AND_DISK), [], column, names).first()
    return [float(row[n]) for n in names]


# --- reconstruction error --------------------------------------------------------------------------

def _split_weights(flat: np.ndarray, shape: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(shape[:-1], shape[1:]):
        w = flat[at:at + a * b].reshape(a, b)
        out.append((w, flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    values = [x]
    for i, (w, b) in enumerate(layers):
        z = values[-1] @ w + b
        values.append(z if i == len(layers) - 1 else np.maximum(z, 0.0))
    return values


def _gradient(x: np.ndarray, flat: np.ndarray, shape: list[int]) -> np.ndarray:
    """Gradient of the mean squared error over all entries of x."""
    layers = _split_weights(flat, shape)
    values = _forward(x, layers)
    delta = 2.0 * (values[-1] - x) / x.size
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        parts.append((values[i].T @ delta, delta.sum(axis=0)))
        if i:
            delta = (delta @ layers[i][0].T) * (values[i] > 0)
    return np.concatenate([p for w, b in reversed(parts) for p in (w.ravel(), b)])


@dataclass
class Reconstructor:
    features: list[str]
    shape: list[int]
    weights: np.ndarray
    threshold: float | None = None

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Mean squared reconstruction error of each row."""
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.shape))

        @F.pandas_udf("double")
        def error(x: pd.Series) -> pd.Series:
            flat, shape = shared.value
            points = np.array(x.to_list(), dtype=float).reshape(len(x), -1)
            return pd.Series(((points - _forward(points, _split_weights(flat, shape))[-1]) ** 2).mean(axis=1))

        return df.withColumn(out, error(_vector(self.features)))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.score(df).withColumn(out, (F.col("score") > F.lit(self.threshold)).cast("int"))


#: Rows of a block of the training table, the unit of its sums, and the fewest rows of which some are set aside to watch.
BLOCK_ROWS, UNIT, LEAST_WATCHED = 4096, float(2**32), 30
_BLOCKS = "block long, x binary"


def _pack(features: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["x"].to_list(), dtype=float).reshape(len(pdf), features)
        order = np.lexsort((*x.T[::-1], pdf["h"].to_numpy()))  # one order, however the rows came
        return pd.DataFrame({"step": [int(pdf["step"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "x": [x[order].tobytes()]})

    return pack


def _total(blocks: DataFrame, features: int, of_block) -> np.ndarray:
    """Sum over all blocks of a vector that belongs to each, in whole numbers of 1 / UNIT: the same for any partitioning."""
    def add(batches):
        total = None
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                one = np.rint(of_block(np.frombuffer(raw).reshape(-1, features)) * UNIT).astype(np.int64)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = [np.frombuffer(r.s, np.int64) for r in blocks.select("block", "x").mapInArrow(add, "s binary").collect()]
    return np.sum(parts, axis=0) / UNIT if parts else np.zeros(0)


def _batch_gradient(blocks: DataFrame, w: np.ndarray, shape: list[int]) -> np.ndarray:
    """Row count and gradient, summed over the rows of one batch."""
    return _total(blocks, shape[0], lambda x: np.concatenate([[len(x)], _gradient(x, w, shape) * len(x)]))


def _watched_loss(blocks: DataFrame, w: np.ndarray, shape: list[int]) -> float | None:
    found = _total(blocks, shape[0], lambda x: np.array(
        [len(x), ((_forward(x, _split_weights(w, shape))[-1] - x) ** 2).mean(axis=1).sum()]))
    return float(found[1] / found[0]) if len(found) else None


def fit_reconstructor(normal: DataFrame, features: list[str], hidden: list[int], epochs: int = 20, steps: int = 32, rate: float = 0.001,
                      percentile: float = 0.95, watch: float = 0.1, patience: int = 5, row_id: str | None = None, seed: int = 42) -> Reconstructor:
    """Small ReLU network that learns to repeat normal rows, by synchronous mini-batch gradient (Adam).

    Rows are dealt by hash into `steps` batches, whatever their number, and kept as a table partitioned by batch. A step reads its batch only, sums the
    gradient in its tasks and moves the one set of weights on the driver. A hashed share of the rows is watched: training stops when their error
    has not improved for `patience` epochs, and the best weights are kept (fewer than 30 rows are all learned from). Weights are the same for any partitioning.
    """
    spark = normal.sparkSession
    shape = [len(features), *hidden, len(features)]
    rng = np.random.default_rng(seed)
    w = np.concatenate([p for a, b in zip(shape[:-1], shape[1:]) for p in (
        rng.uniform(-math.sqrt(6 / (a + b)), math.sqrt(6 / (a + b)), a * b), np.zeros(b))])
    ids = [row_id] if row_id else features
    rows = normal.select(_vector(features).alias("x"), F.xxhash64(F.lit(seed), *ids).alias("h"))
    n = rows.count()
    if not n:
        raise RuntimeError("no normal rows to fit a reconstruction model on")
    share = watch if n >= LEAST_WATCHED else 0.0
    batch = F.when(uniform(seed, F.lit("watch"), "h") < share, -1).otherwise(F.floor(uniform(seed, F.lit("batch"), "h") * steps)).cast("int")
    pieces = max(1, -(-n // (steps * BLOCK_ROWS)))
    dealt = rows.withColumn("step", batch).withColumn("block", F.floor(uniform(seed, F.lit("block"), "h") * F.when(
        F.col("step") < 0, max(1, -(-int(n * share) // BLOCK_ROWS))).otherwise(pieces)))
    folder = f"{ensure_checkpoint_dir(spark)}/reconstructor-{uuid.uuid4().hex}"
    dealt.groupBy("step", "block").applyInPandas(_pack(len(features)), "step int, " + _BLOCKS).repartition("step", "block").write.partitionBy(
        "step").parquet(folder)
    table = spark.read.schema(_BLOCKS + ", step int").parquet(folder)
    batches = [table.where(F.col("step") == s) for s in range(steps)]
    watched = table.where(F.col("step") == -1)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    best, best_loss, waited = w, math.inf, 0
    for epoch in range(epochs):
        for s in np.random.default_rng([seed, epoch]).permutation(steps):
            found = _batch_gradient(batches[s], w, shape)
            if not len(found):
                continue
            g, t = found[1:] / found[0], t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
        loss = _watched_loss(watched, w, shape) if share else None
        if loss is None:
            best = w
            continue
        if loss < best_loss:
            best, best_loss, waited = w, loss, 0
            continue
        waited += 1
        if waited >= patience:
            break
    model = Reconstructor(features, shape, best)
    model.threshold = score_quantiles(model.score(normal.select(*features)).select("score"), [percentile])[0]
    return model
