"""Gradient-boosted trees for two or more classes, grown from histograms summed over partitions, with early stopping.

One tree for each class and round follows the gradient and curvature of the softmax (two classes: logistic) loss. Rows are binned once
and kept as blocks of numpy columns. A level of all trees of a round is one pass: tasks count
gradients and curvatures by (class, node, feature, bin), the sums meet by groups of features, each group offers its best split of every
node, and the driver sees those offers only. Sums are whole numbers of 2^-24, sampling and validation are decided by row hashes, bin borders come from
a hashed sample: the trees are the same however the rows are partitioned.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollwarden.operators.augment import hashed_draws
from pollwarden.session import cut_lineage

UNIT = float(2**24)
#: L2 penalty of leaf values and least curvature of a leaf, as in the published settings' defaults.
PENALTY, LEAST_CURVATURE = 1.0, 1.0
#: Rows of the hashed sample that bin borders are taken from.
CUT_ROWS = 10_000
#: Rounds after which the rows' margins are written anew.
KEEP_ROUNDS = 10

_STATE = "x binary, y binary, h binary, m binary"
#: Rows that one task sums up; a pass over fewer costs more to start than to run.
TASK_ROWS = 20_000
#: A group's best split of a node: gain, and gradient and curvature left of the cut and in all.
Offer = namedtuple("Offer", "cls node feature cut gain gl hl g h")


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i + 1 and 2i + 2); feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size), depth)

    def leaves(self, goes_right, n: int, levels: int | None = None) -> np.ndarray:
        """Node of every row after `levels` steps; goes_right(rows, feature, cut) decides a step."""
        at = np.zeros(n, np.int64)
        for _ in range(self.depth if levels is None else levels):
            rows = np.nonzero(self.feature[at] >= 0)[0]
            if not len(rows):
                break
            node = at[rows]
            at[rows] = 2 * node + 1 + goes_right(rows, self.feature[node], self.cut[node])
        return at


@dataclass
class BoostedModel:
    """Trees by round and class; `losses` holds the validation loss before each round, `best` the rounds kept."""

    cuts: list[np.ndarray]
    classes: int
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    gains: np.ndarray | None = None

    @property
    def best(self) -> int:
        return len(self.trees)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name MLlib's models have
        total = self.gains.sum()
        return Vectors.dense(self.gains / total if total else self.gains)

    def margins(self, x: np.ndarray) -> np.ndarray:
        k = 1 if self.classes == 2 else self.classes
        out = np.zeros((len(x), k))
        width = max((len(c) for c in self.cuts), default=0)
        table = np.full((len(self.cuts), max(width, 1)), np.inf)
        for f, c in enumerate(self.cuts):
            table[f, :len(c)] = c
        right = lambda rows, f, cut: ~(x[rows, f] <= table[f, cut])  # noqa: E731 - NaN goes right
        for trees in self.trees:
            for c, tree in enumerate(trees):
                out[:, c] += tree.value[tree.leaves(right, len(x))]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """df with probability (a vector) and prediction; the model is bounded by rounds, classes and depth and is broadcast."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.Series) -> pd.Series:
            points = np.array(x.to_list(), dtype=float).reshape(len(x), -1)
            return pd.Series(list(_probabilities(shared.value.margins(points))))

        scored = df.withColumn("probability", probabilities(vector_to_array("features")))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumns({"prediction": best.cast("double"), "probability": array_to_vector("probability")})


def _probabilities(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-margins))
        return np.hstack([1.0 - p, p])
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bin_borders(rows: DataFrame, bins: int, seed: int) -> list[np.ndarray]:
    """Borders of every feature: between the distinct values of a hashed sample, or its quantiles if these are more than `bins`."""
    sample = rows.select("x", "h").orderBy(F.xxhash64(F.lit(seed), "h"), "h").limit(CUT_ROWS).collect()
    if not sample:
        raise RuntimeError("no rows to fit boosted trees on")
    out = []
    for column in np.array([r.x for r in sample], dtype=float).T:
        values = np.unique(column[np.isfinite(column)])
        if len(values) > bins:
            values = np.unique(np.quantile(column[np.isfinite(column)], np.linspace(0, 1, bins), method="lower"))
        out.append((values[:-1] + values[1:]) / 2)
    return out


@dataclass
class _Round:
    """What a pass needs: model so far (since the margins were written), this round's growing trees and draws."""

    number: int
    recent: list[list[Tree]]
    growing: list[Tree]
    columns: np.ndarray
    bins: int
    sample: float
    watch: float
    seed: int
    parts: int


def _block(row: dict, classes: int, features: int) -> tuple[np.ndarray, ...]:
    y = np.frombuffer(row["y"], np.int32)
    x = np.frombuffer(row["x"], np.uint8).reshape(len(y), features)
    return x, y, np.frombuffer(row["h"], np.uint64), np.frombuffer(row["m"], np.float64).reshape(len(y), classes)


def _advance(x: np.ndarray, margins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    margins = margins.copy()
    right = lambda rows, f, cut: x[rows, f] > cut
    for trees in rounds:
        for c, tree in enumerate(trees):
            margins[:, c] += tree.value[tree.leaves(right, len(x))]
    return margins


def _sums(blocks: Iterator[tuple[np.ndarray, ...]], level: int, r: _Round) -> Iterator[tuple[int, np.ndarray]]:
    """Histograms of one task, cut by feature groups; group -1 holds loss and number of the watched rows."""
    k, nodes = len(r.growing), 2**level
    total = np.zeros((k, nodes, len(r.columns), r.bins, 2), np.int64)
    loss, seen = 0, 0
    for x, y, h, margins in blocks:
        margins = _advance(x, margins, r.recent)
        p = _probabilities(margins)
        watched = hashed_draws(h, r.seed) < r.watch
        if level == 0 and r.watch:
            right = np.maximum(p[watched, y[watched]], 1e-15)
            loss, seen = loss + int(np.rint(-np.log(right) * UNIT).sum()), seen + int(watched.sum())
        use = np.nonzero(~watched & (hashed_draws(h, r.seed * 1_000_003 + r.number + 1) < r.sample))[0]
        x, y, p = x[use], y[use], p[use]
        right = lambda rows, f, cut, x=x: x[rows, f] > cut
        for c, tree in enumerate(r.growing):
            own = p[:, 1] if k == 1 else p[:, c]
            hit = y == (1 if k == 1 else c)
            g = np.rint((own - hit) * UNIT)
            curve = np.rint(np.maximum(own * (1.0 - own) * (1.0 if k == 1 else 2.0), 1e-16) * UNIT)
            node = tree.leaves(right, len(x), level) - (nodes - 1)
            live = np.nonzero(node >= 0)[0]  # rows whose path is still open at this level
            at = node[live] * r.bins
            for i, f in enumerate(r.columns):
                cell = at + x[live, f]
                total[c, :, i, :, 0] += np.bincount(cell, g[live], nodes * r.bins).astype(np.int64).reshape(nodes, r.bins)
                total[c, :, i, :, 1] += np.bincount(cell, curve[live], nodes * r.bins).astype(np.int64).reshape(nodes, r.bins)
    groups = np.array_split(np.arange(len(r.columns)), r.parts)
    yield from ((j, total[:, :, g].ravel()) for j, g in enumerate(groups) if len(g))
    if level == 0 and r.watch:
        yield -1, np.array([loss, seen], np.int64)


def _offers(part: int, sums: np.ndarray, level: int, r: _Round) -> list[Offer]:
    """Best split of every class and node among one group of features, from all tasks' sums."""
    if part < 0:
        return [Offer(-1, 0, 0, 0, 0.0, 0, 0, int(sums[0]), int(sums[1]))]
    group = np.array_split(r.columns, r.parts)[part]
    sums = sums.reshape(len(r.growing), 2**level, len(group), r.bins, 2)
    out = []
    left = np.cumsum(sums, axis=3)[:, :, :, :-1]
    whole = sums.sum(axis=3)[:, :, :, None]
    gl, hl = left[..., 0] / UNIT, left[..., 1] / UNIT
    g, h = whole[..., 0] / UNIT, whole[..., 1] / UNIT
    with np.errstate(invalid="ignore"):
        gain = gl**2 / (hl + PENALTY) + (g - gl) ** 2 / (h - hl + PENALTY) - g**2 / (h + PENALTY)
    gain[(hl < LEAST_CURVATURE) | (h - hl < LEAST_CURVATURE)] = -1.0
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=2)  # equal gains: the first feature and border
    for c in range(flat.shape[0]):
        for node in range(flat.shape[1]):
            f, cut = divmod(int(best[c, node]), r.bins - 1)
            if whole[c, node, f, 0, 1]:
                out.append(Offer(c, node, int(group[f]), cut, float(flat[c, node, best[c, node]]), int(left[c, node, f, cut, 0]),
                                 int(left[c, node, f, cut, 1]), int(whole[c, node, f, 0, 0]), int(whole[c, node, f, 0, 1])))
    return out


def fit_boosted_trees(train: DataFrame, classes: int, rounds: int, depth: int, rate: float, sample: float, columns: float, bins: int,
                      watch: float, patience: int, seed: int) -> BoostedModel:
    """train: y, features and anything that tells rows apart. `watch` is the hashed share of rows that early stopping looks at; 0 switches it off.

    Training stops once the watched loss has not improved for `patience` rounds, and the rounds up to the best are kept.
    """
    spark = train.sparkSession
    others = [c for c in train.columns if c not in ("y", "features")]
    rows = train.select(F.col("y").cast("int").alias("y"), vector_to_array("features").alias("x"),
                        F.xxhash64(F.lit(seed), *others, "y", vector_to_array("features")).alias("h"))
    model = BoostedModel(bin_borders(rows, bins, seed), classes)
    features, k = len(model.cuts), 1 if classes == 2 else classes
    model.gains = np.zeros(features)

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), dtype=float)
            codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(model.cuts)], axis=1).astype(np.uint8)
            y, h = np.asarray(batch.column(0), dtype=np.int32), np.asarray(batch.column(2), dtype=np.int64)
            cells = [codes.tobytes(), y.tobytes(), h.tobytes(), np.zeros((len(y), k)).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["x", "y", "h", "m"])

    packed = cut_lineage(rows.mapInArrow(pack, _STATE))
    n = (packed.agg(F.sum(F.length("y"))).first()[0] or 0) // 4
    state = packed.rdd.map(lambda row: _block(row, k, features)).coalesce(max(1, -(-n // TASK_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
    recent: list[list[Tree]] = []
    grown: list[tuple[list[Tree], np.ndarray]] = []
    best, best_loss = 0, np.inf
    for number in range(rounds + 1):
        rng = np.random.default_rng([seed, number])
        chosen = np.sort(rng.choice(features, max(1, round(columns * features)), replace=False))
        r = _Round(number, recent, [Tree.empty(depth) for _ in range(k)], chosen, bins, sample, watch, seed,
                   min(len(chosen), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        open_, gains = {(c, 0) for c in range(k)}, np.zeros(features)
        for level in range(depth):
            offers = _best_splits(state, level, r)
            if level == 0 and watch:
                seen = [o for o in offers if o.cls < 0]
                if seen and seen[0].h:
                    model.losses.append(seen[0].g / UNIT / seen[0].h)
                    if model.losses[-1] < best_loss:
                        best, best_loss = number, model.losses[-1]
            if level == 0 and (number == rounds or model.losses and number - best >= patience):
                break
            picked = {}
            for o in offers:
                if o.cls >= 0 and (o.cls, o.node) in open_ and (o.gain, -o.feature) > picked.get((o.cls, o.node), ((-1.0, 0),))[0]:
                    picked[o.cls, o.node] = (o.gain, -o.feature), o
            roots = [o for o in offers if o.cls >= 0 and level == 0]
            for o in roots:  # a tree without any split is its root
                r.growing[o.cls].value[0] = -rate * o.g / (o.h + PENALTY * UNIT)
            open_ = set()
            for (c, node), ((gain, _), o) in picked.items():
                if gain <= 1e-9:
                    continue
                tree, at = r.growing[c], 2**level - 1 + node
                tree.feature[at], tree.cut[at] = o.feature, o.cut
                gains[o.feature] += gain
                for side, (g, h) in enumerate(((o.gl, o.hl), (o.g - o.gl, o.h - o.hl))):
                    tree.value[2 * at + 1 + side] = -rate * g / (h + PENALTY * UNIT)
                    open_.add((c, 2 * node + side))
            if not open_:
                break
        if number == rounds or model.losses and number - best >= patience:
            break
        grown.append((r.growing, gains))
        recent = [*recent, r.growing]
        if len(recent) == KEEP_ROUNDS:
            state = _written(state, recent)
            recent = []
    state.unpersist()
    kept = grown[:best] if model.losses else grown
    model.trees = [trees for trees, _ in kept]
    for _, gains in kept:
        model.gains += gains
    return model


def _best_splits(state: RDD, level: int, r: _Round) -> list[Offer]:
    sums = state.mapPartitions(lambda blocks: _sums(blocks, level, r)).reduceByKey(np.add, min(r.parts, state.getNumPartitions()))
    return sums.flatMap(lambda cell: _offers(*cell, level, r)).collect()


def _written(state: RDD, rounds: list[list[Tree]]) -> RDD:
    """Blocks with the margins of the rounds since they were last written, kept beyond the loss of an executor."""
    out = state.map(lambda block: (*block[:3], _advance(block[0], block[3], rounds))).persist(StorageLevel.MEMORY_AND_DISK)
    out.checkpoint()
    out.count()
    state.unpersist()
    return out
