"""Random forests on many rows, grown from counts of binned rows.

Rows are binned once and kept as blocks of numpy columns; each block is dealt with every group of trees. A level of all trees is one pass: a task
keeps, tree by tree, the rows of the bag and the open node each stands at, and counts (node, drawn feature, bin, class). The counts of a tree meet
in one place, which picks the best split of its nodes; the driver sees these splits only. Counts are whole numbers, and bags and features are
drawn by hashes of row and tree: the trees are the same however the rows are partitioned.

The rules are those of MLlib's classifier: Poisson bags, square root of the features drawn for every node, 32 bins, Gini gain of class-weighted
counts, least number of drawn rows in a child, leaves of one parent that say the same merged into it, and votes by class shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollwarden.operators.augment import hashed_draws
from pollwarden.operators.boosting import bin_borders
from pollwarden.operators.forests import ForestNodes
from pollwarden.session import cut_lineage

BINS = 32
#: Rows of a block and trees of a group: what one task holds. Nodes whose counts travel as one array. Levels after which the rows' nodes are kept anew.
BLOCK_ROWS, GROUP_TREES, NODES, KEEP_LEVELS = 1_000_000, 8, 4096, 3
#: Shares of rows drawn at most 0, 1, ... times into a bag.
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])
#: Splits of a tree's open nodes: feature, code of the border (rows above it go right), and of each node its left and right child's numbers among the next open nodes, -1 for a leaf.
Splits = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class GrownForest:
    """Nodes of all trees and impurity importances; bounded by trees and depth, and broadcast."""

    nodes: ForestNodes
    featureImportances: DenseVector  # noqa: N815 - the name MLlib's models have

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees of the class shares in each row's leaf."""
        n, each, out = self.nodes, np.arange(len(x)), np.zeros((len(x), self.nodes.votes.shape[1]))
        for root in n.roots:
            at = np.full(len(x), root, dtype=np.int32)
            while (feature := n.feature[at]).max(initial=-1) >= 0:
                at = np.where(x[each, feature] <= n.threshold[at], n.left[at], n.right[at])
            out += n.votes[at]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """df with probability (a vector) and prediction."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.Series) -> pd.Series:
            votes = shared.value.votes(np.array(x.to_list(), dtype=float).reshape(len(x), -1))
            return pd.Series(list(votes / votes.sum(axis=1, keepdims=True)))

        scored = df.withColumn("probability", probabilities(vector_to_array("features")))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumns({"prediction": best.cast("double"), "probability": array_to_vector("probability")})


@dataclass
class _Tree:
    """A tree on the driver: columns of all nodes so far, and the numbers of its open nodes."""

    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    levels: list = field(default_factory=list)
    open: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    size: int = 0


def _drawn(seed: list[int], level: int, nodes: int, features: int) -> np.ndarray:
    """The features that each open node of a tree may split on."""
    return np.random.default_rng([*seed, level]).random((nodes, features)).argsort(axis=1)[:, :math.ceil(math.sqrt(features))]


def _bag(h: np.ndarray, seed: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows drawn for a tree, the open node they stand at (the root), and how often each is drawn."""
    times = np.searchsorted(_POISSON, hashed_draws(h, seed[0] * 1_000_003 + seed[1]), "right")
    at = np.flatnonzero(times).astype(np.int32)
    return at, np.zeros(len(at), np.uint8), times[at].astype(np.uint8)


def _counted(group: tuple, level: int, sizes: dict[int, int], seeds: dict[int, list[int]], classes: int, run: int, whole: type) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Drawn rows of a block by (drawn feature, node, bin, class), for each tree of the group and run of nodes."""
    x, y, bags = group
    flat, rows = x.ravel(), x.shape[1]
    for tree, (at, node, times) in bags.items():
        if not sizes.get(tree):
            continue
        drawn = _drawn(seeds[tree], level, sizes[tree], len(x)).T.astype(np.int64) * rows
        for first in range(0, sizes[tree], run):
            some = slice(None) if sizes[tree] <= run else np.flatnonzero((node >= first) & (node < first + run))
            here, own, weights = at[some], node[some].astype(np.int64) - first, times[some].astype(float)
            starts = np.ascontiguousarray(drawn[:, first:first + run])
            cell, size = own * (BINS * classes) + y[here], starts.shape[1] * BINS * classes
            found = np.empty((len(starts), size), whole)
            for j, start in enumerate(starts):
                found[j] = np.bincount(cell + flat[start[own] + here].astype(np.int64) * classes, weights, size)
            yield (tree, first), found


def _gini(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1, keepdims=True)
    return 1.0 - (np.divide(counts, total, out=np.zeros_like(counts), where=total > 0) ** 2).sum(axis=-1)


def _best(key: tuple[int, int], found: np.ndarray, level: int, size: int, seed: list[int], features: int, weights: np.ndarray, min_leaf: int, run: int) -> tuple:
    """Best split of every node: gain (none: -inf), feature, border, and the drawn rows of each class in all and on the left."""
    tree, first = key
    counts = found.reshape(len(found), -1, BINS, len(weights)).astype(np.int64)
    drawn = _drawn(seed, level, size, features)[first:first + run]
    total = counts[0].sum(axis=1)
    gain = np.empty((counts.shape[1], len(counts), BINS - 1))
    whole, impurity = total * weights, _gini(total * weights)[:, None]
    lefts = counts.cumsum(axis=2)[:, :, :-1]
    for j, left in enumerate(lefts):
        right = total[:, None] - left
        share = (left * weights).sum(axis=2) / whole.sum(axis=1)[:, None]
        gain[:, j] = impurity - share * _gini(left * weights) - (1.0 - share) * _gini(right * weights)
        gain[:, j][(left.sum(axis=2) < min_leaf) | (right.sum(axis=2) < min_leaf)] = -np.inf
    gain = gain.reshape(len(gain), -1)
    best = gain.argmax(axis=1)  # equal gains: the feature drawn first and the lowest border
    j, cut = np.divmod(best, BINS - 1)
    each = np.arange(len(best))
    return tree, first, gain[each, best], drawn[each, j].astype(np.int32), cut.astype(np.uint8), total, lefts[j, each, cut]


def _grow(tree: _Tree, offers: list[tuple], borders: list[np.ndarray], last: bool, min_leaf: int) -> Splits:
    """Adds the children of the split nodes; only children of two or more classes, with rows for two leaves, are open."""
    gain, feature, cut, total, left = (np.concatenate([o[k] for o in sorted(offers, key=lambda o: o[1])]) for k in range(2, 7))
    if not tree.size:
        tree.size = 1
        for column, value in ((tree.feature, [-1]), (tree.threshold, [np.inf]), (tree.left, [0]), (tree.gain, [0.0]), (tree.counts, total)):
            column.append(np.asarray(value))
    split = gain > 0
    n, ids = int(split.sum()), tree.open[split]
    counts = np.stack([left[split], (total - left)[split]], axis=1).reshape(2 * n, -1)
    tree.levels.append((ids, feature[split], np.array([borders[f][c] for f, c in zip(feature[split], cut[split])]), tree.size + 2 * np.arange(n), gain[split]))
    children = tree.size + np.arange(2 * n)
    for column, value in ((tree.feature, np.full(2 * n, -1)), (tree.threshold, np.full(2 * n, np.inf)), (tree.left, children), (tree.gain, np.zeros(2 * n)), (tree.counts, counts)):
        column.append(value)
    tree.size += 2 * n
    goes_on = ((counts > 0).sum(axis=1) > 1) & (counts.sum(axis=1) >= 2 * min_leaf) & (not last)
    tree.open = children[goes_on]
    number = np.where(goes_on, np.cumsum(goes_on) - 1, -1).reshape(n, 2)
    sides = np.full((len(split), 2), -1, np.int32)
    sides[split] = number
    return feature, cut, sides.ravel()


def _moved(group: tuple, levels: list[dict[int, Splits]]) -> tuple:
    """The block with its rows further down; rows that reach a leaf are left out."""
    x, y, bags = group
    flat = x.ravel()
    for splits in levels:
        down = {}
        for tree, (at, node, times) in bags.items():
            if tree in splits:
                feature, cut, sides = splits[tree]
                node = node.astype(np.int64)
                above = flat[(feature.astype(np.int64) * x.shape[1])[node] + at] > cut[node]
                to = sides[2 * node + above]
                kept = np.flatnonzero(to >= 0)
                down[tree] = at[kept], to[kept].astype(np.min_scalar_type(len(sides))), times[kept]
        bags = down
    return x, y, bags


def _finished(tree: _Tree, weights: np.ndarray, features: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns of the tree's nodes after merging leaves that say the same, root first, and its importances."""
    feature, threshold, left, gain, counts = (np.concatenate(c) for c in (tree.feature, tree.threshold, tree.left, tree.gain, tree.counts))
    right, counts = left.copy(), counts * weights
    for ids, f, t, child, g in tree.levels:
        feature[ids], threshold[ids], left[ids], right[ids], gain[ids] = f, t, child, child + 1, g
    says = counts.argmax(axis=1)
    for ids, *_ in reversed(tree.levels):
        l, r = left[ids], right[ids]
        merged = ids[(feature[l] < 0) & (feature[r] < 0) & (says[l] == says[r])]
        feature[merged], threshold[merged], left[merged], right[merged] = -1, np.inf, merged, merged
    inner = feature >= 0
    importance = np.bincount(feature[inner], (gain * counts.sum(axis=1))[inner], features)
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    kept[left[inner]] = kept[right[inner]] = True
    number = np.cumsum(kept) - 1
    columns = {"feature": feature[kept], "threshold": threshold[kept], "left": number[left[kept]], "right": number[right[kept]], "votes": counts[kept] / counts[kept].sum(axis=1, keepdims=True)}
    return columns, importance / importance.sum() if importance.sum() > 0 else importance


def fit_grown_forest(train: DataFrame, sizes: dict[int, int], weights: dict[int, float], trees: int, depth: int, min_leaf: int, seed: int) -> GrownForest:
    """train: y, features and anything that tells rows apart; `sizes` and `weights`: rows and weight of each class."""
    context = train.sparkSession.sparkContext
    others = [c for c in train.columns if c not in ("y", "features")]
    rows = train.select(F.col("y").cast("int").alias("y"), vector_to_array("features").alias("x"),
                        F.xxhash64(F.lit(seed), *others, "y", vector_to_array("features")).alias("h"))
    borders = bin_borders(rows, BINS, seed)
    features, classes = len(borders), max(2, max(sizes) + 1)
    by_class = np.array([weights.get(c, 0.0) for c in range(classes)])

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, features)
            if not np.isfinite(x).all():
                raise ValueError("features of train rows must be finite")
            codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(borders)]).astype(np.uint8)
            y, h = np.asarray(batch.column(0)).astype(np.min_scalar_type(classes)), np.asarray(batch.column(2), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (codes, y, h)], ["x", "y", "h"])

    packed = cut_lineage(rows.mapInArrow(pack, "x binary, y binary, h binary")).rdd
    total = sum(sizes.values())
    blocks = max(1, -(-total // BLOCK_ROWS))
    groups = min(trees, max(-(-trees // GROUP_TREES), -(-3 * context.defaultParallelism // blocks)))
    seeds = {t: [seed, t] for t in range(trees)}
    run, whole, kind = NODES, np.int32 if total < 2**30 else np.int64, np.min_scalar_type(classes)

    def deal(number: int, parts: Iterator) -> Iterator:
        cells = [(np.frombuffer(p["x"], np.uint8).reshape(features, -1), np.frombuffer(p["y"], kind), np.frombuffer(p["h"], np.uint64)) for p in parts]
        if cells:
            block = tuple(np.concatenate(c, axis=-1) for c in zip(*cells))
            yield from ((number * groups + g, block) for g in range(groups))

    def plant(key: int, block: tuple) -> tuple:
        x, y, h = block
        return x, y, {t: _bag(h, seeds[t]) for t in range(key % groups, trees, groups)}

    dealt = packed.repartition(blocks).mapPartitionsWithIndex(deal).partitionBy(blocks * groups, lambda key: key)
    state = dealt.map(lambda kv: plant(*kv)).persist(StorageLevel.MEMORY_AND_DISK)
    grown = {t: _Tree() for t in range(trees)}
    parts = min(trees, 4 * context.defaultParallelism)
    before, since = None, []  # the state before the one that is kept now, and the splits since that one
    for level in range(depth):
        now = state
        if since:
            now = state.map(lambda group, since=tuple(since): _moved(group, [s.value for s in since]))
        if len(since) == KEEP_LEVELS:
            before, state, since = state, now.persist(StorageLevel.MEMORY_AND_DISK), []
        open_ = {t: len(tree.open) for t, tree in grown.items() if len(tree.open)}
        counts = now.flatMap(lambda group, level=level, open_=open_: _counted(group, level, open_, seeds, classes, run, whole)).reduceByKey(np.add, parts)
        best = counts.map(lambda kv, level=level, open_=open_: _best(*kv, level, open_[kv[0][0]], seeds[kv[0][0]], features, by_class, min_leaf, run))
        offers: dict[int, list[tuple]] = {}
        for offer in best.collect():
            offers.setdefault(offer[0], []).append(offer)
        if before:
            before.unpersist()
            before = None
        splits = {t: _grow(grown[t], found, borders, level + 1 == depth, min_leaf) for t, found in offers.items()}
        if not any(len(tree.open) for tree in grown.values()):
            break
        since.append(context.broadcast(splits))
    state.unpersist()
    finished = [_finished(tree, by_class, features) for tree in grown.values() if tree.size]  # a tree of an empty bag has no vote
    starts = np.cumsum([0, *[len(c["feature"]) for c, _ in finished]])
    column = lambda name: np.concatenate([c[name] for c, _ in finished])
    shift = np.repeat(starts[:-1], np.diff(starts))
    nodes = ForestNodes(starts[:-1], column("feature").astype(np.int32), column("threshold"), (column("left") + shift).astype(np.int32),
                        (column("right") + shift).astype(np.int32), column("votes"))
    importance = np.sum([i for _, i in finished], axis=0)
    return GrownForest(nodes, Vectors.dense(importance / importance.sum() if importance.sum() > 0 else importance))
