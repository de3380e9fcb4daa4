"""Nodes of a fitted MLlib forest as flat arrays, and votes of rows in which one feature at a time has another value."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.session import ensure_checkpoint_dir

#: Pairs of row and partner that a task walks at once: few enough for their votes to stay in the processor's cache.
PAIRS = 2048


@dataclass
class ForestNodes:
    """All trees in one table of nodes; a leaf has feature -1 and leads to itself, its votes are its class shares."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    votes: np.ndarray

    def path(self, root: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of every row from the root on, one column a level (leaves repeat), and whether the row goes left there."""
        nodes, lefts, each = [np.full(len(x), root, dtype=np.int32)], [], np.arange(len(x))
        while True:
            feature = self.feature[nodes[-1]]
            lefts.append(x[each, feature] <= self.threshold[nodes[-1]])
            if (feature < 0).all():
                return np.stack(nodes, axis=1), np.stack(lefts, axis=1)
            nodes.append(np.where(lefts[-1], self.left[nodes[-1]], self.right[nodes[-1]]))

    def swapped(self, x: np.ndarray, row: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Class of each pair (x[row], z) and feature when that feature's value is taken from z.

        A swap moves a row only in trees whose path tests the feature with another answer: from the first such node
        the row is walked again, elsewhere its leaf is kept. Votes are added tree by tree, in MLlib's order.
        """
        width = z.shape[1]
        votes = np.zeros((self.votes.shape[1], len(row), width))
        flat = votes.reshape(len(votes), -1)
        first = np.empty(flat.shape[1], dtype=np.int64)
        for root in self.roots:
            nodes, lefts = self.path(root, x)
            leaf, nodes, lefts = nodes[row, -1], nodes[row, :-1], lefts[row, :-1]
            feature = self.feature[nodes]
            other = (z[np.arange(len(row))[:, None], feature] <= self.threshold[nodes]) != lefts
            pair, level = np.nonzero(other & (feature >= 0))
            f, at, cell = feature[pair, level], nodes[pair, level], np.arange(len(pair))
            key = pair * width + f
            first[key[::-1]] = cell[::-1]  # of several nodes of a feature the one nearest to the root
            kept = first[key] == cell
            pair, f, at, key, was = pair[kept], f[kept], at[kept], key[kept], lefts[pair[kept], level[kept]]
            at = np.where(was, self.right[at], self.left[at])
            open_ = np.flatnonzero(self.feature[at] >= 0)
            while len(open_):
                p, node = pair[open_], at[open_]
                asked = self.feature[node]
                value = np.where(asked == f[open_], z[p, asked], x[row[p], asked])
                at[open_] = node = np.where(value <= self.threshold[node], self.left[node], self.right[node])
                open_ = open_[self.feature[node] >= 0]
            for k, own in enumerate(self.votes.T):
                moved = flat[k, key] + own[at]
                votes[k] += own[leaf][:, None]
                flat[k, key] = moved
        return votes.argmax(axis=0)


def forest_nodes(spark: SparkSession, model) -> ForestNodes | None:
    """The nodes of an MLlib forest of numeric features, read from its saved table; None for other models."""
    if not isinstance(model, RandomForestClassificationModel) or model.isDefined("thresholds"):
        return None
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    node, split = F.col("nodeData"), F.col("nodeData.split")
    found = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        split["numCategories"].alias("categories"), *[F.get(node["impurityStats"], F.lit(k)).alias(f"c{k}") for k in range(model.numClasses)])
    table = found.toPandas().sort_values(["tree", "id"], ignore_index=True)
    inner = (table["left"] >= 0).to_numpy()
    if (table["categories"][inner] >= 0).any():
        return None
    own = np.arange(len(table))
    roots = np.flatnonzero(table["id"].to_numpy() == 0)
    start = roots[np.searchsorted(roots, own, side="right") - 1]  # ids of a tree count from 0 without a gap
    counts = table[[f"c{k}" for k in range(model.numClasses)]].to_numpy()
    total = np.zeros(len(counts))
    for column in counts.T:
        total = total + column
    return ForestNodes(
        roots, np.where(inner, table["feature"], -1).astype(np.int32), np.where(inner, table["threshold"], np.inf),
        np.where(inner, start + table["left"], own).astype(np.int32), np.where(inner, start + table["right"], own).astype(np.int32),
        np.divide(counts, total[:, None], out=np.zeros_like(counts), where=total[:, None] != 0))


def swapped_hits(pairs: DataFrame, nodes: ForestNodes, repeats: int) -> DataFrame:
    """Rows with a label (`n`) and right answers (`hits`) of each repeat _r and feature _f, as parts to add up.

    Pairs have the row's number _n, its label y and vector _x, and the partner's vector _z; the pairs of a row that lie together share its walk.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(nodes)

    def count(batches):
        n = hits = None
        for pdf in batches:
            for i in range(0, len(pdf), PAIRS):
                part = pdf.iloc[i:i + PAIRS]
                _, one, row = np.unique(part["_n"].to_numpy(), return_index=True, return_inverse=True)
                z = np.array(part["_z"].to_list(), dtype=float)
                got = shared.value.swapped(np.array(part["_x"].iloc[one].to_list(), dtype=float), row, z)
                y, r = part["y"].to_numpy(dtype=float), part["_r"].to_numpy()
                if n is None:
                    n, hits = np.zeros(repeats, dtype=np.int64), np.zeros((repeats, z.shape[1]), dtype=np.int64)
                np.add.at(n, r[~np.isnan(y)], 1)
                right = got == y[:, None]
                for k in range(repeats):
                    hits[k] += right[r == k].sum(axis=0)
        if n is not None:
            r, f = np.indices(hits.shape)
            yield pd.DataFrame({"_r": r.ravel(), "_f": f.ravel(), "n": n[r.ravel()], "hits": hits.ravel()})

    return pairs.select("_r", "_n", "y", "_x", "_z").mapInPandas(count, "_r int, _f int, n long, hits long")
