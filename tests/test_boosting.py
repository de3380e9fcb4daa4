"""Boosted trees: the same trees for any partitioning, early stopping for three classes, and splits against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollwarden.operators import boosting as B
from pollwarden.operators import supervised as P


def rings(n=900, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    radius = np.hypot(x[:, 0], x[:, 1])
    y = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), np.digitize(radius, [0.9, 1.6]))  # a tenth of the labels is noise
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = rings()
    rows = [(i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(x, y))]
    return P.assemble(spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, y int"), ["a", "b", "c", "d"]).select(
        "y", "features", "row_id").cache()


def same(one, two):
    return len(one.trees) == len(two.trees) and all(
        (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all()
        for p, q in zip(one.trees, two.trees) for a, b in zip(p, q))


def test_three_classes_stop_early_on_the_same_trees(table):
    fit = P.boosted_trees(rounds=40, depth=3, rate=0.5, stop_early=True, patience=3)
    one, two = (fit(table.repartition(n), 3) for n in (2, 16))
    assert same(one, two) and one.losses == two.losses
    assert 0 < one.best < 40 and len(one.losses) < 41  # the noise makes the watched loss rise again
    assert one.losses[one.best] == min(one.losses)
    out = one.transform(table)
    assert out.where("prediction = y").count() > 0.75 * 900
    p = out.select(F.col("probability")).first()[0]
    assert len(p) == 3 and sum(p) == pytest.approx(1)
    gains = one.featureImportances.toArray()
    assert gains.sum() == pytest.approx(1) and gains[0] + gains[1] > 0.8


def test_trees_follow_plain_newton_boosting(table):
    """Every split and leaf of two rounds against exhaustive search over the same borders."""
    model = P.boosted_trees(rounds=2, depth=2, rate=0.3, sample=1.0, columns=1.0, bins=16)(table, 3)
    local = table.collect()
    x, y = np.array([r.features.toArray() for r in local]), np.array([r.y for r in local])
    margins = np.zeros((len(y), 3))
    for trees in model.trees:
        p = B._probabilities(margins)
        step = np.zeros_like(margins)
        for c, tree in enumerate(trees):
            g, h = p[:, c] - (y == c), 2 * p[:, c] * (1 - p[:, c])

            def grow(rows, node, level, g=g, h=h, tree=tree):
                best = (1e-9, None)
                for f, cuts in enumerate(model.cuts):
                    for i, at in enumerate(cuts):
                        left = rows[x[rows, f] <= at]
                        hl, hr = h[left].sum(), h[rows].sum() - h[left].sum()
                        if min(hl, hr) >= 1:
                            gain = g[left].sum() ** 2 / (hl + 1) + (g[rows].sum() - g[left].sum()) ** 2 / (hr + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                            if gain > best[0] + 1e-6:
                                best = (gain, (f, i, left))
                if level == 2 or best[1] is None:
                    assert tree.feature[node] == -1 and tree.value[node] == pytest.approx(-0.3 * g[rows].sum() / (h[rows].sum() + 1), abs=1e-5)
                    step[rows, c] = tree.value[node]
                    return
                f, i, left = best[1]
                assert (tree.feature[node], tree.cut[node]) == (f, i)
                grow(left, 2 * node + 1, level + 1)
                grow(np.setdiff1d(rows, left), 2 * node + 2, level + 1)

            grow(np.arange(len(y)), 0, 0)
        margins += step
    assert np.allclose(model.margins(x), margins)


def test_two_classes_constant_columns_and_repeated_rows(spark):
    rows = [(1, float(i % 7), 5.0, float("nan") if i % 5 == 0 else 1.0, int(i % 7 > 3)) for i in range(200)]
    df = P.assemble(spark.createDataFrame(rows, "row_id long, a double, b double, c double, y int"), ["a", "b", "c"])
    model = P.boosted_trees(rounds=12, depth=2, columns=1.0)(df, 2)
    assert model.transform(df).where("prediction <> y").count() == 0 and model.best == 12 and not model.losses
    with pytest.raises(RuntimeError):
        P.boosted_trees(rounds=2)(df.limit(0), 2)
