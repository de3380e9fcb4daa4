"""The kernel SVC against an exact solver of the same objective."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pollwarden.operators import supervised as S


def table(spark, x, y):
    rows = [(i, int(t), [float(v) for v in p]) for i, (p, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, y int, x array<double>").select("row_id", "y", array_to_vector("x").alias("features"))


def exact_decisions(x, y, points, gamma, c=1.0):
    """Squared hinge in the kernel's own space, balanced classes, regularised intercept: Newton steps on the dual coefficients."""
    kernel = S.rbf_kernel(x, x, gamma) + 1.0
    sign = np.where(y == 1, 1.0, -1.0)
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    active, beta = np.ones(len(y), bool), None
    for _ in range(100):
        a = np.flatnonzero(active)
        beta = np.zeros(len(y))
        beta[a] = np.linalg.solve(kernel[np.ix_(a, a)] + np.diag(1.0 / (2 * c * weight[a])), sign[a])
        now = sign * (kernel @ beta) < 1
        if (now == active).all():
            break
        active = now
    return (S.rbf_kernel(points, x, gamma) + 1.0) @ beta > 0


def rings(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, ((x[:, 0] ** 2 + x[:, 1] ** 2 > 1.4) ^ (rng.random(n) < 0.05)).astype(int)


def test_decisions_agree_with_the_exact_kernel(spark):
    x, y = rings(500, 3)
    test, _ = rings(1000, 4)
    model = S.rbf_svc(landmarks=128)(table(spark, x, y), 2)
    got = {r.row_id: r.prediction for r in model.transform(table(spark, test, np.zeros(1000))).select("row_id", "prediction").collect()}
    want = exact_decisions(x, y, test, 1.0 / (3 * x.var()))
    assert np.mean(np.array([got[i] for i in range(1000)]) == want) >= 0.98
    assert model.kernel_error["mean"] < 0.01 and model.kernel_error["max"] >= model.kernel_error["mean"]


def test_landmarks_do_not_depend_on_partitions_or_copies(spark):
    x, y = rings(200, 5)
    x[:80] = x[0]  # one point holds a large share of the rows
    df = table(spark, x, y).select(F.col("features"))
    from pyspark.ml.functions import vector_to_array

    points = df.select(vector_to_array("features").alias("x"))
    one, many = (S.seeded_centres(points.repartition(n), 32) for n in (1, 7))
    assert np.allclose(one, many, atol=1e-9) and len(np.unique(one.round(9), axis=0)) == 32
    few = table(spark, np.vstack([x[0], x[0], x[90]]), np.array([0, 0, 1]))
    model = S.rbf_svc(landmarks=16)(few, 2)
    assert model.kernel_error["max"] < 1e-9  # a landmark at every point: exact
    assert [r.prediction for r in model.transform(few).orderBy("row_id").collect()] == [0.0, 0.0, 1.0]
