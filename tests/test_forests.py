"""swapped votes of a forest come from the paths of its trees, not from a transform of every swapped row."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pollwarden.operators import supervised as P
from pollwarden.operators.forests import forest_nodes


@pytest.fixture(scope="module", params=[2, 3])
def fitted(spark, request):
    rng = np.random.default_rng(request.param)
    x = np.round(rng.normal(size=(400, 5)), 1)  # values and rows repeat
    y = (np.digitize(x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=400), [0.0, 1.0][:request.param - 1])).astype(int)
    rows = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "row_id long, a double, b double, c double, d double, e double, y int")
    rows = P.assemble(rows, list("abcde")).persist()
    return rows, P.random_forest(30, 6)(rows.select("y", "features"), request.param), x


def test_swapped_votes_are_those_of_the_model(spark, fitted):
    _, model, x = fitted
    z = x[::-1].copy()
    x = x.copy()
    x[3, 0], z[7, 1], z[9, 0] = np.nan, np.nan, np.inf
    got = forest_nodes(spark, model).swapped(x, np.r_[0:400, 0:3], np.vstack([z, z[5:8]]))
    swaps = [(i, f, [float(z[i][j] if j == f else v) for j, v in enumerate(x[i])]) for i in range(400) for f in range(5)]
    df = spark.createDataFrame(swaps, "i int, f int, v array<double>").repartition(4)
    want = np.zeros((400, 5))
    for r in model.transform(df.select("i", "f", array_to_vector("v").alias("features"))).select("i", "f", "prediction").collect():
        want[r["i"], r["f"]] = r["prediction"]
    assert (got[:400] == want).all() and len(np.unique(want)) > 1 and len(got) == 403


def test_importance_equals_that_of_any_model_and_scores_the_rows_once(spark, fitted, monkeypatch):
    rows, model, _ = fitted
    rows = rows.withColumn("y", F.when(F.col("row_id") % 10 > 0, F.col("y")))  # a row without a label has no part in the accuracy

    class Plain:
        """The same model, of a type without known nodes."""

        transform = staticmethod(model.transform)

    want = {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in P.permutation_importance(rows, Plain, list("abcde"), "row_id", 3).collect()}
    calls, scored = [], type(model).transform
    monkeypatch.setattr(type(model), "transform", lambda self, df: calls.append(1) or scored(self, df))
    got = {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in P.permutation_importance(rows, model, list("abcde"), "row_id", 3).collect()}
    assert len(calls) == 1 and got.keys() == want.keys() and max(got, key=got.get) == "a" and got["a"][0] > 0.1
    assert all(got[f] == pytest.approx(want[f], abs=1e-12) for f in want)
