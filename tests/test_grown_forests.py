"""forests of many rows are grown tree by tree from counts; the trees are those of a plain search, however the rows lie."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pollwarden.operators import grown as G
from pollwarden.operators import supervised as P
from pollwarden.plans import jobs

TREES, DEPTH, LEAF, SEED = 5, 5, 2, 42


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 5)), 1)
    y = np.digitize(x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=700), [0.0, 1.2])
    rows = spark.createDataFrame([(i, *map(float, v), 4.0, int(c)) for i, (v, c) in enumerate(zip(x, y))], "row_id long, a double, b double, c double, d double, e double, same double, y int")
    return P.assemble(rows, ["a", "b", "c", "d", "e", "same"]).select("y", "features", "row_id").repartition(4).persist()


def fit(rows):
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = {c: sum(sizes.values()) / (len(sizes) * n) for c, n in sizes.items()}
    return G.fit_grown_forest(rows, sizes, weights, TREES, DEPTH, LEAF, SEED), weights


def plain_tree(t, x, y, h, borders, weights):
    """Level by level, every border of every drawn feature tried on the node's own rows."""
    at, _, times = G._bag(h, [SEED, t])
    classes = len(weights)
    count = lambda rows: np.bincount(y[at[rows]], times[rows], classes)
    gini = lambda c: 1.0 - ((c / c.sum()) ** 2).sum()
    root = {"rows": np.arange(len(at))}
    open_ = [root]
    for level in range(DEPTH):
        drawn, below = G._drawn([SEED, t], level, len(open_), x.shape[1]), []
        for node, features in zip(open_, drawn):
            whole, best = count(node["rows"]) * weights, (0.0,)
            for f in features:
                for border in borders[f]:
                    goes = x[at[node["rows"]], f] <= border
                    parts = count(node["rows"][goes]), count(node["rows"][~goes])
                    if min(p.sum() for p in parts) < LEAF:
                        continue
                    left, right = (p * weights for p in parts)
                    gain = gini(whole) - left.sum() / whole.sum() * gini(left) - right.sum() / whole.sum() * gini(right)
                    if gain > best[0] + 1e-12:
                        best = gain, f, border, goes
            if best[0] > 0:
                node["split"] = best[1:3]
                node["sides"] = [{"rows": node["rows"][best[3]]}, {"rows": node["rows"][~best[3]]}]
                below += [s for s in node["sides"] if (count(s["rows"]) > 0).sum() > 1 and count(s["rows"]).sum() >= 2 * LEAF]
        open_ = below

    def merged(node):
        own = count(node["rows"]) * weights
        if "sides" not in node:
            return own / own.sum()
        sides = [merged(s) for s in node["sides"]]
        if all(isinstance(s, np.ndarray) for s in sides) and sides[0].argmax() == sides[1].argmax():
            return own / own.sum()
        return (*node["split"], *sides)

    return merged(root)


def shown(nodes, at):
    if nodes.feature[at] < 0:
        return nodes.votes[at]
    return nodes.feature[at], nodes.threshold[at], shown(nodes, nodes.left[at]), shown(nodes, nodes.right[at])


def alike(one, two):
    if isinstance(one, np.ndarray) or isinstance(two, np.ndarray):
        return isinstance(one, np.ndarray) and isinstance(two, np.ndarray) and np.allclose(one, two)
    return one[0] == two[0] and one[1] == two[1] and alike(one[2], two[2]) and alike(one[3], two[3])


def test_trees_are_those_of_a_plain_search(train):
    model, weights = fit(train)
    rows = train.select("y", vector_to_array("features").alias("x"), F.xxhash64(F.lit(SEED), "row_id", "y", vector_to_array("features")).alias("h"))
    borders = G.bin_borders(rows, G.BINS, SEED)
    found = rows.toPandas()
    x, y, h = np.array(found["x"].to_list()), found["y"].to_numpy(), found["h"].to_numpy(dtype=np.int64).view(np.uint64)
    for t, root in enumerate(model.nodes.roots):
        assert alike(shown(model.nodes, root), plain_tree(t, x, y, h, borders, np.array([weights[c] for c in range(3)])))
    assert max(model.nodes.feature) >= 0 and model.featureImportances[5] == 0.0


def test_trees_do_not_depend_on_partitions_blocks_and_runs(train, monkeypatch):
    want = fit(train)[0].nodes
    monkeypatch.setattr(G, "BLOCK_ROWS", 150)
    monkeypatch.setattr(G, "GROUP_TREES", 2)
    monkeypatch.setattr(G, "NODES", 3)
    monkeypatch.setattr(G, "KEEP_LEVELS", 1)
    train.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = fit(train.repartition(7))[0].nodes
    finally:
        train.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(np.array_equal(getattr(got, k), getattr(want, k)) for k in ("roots", "feature", "threshold", "left", "right", "votes"))


def test_many_rows_are_not_fitted_by_passes_over_all_trees(train, monkeypatch):
    mllib = P.random_forest(TREES, DEPTH)(train, 3)
    monkeypatch.setattr(P, "GROWN_ROWS", 500)
    monkeypatch.setattr(P, "RandomForestClassifier", None)
    model = P.random_forest(TREES, DEPTH)(train, 3)
    rate = lambda m: m.transform(train).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
    assert rate(model) > 0.75 and rate(model) == pytest.approx(rate(mllib), abs=0.06)
    row = model.transform(train).select("probability", "prediction").first()
    assert row["probability"].toArray().sum() == pytest.approx(1.0) and row["probability"].toArray().argmax() == row["prediction"]
    drops = {r["feature"]: r["importance_mean"] for r in P.permutation_importance(train, model, list("abcdef"), "row_id", 2).collect()}
    assert max(drops, key=drops.get) == "a" and drops["f"] == 0.0
    broken = train.withColumn("y", F.when(F.col("row_id") > 0, F.col("y")))
    with pytest.raises(Exception):
        P.random_forest(TREES, DEPTH)(broken, 3)


def test_reports_do_not_carry_the_model(spark):
    """The model is in the closure of every stage that follows its scoring, unless the predictions are kept."""
    class Marked:
        @staticmethod
        def transform(df):
            return df.withColumn("prediction", F.udf(lambda v: 0.0, "double")("y").alias("marked_model"))

    rng = np.random.default_rng(1)
    polls = spark.createDataFrame([(i, *[float(v) for v in rng.integers(1, 9, 10)], "ddos" if i % 2 else "normal") for i in range(60)],
                                  "flow_id long, " + ", ".join(f"{c} double" for c in jobs.FEATURES) + ", label string")
    polls = polls.withColumns({c: F.col(c).cast("long") for c in ("packet_count", "byte_count", "duration_sec")}).withColumn("source", F.lit("")).withColumn("is_synthetic", F.lit(0))
    marked = lambda rows, classes: Marked
    shift = jobs.domain_shift_report(polls, n_bootstrap=8, trainer=marked)
    real = jobs.real_only_report(polls, probe=Marked, trainer=marked)["report"]
    for out in (shift, real):
        assert "<lambda>" not in out._jdf.queryExecution().toString()
    assert {r["part"]: r["n_test"] for r in shift.collect()} == {"real_test": 12, "bootstrap": 8, "all": 20}
    assert {r["model"] for r in real.collect()} == {"real_only", "full_model"}
