"""Detectors and augmentation: invariants, since exact values depend on random draws."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pollwarden.catalog import views as V
from pollwarden.catalog.detectors import XS, vectors
from pollwarden.functions.features import flow_features
from pollwarden.operators import anomaly as A
from pollwarden.operators import augment as G
from pollwarden.operators import cleaning as C
from pollwarden.operators import splits as S
from pollwarden.operators import supervised as P


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    rows += [(1000 + i, float(9 + a), float(-9 + b), 1) for i, (a, b) in enumerate(rng.normal(size=(12, 2)))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, y int").repartition(4).persist()


def test_isolation_forest_ranks_outliers_first_and_repeats(blobs):
    normal = blobs.where("y = 0")
    one = A.fit_isolation_forest(normal, "row_id", ["a", "b"], trees=40, contamination=0.05)
    two = A.fit_isolation_forest(normal.repartition(3), "row_id", ["a", "b"], trees=40, contamination=0.05)
    assert one.threshold == pytest.approx(two.threshold)
    top = [r["y"] for r in one.score(blobs).orderBy(F.desc("score")).limit(12).collect()]
    assert sum(top) >= 11
    flagged = one.predict(normal).where("prediction = -1").count()
    assert abs(flagged - 30) <= 1


def test_isolation_forest_samples_are_the_smallest_draws(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), F.array(F.col("id").cast("double")).alias("x")).repartition(7)
    h = np.array([r.h for r in rows.orderBy("x").collect()]).astype(np.int64).view(np.uint64)
    got = A._draw(rows, 6, 64, 5000).toPandas()
    assert sum(len(b) // 8 for b in got["u"]) < 6 * 200  # few rows travel
    for t, own in got.groupby("tree"):
        u, x = (np.concatenate([np.frombuffer(b) for b in own[c]]) for c in ("u", "x"))
        assert x[np.argsort(u)[:64]].tolist() == np.argsort(G.hashed_draws(h, t))[:64].tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_shuffled_numbers_are_a_permutation(n):
    one, two = (G.shuffled_number(np.arange(n), n, s) for s in (1, 2))
    assert sorted(one.tolist()) == list(range(n)) == sorted(two.tolist())
    if n >= 1000:
        assert (one != two).mean() > 0.9 and abs(np.corrcoef(one, np.arange(n))[0, 1]) < 0.15
        assert (one[:5] == G.shuffled_number(np.arange(5), n, 1)).all()  # each number on its own


def test_mean_path():
    assert A.mean_path(1) == 0 and A.mean_path(2) == 1 and A.mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_reconstruction_flags_outliers(blobs):
    model = A.fit_reconstructor(blobs.where("y = 0"), ["a", "b"], [8, 4, 8], epochs=6, rate=0.01, steps=12)
    out = model.predict(blobs).groupBy("y").agg(F.avg("prediction").alias("p"))
    rates = {r["y"]: r["p"] for r in out.collect()}
    assert rates[1] == 1.0 and rates[0] <= 0.06


def test_reconstruction_weights_do_not_depend_on_partitions(blobs):
    fit = lambda rows: A.fit_reconstructor(rows.where("y = 0"), ["a", "b"], [4], epochs=3, steps=4, rate=0.01, row_id="row_id")
    one, two = fit(blobs.repartition(2)), fit(blobs.repartition(16))
    assert (one.weights == two.weights).all() and one.threshold == two.threshold


def test_reconstruction_stops_and_keeps_the_best_weights(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(200, 2)))], "row_id long, a double, b double")
    seen, real = [], A._watched_loss

    def loss(blocks, w, shape):
        seen.append((w, real(blocks, w, shape)))
        return [0.5, 0.4, 0.9, 0.8][len(seen) - 1]  # the error rises after the second epoch

    monkeypatch.setattr(A, "_watched_loss", loss)
    model = A.fit_reconstructor(rows, ["a", "b"], [3], epochs=30, steps=2, patience=2, row_id="row_id")
    assert len(seen) == 4 and (model.weights == seen[1][0]).all() and all(x > 0 for _, x in seen)
    few = A.fit_reconstructor(rows.limit(12), ["a", "b"], [3], epochs=2, steps=2, row_id="row_id")
    assert len(seen) == 4 and np.isfinite(few.weights).all()  # too few rows to set any aside
    with pytest.raises(RuntimeError):
        A.fit_reconstructor(rows.limit(0), ["a", "b"], [3])


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    shape, x = [3, 4, 3], rng.normal(size=(5, 3))
    w = rng.normal(size=3 * 4 + 4 + 4 * 3 + 3)

    def loss(v):
        return ((A._forward(x, A._split_weights(v, shape))[-1] - x) ** 2).mean()

    grad = A._gradient(x, w, shape)
    for i in range(0, len(w), 5):
        step = np.zeros_like(w)
        step[i] = 1e-6
        assert grad[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-6)


def test_smote_equalises_and_stays_inside_the_class(blobs):
    out = G.smote(blobs, "y", "row_id", ["a", "b"], cell_rows=5)
    sizes = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert sizes == {0: 600, 1: 600}
    low, high = blobs.where("y = 1").agg(F.min("a"), F.max("a")).first()
    made = out.where("row_id IS NULL")
    assert made.where((F.col("a") < low) | (F.col("a") > high)).count() == 0
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, G.smote(blobs, "y", "row_id", ["a", "b"], cell_rows=5).collect()), key=str)


def test_smote_neighbours_reach_their_recall(spark):
    """20,000 rows of 64 independent dimensions, the hardest case for an index, against brute force on a hundred of them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64)).astype(np.float32)
    table = spark.createDataFrame([("c", i, r) for i, r in enumerate(x.tolist())], "y string, _id long, x array<double>").repartition(4)
    got = {r["_id"]: r["near"] for r in G.nearest_in_class(table, "y", 5, {"c": 20_000}).where("_id % 200 = 0").collect()}
    x = x.astype(float)
    hits = 0
    for i, near in got.items():
        d = ((x - x[i]) ** 2).sum(axis=1)
        best = set(np.argsort(d)[1:6].tolist())
        assert len(near) == 5 and near == sorted(near, key=lambda j: d[j])
        hits += len(best & set(near))
    assert len(got) == 100 and hits >= 0.9 * 500


def test_smote_neighbours_of_one_cell_are_exact_and_copies_are_split(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(60, 3)), np.zeros((40, 3))])
    table = spark.createDataFrame([(1, i, r) for i, r in enumerate(x.tolist())], "y int, _id long, x array<double>")
    for r in G.nearest_in_class(table, "y", 4, {1: 100}).where("_id < 60").collect():
        d = ((x - x[r["_id"]]) ** 2).sum(axis=1)
        assert [d[j] for j in r["near"]] == pytest.approx(sorted(d)[1:5])
    split = G.nearest_in_class(table, "y", 4, {1: 100}, cell_rows=5).collect()  # a cell of copies holds far more than its share
    assert len(split) == 100 and all(len(set(r["near"])) == len(r["near"]) <= 4 and r["_id"] not in r["near"] for r in split)
    assert all((x[r["near"]] == 0).all() for r in split if r["_id"] >= 60)


def test_smote_skips_a_single_row_class(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 0), (3, 5.0, 1)], "row_id long, a double, y int")
    assert G.smote(df, "y", "row_id", ["a"]).count() == 3


def test_bootstrap_noise_is_clamped_and_rates_follow(spark, sf):
    seeds = flow_features(V.flow_polls(spark, sf)).where("label = 'ddos' AND is_synthetic = 0").withColumn("source", F.lit(""))
    out = G.bootstrap_rows(seeds, "flow_id", 200)
    assert out.count() == 200 and out.where("is_synthetic <> 1 OR source <> 'real_seed_bootstrap'").count() == 0
    off = out.where((F.abs(F.col("packet_count_per_sec") - F.col("packet_count") / F.col("flow_duration")) > 1e-9)
                    | (F.col("packet_count") < 0) | (F.col("flow_duration") <= 0))
    assert off.count() == 0
    high = seeds.agg(F.max("packet_count")).first()[0]
    assert out.agg(F.max("packet_count")).first()[0] <= 1.5 * high + 1
    with pytest.raises(ValueError):
        G.bootstrap_rows(seeds.where("false"), "flow_id", 5)


def test_bootstrap_job_is_idempotent(spark, sf):
    polls = flow_features(V.flow_polls(spark, sf)).withColumn("source", F.lit(""))
    once = G.with_bootstrap(polls, target=50)
    twice = G.with_bootstrap(once, target=50)
    assert once.count() == twice.count() == polls.count() + 50


def test_flood_ranges(spark):
    rows = G.flood_rows(spark, {"tcp": 50, "udp": 40, "icmp": 30})
    assert rows.count() == 120
    bad = rows.where("(ip_proto = 1 AND (tp_src <> 0 OR tp_dst <> 0)) OR packet_count < 50000 OR duration_sec NOT BETWEEN 5 AND 89 OR label <> 'ddos'")
    assert bad.count() == 0


def test_caps_and_weights(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "row_id long, label string")
    sizes = {r["label"]: r["count"] for r in S.proportional_cap(df, "label", "row_id", 20).groupBy("label").count().collect()}
    assert sizes == {"a": 18, "b": 2}
    assert S.proportional_cap(df, "label", "row_id", 0).count() == 100
    sizes = {r["label"]: r["count"] for r in S.class_cap(df, "label", "row_id", 5).groupBy("label").count().collect()}
    assert sizes == {"a": 5, "b": 5}
    weights = {r["label"]: r["weight"] for r in S.class_weights(df, "label").collect()}
    assert weights == {"a": pytest.approx(100 / 180), "b": pytest.approx(5.0)}


def test_linear_svc_reaches_the_optimum(blobs):
    rows = P.assemble(blobs, ["a", "b"]).select("y", "features", "row_id")
    model = P.linear_svc(tol=1e-9)(rows, 2)
    local = rows.select("y", vector_to_array("features").alias("x")).toPandas()
    x = np.hstack([np.array(local["x"].to_list()), np.ones((len(local), 1))])
    y = np.where(local["y"] == 1, 1.0, -1.0)
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w = model.planes[0]
    gap = np.maximum(1 - y * (x @ w), 0)
    assert np.linalg.norm(w - 2 * x.T @ (weight * y * gap)) < 1e-6
    assert model.transform(rows).where("prediction <> y").count() == 0


def test_three_class_svc(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(c * 4 + rng.normal() * 0.3), float((c == 1) * 4 + rng.normal() * 0.3), c) for i, c in enumerate([0, 1, 2] * 40)]
    df = P.assemble(spark.createDataFrame(rows, "row_id long, a double, b double, y int"), ["a", "b"])
    assert P.linear_svc()(df, 3).transform(df).where("prediction = y").count() >= 118


def test_importances_find_the_signal(spark, sf):
    rows = vectors(spark, sf)
    rows = P.assemble(rows.withColumn("y", (F.col("x0") > 0).cast("int")), XS).persist()
    model = P.random_forest(10, 4)(rows.select("y", "features", "row_id"), 2)
    assert P.importance_table(spark, model, XS, 3).count() == 3
    drops = {r["feature"]: r["importance_mean"] for r in P.permutation_importance(rows, model, XS, "row_id", 2).collect()}
    assert len(drops) == len(XS) and max(drops, key=drops.get) == "x0" and drops["x0"] > 0.1
    ranked = P.shapley_ranking(rows, model, XS, "row_id", rows=40, orders=3, top=4).collect()
    assert len(ranked) == 4 and ranked[0]["mean_abs"] >= ranked[-1]["mean_abs"] > 0


def test_shapley_contributions_add_up(spark, sf):
    rows = P.assemble(vectors(spark, sf), XS)
    model = P.random_forest(5, 3)(rows.select("y", "features", "row_id"), 2)
    table = P.shapley_ranking(rows, model, XS, "row_id", rows=30, orders=2, top=10**6).groupBy("feature").agg(
        F.max("mean_abs").alias("a"), F.min("mean_abs").alias("b"))
    assert table.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0  # two classes mirror each other


def test_decode_predictions(spark):
    df = spark.range(4)
    out = df.select(C.decode_prediction("random_forest", F.col("id")).alias("v")).collect()
    assert [r["v"] for r in out] == ["DDOS", "NORMAL", "PORTSCAN", "UNKNOWN"]


def test_forest_keeps_the_nodes_of_rows_and_grows_the_same_trees(spark):
    """F3, F5, F6, F8, F10: a pass over the rows does not walk every tree from its root; the trees are those of a walk."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = spark.range(600).selectExpr("id AS row_id", "id * 7 % 11 AS a", "id * 5 % 13 AS b", "id % 17 AS c", "CAST((id * 7 % 11 + id % 17) % 2 AS INT) AS y")
    train = P.assemble(rows, ["a", "b", "c"]).select("y", "features").repartition(3, "features").persist()
    kept = P.random_forest(12, 6, weighted=False)(train, 2)
    walked = RandomForestClassifier(numTrees=12, maxDepth=6, minInstancesPerNode=2, featureSubsetStrategy="sqrt", labelCol="y", seed=42).fit(train)
    assert kept.getCacheNodeIds()
    shown = [m.toDebugString.split("\n", 1)[1] for m in (kept, walked)]
    assert shown[0] == shown[1]
