"""Supervised detectors on MLlib, with fold-local preprocessing."""

from __future__ import annotations

import math
import warnings
import weakref
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pollwarden.operators.augment import shuffled_number, uniform
from pollwarden.operators.boosting import fit_boosted_trees
from pollwarden.operators.forests import forest_nodes, swapped_hits
from pollwarden.operators.grown import GrownForest, fit_grown_forest
from pollwarden.operators.ordered import hash_chunk, number_rows
from pollwarden.operators.rules import impute, median_fills, scale, scaler_stats
from pollwarden.operators.splits import class_cap, proportional_cap, with_class_weights
from pollwarden.session import cut_lineage, ensure_checkpoint_dir, sized

Trainer = Callable[[DataFrame, int], object]

#: Train rows from which a forest is grown tree by tree (operators/grown.py): below, MLlib's passes over all trees at once cost less to start.
GROWN_ROWS = 100_000


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def random_forest(trees: int = 200, depth: int = 12, min_leaf: int = 2, weighted: bool = True, seed: int = 42) -> Trainer:
    """MLlib's forest. Rows keep the node they stand at in every tree, so a pass does not walk them down all trees again from the roots.

    From GROWN_ROWS rows on the package grows it by the same rules: MLlib updates the counts of all trees' nodes row by row, which are
    far apart in memory, and deep levels then take most of the time.
    """
    def fit(train: DataFrame, classes: int):
        sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(sizes.values())
        if total >= GROWN_ROWS and depth > 0 and all(c is not None and c >= 0 for c in sizes):  # other classes MLlib refuses
            weights = {c: total / (len(sizes) * n) if weighted else 1.0 for c, n in sizes.items()}
            return fit_grown_forest(train, sizes, weights, trees, depth, min_leaf, seed)
        ensure_checkpoint_dir(train.sparkSession)  # the nodes' lineage is cut every tenth pass
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, cacheNodeIds=True, checkpointInterval=10,
                                        featureSubsetStrategy="sqrt", labelCol="y", featuresCol="features", seed=seed)
        if weighted:
            train = with_class_weights(train, "y")
            forest = forest.setWeightCol("weight")
        return forest.fit(train)

    return fit


def boosted_trees(rounds: int = 200, depth: int = 6, rate: float = 0.1, sample: float = 0.8, columns: float = 0.8, bins: int = 64,
                  stop_early: bool = False, patience: int = 20, seed: int = 42) -> Trainer:
    """Gradient-boosted trees with one softmax over all classes (operators/boosting.py).

    Early stopping watches a hashed tenth of the train rows, never the test rows, and keeps the rounds up to the best one.
    """
    def fit(train: DataFrame, classes: int):
        return fit_boosted_trees(train, classes, rounds, depth, rate, sample, columns, bins, 0.1 if stop_early else 0.0, patience, seed)

    return fit


@dataclass
class MarginModel:
    """Linear one-against-rest margins; two classes share one hyperplane."""

    planes: list[np.ndarray]

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")

        def margin(plane: np.ndarray):
            products = F.zip_with(x, F.array(*[F.lit(float(v)) for v in plane[:-1]]), lambda a, b: a * b)
            return F.aggregate(products, F.lit(float(plane[-1])), lambda s, v: s + v)

        if len(self.planes) == 1:
            return df.withColumn("prediction", (margin(self.planes[0]) > 0).cast("double"))
        margins = F.array(*[margin(p) for p in self.planes])
        return df.withColumn("_margins", margins).withColumn(
            "prediction", (F.array_position("_margins", F.array_max("_margins")) - 1).cast("double")).drop("_margins")


def _tree_sum(parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' arrays (column s), added in up to 64 groups before the driver sees them, in a fixed order of groups."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "s": [np.sum(np.stack(pdf.sort_values("task")["s"].to_list()), axis=0)]})

    dealt = parts.withColumn("task", F.spark_partition_id()).withColumn("part", F.pmod("task", F.lit(64)))
    found = dealt.groupBy("part").applyInPandas(add, "part int, s array<double>").collect()
    return np.sum([np.array(r["s"]) for r in sorted(found, key=lambda r: r["part"])], axis=0)


def _margin_sums(rows: DataFrame, planes: list[np.ndarray]) -> np.ndarray:
    """Loss, gradient and curvature of the squared hinge for every plane, in one pass over the rows.

    Tasks reduce their Arrow batches to one array; the arrays are added in groups before the driver sees them.
    """
    def partial(batches):
        total = None
        for pdf in batches:
            x = np.array(pdf["x"].to_list(), dtype=float)
            x = np.hstack([x, np.ones((len(x), 1))])
            y, weight = pdf["y"].to_numpy(), pdf["weight"].to_numpy()
            parts = []
            for i, w in enumerate(planes):
                sign = np.where(y == (1 if len(planes) == 1 else i), 1.0, -1.0)
                gap = np.maximum(1.0 - sign * (x @ w), 0.0)
                active = gap > 0
                xa, wa = x[active], weight[active]
                parts += [[np.sum(wa * gap[active] ** 2)], -2.0 * (xa.T @ (wa * sign[active] * gap[active])),
                          (2.0 * (xa.T * wa) @ xa).ravel()]
            found = np.concatenate(parts)
            total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"s": [total]})

    return _tree_sum(rows.mapInPandas(partial, "s array<double>"))


def linear_svc(c: float = 1.0, iterations: int = 4000, balanced: bool = True, tol: float = 1e-4) -> Trainer:
    """L2-regularised squared-hinge SVC, solved in the primal by Newton steps (Keerthi and DeCoste 2005).

    The curvature is a small matrix, so a step costs one pass and a dozen steps suffice; the intercept is
    regularised with the weights. A model that has not met the tolerance after `iterations` steps is returned with a warning.
    """
    def fit(train: DataFrame, classes: int):
        rows = with_class_weights(train, "y") if balanced else train.withColumn("weight", F.lit(1.0))
        rows = rows.select(vector_to_array("features").alias("x"), F.col("y").cast("int").alias("y"), "weight")
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        d = len(rows.select("x").first()["x"]) + 1
        planes = [np.zeros(d) for _ in range(1 if classes == 2 else classes)]
        step = d * d + d + 1
        best = [(math.inf, p) for p in planes]
        rate = [1.0] * len(planes)
        move = [np.zeros(d) for _ in planes]
        start = None
        for _ in range(iterations):
            sums = _margin_sums(rows, planes)
            norms = []
            for i, w in enumerate(planes):
                loss, grad = sums[i * step], sums[i * step + 1:i * step + 1 + d]
                curve = sums[i * step + 1 + d:(i + 1) * step].reshape(d, d)
                value = 0.5 * w @ w + c * loss
                if value > best[i][0]:
                    # The full step overshot: halve it from the best point.
                    rate[i] /= 2
                    planes[i] = best[i][1] + rate[i] * move[i]
                    norms.append(math.inf if rate[i] > 1e-6 else 0.0)
                    continue
                full = w + c * grad
                best[i] = (value, w)
                move[i] = -np.linalg.solve(np.eye(d) + c * curve, full)
                rate[i] = 1.0
                planes[i] = w + move[i]
                norms.append(float(np.linalg.norm(full)))
            start = start or [max(n, 1e-12) for n in norms]
            if all(n <= tol * s for n, s in zip(norms, start)):
                break
        else:
            warnings.warn(f"linear SVC stopped after {iterations} steps short of its tolerance", stacklevel=2)
        rows.unpersist()
        return MarginModel([b[1] for b in best])

    return fit


@dataclass
class NystroemSVC:
    """RBF-kernel SVC on Nystroem features (Williams and Seeger 2001): kernel values to landmarks, whitened, and a linear SVC.

    `kernel_error` holds the mean and the largest absolute error of the kernel over pairs of a seeded sample of train rows.
    """

    gamma: float
    landmarks: np.ndarray
    whitening: np.ndarray
    model: object = None
    kernel_error: dict[str, float] | None = None

    def features_of(self, points: np.ndarray) -> np.ndarray:
        return rbf_kernel(points, self.landmarks, self.gamma) @ self.whitening

    def project(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(NystroemSVC(self.gamma, self.landmarks, self.whitening))

        @F.pandas_udf("array<double>")
        def near(x: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.features_of(np.array(x.to_list(), dtype=float).reshape(len(x), -1))))

        return df.withColumn("features", array_to_vector(near(vector_to_array("features"))))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.project(df))


def rbf_kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    apart = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2.0 * a @ b.T
    return np.exp(-gamma * np.maximum(apart, 0.0))


def _hashed_points(points: DataFrame, n: int, seed: int) -> np.ndarray:
    """The n different points of the smallest seeded hashes: the same for any partitioning, and copies of one point count once."""
    hashed = points.select("x", F.xxhash64(F.lit(seed), "x").alias("h")).groupBy("h").agg(F.first("x").alias("x"))
    return np.array([r["x"] for r in hashed.orderBy("h").limit(n).collect()], dtype=float)


def seeded_centres(points: DataFrame, k: int, rounds: int = 5, seed: int = 42) -> np.ndarray:
    """k-means centres of the points (column x): seeded points, then Lloyd steps, each one pass that keeps k sums a task."""
    centres = _hashed_points(points, k, seed)
    for _ in range(rounds):
        shared = points.sparkSession.sparkContext.broadcast(centres)

        def partial(batches):
            total = None
            for pdf in batches:
                x = np.array(pdf["x"].to_list(), dtype=float)
                near = np.argmin((shared.value ** 2).sum(1)[None, :] - 2.0 * x @ shared.value.T, axis=1)
                found = np.zeros((len(shared.value), x.shape[1] + 1))
                np.add.at(found, near, np.hstack([x, np.ones((len(x), 1))]))
                total = found if total is None else total + found
            if total is not None:
                yield pd.DataFrame({"s": [total.ravel()]})

        sums = _tree_sum(points.mapInPandas(partial, "s array<double>")).reshape(len(centres), -1)
        filled = sums[:, -1] > 0
        centres = np.where(filled[:, None], sums[:, :-1] / np.maximum(sums[:, -1:], 1.0), centres)
        shared.unpersist()
    return centres


def rbf_svc(c: float = 1.0, landmarks: int = 256, iterations: int = 200, seed: int = 42, rounds: int = 5, checked: int = 400) -> Trainer:
    """SVC with the kernel exp(-gamma d^2), gamma one over width times variance, through `landmarks` seeded k-means centres.

    Directions of the landmarks' kernel below 1e-9 of its largest eigenvalue are left out, so copies and fewer different points than landmarks
    do no harm: with a landmark at every point the kernel is exact. The kernel's error on `checked` train points is kept with the model.
    """
    def fit(train: DataFrame, classes: int):
        points = train.select(vector_to_array("features").alias("x"))
        cells = points.select(F.explode("x").alias("v"))
        variance = cells.agg(F.var_pop("v")).first()[0] or 1.0
        centres = seeded_centres(points, landmarks, rounds, seed)
        gamma = 1.0 / (centres.shape[1] * variance)
        values, axes = np.linalg.eigh(rbf_kernel(centres, centres, gamma))
        kept = values > 1e-9 * values[-1]
        shell = NystroemSVC(gamma, centres, axes[:, kept] / np.sqrt(values[kept]))
        seen = _hashed_points(points, checked, seed + 1)
        mapped = shell.features_of(seen)
        off = np.abs(mapped @ mapped.T - rbf_kernel(seen, seen, gamma))
        shell.kernel_error = {"mean": float(off.mean()), "max": float(off.max())}
        shell.model = linear_svc(c, iterations)(shell.project(train), classes)
        return shell

    return fit


@dataclass
class Prepared:
    """Preprocessing fitted on train rows only: one-row tables of medians, means and deviations."""

    features: list[str]
    fills: DataFrame | None = None
    stats: DataFrame | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        out = impute(df, self.fills, self.features) if self.fills is not None else df
        return scale(out, self.stats, self.features) if self.stats is not None else out


# Models of one fold share its train frame, and with it the fitted preprocessing.
_FITTED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def prepare(train: DataFrame, features: list[str], with_impute: bool = False) -> Prepared:
    """Preprocessing fitted on these rows, once per frame and feature list."""
    known = _FITTED.setdefault(train, {})
    key = (tuple(features), with_impute)
    if key not in known:
        known[key] = _fit_preprocessing(train, features, with_impute)
    return known[key]


def _fit_preprocessing(train: DataFrame, features: list[str], with_impute: bool) -> Prepared:
    fills = sized(median_fills(train, features)) if with_impute else None
    seen = impute(train, fills, features) if fills is not None else train
    return Prepared(features, fills, sized(scaler_stats(seen, features)))


def fit_predict(trainer: Trainer, train: DataFrame, test: DataFrame, features: list[str], classes: int,
                with_impute: bool = False, train_cap: int = 0, row_id: str = "row_id") -> DataFrame:
    """Test rows with an integer prediction; every statistic comes from the train rows."""
    if train_cap:  # the cap's rows are read for the statistics and for the vectors
        train = proportional_cap(train, "y", row_id, train_cap).persist(StorageLevel.MEMORY_AND_DISK)
    ready = prepare(train, features, with_impute)
    # Iterative fits read the train rows many times: keep the assembled vectors, not the plan behind them.
    vectors = assemble(ready.apply(train), features).select("y", "features", row_id).persist(StorageLevel.MEMORY_AND_DISK)
    model = trainer(vectors, classes)
    vectors.unpersist()
    if train_cap:
        train.unpersist()
    out = model.transform(assemble(ready.apply(test), features))
    return out.withColumn("p", F.col("prediction").cast("int"))


def validation_score(trainer: Trainer, train: DataFrame, features: list[str], classes: int, row_id: str = "row_id",
                     share: float = 0.2, seed: int = 42) -> DataFrame:
    """Accuracy on a hashed slice of the train rows: what a forest reports out of bag, labelled for what it is."""
    held = uniform(seed, F.lit("validation"), row_id) < share
    found = fit_predict(trainer, train.where(~held), train.where(held), features, classes, row_id=row_id)
    return found.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("p")).cast("int")).alias("accuracy")).withColumn(
        "measured_on", F.lit("validation_slice"))


def importance_table(spark, model, features: list[str], top: int = 20) -> DataFrame:
    """Impurity importances, highest first."""
    values = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(values, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def permutation_importance(df: DataFrame, model, features: list[str], row_id: str, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Mean and deviation of the accuracy lost when one feature is shuffled over the whole table.

    Rows are numbered once; the partner of a number comes from a seeded permutation that is computed, not sorted, so all repeats are one join on the
    number, for all features and at any size. A forest's trees are walked again only where the swapped value answers a test on the row's path
    otherwise (operators/forests.py); other models score every swapped row.
    """
    hashed = F.xxhash64(F.lit(seed), "_id")
    rows = df.select(F.col(row_id).alias("_id"), "y", vector_to_array("features").alias("_x"))
    rows = cut_lineage(number_rows(rows, [], [hashed, F.col("_id")], hash_chunk(hashed), "_n"))
    n = rows.count()
    base = model.transform(rows.withColumn("features", array_to_vector("_x")))
    base_accuracy = base.agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]

    def partner(salt: int):
        return F.pandas_udf(lambda i: pd.Series(shuffled_number(i.to_numpy(), n, salt)), "long")("_n")

    mixed = rows.select(F.col("_x").alias("_z"), F.posexplode(F.array(*[partner(seed + r) for r in range(repeats)])).alias("_r", "_n"))
    both = rows.join(mixed, "_n")
    nodes = model.nodes if isinstance(model, GrownForest) else forest_nodes(df.sparkSession, model)
    if nodes:
        counts = swapped_hits(both, nodes, repeats)
    else:
        cells = both.select("y", "_x", "_z", "_r", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("_f"))
        swapped = F.transform("_x", lambda v, i: F.when(i == F.col("_f"), F.get("_z", F.col("_f"))).otherwise(v))
        scored = model.transform(cells.withColumn("features", array_to_vector(swapped)))
        right = (F.col("prediction") == F.col("y")).cast("int")
        counts = scored.groupBy("_r", "_f").agg(F.count(right).alias("n"), F.sum(right).alias("hits"))
    drops = counts.groupBy("_r", "_f").agg((F.lit(base_accuracy) - F.try_divide(F.sum("hits"), F.sum("n"))).alias("drop"))
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("_f"))
    return drops.groupBy(name.alias("feature")).agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))


def shapley_ranking(df: DataFrame, model, features: list[str], row_id: str, rows: int = 500, orders: int = 8,
                    seed: int = 42, top: int = 20) -> DataFrame:
    """Mean absolute contribution of each feature to each class, by sampled permutations.

    For a sampled row and a background row, features switch from background to row in a random order; the
    change of the class probability at each switch belongs to the feature that switched
    (Strumbelj and Kononenko 2014). Sampling is the operator's definition.
    """
    sampled = class_cap(df.withColumn("_all", F.lit(1)), "_all", row_id, rows, seed=seed)
    picked = sampled.select(F.col(row_id).alias("_id"), vector_to_array("features").alias("_x"))
    numbered = picked.withColumn("_n", F.row_number().over(Window.orderBy("_id")))  # at most `rows` rows
    total = numbered.count()
    slots = numbered.withColumn("_o", F.explode(F.sequence(F.lit(1), F.lit(orders))))
    partner = 1 + F.floor(uniform(seed, F.lit("partner"), "_id", "_o") * total)
    slots = slots.withColumn("_m", partner)
    pairs = slots.join(numbered.select(F.col("_n").alias("_m"), F.col("_x").alias("_z")), "_m")
    draw = F.array(*[F.struct(uniform(seed, F.lit("order"), F.lit(i), "_id", "_o").alias("u"), F.lit(i).alias("i"))
                     for i in range(len(features))])
    pairs = pairs.withColumn("_order", F.transform(F.array_sort(draw), lambda s: s["i"]))
    steps = pairs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = F.transform("_x", lambda v, i: F.when(
        F.array_position("_order", i) <= F.col("_k"), v).otherwise(F.get("_z", i)))
    scored = model.transform(steps.withColumn("features", array_to_vector(mixed)))
    classes = scored.select("_id", "_o", "_k", "_order", F.posexplode(vector_to_array("probability")).alias("cls", "prob"))
    before = F.lag("prob").over(Window.partitionBy("_id", "_o", "cls").orderBy("_k"))
    moved = classes.withColumn("_d", F.col("prob") - before).where("_k > 0")
    moved = moved.withColumn("_f", F.get("_order", F.col("_k") - 1))
    by_row = moved.groupBy("_id", "cls", "_f").agg(F.avg("_d").alias("_d"))
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("_f"))
    return by_row.groupBy("cls", name.alias("feature")).agg(F.avg(F.abs("_d")).alias("mean_abs")).orderBy(
        F.desc("mean_abs"), "cls", "feature").limit(top)


def pca_projection(df: DataFrame, features: list[str], label: str, row_id: str, per_class: int = 3000, seed: int = 42):
    """Two principal components of a capped sample per class, and the variance they explain."""
    rows = class_cap(df, label, row_id, per_class, seed=seed)
    scaled = assemble(scale(rows, scaler_stats(rows, features), features), features)
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(scaled)
    both = model.transform(scaled).withColumn("pc", vector_to_array("pc"))
    points = both.select(row_id, label, F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))
    return points, [float(v) for v in model.explainedVariance]
