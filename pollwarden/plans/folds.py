"""Fold loops: every model is fitted by Spark jobs, every fold's predictions are materialised once."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwarden.functions.features import label_code, label_name
from pollwarden.operators import anomaly, augment, rules, splits, supervised
from pollwarden.operators.metrics import averages, confusion_counts, per_class
from pollwarden.schemas import FAULT_FAMILIES
from pollwarden.session import cut_lineage

# A detector takes train and test rows (with label code y and row_id) and returns the test rows with p.
Detector = Callable[[DataFrame, DataFrame], DataFrame]


def supervised_detector(trainer, features: list[str], classes: int, with_impute: bool = False, train_cap: int = 0,
                        smote: bool = False) -> Detector:
    def detect(train: DataFrame, test: DataFrame) -> DataFrame:
        if smote:
            return smote_fit_predict(trainer, train, test, features, classes, train_cap)
        return supervised.fit_predict(trainer, train, test, features, classes, with_impute, train_cap)

    return detect


def smote_fit_predict(trainer, train, test, features, classes, train_cap=0, scaled: bool = True) -> DataFrame:
    """Oversample the train side only, after scaling (or before it, for the un-split export)."""
    train = splits.proportional_cap(train, "y", "row_id", train_cap) if train_cap else train
    if scaled:
        ready = supervised.prepare(train, features)
        grown = augment.smote(ready.apply(train).select("row_id", "y", *features), "y", "row_id", features)
    else:
        grown = augment.smote(train.select("row_id", "y", *features), "y", "row_id", features)
        ready = supervised.prepare(grown, features)
        grown = ready.apply(grown)
    model = trainer(supervised.assemble(cut_lineage(grown), features).select("y", "features", "row_id"), classes)
    out = model.transform(supervised.assemble(ready.apply(test), features))
    return out.withColumn("p", F.col("prediction").cast("int"))


def _one_class(train: DataFrame, test: DataFrame, features: list[str], normal: Column, with_impute: bool):
    """Preprocessing and rows of a one-class fold: normal train rows only."""
    rows = train.where(normal)
    if rows.isEmpty():
        raise RuntimeError("train fold has no normal rows for a one-class fit")
    ready = supervised.prepare(rows, features, with_impute)
    return ready.apply(rows), ready.apply(test)


def forest_detector(features: list[str], normal: Column, with_impute: bool = False, trees: int = 200,
                    contamination: float = 0.05, hit: int = 1, miss: int = 0) -> Detector:
    def detect(train: DataFrame, test: DataFrame) -> DataFrame:
        rows, scored = _one_class(train, test, features, normal, with_impute)
        model = anomaly.fit_isolation_forest(rows.persist(StorageLevel.MEMORY_AND_DISK), "row_id", features, trees,
                                             contamination=contamination)
        return model.predict(scored).withColumn("p", F.when(F.col("prediction") == -1, hit).otherwise(miss))

    return detect


def reconstruction_detector(features: list[str], normal: Column, hidden: list[int], with_impute: bool = False,
                            epochs: int = 20, patience: int = 5, hit: int = 1, miss: int = 0) -> Detector:
    def detect(train: DataFrame, test: DataFrame) -> DataFrame:
        rows, scored = _one_class(train, test, features, normal, with_impute)
        model = anomaly.fit_reconstructor(rows, features, hidden, epochs, patience=patience, row_id="row_id")
        return model.predict(scored).withColumn("p", F.when(F.col("prediction") == 1, hit).otherwise(miss))

    return detect


def fault_rule_detector(task: str, labels: list[str]) -> Detector:
    """Calibrated rule: four fault families, or fault against normal."""
    def detect(train: DataFrame, test: DataFrame) -> DataFrame:
        limits = rules.fault_rule_thresholds(train, [])
        out = rules.fault_rule(test, limits, [], out="_verdict")
        verdict = F.col("_verdict")
        if task == "binary":
            verdict = F.when(verdict == "normal", "normal").otherwise("fault")
        return out.withColumn("p", label_code(verdict, labels))

    return detect


def cross_predict(df: DataFrame, group: str, folds: list, detectors: dict[str, Detector], parallel: int = 1) -> DataFrame:
    """Predictions (model, fold, grp, row_id, y, p) of every detector on every held-out group.

    `folds` lists the held-out groups in fold order. Each (fold, model) runs its own jobs and is checkpointed
    once; a small thread pool may overlap them.
    """
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)

    sides = {held: (rows.where(F.col(group) != held), rows.where(F.col(group) == held)) for held in folds}

    def run(task):
        fold, held, name = task
        train, test = sides[held]
        found = detectors[name](train, test)
        return cut_lineage(found.select(
            F.lit(name).alias("model"), F.lit(fold).alias("fold"), F.col(group).cast("string").alias("grp"),
            "row_id", F.col("y").cast("int").alias("y"), F.col("p").cast("int").alias("p")))

    tasks = [(i, held, name) for i, held in enumerate(folds) for name in detectors]
    if parallel > 1:
        with ThreadPoolExecutor(parallel) as pool:
            parts = list(pool.map(run, tasks))
    else:
        parts = [run(t) for t in tasks]
    rows.unpersist()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def group_list(df: DataFrame, group: str, limit: int = 10_000) -> list:
    """Held-out groups in sorted order: one per fold, each costing a model fit."""
    rows = df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} groups: use grouped folds instead of one fold per group")
    return [r[0] for r in rows]


def gap_report(train_pred: DataFrame, test_pred: DataFrame) -> DataFrame:
    """Mean train and test quality over folds, their gap and the over-fitting verdict."""
    def fold_scores(pred: DataFrame, side: str) -> DataFrame:
        counts = confusion_counts(pred, ["model", "fold"])
        right = F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0))
        acc = counts.groupBy("model", "fold").agg((right / F.sum("n")).alias("accuracy"))
        f1 = averages(per_class(counts, ["model", "fold"]), ["model", "fold"])
        both = acc.join(f1, ["model", "fold"])
        return both.groupBy("model").agg(
            F.avg("accuracy").alias(f"{side}_accuracy_mean"), F.stddev_pop("accuracy").alias(f"{side}_accuracy_std"),
            F.avg("f1_macro").alias(f"{side}_f1_mean"), F.stddev_pop("f1_macro").alias(f"{side}_f1_std"))

    out = fold_scores(train_pred, "train").join(fold_scores(test_pred, "test"), "model")
    gap = F.col("train_accuracy_mean") - F.col("test_accuracy_mean")
    verdict = F.when(gap < 0.02, "no overfitting").when(gap < 0.05, "slight overfitting").otherwise("overfitting")
    return out.withColumns({"gap": gap, "verdict": verdict})


def stratified_cross_validation(df: DataFrame, label: str, row_id: str, features: list[str], trainer, classes: int,
                                k: int = 10, model: str = "model") -> tuple[DataFrame, DataFrame]:
    """Train-side and test-side predictions of k stratified folds."""
    rows = splits.stratified_folds(df, label, row_id, k).withColumn("row_id", F.col(row_id)).persist(StorageLevel.MEMORY_AND_DISK)
    sides: dict[str, list[DataFrame]] = {"train": [], "test": []}
    for fold in range(k):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        ready = supervised.prepare(train, features)
        fitted = trainer(supervised.assemble(ready.apply(train), features).select("y", "features", "row_id"), classes)
        for side, part in (("train", train), ("test", test)):
            scored = fitted.transform(supervised.assemble(ready.apply(part), features))
            sides[side].append(cut_lineage(scored.select(
                F.lit(model).alias("model"), F.lit(fold).alias("fold"), "row_id", F.col("y").cast("int").alias("y"),
                F.col("prediction").cast("int").alias("p"))))
    rows.unpersist()
    out = []
    for side in ("train", "test"):
        merged = sides[side][0]
        for part in sides[side][1:]:
            merged = merged.unionByName(part)
        out.append(merged)
    return out[0], out[1]


def decode(pred: DataFrame, labels: list[str]) -> DataFrame:
    """Label codes back to names."""
    return pred.withColumns({"y": label_name(F.col("y"), labels), "p": label_name(F.col("p"), labels)})


FAULT_LABELS = {"binary": ["fault", "normal"], "four_class": FAULT_FAMILIES}
