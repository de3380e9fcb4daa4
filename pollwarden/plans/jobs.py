"""The jobs a user calls: evaluations, merges, imports, augmentation, the batch pipeline.

Each takes DataFrames and keyword arguments and returns DataFrames; writing is left to `sources.sinks`.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.functions.features import label_code
from pollwarden.operators import augment, cleaning, metrics, rules, splits, supervised, telemetry
from pollwarden.operators.runs import rows_of_runs
from pollwarden.plans import folds as K
from pollwarden.schemas import (
    FAULT_FEATURES, FEATURES, LABELS, PORT_FREE_FEATURES, assert_no_leak, feature_columns, require_columns,
)
from pollwarden.session import cut_lineage, sized
from pollwarden.sources import sinks


@dataclass
class Effort:
    """Model sizes; the defaults are the published ones."""

    trees: int = 200
    depth: int = 12
    rounds: int = 200
    boost_depth: int = 6
    epochs: int | None = None  # None: what is published for the job (20 to 40)
    iterations: int = 4000
    parallel: int = 1
    extra: dict = field(default_factory=dict)


def _with_ids(df: DataFrame, row_id: str) -> DataFrame:
    return df.withColumn("row_id", F.col(row_id))


def evaluate_binary_loso(polls: DataFrame, max_polls: int = 3, models: list[str] | None = None,
                         append_to: DataFrame | None = None, svm_train_cap: int = 40_000,
                         skip_autoencoder: bool = False, row_id: str = "flow_id", group: str = "scenario_id",
                         effort: Effort = Effort()) -> dict[str, DataFrame]:
    """Normal against attack on early polls, one scenario held out at a time, without ports or oversampling."""
    clean = cleaning.clean_polls(polls)
    early = telemetry.early_polls(clean, max_polls, row_id)
    rows = _with_ids(early, row_id).withColumn("y", cleaning.binary_target(F.col("label")))
    f = PORT_FREE_FEATURES
    normal = F.col("y") == 0
    available = {
        "IsolationForest": K.forest_detector(f, normal, trees=effort.trees),
        "Autoencoder": K.reconstruction_detector(f, normal, [8, 4, 8], epochs=effort.epochs or 20),
        "LinearSVC": K.supervised_detector(supervised.linear_svc(iterations=effort.iterations), f, 2, train_cap=svm_train_cap),
        "RandomForest": K.supervised_detector(supervised.random_forest(effort.trees, effort.depth), f, 2),
        "XGBoost": K.supervised_detector(supervised.boosted_trees(effort.rounds, effort.boost_depth), f, 2),
    }
    if skip_autoencoder:
        available.pop("Autoencoder")
    chosen = {m: available[m] for m in (models or list(available)) if m in available}
    rows = cut_lineage(rows.select("row_id", group, "label", "y", *f))
    held = rows.groupBy(F.col(group).cast("string").alias("grp")).agg(F.mode("label", deterministic=True).alias("heldout_label"))
    pred = K.cross_predict(rows, group, K.group_list(rows, group), chosen, effort.parallel)
    per_fold = metrics.binary_report(metrics.confusion_counts(pred, ["model", "fold", "grp"]), ["model", "fold", "grp"])
    per_fold = per_fold.join(held, "grp")
    summary = metrics.loso_summary(pred, held)
    if append_to is not None:
        summary = metrics.upsert(append_to, summary, "model")
    return {"predictions": pred, "per_scenario": per_fold, "summary": summary}


def evaluate_multiclass_loso(polls: DataFrame, feature_set: str = "no_raw_ports", with_unsupervised: bool = False,
                             with_linearsvc: bool = True, linearsvc_only: bool = False, cap: int = 40_000,
                             row_id: str = "flow_id", group: str = "scenario_id", effort: Effort = Effort()) -> dict[str, DataFrame]:
    """Three classes on the last poll of each flow, one scenario held out at a time, per feature set."""
    wanted = {"all": ["with_raw_ports", "no_raw_ports", "behavior_window"],
              "primary": ["with_raw_ports", "no_raw_ports"]}.get(feature_set, [feature_set])
    clean = cleaning.clean_polls(polls, "scenario")
    last = telemetry.last_polls(telemetry.behaviour_windows(clean), tie_break=row_id)
    rows = _with_ids(last, row_id).withColumn("y", label_code(F.col("label"), LABELS))
    behaviour = feature_columns("behavior_window")
    keep = list(dict.fromkeys([*FEATURES, *behaviour]))
    rows = cut_lineage(rows.select("row_id", group, "run_id", "label", "y", *keep))
    held = rows.groupBy(F.col(group).cast("string").alias("grp")).agg(F.mode("label", deterministic=True).alias("heldout_label"))
    groups = K.group_list(rows, group)
    preds, binary = None, None
    for name in wanted:
        f = feature_columns(name)
        models = {
            "RandomForest": K.supervised_detector(supervised.random_forest(effort.trees, effort.depth), f, len(LABELS)),
            "XGBoost": K.supervised_detector(supervised.boosted_trees(effort.rounds, effort.boost_depth), f, len(LABELS)),
        }
        svc = K.supervised_detector(supervised.linear_svc(iterations=effort.iterations), f, len(LABELS), train_cap=cap)
        if with_linearsvc or linearsvc_only:
            models["LinearSVC"] = svc
        if linearsvc_only:
            models = {"LinearSVC": svc}
        models = {m: d for m, d in models.items() if m in effort.extra.get("models", models)}
        part = K.cross_predict(rows, group, groups, models, effort.parallel).withColumn("feature_set", F.lit(name))
        preds = part if preds is None else preds.unionByName(part)
        if with_unsupervised:
            normal = F.col("label") == "normal"
            flags = rows.withColumn("y", cleaning.binary_target(F.col("label")))
            single = {"IsolationForest": K.forest_detector(f, normal, trees=effort.trees),
                      "Autoencoder": K.reconstruction_detector(f, normal, [8, 4, 8], epochs=effort.epochs or 20)}
            part = K.cross_predict(flags, group, groups, single, effort.parallel).withColumn("feature_set", F.lit(name))
            binary = part if binary is None else binary.unionByName(part)
    by = ["feature_set", "model", "grp"]
    named = K.decode(preds, LABELS).join(held, "grp")
    counts = metrics.confusion_counts(named, by)
    macro = metrics.averages(metrics.per_class(counts, by, LABELS), by).select(*by, "f1_macro")
    recall = metrics.heldout_recall(named.withColumn("model", F.concat_ws("|", "feature_set", "model")), LABELS)
    recall = recall.withColumns({"feature_set": F.split("model", r"\|")[0], "model": F.split("model", r"\|")[1]})
    per_fold = metrics.accuracy(counts, by).join(macro, by).join(recall, by)
    out = {"predictions": named, "per_scenario": per_fold, "summary": metrics.multiclass_summary(per_fold),
           "inventory": telemetry.scenario_inventory(clean, last)}
    if binary is not None:
        out["unsupervised"] = metrics.binary_report(metrics.confusion_counts(binary, by), by)
    return out


def evaluate_grouped(polls: DataFrame, with_smote_train: bool = False, min_groups: int = 3, linearsvc_only: bool = False,
                     cap: int = 40_000, row_id: str = "flow_id", group: str = "run_id", effort: Effort = Effort()) -> dict[str, DataFrame]:
    """Folds by run: refuses with a status row when there are too few runs or labels."""
    clean = cleaning.clean_polls(polls, "grouped")
    status = splits.readiness(clean, min_groups, group)
    row = status.first()
    kind, note = splits.choose_splitter(row["n_groups"], min_groups)
    if row["status"] != "ok" or kind is None:
        return {"status": status}
    rows = _with_ids(clean, row_id).withColumn("y", label_code(F.col("label"), LABELS))
    if kind == "group_kfold":
        fold_map = splits.group_folds(rows, group, 5).select(group, F.col("fold").alias("_fold"))
    else:
        fold_map = splits.leave_one_group_out(rows, group).select(group, F.col("fold").alias("_fold"))
    rows = cut_lineage(rows.join(fold_map, group).select("row_id", "_fold", "label", "y", *FEATURES))
    n = len(LABELS)
    svc = K.supervised_detector(supervised.linear_svc(iterations=effort.iterations), FEATURES, n, train_cap=cap, smote=with_smote_train)
    models = {
        "RandomForest": K.supervised_detector(supervised.random_forest(effort.trees, effort.depth), FEATURES, n, smote=with_smote_train),
        "XGBoost": K.supervised_detector(supervised.boosted_trees(effort.rounds, effort.boost_depth), FEATURES, n, smote=with_smote_train),
        "LinearSVC": svc,
    }
    models = {"LinearSVC": svc} if linearsvc_only else models
    models = {m: d for m, d in models.items() if m in effort.extra.get("models", models)}
    pred = K.cross_predict(rows, "_fold", K.group_list(rows, "_fold"), models, effort.parallel)
    by = ["model", "grp"]
    named = K.decode(pred, LABELS)
    counts = metrics.confusion_counts(named, by)
    macro = metrics.averages(metrics.per_class(counts, by), by)
    ddos = metrics.per_class(counts, by, LABELS).where("label = 'ddos'").select(*by, F.col("recall").alias("ddos_recall"))
    per_fold = metrics.accuracy(counts, by).join(macro, by).join(ddos, by)
    out = {"status": status, "predictions": named, "per_fold": per_fold.withColumn("splitter", F.lit(note)),
           "summary": metrics.fold_spread(per_fold, ["model"], ["accuracy", "precision_macro", "recall_macro", "f1_macro", "ddos_recall"]),
           "confusion": metrics.confusion_wide(metrics.confusion_counts(named, ["model"]), ["model"], LABELS)}
    if not linearsvc_only and effort.extra.get("unsupervised", True):
        flags = rows.withColumn("y", cleaning.binary_target(F.col("label")))
        normal = F.col("label") == "normal"
        single = {"IsolationForest": K.forest_detector(FEATURES, normal, trees=effort.trees),
                  "Autoencoder": K.reconstruction_detector(FEATURES, normal, [8, 4, 8], epochs=effort.epochs or 30)}
        found = K.cross_predict(flags, "_fold", K.group_list(rows, "_fold"), single, effort.parallel)
        out["unsupervised"] = metrics.binary_report(metrics.confusion_counts(found, by), by)
    return out


def evaluate_fault(snapshots: DataFrame, prefix: str = "", skip_four_class: bool = False, supervised_only: bool = False,
                   row_id: str = "row_id", min_scenarios: int = 4, effort: Effort = Effort()) -> dict[str, DataFrame | str]:
    """Fault detection (binary) and fault typing (four classes), one scenario held out at a time."""
    steady = telemetry.steady_state(snapshots, row_id)
    features = assert_no_leak([c for c in FAULT_FEATURES if c in snapshots.columns])
    if not prefix:
        kinds = sorted(r[0] for r in steady.select(F.lower("protocol")).distinct().limit(3).collect() if r[0])
        prefix = {("e",): "fault_protocol_e", ("d",): "fault_protocol_d"}.get(tuple(kinds), "fault_protocol")
    rows = _with_ids(steady, row_id).select(
        "row_id", "scenario_id", "fault_family", *[F.col(c).cast("double").alias(c) for c in features])
    rows = cut_lineage(rows)
    groups = K.group_list(rows, "scenario_id")
    if len(groups) < min_scenarios:
        raise ValueError(f"need at least {min_scenarios} scenarios, have {len(groups)}")
    out: dict[str, DataFrame | str] = {"prefix": prefix}
    for task in ("binary",) if skip_four_class else ("binary", "four_class"):
        labels = K.FAULT_LABELS[task]
        target = cleaning.fault_target(F.col("fault_family")) if task == "binary" else F.col("fault_family")
        coded = rows.withColumn("y", label_code(target, labels))
        n = len(labels)
        models = {
            "random_forest": K.supervised_detector(
                supervised.random_forest(effort.trees, effort.extra.get("fault_depth", 30), 1, weighted=False), features, n, True),
            "svm": K.supervised_detector(supervised.rbf_svc(iterations=effort.iterations), features, n, True),
            "xgboost": K.supervised_detector(supervised.boosted_trees(effort.rounds, 4, sample=1.0, columns=1.0), features, n, True),
        }
        if task == "binary" and not supervised_only:
            codes = {x: i for i, x in enumerate(sorted(labels))}
            normal = F.col("fault_family") == "normal"
            models["isolation_forest"] = K.forest_detector(features, normal, True, effort.trees, hit=codes["fault"], miss=codes["normal"])
            models["autoencoder"] = K.reconstruction_detector(
                features, normal, [16, 8, 4, 8, 16], True, effort.epochs or 300, patience=10, hit=codes["fault"], miss=codes["normal"])
        models["rule_based"] = K.fault_rule_detector(task, labels)
        models = {m: d for m, d in models.items() if m in effort.extra.get("models", models)}
        pred = K.decode(K.cross_predict(coded, "scenario_id", groups, models, effort.parallel), labels)
        table = cut_lineage(metrics.fold_report(pred))
        spread = metrics.dispersion_report(table, ["accuracy", "f1_macro"])
        counts = metrics.confusion_counts(pred, ["model"])
        if task == "four_class":
            # One-class models cannot name a family: their rows say so instead of scoring zero.
            absent = F.explode(F.array(F.lit("isolation_forest"), F.lit("autoencoder")))
            na = table.limit(1).select(absent.alias("model"), F.lit(metrics.POOLED).alias("grp"), F.lit(0).cast("long").alias("n_test"),
                                       F.lit("N/A: answers the binary task only").alias("note"))
            table = table.unionByName(na, allowMissingColumns=True)
        out[f"{task}_loso"] = table
        out[f"{task}_dispersion"] = spread
        out[f"{task}_per_class"] = metrics.per_class(counts, ["model"], labels)
        out[f"{task}_confusion"] = metrics.confusion_matrix(counts, ["model"], labels)
    return out


def merge_fault_runs(flows: DataFrame, ports: DataFrame, probes: DataFrame, meta: DataFrame, protocol: str = "",
                     mode: str = "asof") -> DataFrame:
    """All runs (of one protocol, if named) to fault snapshots in one job."""
    if protocol:
        meta = meta.where(F.lower("protocol") == protocol.strip().lower())
        known = meta.select("run_id")
        flows, ports, probes = (t.join(known, "run_id", "left_semi") for t in (flows, ports, probes))
    return telemetry.fault_snapshots(flows, ports, probes, meta, mode)


def merge_runs(runs: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """Collected runs, tagged and completed, with the legacy table in front if wanted."""
    tagged = cleaning.tag_independent(runs)
    if legacy is None:
        return tagged
    return cleaning.fill_provenance(legacy, blank_is_missing=False).unionByName(tagged, allowMissingColumns=True)


def audit_overlap(train: DataFrame | None = None, test: DataFrame | None = None, grouped: DataFrame | None = None,
                  k: int = 5) -> DataFrame:
    """Test rows whose feature vector also occurs in train: one split, or every fold by run."""
    if grouped is None:
        return splits.overlap_report(test, train, FEATURES).withColumns({"protocol": F.lit("train_test"), "fold": F.lit(-1)})
    rows = cleaning.known_runs(cleaning.real_only(grouped), "audit").dropna(subset=[*FEATURES, "label"])
    mapped = rows.join(splits.group_folds(rows, "run_id", k).select("run_id", "fold"), "run_id")
    # Per vector and fold: the vector is shared if another fold holds more copies than none.
    copies = mapped.groupBy(F.xxhash64(*FEATURES).alias("_h"), F.struct(*FEATURES).alias("_f"), "fold").agg(F.count(F.lit(1)).alias("n"))
    total = copies.groupBy("_h", "_f").agg(F.sum("n").alias("_all"))
    shared = F.col("_all") > F.col("n")
    per_fold = copies.join(total, ["_h", "_f"]).groupBy("fold").agg(
        F.sum("n").alias("n_test"), F.count(F.when(shared, 1)).alias("n_overlap_fingerprints"),
        F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("n_test_rows_in_overlap"))
    whole = per_fold.agg(F.sum("n_test").alias("t"))
    return per_fold.withColumns({
        "n_train": whole.scalar() - F.col("n_test"),
        "overlap_rate_of_test": F.col("n_test_rows_in_overlap") / F.col("n_test"), "protocol": F.lit("grouped")})


def bootstrap_job(df: DataFrame, target: int = 400, seed: int = 42, replace_old_handcraft: bool = False) -> DataFrame:
    return augment.with_bootstrap(df, "flow_id", target, seed, replace_old_handcraft)


def import_public_3class(spark: SparkSession, files: dict[str, str], test_size: float = 0.2, random_state: int = 42,
                         smote: bool = True) -> dict[str, DataFrame]:
    """Three public files to one table, split, with the train side oversampled and a summary."""
    merged = None
    for key, path in files.items():
        part = cleaning.map_public_flows(spark.read.parquet(path), key, F.lit(path.rsplit("/", 1)[-1]))
        merged = part if merged is None else merged.unionByName(part)
    rows = merged.dropDuplicates([*FEATURES, "label", "source_file"])
    rows = rows.withColumn("row_id", F.xxhash64(*FEATURES, "label", "source_file"))
    out = cut_lineage(splits.stratified_split(rows, "label", "row_id", test_size, random_state))
    train, test = out.where("split = 'train'"), out.where("split = 'test'")
    grown = augment.smote(train.select("row_id", "label", *FEATURES), "label", "row_id", FEATURES) if smote else train
    summary = out.groupBy("source_file", "label").agg(F.count(F.lit(1)).alias("n"))
    return {"processed": out, "train_raw": train, "train": grown, "test": test, "summary": summary}


def import_public_binary(spark: SparkSession, path: str, test_size: float = 0.2, random_state: int = 42) -> dict[str, DataFrame]:
    raw = spark.read.option("header", True).csv(path).select(*[F.col(f"`{c}`") for c in cleaning.BINARY_COLUMNS])
    rows = cleaning.map_public_binary(raw)
    rows = rows.withColumn("row_id", F.xxhash64(*FEATURES, "label"))
    out = cut_lineage(splits.stratified_split(rows, "label", "row_id", test_size, random_state))
    return {"processed": out, "train": out.where("split = 'train'"), "test": out.where("split = 'test'")}


def run_public_benchmark(train: DataFrame, test: DataFrame, labels: list[str], max_train_per_class: int = 100_000,
                         max_normal_train: int = 100_000, row_id: str = "row_id", effort: Effort = Effort()) -> DataFrame:
    """Supervised and one-class models on a public split, one comparison table tagged by metric scope."""
    code = label_code(F.col("label"), labels)
    train, test = (_with_ids(t, row_id).withColumn("y", code) for t in (train, test))
    capped = splits.class_cap(train, "label", "row_id", max_train_per_class)
    n, f = len(labels), FEATURES
    macro = None
    trainers = {"RandomForest": supervised.random_forest(effort.trees, effort.depth),
                "XGBoost": supervised.boosted_trees(effort.rounds, effort.boost_depth)}
    for name, trainer in trainers.items():
        start = time.monotonic()
        found = cut_lineage(supervised.fit_predict(trainer, capped, test, f, n, row_id="row_id").select("y", "p"))
        counts = metrics.confusion_counts(found.withColumn("model", F.lit(name)), ["model"])
        row = metrics.accuracy(counts, ["model"]).join(metrics.averages(metrics.per_class(counts, ["model"]), ["model"]), "model")
        row = row.select("model", "accuracy", F.col("f1_macro").alias("f1"), F.lit(time.monotonic() - start).alias("seconds"))
        macro = row if macro is None else macro.unionByName(row)
    normal = splits.class_cap(train.where("label = 'normal'"), "label", "row_id", max_normal_train)
    flagged = test.withColumn("y", cleaning.binary_target(F.col("label")))
    single = None
    detectors = {"IsolationForest": K.forest_detector(f, F.lit(True), trees=effort.trees),
                 "Autoencoder": K.reconstruction_detector(f, F.lit(True), [8, 6, 4, 6, 8], epochs=effort.epochs or 40)}
    for name, detect in detectors.items():
        start = time.monotonic()
        found = cut_lineage(detect(normal, flagged).select("y", "p", "score").withColumn("model", F.lit(name)))
        report = metrics.binary_report(metrics.confusion_counts(found, ["model"]), ["model"])
        areas = metrics.curve_areas(metrics.curve_points(found, ["model"]), ["model"])
        row = report.join(areas, "model").select("model", "accuracy", F.col("f1_anomaly").alias("f1"), "roc_auc", "average_precision",
                                                 F.lit(time.monotonic() - start).alias("seconds"))
        single = row if single is None else single.unionByName(row)
    return metrics.comparison_table([(macro, "multiclass_macro"), (single, "anomaly_class")])


def recover_runs(flows: DataFrame, logs: DataFrame, attackers: list[str], only: list[str] | None = None) -> DataFrame:
    """Attack rows of each logged run: its window plus 15 s and the targets named in its commands."""
    wanted = logs.where(F.col("scenario_id").startswith("ddos_"))
    if only:
        named = F.lit(False)
        for item in only:
            named = named | F.col("run_id").startswith(item)
        wanted = wanted.where(named)
    kept = rows_of_runs(flows.drop("run_id", "scenario_id"), wanted.withColumn("kind", F.lit("ddos")), attackers, grace_sec=15)
    return kept.withColumns({"label": F.lit("ddos"), "is_synthetic": F.lit(0), "source": F.lit("independent_lab")}).drop(
        "targets", "kind", "start_time", "end_time")


def real_only_report(polls: DataFrame, row_id: str = "flow_id", dedupe: bool = True, probe: PipelineModel | None = None,
                     trainer=None, effort: Effort = Effort()) -> dict[str, DataFrame]:
    """Retrain on real rows only: class counts, split note, macro and weighted metrics, optional probe."""
    real = cleaning.complete_rows(cleaning.real_only(polls), [*FEATURES, "label"])
    if dedupe:
        # The smallest id stands for each copy, so a retried task keeps the same row.
        real = real.groupBy(*FEATURES, "label").agg(F.min(row_id).alias(row_id))
    rows = cut_lineage(_with_ids(real, row_id).withColumn("y", label_code(F.col("label"), LABELS)))  # the split reads them several times
    out = cut_lineage(splits.stratified_split(rows, "label", "row_id"))
    counts = out.groupBy("label", "split", "split_note").agg(F.count(F.lit(1)).alias("n"))
    trainer = trainer or supervised.random_forest(effort.trees, effort.depth)
    train, test = out.where("split = 'train'"), out.where("split = 'test'")
    pred = supervised.fit_predict(trainer, train, test, FEATURES, len(LABELS)).withColumn("model", F.lit("real_only"))
    pred = cut_lineage(pred.select("model", "y", "p"))
    if probe is not None:
        seen = probe.transform(out).select(F.lit("full_model").alias("model"), "y", F.col("prediction").cast("int").alias("p"))
        pred = pred.unionByName(cut_lineage(seen))
    table = sized(metrics.confusion_counts(pred, ["model"]))
    classes = metrics.per_class(table, ["model"])
    return {"class_counts": counts, "report": metrics.accuracy(table, ["model"]).join(metrics.averages(classes, ["model"]), "model"),
            "per_class": classes}


def domain_shift_report(real: DataFrame, row_id: str = "flow_id", n_bootstrap: int = 400, trainer=None, seed: int = 42,
                        effort: Effort = Effort()) -> DataFrame:
    """Fit on the real train rows; score the real test rows, the bootstrapped attack rows, and both together.

    One row per part (`real_test`, `bootstrap`, `all`): rows, accuracy and macro metrics over the classes that occur in it.
    """
    rows = augment.domain_shift_set(real, row_id, n_bootstrap=n_bootstrap, seed=seed)
    coded = rows.withColumns({"row_id": F.xxhash64("part", row_id, *FEATURES), "y": label_code(F.col("label"), LABELS)})
    coded = cut_lineage(coded.select("row_id", "part", "y", *FEATURES))
    trainer = trainer or supervised.random_forest(effort.trees, effort.depth)
    found = supervised.fit_predict(trainer, coded.where("part = 'train'"), coded.where("part <> 'train'"), FEATURES, len(LABELS))
    found = cut_lineage(found.select("part", "y", "p"))  # else every task of the report unpacks the forest
    counts = sized(metrics.confusion_counts(found, ["part"]))
    counts = counts.unionByName(counts.groupBy("y", "p").agg(F.sum("n").alias("n")).withColumn("part", F.lit("all")))
    n_train = coded.where("part = 'train'").agg(F.count(F.lit(1)).alias("n"))
    out = metrics.accuracy(counts, ["part"]).join(metrics.averages(metrics.per_class(counts, ["part"]), ["part"]), "part")
    return out.withColumn("n_train", n_train.scalar())


def public_binary_report(parts: dict[str, DataFrame], effort: Effort = Effort()) -> DataFrame:
    """Two models, four metrics, four decimals."""
    labels = ["anomaly", "normal"]
    rows = []
    for name, trainer in (("RandomForest", supervised.random_forest(effort.trees, effort.depth)),
                          ("XGBoost", supervised.boosted_trees(effort.rounds, effort.boost_depth))):
        train, test = (t.withColumn("y", cleaning.binary_target(F.col("label"))) for t in (parts["train"], parts["test"]))
        found = supervised.fit_predict(trainer, train, test, FEATURES, len(labels)).withColumn("model", F.lit(name))
        rows.append(cut_lineage(found.select("model", "y", "p")))
    report = metrics.binary_report(metrics.confusion_counts(rows[0].unionByName(rows[1]), ["model"]), ["model"])
    return report.select("model", *[F.round(c, 4).alias(c) for c in ("accuracy", "precision_anomaly", "recall_anomaly", "f1_anomaly")])


def fit_final_model(polls: DataFrame, max_polls: int = 3, row_id: str = "flow_id", effort: Effort = Effort(), seed: int = 42) -> dict:
    """Fit the selected model on every clean early poll. No quality is reported: these are the fit rows."""
    early = cut_lineage(telemetry.early_polls(cleaning.clean_polls(polls), max_polls, row_id).withColumn(
        "y", cleaning.binary_target(F.col("label"))))
    f = PORT_FREE_FEATURES
    stats = rules.scaler_stats(early, f).first()
    scaled = ", ".join(f"(CAST({c} AS DOUBLE) - {float(stats[c + '_mean'])!r}D) / {float(stats[c + '_std'])!r}D AS _s_{c}" for c in f)
    forest = RandomForestClassifier(numTrees=effort.trees, maxDepth=effort.depth, minInstancesPerNode=2, weightCol="weight", cacheNodeIds=True,
                                    featureSubsetStrategy="sqrt", labelCol="y", featuresCol="features", seed=seed)
    prep = [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
            VectorAssembler(inputCols=[f"_s_{c}" for c in f], outputCol="features")]
    ready = Pipeline(stages=prep).fit(early)
    model = forest.fit(ready.transform(splits.with_class_weights(early, "y")))
    counts = {str(r["y"]): r["n"] for r in early.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = early.agg(F.count_distinct("run_id").alias("r"), F.count_distinct("scenario_id").alias("s")).first()
    digest = sinks.table_digest(early.select("run_id", row_id, "label", *f)).first()["hash_sum"]
    manifest = sinks.model_manifest(polls.sparkSession, "binary_anomaly_port_agnostic", f, counts, sizes["r"], sizes["s"],
                                    {"trees": effort.trees, "depth": effort.depth, "max_polls": max_polls}, digest)
    return {"model": PipelineModel(stages=[*ready.stages, model]), "manifest": manifest}


def check_scoring_input(df: DataFrame, manifest: DataFrame, label: str | None = None) -> DataFrame:
    """Contract between a scoring table and a model: columns first, then one pass over the rows."""
    row = manifest.first()
    features, known = list(row["features"]), sorted(row["class_counts"] or {})
    missing = [c for c in features if c not in df.columns]
    present = [c for c in features if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in present]]
    unseen = F.lit(0)
    if label:
        unseen = F.count(F.when(~F.col(label).cast("string").isin(known), 1))
    out = df.agg(*aggs, unseen.alias("n_unseen_labels"))
    nulls = sum((F.col(f"null_{c}") for c in present), F.lit(0))
    return out.select(
        F.lit(row["task"]).alias("task"), F.lit(len(features)).alias("n_features"),
        F.lit(", ".join(missing)).alias("missing_columns"), "n_rows", nulls.alias("n_null_values"), "n_unseen_labels",
        (F.lit(not missing) & (nulls == 0) & (F.col("n_unseen_labels") == 0)).alias("ok"))


def scoring_cost(model, df: DataFrame, name: str = "model") -> DataFrame:
    """Batch scoring throughput: rows and seconds of one full pass."""
    start = time.monotonic()
    n = model.transform(df).agg(F.count(F.lit(1)), F.sum("prediction")).first()[0]
    spent = max(time.monotonic() - start, 1e-9)
    return df.sparkSession.createDataFrame([(name, n, spent, n / spent)], "model string, n_rows long, seconds double, rows_per_sec double")


def stream_cost(progress: list[dict]) -> dict[str, float]:
    """Micro-batch durations and rates from StreamingQueryProgress records."""
    spent = sorted(p["durationMs"].get("triggerExecution", 0) for p in progress if p.get("numInputRows"))
    rows = sum(p["numInputRows"] for p in progress)
    if not spent:
        return {"batches": 0, "rows": rows}
    pick = lambda q: float(spent[min(len(spent) - 1, int(q * len(spent)))])
    return {"batches": len(spent), "rows": rows, "p50_ms": pick(0.5), "p95_ms": pick(0.95), "p99_ms": pick(0.99),
            "rows_per_sec": 1000.0 * rows / max(sum(spent), 1)}


def run_pipeline(polls: DataFrame, smoke: bool = False, bootstrap: int = 400, replace_handcraft: bool = False,
                 effort: Effort = Effort()) -> dict[str, DataFrame | str]:
    """Provenance, bootstrap, split, models, baselines, real-only report as one application.

    A failing step is recorded and skipped unless it is one of split, train and real-only.
    """
    out: dict[str, DataFrame | str] = {}
    data = cleaning.mark_synthetic(require_columns(polls, [*FEATURES, "label", "source"]))
    if bootstrap > 0:
        data = augment.with_bootstrap(data, "flow_id", bootstrap, replace_handmade=replace_handcraft)
    # Generated ids replace the originals only in bootstrap rows; the hash keeps row ids unique.
    rows = data.where(F.col("label").isin(LABELS)).dropna(subset=FEATURES)
    rows = cut_lineage(rows.withColumns({"row_id": F.xxhash64("flow_id", "source", *FEATURES), "y": label_code(F.col("label"), LABELS)}))
    parts = cut_lineage(splits.stratified_split(rows, "label", "row_id"))
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    out["split"] = parts.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))
    booster = supervised.boosted_trees(effort.rounds, effort.boost_depth, stop_early=True)
    pred = supervised.fit_predict(booster, train, test, FEATURES, len(LABELS))
    pred = cut_lineage(pred.select(F.lit("XGBoost").alias("model"), "y", "p"))
    counts = metrics.confusion_counts(pred, ["model"])
    out["train"] = metrics.accuracy(counts, ["model"]).join(metrics.averages(metrics.per_class(counts, ["model"]), ["model"]), "model")
    scored = test.withColumn("y", cleaning.binary_target(F.col("label")))

    def baselines() -> DataFrame:
        multi = scored.withColumn("p", rules.multi_rule())
        return rules.static_threshold(scored).withColumn("method", F.lit("static")).unionByName(
            metrics.binary_report(metrics.confusion_counts(multi, []), []).withColumn("method", F.lit("multi_rule")),
            allowMissingColumns=True).unionByName(rules.z_score(scored).withColumn("method", F.lit("z_score")), allowMissingColumns=True)

    def forest() -> DataFrame:
        found = K.forest_detector(FEATURES, F.col("label") == "normal", trees=effort.trees)(train, scored)
        return metrics.binary_report(metrics.confusion_counts(found, []), [])

    def network() -> DataFrame:
        found = K.reconstruction_detector(FEATURES, F.col("label") == "normal", [16, 8, 4, 8, 16], epochs=effort.epochs or 100, patience=10)(train, scored)
        return metrics.binary_report(metrics.confusion_counts(found, []), [])

    def cross_validation() -> DataFrame:
        both = K.stratified_cross_validation(rows, "label", "row_id", FEATURES, supervised.random_forest(effort.trees, effort.depth), len(LABELS))
        return K.gap_report(*both)

    steps = {"isolation_forest": forest, "baselines": baselines}
    if not smoke:
        steps.update({"autoencoder": network, "cross_validation": cross_validation})
    for name, step in steps.items():
        try:
            out[name] = cut_lineage(step())
        except Exception as exc:  # noqa: BLE001 - optional step
            out[f"{name}_error"] = f"{type(exc).__name__}: {exc}"
    out.update(real_only_report(polls, effort=effort))
    return out

