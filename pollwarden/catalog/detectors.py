"""Preprocessing, rule detectors, models and their reports."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pollwarden.catalog import query
from pollwarden.catalog import views as V
from pollwarden.catalog.evaluation import rounded
from pollwarden.catalog.telemetry import clean, early
from pollwarden.operators import anomaly, cleaning, metrics, rules, splits, supervised
from pollwarden.plans import folds as K
from pollwarden.plans import jobs
from pollwarden.functions.features import label_code
from pollwarden.schemas import FEATURES, LABELS, PORT_FREE_FEATURES

FLOATS = ["packet_count", "byte_count", "packet_count_per_sec", "packet_size_avg"]


def with_split(spark, sf):
    """Flow features with the first scenario group as the held-out part."""
    return clean(spark, sf).withColumn("held", F.col("scenario_id").endswith("_0"))


_STATS = ", ".join(f"avg({c}) FILTER (NOT held) AS {c}_mean, CASE WHEN stddev_pop({c}) FILTER (NOT held) = 0 THEN 1 ELSE "
                   f"stddev_pop({c}) FILTER (NOT held) END AS {c}_std" for c in FLOATS)


@query("d1_standard_scaler", f"""WITH {V.FEATURE_SQL}, t AS (SELECT *, ends_with(scenario_id, '_0') AS held FROM clean),
s AS (SELECT {_STATS} FROM t)
SELECT flow_id, {", ".join(f"round(({c} - {c}_mean) / {c}_std, 6) AS {c}" for c in FLOATS)} FROM t, s""")
def d1(spark, sf):
    rows = with_split(spark, sf)
    out = rules.scale(rows, rules.scaler_stats(rows.where("NOT held"), FLOATS), FLOATS)
    return rounded(out.select("flow_id", *FLOATS))


_FILL = ["udp_lost_pct", "jitter_ms", "rtt_mean_ms"]


@query("d2_median_impute", f"""WITH {V.SAMPLE_SQL}, t AS (SELECT *, scenario_id = 'sc_0' AS held FROM fault_samples),
m AS (SELECT {", ".join(f"coalesce(quantile_cont({c}, 0.5) FILTER (NOT held), 0) AS {c}_m" for c in _FILL)} FROM t)
SELECT probe_id, {", ".join(f"round(coalesce({c}, {c}_m), 6) AS {c}" for c in _FILL)}, 0::DOUBLE AS empty FROM t, m""")
def d2(spark, sf):
    rows = V.fault_samples(spark, sf).withColumn("empty", F.lit(None).cast("double"))
    cols = [*_FILL, "empty"]
    fills = rules.median_fills(rows.where("scenario_id <> 'sc_0'"), cols)
    return rounded(rules.impute(rows, fills, cols).select("probe_id", *cols))


@query("d3_normal_only_impute", f"""WITH {V.SAMPLE_SQL},
m AS (SELECT {", ".join(f"coalesce(quantile_cont({c}, 0.5), 0) AS {c}_m" for c in _FILL)} FROM fault_samples WHERE fault_family = 'normal')
SELECT probe_id, {", ".join(f"round(coalesce({c}, {c}_m), 6) AS {c}" for c in _FILL)} FROM fault_samples, m""")
def d3(spark, sf):
    rows = V.fault_samples(spark, sf)
    fills = rules.median_fills(rules.normal_rows(rows, "fault_family"), _FILL)
    return rounded(rules.impute(rows, fills, _FILL).select("probe_id", *_FILL))


_LIMITS = f"""{V.SAMPLE_SQL}, sc AS (SELECT DISTINCT scenario_id AS held FROM fault_samples),
tr AS (SELECT sc.held, f.* FROM sc JOIN fault_samples f ON f.scenario_id <> sc.held),
nn AS (SELECT held, count(*) FILTER (fault_family = 'normal') AS k FROM tr GROUP BY 1),
lim AS (SELECT tr.held, greatest(2, quantile_cont(coalesce(probe_loss_pct, 0), 0.95)) AS lim_loss,
  greatest(3, quantile_cont(coalesce(udp_lost_pct, 0), 0.95)) AS lim_uloss, greatest(20, 2 * quantile_cont(coalesce(rtt_mean_ms, 0), 0.95)) AS lim_rtt,
  coalesce(greatest(0.5, 0.5 * quantile_cont(throughput_mbps, 0.25)), 1) AS lim_thr
  FROM tr JOIN nn USING (held) WHERE nn.k < 3 OR fault_family = 'normal' GROUP BY 1)"""


def held_out_limits(spark, sf):
    """Rule limits of every fold: the train rows of a fold are all rows of the other scenarios."""
    rows = V.fault_samples(spark, sf)
    return rows, rules.held_out_rule_limits(rows, "scenario_id").withColumnRenamed("scenario_id", "held")


@query("d4_rule_limits", f"""WITH {_LIMITS} SELECT held, round(lim_loss, 6) AS lim_loss, round(lim_uloss, 6) AS lim_uloss,
  round(lim_rtt, 6) AS lim_rtt, round(lim_thr, 6) AS lim_thr FROM lim""")
def d4(spark, sf):
    return rounded(held_out_limits(spark, sf)[1])


_VERDICT = """CASE WHEN coalesce(probe_loss_pct, 0) >= lim_loss OR coalesce(udp_lost_pct, 0) >= lim_uloss THEN 'loss'
  WHEN coalesce(rtt_mean_ms, 0) >= lim_rtt THEN 'delay' WHEN throughput_mbps <= lim_thr THEN 'bandwidth' ELSE 'normal' END"""


@query("d4_d5_fault_rule", f"""WITH {_LIMITS} SELECT f.probe_id, {_VERDICT} AS p4, CASE WHEN {_VERDICT} = 'normal' THEN 'normal' ELSE 'fault' END AS p2
FROM fault_samples f JOIN lim ON f.scenario_id = lim.held""")
def d5(spark, sf):
    rows, limits = held_out_limits(spark, sf)
    out = rules.fault_rule(rows, limits.withColumnRenamed("held", "scenario_id"), ["scenario_id"], out="p4")
    return out.select("probe_id", "p4", cleaning.fault_target(F.col("p4")).alias("p2"))


def binary_rates(spark, sf):
    return early(spark, sf).withColumn("y", cleaning.binary_target(F.col("label")))


_SWEEP = """s AS (SELECT k.i AS idx, k.t AS threshold, sum((y=1 AND r>k.t)::INT) AS tp, sum((y=0 AND r>k.t)::INT) AS fp,
  sum((y=1 AND NOT r>k.t)::INT) AS fn, sum((y=0 AND NOT r>k.t)::INT) AS tn
  FROM q, (VALUES {v}) k(i, t) GROUP BY 1, 2)"""
_STATIC = _SWEEP.format(v=", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(rules.STATIC_THRESHOLDS)))
_RATES = """round((tp+tn)::DOUBLE/(tp+tn+fp+fn),6) AS accuracy, round(coalesce(tp::DOUBLE/nullif(tp+fp,0),0),6) AS precision_anomaly,
  round(coalesce(tp::DOUBLE/nullif(tp+fn,0),0),6) AS recall_anomaly, round(coalesce(2*tp::DOUBLE/nullif(2*tp+fp+fn,0),0),6) AS f1_anomaly"""
_RATE_COLS = ["accuracy", "precision_anomaly", "recall_anomaly", "f1_anomaly"]


@query("d6_o3_static_threshold", f"""WITH {V.EARLY_SQL}, q AS (SELECT (label<>'normal')::INT AS y, packet_count_per_sec AS r FROM early), {_STATIC}
SELECT threshold, {_RATES}, 'test' AS tuned_on FROM s ORDER BY (tp+tn)::DOUBLE/(tp+tn+fp+fn) DESC, idx LIMIT 1""")
def d6(spark, sf):
    return rounded(rules.static_threshold(binary_rates(spark, sf)).select("threshold", *_RATE_COLS, "tuned_on"))


@query("d7_multi_rule", f"""WITH {V.RULE_SQL}, s AS (SELECT sum((y=1 AND p=1)::INT) AS tp, sum((y=0 AND p=1)::INT) AS fp,
  sum((y=1 AND p=0)::INT) AS fn, sum((y=0 AND p=0)::INT) AS tn FROM rule_pred) SELECT {_RATES} FROM s""")
def d7(spark, sf):
    scored = binary_rates(spark, sf).withColumn("p", rules.multi_rule())
    return rounded(metrics.binary_report(metrics.confusion_counts(scored, []), []).select(*_RATE_COLS))


@query("d8_z_score", f"""WITH {V.EARLY_SQL}, l AS (SELECT avg(packet_count_per_sec) + 2 * stddev_samp(packet_count_per_sec) AS t FROM early),
s AS (SELECT t, sum((label<>'normal' AND packet_count_per_sec>t)::INT) AS tp, sum((label='normal' AND packet_count_per_sec>t)::INT) AS fp,
  sum((label<>'normal' AND NOT packet_count_per_sec>t)::INT) AS fn, sum((label='normal' AND NOT packet_count_per_sec>t)::INT) AS tn FROM early, l GROUP BY 1)
SELECT round(t, 4) AS threshold, {_RATES}, 'test' AS tuned_on FROM s""")
def d8(spark, sf):
    out = rules.z_score(binary_rates(spark, sf)).withColumn("threshold", F.round("threshold", 4))
    return rounded(out.select("threshold", *_RATE_COLS, "tuned_on"))


_SETTINGS = [0.001, 0.005, 0.01, 0.05]


@query("d16_contamination_sweep", f"""WITH q AS (SELECT (event_type='error')::INT AS y, value AS r FROM events),
th AS (SELECT {", ".join(f"quantile_cont(r, {1 - c}) AS t{i}" for i, c in enumerate(_SETTINGS))} FROM q WHERE y = 0),
k AS (SELECT unnest([{", ".join(str(i) for i in range(len(_SETTINGS)))}]) AS i, unnest([{", ".join(f"t{i}" for i in range(len(_SETTINGS)))}]) AS t FROM th),
s AS (SELECT i AS idx, t AS threshold, sum((y=1 AND r>t)::INT) AS tp, sum((y=0 AND r>t)::INT) AS fp, sum((y=1 AND NOT r>t)::INT) AS fn,
  sum((y=0 AND NOT r>t)::INT) AS tn FROM q, k GROUP BY 1, 2)
SELECT idx, round(threshold, 6) AS threshold, {_RATES} FROM s""")
def d16(spark, sf):
    """One scoring, several settings: only the threshold moves."""
    rows = V.table(spark, sf, "events").select((F.col("event_type") == "error").cast("int").alias("y"), F.col("value").alias("score"))
    limits = anomaly.score_quantiles(rows.where("y = 0"), [1 - c for c in _SETTINGS])
    out = metrics.threshold_sweep(rows, "score", "y", limits)
    return rounded(out.select("idx", "threshold", *_RATE_COLS))


# --- models over the embedding table: labels below 7 are normal --------------------------------------------

XS = [f"x{i}" for i in range(64)]


def vectors(spark, sf):
    """Embedding columns; labels from 7 on count as attacks."""
    return V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") >= 7).cast("int").alias("y"), F.col("label").alias("cls"),
        *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(XS)])


def halves(spark, sf):
    rows = splits.stratified_split(vectors(spark, sf), "y", "row_id").drop("split_note").persist()
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def report(found, name):
    counts = metrics.confusion_counts(found.withColumn("model", F.lit(name)), ["model"])
    return rounded(metrics.binary_report(counts, ["model"]))


@query("d9_random_forest")
def d9(spark, sf):
    train, test = halves(spark, sf)
    return report(supervised.fit_predict(supervised.random_forest(), train, test, XS, 2), "random_forest")


@query("d10_d11_boosted_trees")
def d10(spark, sf):
    train, test = halves(spark, sf)
    trainer = supervised.boosted_trees(stop_early=True)
    return report(supervised.fit_predict(trainer, train, test, XS, 2), "boosted_trees")


@query("d11_three_class_boosting", """SELECT count(*) AS n_test, count(*) AS n_predicted FROM embeddings WHERE vec_id % 5 = 0""")
def d11(spark, sf):
    """Three classes under one softmax, stopped early; every test row gets one of the three."""
    rows = vectors(spark, sf).withColumn("y", F.when(F.col("cls") < 5, 0).when(F.col("cls") < 8, 1).otherwise(2))
    trainer = supervised.boosted_trees(depth=4, stop_early=True, patience=5)
    out = supervised.fit_predict(trainer, rows.where("row_id % 5 <> 0"), rows.where("row_id % 5 = 0"), XS, 3)
    return out.agg(F.count(F.lit(1)).alias("n_test"), F.count(F.when(F.col("p").isin(0, 1, 2), 1)).alias("n_predicted"))


@query("d12_linear_svc")
def d12(spark, sf):
    train, test = halves(spark, sf)
    return report(supervised.fit_predict(supervised.linear_svc(), train, test, XS, 2, train_cap=40_000), "linear_svc")


@query("d13_rbf_svc")
def d13(spark, sf):
    train, test = halves(spark, sf)
    return report(supervised.fit_predict(supervised.rbf_svc(), train, test, XS, 2), "rbf_svc")


@query("d14_isolation_forest")
def d14(spark, sf):
    train, test = halves(spark, sf)
    return report(K.forest_detector(XS, F.col("y") == 0)(train, test), "isolation_forest")


@query("o4_best_contamination")
def o4(spark, sf):
    """Fit once on normal train rows, sweep the contamination on the test rows, keep the best F1."""
    train, test = halves(spark, sf)
    normal = train.where("y = 0")
    forest = anomaly.fit_isolation_forest(normal, "row_id", XS)
    return rounded(metrics.best_setting(anomaly.contamination_sweep(forest, normal, test), "f1_anomaly"))


@query("d27_validation_slice")
def d27(spark, sf):
    return rounded(supervised.validation_score(supervised.random_forest(), halves(spark, sf)[0], XS, 2))


@query("d15_reconstruction")
def d15(spark, sf):
    train, test = halves(spark, sf)
    return report(K.reconstruction_detector(XS, F.col("y") == 0, [8, 4, 8])(train, test), "autoencoder")


@query("d17_leave_scenario_out")
def d17(spark, sf):
    """Early polls, one event family held out at a time, forest against rule-free truth.

    5 trees of depth 5: a forest of the published size took 75 seconds on 10,000 polls of scale 0.01, and five are fitted.
    """
    rows = binary_rates(spark, sf).withColumns({"row_id": F.col("flow_id"), "family": F.split("scenario_id", "_")[0]})
    rows = rows.select("row_id", "family", "y", *PORT_FREE_FEATURES)
    models = {"RandomForest": K.supervised_detector(supervised.random_forest(5, 5), PORT_FREE_FEATURES, 2)}
    pred = K.cross_predict(rows, "family", K.group_list(rows, "family"), models, parallel=2)
    return rounded(metrics.fold_report(pred))


@query("d18_gap_report")
def d18(spark, sf):
    both = K.stratified_cross_validation(vectors(spark, sf), "y", "row_id", XS, supervised.random_forest(5, 4), 2, k=3, model="forest")
    return rounded(K.gap_report(*both))


def fitted(spark, sf):
    rows = supervised.assemble(vectors(spark, sf), XS).persist()
    return rows, supervised.random_forest()(rows.select("y", "features", "row_id"), 2)


@query("d19_d20_o5_feature_importance")
def d20(spark, sf):
    return supervised.importance_table(spark, fitted(spark, sf)[1], XS, 10)


@query("d21_permutation_importance")
def d21(spark, sf):
    rows, model = fitted(spark, sf)
    return supervised.permutation_importance(rows, model, XS, "row_id")


@query("d22_attribution_ranking")
def d22(spark, sf):
    rows, model = fitted(spark, sf)
    return supervised.shapley_ranking(rows, model, XS, "row_id", rows=500)


@query("d23_pca_projection")
def d23(spark, sf):
    return supervised.pca_projection(vectors(spark, sf), XS, "cls", "row_id")[0]


@query("d25_scoring_contract", """SELECT 'binary' AS task, 2 AS n_features, '' AS missing_columns, count(*) AS n_rows,
  0 AS n_null_values, sum((event_type NOT IN ('click', 'view'))::INT)::BIGINT AS n_unseen_labels, false AS ok FROM events""")
def d25(spark, sf):
    from pollwarden.sources.sinks import model_manifest

    rows = V.table(spark, sf, "events")
    manifest = model_manifest(spark, "binary", ["value", "user_id"], {"click": 1, "view": 1}, 1, 1, {}, "")
    out = jobs.check_scoring_input(rows, manifest, "event_type")
    return out.withColumn("n_null_values", F.col("n_null_values").cast("int"))


@query("d26_scoring_cost")
def d26(spark, sf):
    rows, model = fitted(spark, sf)
    return jobs.scoring_cost(model, rows, "random_forest")


@query("d28_real_only_report")
def d28(spark, sf):
    """Retrained on the train part at the published size, with a probe: a smaller model of all real rows, scored on all of them."""
    polls = clean(spark, sf).withColumn("source", F.lit(""))
    rows = polls.dropna(subset=[*FEATURES, "label"]).withColumn("y", label_code(F.col("label"), LABELS))
    forest = RandomForestClassifier(numTrees=20, maxDepth=8, minInstancesPerNode=2, featureSubsetStrategy="sqrt", labelCol="y", seed=42)
    rows = rows.select(*FEATURES, "y").persist()  # the fit reads them several times
    full = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)
    rows.unpersist()
    out = jobs.real_only_report(polls, probe=full)
    return rounded(out["report"])


@query("d29_public_binary_report")
def d29(spark, sf):
    from pollwarden.catalog.cleaning import binary_flows

    rows = cleaning.map_public_binary(binary_flows(spark, sf))
    rows = rows.withColumn("row_id", F.xxhash64(*rows.columns))
    parts = splits.stratified_split(rows, "label", "row_id").persist()
    return jobs.public_binary_report({"train": parts.where("split = 'train'"), "test": parts.where("split = 'test'")},
                                     jobs.Effort(trees=5, depth=5, rounds=3))


# 5 trees: the manifest says the same of a model of any size. The full fit is that of st4.
@query("d30_k6_final_fit_manifest", f"""WITH {V.EARLY_SQL} SELECT 'binary_anomaly_port_agnostic' AS task, 8 AS n_features,
  count(DISTINCT run_id) AS n_runs, count(DISTINCT scenario_id) AS n_scenarios, count(*) FILTER (label = 'normal') AS n_normal,
  count(*) FILTER (label <> 'normal') AS n_attack FROM early""")
def d30(spark, sf):
    out = jobs.fit_final_model(featured(spark, sf), effort=jobs.Effort(trees=5, depth=5))
    return out["manifest"].select("task", F.size("features").alias("n_features"), "n_runs", "n_scenarios",
                                  F.col("class_counts")["0"].alias("n_normal"), F.col("class_counts")["1"].alias("n_attack"))


def featured(spark, sf):
    from pollwarden.functions.features import flow_features

    return flow_features(V.flow_polls(spark, sf))


@query("audit_overlap_grouped")
def audit(spark, sf):
    out = jobs.audit_overlap(grouped=featured(spark, sf))
    return rounded(out)


