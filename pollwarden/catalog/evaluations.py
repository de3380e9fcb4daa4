"""The evaluation and merge jobs through their public functions, by the models that can be fitted at their published size in every fold.

A forest of the published size takes over a minute on 10,000 polls; `d9`, `d28` and `m11` fit one each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pollwarden.catalog import query
from pollwarden.catalog import views as V
from pollwarden.catalog.files import fresh_folder, full_polls
from pollwarden.catalog.telemetry import clean
from pollwarden.plans import jobs
from pollwarden.plans.folds import FAULT_LABELS
from pollwarden.schemas import LABELS
from pollwarden.sources import readers as R
from pollwarden.sources import sinks as K


def with_family(spark, sf):
    """Polls with their event family as the scenario that is held out."""
    return clean(spark, sf).withColumns({"scenario_id": F.split("scenario_id", "_")[0], "source": F.lit("")})


def answered(pred, by, labels):
    """Rows, attack rows and rows with an answer out of `labels`, for each model and held-out group."""
    return pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"), F.count_distinct("row_id").alias("n_rows"),
                                 F.count(F.when(F.col("p").isin(labels), 1)).alias("n_answers"))


@query("job_evaluate_binary_loso", f"""WITH {V.EARLY_SQL}, f AS (SELECT split_part(scenario_id, '_', 1) AS grp, label FROM early)
SELECT model, grp, count(*) AS n_test, count(*) AS n_rows, count(*) AS n_answers, mode(label) AS heldout_label
FROM f, (VALUES ('LinearSVC')) m(model) GROUP BY 1, 2""")
def binary_loso(spark, sf):
    """Every early poll of a held-out family is answered once by each model; the per-scenario table names the family's label."""
    out = jobs.evaluate_binary_loso(with_family(spark, sf), models=["LinearSVC"], effort=jobs.Effort(parallel=2))
    found = answered(out["predictions"], ["model", "grp"], [0, 1])
    return found.join(out["per_scenario"].select("model", "grp", "heldout_label"), ["model", "grp"])


@query("job_evaluate_multiclass_loso", f"""WITH {V.FEATURE_SQL}, l AS (SELECT *, row_number() OVER (
  PARTITION BY run_id, datapath_id, ip_src, ip_dst, ip_proto, tp_src, tp_dst ORDER BY timestamp DESC, flow_id DESC) AS rn FROM clean)
SELECT 'behavior_window' AS feature_set, 'LinearSVC' AS model, split_part(scenario_id, '_', 1) AS grp,
  count(*) AS n_test, count(*) AS n_rows, count(*) AS n_answers FROM l WHERE rn = 1 GROUP BY 3""")
def multiclass_loso(spark, sf):
    """Three classes on the last poll of each flow, ports replaced by behaviour windows."""
    out = jobs.evaluate_multiclass_loso(with_family(spark, sf), "behavior_window", linearsvc_only=True, effort=jobs.Effort(parallel=2))
    return answered(out["predictions"], ["feature_set", "model", "grp"], LABELS)


@query("job_evaluate_grouped", f"""WITH {V.FEATURE_SQL}
SELECT 'LinearSVC' AS model, 'GroupKFold(n_splits=5)' AS splitter, count(*) AS n_test, count(*) AS n_rows, count(*) AS n_answers, 5 AS n_folds FROM clean""")
def grouped(spark, sf):
    """Five folds of whole runs: each poll is in one test part and is answered there."""
    out = jobs.evaluate_grouped(clean(spark, sf).withColumn("source", F.lit("")), linearsvc_only=True, effort=jobs.Effort(parallel=2))
    folds = out["per_fold"].groupBy("model", "splitter").agg(F.count(F.lit(1)).alias("n_folds"))
    return answered(out["predictions"], ["model"], LABELS).join(folds, "model")


@query("job_evaluate_fault", f"""WITH {V.SAMPLE_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p_ts, probe_id) AS rn,
  count(*) OVER (PARTITION BY run_id) AS n FROM fault_samples),
s AS (SELECT * FROM t WHERE n_flows > 0 AND (n <= 2 OR (n <= 4 AND rn > 1 AND rn < n) OR (n > 4 AND rn > 2 AND rn < n - 1))),
r AS (SELECT scenario_id AS grp, count(*) AS n_test FROM s GROUP BY 1)
SELECT task, model, coalesce(grp, '_pooled') AS grp, sum(n_test)::BIGINT AS n_test, true AS is_rate
FROM r, (VALUES ('binary'), ('four_class')) k(task), (VALUES ('rule_based')) m(model) GROUP BY task, model, ROLLUP(grp)""")
def fault(spark, sf):
    """Both tasks by the calibrated rule; one-class rows that say they answer one task only are left out.

    With the kernel SVC beside the rule (14 fits) it was ended after 75 seconds at scale 0.01 without a result.
    """
    rows = V.fault_samples(spark, sf).withColumnsRenamed({"p_ts": "timestamp", "probe_id": "row_id"})
    out = jobs.evaluate_fault(rows, "fault", supervised_only=True, effort=jobs.Effort(parallel=2, extra={"models": ["rule_based"]}))
    parts = [out[f"{task}_loso"].where(F.col("accuracy").isNotNull()).select(
        F.lit(task).alias("task"), "model", "grp", "n_test", F.col("accuracy").between(0, 1).alias("is_rate")) for task in FAULT_LABELS]
    return parts[0].unionByName(parts[1])


def save_named(spark, df, folder, names):
    """One headed CSV file for each name, rows dealt to them by flow id."""
    for k, name in enumerate(names):
        part = f"{folder}-{k}"
        df.where(F.pmod("flow_id", F.lit(len(names))) == k).coalesce(1).write.option("header", True).option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(part)
        K.move_single(spark, part, f"{folder}/{name}")


@query("s5_merge_runs", f"""WITH {V.FLOW_SQL} SELECT 'run_' || (flow_id % 4) || '.csv' AS source_file, label, count(*) AS n,
  CAST(sum(packet_count) AS BIGINT) AS packets, 0 AS is_synthetic FROM flow_polls WHERE flow_id % 4 <> 3 GROUP BY 1, 2""")
def s5(spark, sf):
    """A folder of collected runs, merged: of its four files one carries the marker in its name and is left out whole."""
    folder = fresh_folder(spark, "runs")
    save_named(spark, full_polls(spark, sf), folder, ["run_0.csv", "run_1.csv", "run_2.csv", "run_3_Normal_Massive.csv"])
    out = jobs.merge_runs(R.read_run_folder(spark, folder))
    return out.groupBy("source_file", "label", F.col("is_synthetic").cast("int").alias("is_synthetic")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("packet_count").alias("packets"))
