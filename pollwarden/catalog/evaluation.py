"""Metric reports over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollwarden.catalog import query
from pollwarden.catalog import views as V
from pollwarden.catalog.telemetry import early
from pollwarden.operators import metrics as M
from pollwarden.operators.percentiles import exact_percentiles

LABELS = ["A", "N", "R"]


def rounded(df, digits=6, keep=()):
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def rule_pred(spark, sf):
    return V.rule_predictions(early(spark, sf))


_CELLS = """sum(CASE WHEN y=1 AND p=1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y=0 AND p=1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y=1 AND p=0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y=0 AND p=0 THEN 1 ELSE 0 END) AS tn"""
_BINARY = """CAST(tp+fp+fn+tn AS BIGINT) AS n_test, round((tp+tn)::DOUBLE/(tp+fp+fn+tn),6) AS accuracy,
  round(coalesce(tp::DOUBLE/nullif(tp+fp,0),0),6) AS precision_anomaly, round(coalesce(tp::DOUBLE/nullif(tp+fn,0),0),6) AS recall_anomaly,
  round(coalesce(2*tp::DOUBLE/nullif(2*tp+fp+fn,0),0),6) AS f1_anomaly, round(fp::DOUBLE/nullif(fp+tn,0),6) AS false_positive_rate_normal"""


@query("early_poll_rule_loso", f"""WITH {V.RULE_SQL},
c AS (SELECT model, CASE WHEN grouping(grp)=1 THEN '_pooled' ELSE grp END AS grp, {_CELLS}
  FROM rule_pred GROUP BY GROUPING SETS ((model, grp), (model)))
SELECT model, grp, {_BINARY} FROM c""")
def early_poll_rule_loso(spark, sf):
    """Scan, clean, features, first polls, rule verdict, per-scenario and pooled binary metrics."""
    counts = M.with_pooled(M.confusion_counts(rule_pred(spark, sf), ["model", "grp"]), "grp")
    return rounded(M.binary_report(counts, ["model", "grp"]).drop("fpr", "fnr"))


@query("a16_loso_summary", f"""WITH {V.RULE_SQL},
c AS (SELECT model, grp, any_value(heldout_label) AS lab, {_CELLS} FROM rule_pred GROUP BY 1, 2),
f AS (SELECT *, coalesce(tp::DOUBLE/nullif(tp+fn,0),0) AS rec, fp::DOUBLE/nullif(fp+tn,0) AS fpr FROM c),
o AS (SELECT model, {_CELLS} FROM rule_pred GROUP BY 1)
SELECT o.model, round((o.tp+o.tn)::DOUBLE/(o.tp+o.fp+o.fn+o.tn),6) AS pooled_snapshot_accuracy,
  round(2*o.tp::DOUBLE/(2*o.tp+o.fp+o.fn),6) AS pooled_f1_anomaly, round(o.tp::DOUBLE/(o.tp+o.fp),6) AS pooled_precision_anomaly,
  round(o.tp::DOUBLE/(o.tp+o.fn),6) AS pooled_recall_anomaly,
  round((SELECT avg(rec) FROM f WHERE lab<>'normal'),6) AS attack_scenario_recall_mean,
  round((SELECT min(rec) FROM f WHERE lab<>'normal'),6) AS attack_scenario_recall_min,
  round((SELECT avg(fpr) FROM f WHERE lab='normal'),6) AS normal_scenario_fpr_mean,
  round((SELECT max(fpr) FROM f WHERE lab='normal'),6) AS normal_scenario_fpr_max,
  (SELECT count(*) FROM f) AS n_scenarios FROM o""")
def a16(spark, sf):
    pred = rule_pred(spark, sf).persist()
    labels = pred.groupBy("grp").agg(F.mode("heldout_label", deterministic=True).alias("heldout_label"))
    return rounded(M.loso_summary(pred, labels))


@query("a8_a15_fold_report", f"""WITH {V.PREDICTION_SQL},
q AS (SELECT model, grp, y, p FROM predictions UNION ALL SELECT model, '_pooled', y, p FROM predictions),
acc AS (SELECT model, grp, count(*) AS n_test, round(avg((y=p)::INT),6) AS accuracy FROM q GROUP BY 1,2),
lab AS (SELECT DISTINCT model, grp, label FROM (SELECT model, grp, y AS label FROM q UNION ALL SELECT model, grp, p FROM q)),
pc AS (SELECT l.model, l.grp, l.label, coalesce(2*sum((q.y=l.label AND q.p=l.label)::INT)::DOUBLE
    / nullif(sum((q.y=l.label)::INT)+sum((q.p=l.label)::INT),0),0) AS f1
  FROM lab l JOIN q ON l.model=q.model AND l.grp=q.grp GROUP BY 1,2,3)
SELECT acc.*, round(f.f1,6) AS f1_macro FROM acc JOIN (SELECT model, grp, avg(f1) AS f1 FROM pc GROUP BY 1,2) f USING (model, grp)""")
def a15(spark, sf):
    return rounded(M.fold_report(V.predictions(spark, sf)))


_SINGLE = "q AS (SELECT * FROM predictions WHERE NOT (grp='g1' AND y<>'A'))"
_GRID = "lab AS (SELECT unnest(['A','N','R']) AS label)"
_CLASS = """pc AS (SELECT q.grp, l.label,
  coalesce(sum((q.y=l.label AND q.p=l.label)::INT)::DOUBLE/nullif(sum((q.p=l.label)::INT),0),0) AS precision,
  coalesce(sum((q.y=l.label AND q.p=l.label)::INT)::DOUBLE/nullif(sum((q.y=l.label)::INT),0),0) AS recall,
  coalesce(2*sum((q.y=l.label AND q.p=l.label)::INT)::DOUBLE/nullif(sum((q.y=l.label)::INT)+sum((q.p=l.label)::INT),0),0) AS f1,
  CAST(sum((q.y=l.label)::INT) AS BIGINT) AS support FROM q JOIN lab l ON true GROUP BY 1,2)"""


def single_class(spark, sf):
    """One held-out group with a single class, where the label set of the macro average matters."""
    return V.predictions(spark, sf).where("NOT (grp = 'g1' AND y <> 'A')")


@query("a12_per_class", f"""WITH {V.PREDICTION_SQL}, {_SINGLE}, {_GRID}, {_CLASS}
SELECT grp, label, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, support FROM pc""")
def a12(spark, sf):
    counts = M.confusion_counts(single_class(spark, sf), ["grp"])
    return rounded(M.per_class(counts, ["grp"], LABELS))


@query("a13_averages", f"""WITH {V.PREDICTION_SQL}, {_SINGLE}, {_GRID}, {_CLASS}
SELECT grp, {", ".join(f"round(avg({m}),6) AS {m}_macro, round(sum({m}*support)/sum(support),6) AS {m}_weighted" for m in ("precision", "recall", "f1"))}
FROM pc GROUP BY 1""")
def a13(spark, sf):
    counts = M.confusion_counts(single_class(spark, sf), ["grp"])
    return rounded(M.averages(M.per_class(counts, ["grp"], LABELS), ["grp"]))


@query("a9_a10_binary_rates", """WITH t AS (SELECT quality AS y, toxic AS p FROM labels)
SELECT count(*) AS n_test, round(avg((y=p)::INT),6) AS accuracy,
  round(sum((y=0 AND p=1)::INT)::DOUBLE/sum((y=0)::INT),6) AS fpr, round(sum((y=1 AND p=0)::INT)::DOUBLE/sum((y=1)::INT),6) AS fnr,
  round(coalesce(sum((y=1 AND p=1)::INT)::DOUBLE/nullif(sum((p=1)::INT),0),0),6) AS precision_anomaly FROM t""")
def a10(spark, sf):
    rows = V.table(spark, sf, "labels")
    out = M.binary_report(M.confusion_counts(rows, [], "quality", "toxic"), [])
    return rounded(out.select("n_test", "accuracy", "fpr", "fnr", "precision_anomaly"))


@query("a11_confusion_long", f"""WITH {V.PREDICTION_SQL}, {_SINGLE},
g AS (SELECT grp, a.label AS y, b.label AS p FROM (SELECT DISTINCT grp FROM q), (SELECT unnest(['A','N','R','X']) AS label) a,
  (SELECT unnest(['A','N','R','X']) AS label) b)
SELECT g.grp, g.y, g.p, count(q.grp) AS n FROM g LEFT JOIN q ON g.grp=q.grp AND g.y=q.y AND g.p=q.p GROUP BY 1,2,3""")
def a11(spark, sf):
    counts = M.confusion_counts(single_class(spark, sf), ["grp"])
    return M.confusion_matrix(counts, ["grp"], [*LABELS, "X"])


@query("a11_confusion_wide", f"""WITH {V.PREDICTION_SQL} SELECT model, y, {", ".join(f"count(*) FILTER (p='{x}') AS pred_{x}" for x in LABELS)}
FROM predictions GROUP BY 1,2""")
def a11w(spark, sf):
    return M.confusion_wide(M.confusion_counts(V.predictions(spark, sf), ["model"]), ["model"], LABELS)


_HELD = """q AS (SELECT *, CASE grp WHEN 'g1' THEN 'A' WHEN 'g2' THEN 'N' ELSE 'R' END AS heldout_label FROM predictions
  WHERE NOT (grp='g1' AND y<>'A'))"""


@query("a14_heldout_recall", f"""WITH {V.PREDICTION_SQL}, {_HELD}
SELECT model, grp, heldout_label, round(avg((p=y)::INT) FILTER (y=heldout_label),6) AS recall_heldout_label,
  {", ".join(f"count(*) FILTER (y='{x}') AS support_{x}, round(avg((p=y)::INT) FILTER (y='{x}'),6) AS recall_{x}" for x in LABELS)}
FROM q GROUP BY 1,2,3""")
def a14(spark, sf):
    held = F.when(F.col("grp") == "g1", "A").when(F.col("grp") == "g2", "N").otherwise("R")
    pred = single_class(spark, sf).withColumn("heldout_label", held)
    return rounded(M.heldout_recall(pred, LABELS))


_FOLDS = """folds AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'no_raw_ports' ELSE 'with_raw_ports' END AS feature_set,
  concat('m', (l_suppkey % 3)::VARCHAR) AS model, CASE WHEN l_suppkey % 5 = 0 THEN 'normal' ELSE 'ddos' END AS heldout_label,
  l_suppkey AS grp, avg(l_discount) AS recall_heldout_label, avg(l_tax) AS f1_macro, avg((l_returnflag='N')::INT) AS accuracy
  FROM lineitem GROUP BY l_suppkey)"""


def folds(spark, sf):
    """A fold table: one row per supplier stands for one held-out scenario."""
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("grp")).agg(
        F.avg("l_discount").alias("recall_heldout_label"), F.avg("l_tax").alias("f1_macro"),
        F.avg((F.col("l_returnflag") == "N").cast("int")).alias("accuracy"),
    ).withColumns({
        "feature_set": F.when(F.col("grp") % 2 == 0, "no_raw_ports").otherwise("with_raw_ports"),
        "model": F.concat(F.lit("m"), (F.col("grp") % 3).cast("string")),
        "heldout_label": F.when(F.col("grp") % 5 == 0, "normal").otherwise("ddos")})


def _spread(c):
    return (f"round(avg({c}),6) AS {c}_mean, round(coalesce(stddev_samp({c}),0),6) AS {c}_std, "
            f"round(min({c}),6) AS {c}_min, round(max({c}),6) AS {c}_max")


@query("a17_multiclass_summary", f"""WITH {_FOLDS}
SELECT feature_set, model, heldout_label, count(*) AS n_scenarios, {_spread("recall_heldout_label")}, {_spread("f1_macro")},
  round(avg(accuracy),6) AS accuracy_mean FROM folds GROUP BY GROUPING SETS ((feature_set, model), (feature_set, model, heldout_label))""")
def a17(spark, sf):
    return rounded(M.multiclass_summary(folds(spark, sf)))


@query("a18_fold_spread", f"""WITH {_FOLDS} SELECT model, {", ".join(f"round(avg({c}),6) AS {c}_mean, round(stddev_samp({c}),6) AS {c}_std, count({c}) AS {c}_count" for c in ("accuracy", "f1_macro"))}
FROM folds GROUP BY 1""")
def a18(spark, sf):
    return rounded(M.fold_spread(folds(spark, sf), ["model"], ["accuracy", "f1_macro"]))


@query("a19_scenario_dispersion", f"""WITH {_FOLDS} SELECT model, count(*) AS n_scenarios,
  {", ".join(f"round(avg({c}),6) AS {c}_mean, round(stddev_pop({c}),6) AS {c}_std, round(min({c}),6) AS {c}_min, round(median({c}),6) AS {c}_median" for c in ("accuracy", "f1_macro"))}
FROM folds GROUP BY 1""")
def a19(spark, sf):
    rows = folds(spark, sf).withColumn("grp", F.col("grp").cast("string"))
    return rounded(M.scenario_dispersion(rows, ["accuracy", "f1_macro"]))


@query("a20_cluster_bootstrap")
def a20(spark, sf):
    rows = folds(spark, sf).withColumn("grp", F.col("grp").cast("string"))
    return M.bootstrap_interval(rows, ["accuracy", "f1_macro"])


@query("a21_exact_percentiles", """SELECT event_type, """ + ", ".join(
    f"round(quantile_cont(value, {p}),6) AS p{n}" for n, p in (("25", .25), ("50", .5), ("90", .9), ("95", .95), ("97", .97), ("99", .99)))
    + " FROM events GROUP BY 1")
def a21(spark, sf):
    probs = {"p25": 0.25, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p97": 0.97, "p99": 0.99}
    return rounded(exact_percentiles(V.table(spark, sf, "events"), ["event_type"], "value", probs))


@query("a21_exact_percentiles_large", """SELECT round(quantile_cont(l_extendedprice, 0.25),6) AS p25,
  round(quantile_cont(l_extendedprice, 0.5),6) AS p50, round(quantile_cont(l_extendedprice, 0.95),6) AS p95 FROM lineitem""")
def a21b(spark, sf):
    """A group far larger than the sketch: the bracket has to do the work."""
    rows = V.table(spark, sf, "lineitem")
    return rounded(exact_percentiles(rows, [], "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p95": 0.95}, accuracy=1000))


_SCORED = """s AS (SELECT grp, (y='A')::INT AS hit, score FROM predictions),
d AS (SELECT grp, score, sum(hit) AS pos, count(*)-sum(hit) AS neg FROM s GROUP BY 1,2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY grp) AS n_pos,
  sum(neg) OVER (PARTITION BY grp) AS n_neg FROM d WINDOW w AS (PARTITION BY grp ORDER BY score DESC))"""


def curve(spark, sf):
    rows = V.predictions(spark, sf).withColumn("hit", (F.col("y") == "A").cast("int"))
    return M.curve_points(rows, ["grp"], "score", "hit")


@query("a22_roc_points", f"""WITH {V.PREDICTION_SQL}, {_SCORED} SELECT grp, score, round(fp::DOUBLE/n_neg,6) AS fpr, round(tp::DOUBLE/n_pos,6) AS tpr FROM c""")
def a22(spark, sf):
    return rounded(M.roc_points(curve(spark, sf), ["grp"]))


@query("a23_pr_points", f"""WITH {V.PREDICTION_SQL}, {_SCORED} SELECT grp, score, round(tp::DOUBLE/(tp+fp),6) AS precision, round(tp::DOUBLE/n_pos,6) AS recall FROM c""")
def a23(spark, sf):
    return rounded(M.pr_points(curve(spark, sf), ["grp"]))


@query("a22_a23_areas", f"""WITH {V.PREDICTION_SQL}, {_SCORED} SELECT grp, round(sum(neg*(tp-pos/2.0::DOUBLE))/any_value(n_pos*n_neg),6) AS roc_auc,
  round(sum(pos*tp::DOUBLE/(tp+fp))/any_value(n_pos),6) AS average_precision FROM c GROUP BY 1""")
def areas(spark, sf):
    return rounded(M.curve_areas(curve(spark, sf), ["grp"]))


@query("a22_one_vs_rest_auc", f"""WITH {V.PREDICTION_SQL}, l AS (SELECT grp, k.cls, (y=k.cls)::INT AS hit,
   CASE k.cls WHEN 'A' THEN -score WHEN 'N' THEN -abs(score-25) ELSE score END AS score FROM predictions, (SELECT unnest(['A','N','R']) AS cls) k),
d AS (SELECT grp, cls, score, sum(hit) AS pos, count(*)-sum(hit) AS neg FROM l GROUP BY 1,2,3),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY grp,cls) AS n_pos,
  sum(neg) OVER (PARTITION BY grp,cls) AS n_neg FROM d WINDOW w AS (PARTITION BY grp,cls ORDER BY score DESC)),
a AS (SELECT grp, cls, sum(neg*(tp-pos/2.0::DOUBLE))/any_value(n_pos*n_neg) AS auc FROM c GROUP BY 1,2)
SELECT grp, round(avg(auc),6) AS roc_auc_ovr FROM a GROUP BY 1""")
def ovr(spark, sf):
    s = F.col("score")
    rows = V.predictions(spark, sf).withColumns({"sA": -s, "sN": -F.abs(s - 25), "sR": s})
    return rounded(M.one_vs_rest_auc(rows, ["grp"], LABELS, {"A": "sA", "N": "sN", "R": "sR"}))


@query("a24_score_histogram", """WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY 1)
SELECT e.event_type, least(floor((value-lo)/(hi-lo)*50),49)::INT AS bin, count(*) AS n,
  round(count(*)/(any_value(r.n)*(any_value(hi)-any_value(lo))/50),6) AS density FROM events e JOIN r USING (event_type) GROUP BY 1,2""")
def a24(spark, sf):
    return rounded(M.score_histogram(V.table(spark, sf, "events"), ["event_type"], "value"))


@query("a27_readiness", f"""WITH {V.FEATURE_SQL} SELECT count(*) AS n_rows, count(DISTINCT run_id) AS n_groups, count(DISTINCT label) AS n_labels,
  CASE WHEN count(DISTINCT run_id) < 3 THEN 'insufficient_groups' WHEN count(DISTINCT label) < 2 THEN 'insufficient_labels' ELSE 'ok' END AS status FROM clean""")
def a27(spark, sf):
    from pollwarden.catalog.telemetry import clean
    from pollwarden.operators.splits import readiness

    return readiness(clean(spark, sf))


@query("d24_model_comparison", f"""WITH {V.PREDICTION_SQL}, {_GRID}, pc AS (SELECT l.label,
  2*sum((q.y=l.label AND q.p=l.label)::INT)::DOUBLE/nullif(sum((q.y=l.label)::INT)+sum((q.p=l.label)::INT),0) AS f1
  FROM predictions q JOIN lab l ON true GROUP BY 1),
b AS (SELECT {_CELLS} FROM (SELECT (y='A')::INT AS y, (p='A')::INT AS p FROM predictions))
SELECT 'rule' AS model, round((SELECT avg((y=p)::INT) FROM predictions),6) AS accuracy, round((SELECT avg(f1) FROM pc),6) AS f1, 'multiclass_macro' AS metric_scope
UNION ALL SELECT 'rule', round((tp+tn)::DOUBLE/(tp+tn+fp+fn),6), round(2*tp::DOUBLE/(2*tp+fp+fn),6), 'anomaly_class' FROM b""")
def d24(spark, sf):
    pred = V.predictions(spark, sf)
    counts = M.confusion_counts(pred, ["model"])
    macro = M.accuracy(counts, ["model"]).join(M.averages(M.per_class(counts, ["model"], LABELS), ["model"]), "model")
    binary = pred.withColumns({"y": (F.col("y") == "A").cast("int"), "p": (F.col("p") == "A").cast("int")})
    anomaly = M.binary_report(M.confusion_counts(binary, ["model"]), ["model"])
    return rounded(M.comparison_table([
        (macro.select("model", "accuracy", F.col("f1_macro").alias("f1")), "multiclass_macro"),
        (anomaly.select("model", "accuracy", F.col("f1_anomaly").alias("f1")), "anomaly_class")]))
