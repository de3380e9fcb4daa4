"""The jobs end to end with small models, and the file readers on files written here."""

import json

import pytest
from pyspark.sql import functions as F

from pollwarden import schemas
from pollwarden.catalog import views as V
from pollwarden.functions.features import flow_features
from pollwarden.operators.splits import leave_one_group_out
from pollwarden.plans import jobs as J
from pollwarden.sources import readers as R
from pollwarden.sources import sinks as K

TINY = J.Effort(trees=4, depth=4, rounds=2, epochs=1, iterations=10)


@pytest.fixture(scope="module")
def polls(spark, sf):
    rows = flow_features(V.flow_polls(spark, sf)).withColumn("source", F.lit(""))
    # One attack and two normal scenarios keep the fold loops short.
    twin = F.when(F.col("label") == "normal", F.col("flow_id") % 2).otherwise(0).cast("string")
    return rows.where("label <> 'portscan' OR flow_id % 2 = 0").withColumn("scenario_id", F.concat_ws("_", "label", twin)).withColumn(
        "run_id", F.concat(F.lit("run_"), (F.col("flow_id") % 4).cast("string"))).persist()


def test_binary_loso(polls):
    out = J.evaluate_binary_loso(polls, models=["RandomForest", "LinearSVC"], effort=TINY)
    assert out["per_scenario"].count() == 8
    assert {r["model"] for r in out["summary"].collect()} == {"RandomForest", "LinearSVC"}
    assert out["predictions"].groupBy("model", "row_id").count().where("count > 1").count() == 0
    old = out["summary"].withColumn("n_scenarios", F.lit(99).cast("long"))
    again = J.evaluate_binary_loso(polls, models=["Autoencoder", "RandomForest"], skip_autoencoder=True, append_to=old, effort=TINY)
    assert {r["model"]: r["n_scenarios"] for r in again["summary"].collect()} == {"RandomForest": 4, "LinearSVC": 99}


def test_multiclass_loso_caps_macro_f1(polls):
    effort = J.Effort(trees=3, depth=3, extra={"models": ["RandomForest"]})
    out = J.evaluate_multiclass_loso(polls, "behavior_window", effort=effort)
    rows = out["per_scenario"].collect()
    assert len(rows) == 4 and all(r["f1_macro"] <= 1 / 3 + 1e-12 for r in rows)
    assert out["summary"].count() == 4 and out["inventory"].count() == 4


def test_grouped_refuses_and_runs(polls):
    refused = J.evaluate_grouped(polls.withColumn("run_id", F.lit("r1")), effort=TINY)
    assert list(refused) == ["status"] and refused["status"].first()["status"] == "insufficient_groups"
    one = J.evaluate_grouped(polls.where("label = 'normal'"), effort=TINY)
    assert one["status"].first()["status"] == "insufficient_labels"
    effort = J.Effort(trees=3, depth=3, extra={"models": ["RandomForest"], "unsupervised": False})
    out = J.evaluate_grouped(polls, with_smote_train=True, effort=effort)
    assert out["per_fold"].count() == 4 and out["summary"].first()["accuracy_count"] == 4


def test_fault_evaluation(spark, sf):
    rows = V.fault_samples(spark, sf).withColumnRenamed("p_ts", "timestamp").withColumn("row_id", F.col("probe_id"))
    with pytest.raises(ValueError):
        J.evaluate_fault(rows.where("scenario_id IN ('sc_0', 'sc_1')"))
    effort = J.Effort(trees=3, depth=3, rounds=2, epochs=1, extra={"models": ["random_forest", "rule_based"], "fault_depth": 3})
    out = J.evaluate_fault(rows.where("scenario_id < 'sc_4'"), effort=effort)
    assert out["prefix"] == "fault_protocol"
    table = out["four_class_loso"]
    assert table.where("note IS NOT NULL").count() == 2 and table.where("model = 'rule_based'").count() == 5
    assert out["binary_confusion"].count() == 8 and out["binary_dispersion"].count() == 2
    with pytest.raises(RuntimeError):
        schemas.assert_no_leak([*schemas.FAULT_FEATURES, "scenario_id"])


def test_merge_fault_runs_from_files(spark, tmp_path):
    run = tmp_path / "fault_a"
    run.mkdir()
    quiet = tmp_path / "fault_b"
    quiet.mkdir()
    for folder, name in ((run, "a"), (quiet, "b")):
        meta = {"run_id": name, "scenario_id": f"s_{name}", "fault_label": "x", "fault_family": "loss", "fault_severity": "high",
                "protocol": "e", "s1_core_port": 3, "s2_core_port": 4, "configured_loss": 5}
        (folder / "meta.json").write_text(json.dumps(meta))
        (folder / "probes.csv").write_text("timestamp,rtt_min_ms,rtt_mean_ms,rtt_max_ms,probe_loss_pct,throughput_mbps,jitter_ms,udp_lost_pct\n"
                                           "2024-01-01 00:00:08,1,2,3,0,9.5,,\n2024-01-01 00:00:08,1,5,3,0,9.5,,\n")
    head = ",".join(f.name for f in schemas.FAULT_FLOW_POLL.fields)
    body = "\n".join(f"2024-01-01 00:00:{s:02d},1,10.0.0.1,10.0.0.5,{p},1,2,10,100,5,10,{d},50,{d},10,5,{h}"
                     for s, p, d, h in ((5, 6, 0, 0), (10, 6, 4, 1), (10, 17, 6, 1), (12, 6, 1, 1)))
    (run / "flows.csv").write_text(head + "\n" + body + "\n")
    (quiet / "flows.csv").write_text("")
    ports = ",".join(f.name for f in schemas.PORT_POLL.fields)
    zeros = ",".join("0" for _ in range(8))
    (run / "ports.csv").write_text(ports + f"\n2024-01-01 00:00:11,1,3,{zeros},{zeros},80,20,0.5,5,1\n2024-01-01 00:00:11,1,9,{zeros},{zeros},999,20,0.5,5,1\n")
    (quiet / "ports.csv").write_text(ports + "\n")
    tables = R.read_fault_runs(spark, str(tmp_path), "e")
    out = {(r["run_id"], r["timestamp"].second): r for r in J.merge_fault_runs(**tables, protocol="e").collect()}
    assert set(out) == {("a", 10), ("a", 12), ("b", 8)}
    first = out[("a", 10)]
    assert (first["n_flows"], first["delta_packet_sum"], first["tcp_share"], first["core_bps"], first["rtt_mean_ms"]) == (2, 10.0, 0.4, 100.0, 5.0)
    assert out[("a", 12)]["udp_delta_packet_sum"] == 6.0  # borrowed from two seconds before
    assert out[("b", 8)]["n_flows"] == 0 and out[("b", 8)]["core_bps"] is None and out[("b", 8)]["rtt_mean_ms"] == 5.0
    assert set(schemas.FAULT_FEATURES) <= set(first.asDict())
    assert R.read_fault_runs(spark, str(tmp_path), "d")["meta"].count() == 0


def test_run_folder_and_logs(spark, tmp_path):
    head = ",".join(f.name for f in schemas.FLOW_POLL.fields)

    def line(run):
        return f"2024-01-01 00:00:05,1,7,10.0.0.1,10.0.0.2,6,1,2,3,4,5,6,0.5,0.5,1.5,5.0,ddos,0,,{run},s,c,t,h,tcp,1,,10.0.0.2,x"

    (tmp_path / "run_1.csv").write_text(head + "\n" + line("r1") + "\n" + line("") + "\n")
    (tmp_path / "run_2.csv").write_text(head + "\n")
    (tmp_path / "run_3.csv").write_text(head + "\n" + line("r3") + "\n" + line("run_normal_massive_9") + "\n")
    (tmp_path / "run_normal_massive_4.csv").write_text(head + "\n" + line("r4") + "\n")
    (tmp_path / "other.csv").write_text("junk\n")
    rows = J.merge_runs(R.read_run_folder(spark, str(tmp_path)))
    assert sorted((r["run_id"], r["attacker_count"], r["source"]) for r in rows.collect()) == [
        ("r1", -1, schemas.SOURCE_INDEPENDENT), ("unknown", -1, schemas.SOURCE_INDEPENDENT)]
    empty = R.read_polls(spark, str(tmp_path / "run_2.csv"))
    assert empty.count() == 0 and dict(empty.dtypes)["packet_count"] == "bigint"
    log = {"run_id": "r9", "scenario_id": "ddos_x", "start_time": "2024-01-01 00:00:00", "end_time": "2024-01-01 00:00:01",
           "commands": [["h4", "hping3 -S 10.0.0.2 -p 80 &"], ["h5", "hping3 10.0.0.3; 10.0.0.2"]]}
    (tmp_path / "run_9.json").write_text(json.dumps(log))
    logs = R.read_run_logs(spark, str(tmp_path))
    assert sorted(logs.first()["targets"]) == ["10.0.0.2", "10.0.0.3"]
    flows = R.read_polls(spark, str(tmp_path / "run_1.csv"))
    found = J.recover_runs(flows, logs, ["10.0.0.1"]).collect()
    assert len(found) == 2 and {r["run_id"] for r in found} == {"r9"}  # 5 s is inside the 15 s grace
    assert J.recover_runs(flows, logs, ["10.0.0.1"], only=["zz"]).count() == 0


def test_unheaded_polls_and_intervals(spark, tmp_path):
    body = "2024-01-01 00:00:05,1,7,10.0.0.1,10.0.0.2,6,1,2,3,4,5,6,0.5,0.5,1.5,5.0,ddos\n"
    (tmp_path / "bare.csv").write_text(body)
    (tmp_path / "headed.csv").write_text(",".join(schemas.BASE_COLUMNS[:17]) + "\n" + body)
    for name in ("bare.csv", "headed.csv"):
        rows = R.read_unheaded_polls(spark, str(tmp_path / name)).collect()
        assert len(rows) == 1 and rows[0]["label"] == "ddos" and rows[0]["packet_count"] == 3
    (tmp_path / "labels.csv").write_text("start_time,end_time,label\n2024-01-01 00:00:00,2024-01-01 00:00:09,a\n2024-01-01 00:00:05,2024-01-01 00:00:06,b\n")
    assert [r["label"] for r in R.read_intervals(spark, str(tmp_path / "labels.csv")).orderBy("idx").collect()] == ["a", "b"]


def test_files_with_another_header_fail(spark, tmp_path):
    (tmp_path / "run_1.csv").write_text("timestamp,label,packet_count\n2024-01-01 00:00:00,ddos,5\n")
    (tmp_path / "run_2.csv").write_text("timestamp,label,packet_count\n2024-01-01 00:00:05,normal,6\n")
    assert {(r["label"], r["packet_count"]) for r in R.read_polls(spark, str(tmp_path)).collect()} == {("ddos", 5), ("normal", 6)}
    (tmp_path / "run_3.csv").write_text("label,packet_count,timestamp\nddos,7,2024-01-01 00:00:00\n")
    with pytest.raises(Exception, match="(?i)header"):
        R.read_polls(spark, str(tmp_path)).collect()


def test_interval_priority_follows_file_names_and_lines(spark, tmp_path):
    """The larger file is read first by Spark; names and lines still give the order."""
    line = "2024-01-01 00:00:00,2024-01-01 00:00:09,"
    (tmp_path / "b.csv").write_text("start_time,end_time,label\n" + "".join(f"{line}b{i}\n" for i in range(50)))
    (tmp_path / "a.csv").write_text(f"start_time,end_time,label\n{line}a0\n{line}a1\n")
    got = R.read_intervals(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r["label"] for r in got] == ["a0", "a1", *(f"b{i}" for i in range(50))] and [r["idx"] for r in got] == list(range(52))


def test_public_import_and_benchmark(spark, sf, tmp_path):
    from pollwarden.catalog.cleaning import public_flows

    path = str(tmp_path / "day.parquet")
    public_flows(spark, sf).drop("l_orderkey", "l_linenumber").write.parquet(path)
    parts = J.import_public_3class(spark, {"day": path}, smote=True)
    sizes = {r["label"]: r["count"] for r in parts["train"].groupBy("label").count().collect()}
    assert len(set(sizes.values())) == 1 and len(sizes) == 3
    table = J.run_public_benchmark(parts["train_raw"], parts["test"], schemas.LABELS, 200, 200, effort=TINY)
    scopes = {(r["model"], r["metric_scope"]) for r in table.collect()}
    assert scopes == {("RandomForest", "multiclass_macro"), ("XGBoost", "multiclass_macro"),
                      ("IsolationForest", "anomaly_class"), ("Autoencoder", "anomaly_class")}


def test_final_fit_contract_and_pipeline_model(polls, spark, tmp_path):
    out = J.fit_final_model(polls, effort=TINY)
    manifest = out["manifest"].first()
    assert manifest["features"] == schemas.PORT_FREE_FEATURES and "accuracy" not in manifest.asDict()
    ok = J.check_scoring_input(polls, out["manifest"]).first()
    assert ok["ok"] and ok["missing_columns"] == ""
    broken = J.check_scoring_input(polls.drop("byte_count"), out["manifest"]).first()
    assert not broken["ok"] and broken["missing_columns"] == "byte_count"
    out["model"].write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(str(tmp_path / "m")).transform(polls)
    assert again.where("prediction IS NULL").count() == 0


def test_overlap_audit(polls):
    rows = J.audit_overlap(grouped=polls, k=3).collect()
    assert len(rows) == 3 and sum(r["n_test"] for r in rows) == polls.where("is_synthetic = 0").count()
    single = J.audit_overlap(polls, polls).first()
    assert single["overlap_rate_of_test"] == 1.0


def test_run_pipeline_smoke(polls):
    out = J.run_pipeline(polls, smoke=True, bootstrap=30, effort=TINY)
    assert not [k for k in out if k.endswith("_error")]
    assert {r["method"] for r in out["baselines"].collect()} == {"static", "multi_rule", "z_score"}
    assert {"split", "train", "report", "class_counts"} <= set(out)


def test_no_group_in_both_sides(polls):
    folds = leave_one_group_out(polls, "scenario_id")
    assert [r["fold"] for r in folds.orderBy("scenario_id").collect()] == [0, 1, 2, 3]


def test_report_writes_and_digests(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "model string, v int")
    K.write_report(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    assert K.table_digest(df).first() == K.table_digest(df.orderBy("v").repartition(3)).first()
    assert K.table_digest(df).first() != K.table_digest(df.limit(1)).first()
    K.write_split(df.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'train'").count() == 2
    assert K.file_digests(spark, str(tmp_path / "s" / "split=train")).count() >= 1
