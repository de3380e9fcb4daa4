"""Edge frames of the operators' rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pollwarden import schemas
from pollwarden.functions import features as X
from pollwarden.functions.probetext import iperf_values, ping_values
from pollwarden.operators import cleaning as C
from pollwarden.operators import metrics as M
from pollwarden.operators import rules as R
from pollwarden.operators import splits as S
from pollwarden.operators import telemetry as T

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def test_flow_features(spark):
    df = spark.createDataFrame([(100, 8000, 5, 0), (0, 0, 0, 0)], "packet_count long, byte_count long, duration_sec long, duration_nsec long")
    rows = X.flow_features(df).collect()
    assert (rows[0]["packet_count_per_sec"], rows[0]["byte_count_per_sec"], rows[0]["packet_size_avg"]) == (20.0, 1600.0, 80.0)
    assert (rows[1]["packet_count_per_sec"], rows[1]["byte_count_per_sec"], rows[1]["packet_size_avg"], rows[1]["flow_duration"]) == (0, 0, 0, 0)


def test_feature_sets_and_leak_guard():
    assert len(schemas.feature_columns("with_raw_ports")) == 10
    assert len(schemas.feature_columns("no_raw_ports")) == 8
    assert len(schemas.FAULT_FEATURES) == 31
    schemas.assert_no_leak(schemas.FAULT_FEATURES)
    with pytest.raises(RuntimeError):
        schemas.assert_no_leak(["rtt_mean_ms", "fault_label"])
    with pytest.raises(ValueError):
        schemas.feature_columns("other")


def test_required_columns(spark):
    with pytest.raises(ValueError):
        schemas.require_columns(spark.range(1), ["timestamp"])
    with pytest.raises(ValueError):
        T.early_polls(spark.range(1), 0)


def test_median_uses_train_only_and_keeps_empty_columns(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    test = spark.createDataFrame([(None, None)], "a double, b double")
    row = R.impute(test, R.median_fills(train, ["a", "b"]), ["a", "b"]).first()
    assert (row["a"], row["b"]) == (2.0, 0.0)


def test_normal_only_median(spark):
    df = spark.createDataFrame([(1.0, "normal"), (3.0, "normal"), (100.0, "fault")], "a double, label string")
    assert R.median_fills(R.normal_rows(df), ["a"]).first()["a_fill"] == 2.0
    with pytest.raises(RuntimeError):
        R.normal_rows(df.where("label = 'fault'"))


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = R.scale(df, R.scaler_stats(df, ["a", "b"]), ["a", "b"]).collect()
    assert sorted(r["a"] for r in rows) == [-1.0, 1.0] and {r["b"] for r in rows} == {0.0}


def test_flow_delta_reset(spark):
    rows = [(i, at(5 * i), 1, "a", "b", 6, 1, 2, p, p * 10) for i, p in enumerate([10, 15, 4, 9])]
    df = spark.createDataFrame(rows, "flow_id long, timestamp timestamp_ntz, datapath_id int, ip_src string, ip_dst string, ip_proto int, "
                                     "tp_src int, tp_dst int, packet_count long, byte_count long")
    out = T.flow_deltas(df, chunk_seconds=5).orderBy("flow_id").collect()
    assert [r["has_delta"] for r in out] == [0, 1, 0, 1]
    assert [r["delta_packet"] for r in out] == [0, 5, 0, 5]
    assert [r["packet_rate_window"] for r in out] == [0, 1.0, 0, 1.0]


def test_port_delta_clamps_each_counter(spark):
    cols = ", ".join(f"{c} long" for c in schemas.PORT_COUNTERS)
    rows = [(i, at(5 * i), 1, 1, *[v if c == "rx_packets" else 7 * i for c in schemas.PORT_COUNTERS]) for i, v in enumerate([10, 4, 9])]
    out = T.port_deltas(spark.createDataFrame(rows, f"row_id long, timestamp timestamp_ntz, datapath_id int, port_no int, {cols}")).orderBy("row_id").collect()
    assert [r["has_delta"] for r in out] == [0, 1, 1]
    assert [r["delta_rx_packets"] for r in out] == [0, 0, 5]
    assert [r["rx_bps"] for r in out] == [0.0, 8 * 7 / 5, 8 * 7 / 5]


def test_last_poll_prefers_unreadable_time(spark):
    df = spark.createDataFrame([(1, "k", at(1)), (2, "k", None), (3, "k", at(2))], "flow_id long, run_id string, timestamp timestamp_ntz")
    assert T.last_polls(df, ["run_id"]).first()["flow_id"] == 2


def test_behaviour_windows_match_null_sources(spark):
    df = spark.createDataFrame([("r", at(0), None, "x", 1, 1), ("r", at(0), None, "y", 1, None)],
                               "run_id string, timestamp timestamp_ntz, ip_src string, ip_dst string, tp_dst int, flow_id long")
    rows = T.behaviour_windows(df).collect()
    assert len(rows) == 2 and {(r["win_unique_dst_ips"], r["win_unique_dst_ports"], r["win_flow_count"]) for r in rows} == {(2, 1, 1)}


def test_macro_f1_depends_on_the_label_set(spark):
    df = spark.createDataFrame([("normal", "normal"), ("normal", "normal"), ("normal", "ddos")], "y string, p string").withColumn("g", F.lit(1))
    counts = M.confusion_counts(df, ["g"])
    everything = M.averages(M.per_class(counts, ["g"], schemas.LABELS), ["g"]).first()["f1_macro"]
    seen = M.averages(M.per_class(counts, ["g"]), ["g"]).first()["f1_macro"]
    assert everything == pytest.approx(0.8 / 3) and seen == pytest.approx(0.4)


def test_average_precision_is_the_step_sum(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, score double").withColumn("g", F.lit(1))
    row = M.curve_areas(M.curve_points(df, ["g"]), ["g"]).first()
    assert row["average_precision"] == pytest.approx(0.8333, abs=1e-4) and row["roc_auc"] == pytest.approx(0.75)


def test_best_setting_first_wins(spark):
    df = spark.createDataFrame([(0, 10.0, 0.5), (1, 20.0, 0.9), (2, 30.0, 0.9)], "idx int, threshold double, accuracy double")
    assert M.best_setting(df, "accuracy").first()["threshold"] == 20.0


def test_fault_rule_precedence(spark):
    limits = spark.createDataFrame([(2.0, 3.0, 20.0, 1.0)], "lim_loss double, lim_uloss double, lim_rtt double, lim_thr double")
    rows = [(1, 9.0, None, 99.0, 0.1), (2, None, None, 99.0, 0.1), (3, None, None, None, 0.1), (4, None, None, None, None), (5, None, 3.0, None, 5.0)]
    df = spark.createDataFrame(rows, "id int, probe_loss_pct double, udp_lost_pct double, rtt_mean_ms double, throughput_mbps double")
    got = {r["id"]: r["p"] for r in R.fault_rule(df, limits, []).collect()}
    assert got == {1: "loss", 2: "delay", 3: "bandwidth", 4: "normal", 5: "loss"}


def test_rule_thresholds_without_throughput_or_normals(spark):
    df = spark.createDataFrame([(1.0, None, 4.0, None, "loss")] * 4, "probe_loss_pct double, udp_lost_pct double, rtt_mean_ms double, throughput_mbps double, fault_family string")
    row = R.fault_rule_thresholds(df, []).first()
    assert (row["lim_loss"], row["lim_uloss"], row["lim_rtt"], row["lim_thr"]) == (2.0, 3.0, 20.0, 1.0)


def test_iperf_lines(spark):
    tcp = "20240101,10.0.0.1,5001,10.0.0.4,40000,3,0.0-5.0,1000,9400000"
    cases = {
        "tcp": (tcp, (9.4, None, None)),
        "udp13": (tcp + ",0.25,1,100,1.5%", (9.4, 0.25, 1.5)),
        "udp12": (tcp + ",0.25,5,100", (9.4, 0.25, 5.0)),
        "junk_last": (tcp + "\nnot,a,line\n1,2,3,4,5,6,7,8,x", (9.4, None, None)),
        "later_line": (tcp + ",0.25,1,100,bad%\n" + tcp + ",0.5,2,100,", (9.4, 0.5, 2.0)),
        "empty": ("", (None, None, None)), "null": (None, (None, None, None)),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, t string")
    for r in df.select("k", iperf_values(F.col("t")).alias("v")).collect():
        assert tuple(r["v"]) == cases[r["k"]][1], r["k"]


def test_ping_text(spark):
    text = "4 packets transmitted, 3 received, 25% packet loss, time 3ms\nrtt min/avg/max/mdev = 0.1/0.2/0.4/0.05 ms"
    df = spark.createDataFrame([(text,), ("no answer",)], "t string").select(ping_values(F.col("t")).alias("v"))
    assert [tuple(r["v"]) for r in df.collect()] == [(0.1, 0.2, 0.4, 25.0), (None,) * 4]


def test_split_falls_back_when_a_class_has_one_row(spark):
    rows = [(i, "a") for i in range(20)] + [(99, "b")]
    out = S.stratified_split(spark.createDataFrame(rows, "id long, label string"), "label", "id").collect()
    assert {r["split_note"] for r in out} == {"unstratified"} and sum(r["split"] == "test" for r in out) == 4
    one = S.stratified_split(spark.createDataFrame([(1, "a")], "id long, label string"), "label", "id").collect()
    assert one[0]["split"] == "train"


def test_split_is_repeatable_and_disjoint(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    a = {(r["event_id"], r["split"]) for r in S.stratified_split(df, "event_type", "event_id").collect()}
    b = {(r["event_id"], r["split"]) for r in S.stratified_split(df.repartition(7), "event_type", "event_id").collect()}
    assert a == b and len(a) == df.count()


def test_choose_splitter():
    assert S.choose_splitter(2)[0] is None
    assert S.choose_splitter(5)[0] == "leave_one_out" and S.choose_splitter(6)[0] == "group_kfold"


def test_core_ports_without_ids_keep_everything(spark):
    ports = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "run_id string, port_no int")
    meta = spark.createDataFrame([("a", 1, 9), ("b", None, 1)], "run_id string, s1_core_port int, s2_core_port int")
    assert sorted(map(tuple, C.core_ports(ports, meta).collect())) == [("a", 1), ("b", 1), ("b", 2)]


def test_overlap_report_counts_copies(spark):
    train = spark.createDataFrame([(1, 1), (2, 2)], "a int, b int")
    test = spark.createDataFrame([(1, 1), (1, 1), (3, 3), (None, 1)], "a int, b int")
    row = S.overlap_report(test, train, ["a", "b"]).first()
    assert (row["n_test"], row["n_overlap_fingerprints"], row["n_test_rows_in_overlap"]) == (4, 1, 2)


def test_upsert_and_patch(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "model string, v int")
    new = spark.createDataFrame([("b", 9, "x")], "model string, v int, note string")
    assert sorted(map(tuple, M.upsert(old, new).collect()), key=str) == [("a", 1, None), ("b", 9, "x")]
    assert sorted(map(tuple, M.patch(old, new, "model", ["v"]).collect())) == [("a", 1), ("b", 9)]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("g", 2.0)] * 3, "g string, score double")
    rows = M.score_histogram(df, ["g"]).collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(25, 3)] and rows[0]["density"] == pytest.approx(50.0)


def test_bootstrap_interval_covers_the_mean_and_repeats(spark):
    rows = [("m", f"s{i}", i / 20, 0.5) for i in range(20)] + [("m", M.POOLED, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "model string, grp string, accuracy double, f1_macro double")
    a, b = (M.bootstrap_interval(df, ["accuracy", "f1_macro"], 200).first() for _ in range(2))
    assert a == b and a["accuracy_ci95_low"] < 0.475 < a["accuracy_ci95_high"] and a["f1_macro_ci95_low"] == 0.5
