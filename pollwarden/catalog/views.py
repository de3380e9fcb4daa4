"""Flow-telemetry views over the supplied test tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "ts AS timestamp",
        "CAST(1 + user_id % 2 AS INT) AS datapath_id",
        "event_id AS flow_id",
        "concat('10.0.0.', CAST(user_id % 25 AS STRING)) AS ip_src",
        "concat('10.0.1.', CAST(user_id % 3 AS STRING)) AS ip_dst",
        "CAST(CASE user_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS INT) AS ip_proto",
        "CAST(CASE WHEN user_id % 3 = 2 THEN 0 ELSE 1024 + user_id % 5 END AS INT) AS tp_src",
        "CAST(CASE WHEN user_id % 3 = 2 THEN 0 ELSE 80 + event_id % 2 END AS INT) AS tp_dst",
        "CAST(floor(value * 10) * CASE WHEN event_id % 11 = 0 THEN 1000 ELSE 1 END AS BIGINT) AS packet_count",
        "CAST(CASE WHEN event_id % 13 = 0 THEN event_id % 250 ELSE floor(value * 10) * 64 + event_id % 1000 END AS BIGINT) AS byte_count",
        "CAST(event_id % 60 AS BIGINT) AS duration_sec",
        "CAST((event_id % 1000) * 1000000 AS BIGINT) AS duration_nsec",
        "CASE event_type WHEN 'error' THEN 'ddos' WHEN 'signup' THEN 'portscan' ELSE 'normal' END AS label",
        "CAST(CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS INT) AS is_synthetic",
        "CASE WHEN event_id % 97 = 0 THEN 'unknown' ELSE concat('run_', CAST(day(ts) AS STRING)) END AS run_id",
        "concat(event_type, '_', CAST(user_id % 4 AS STRING)) AS scenario_id",
    )


FLOW_SQL = """flow_polls AS (SELECT ts AS timestamp,
  CAST(1 + user_id % 2 AS INT) AS datapath_id, event_id AS flow_id,
  concat('10.0.0.', CAST(user_id % 25 AS VARCHAR)) AS ip_src,
  concat('10.0.1.', CAST(user_id % 3 AS VARCHAR)) AS ip_dst,
  CAST(CASE user_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS INT) AS ip_proto,
  CAST(CASE WHEN user_id % 3 = 2 THEN 0 ELSE 1024 + user_id % 5 END AS INT) AS tp_src,
  CAST(CASE WHEN user_id % 3 = 2 THEN 0 ELSE 80 + event_id % 2 END AS INT) AS tp_dst,
  CAST(floor(value * 10) * CASE WHEN event_id % 11 = 0 THEN 1000 ELSE 1 END AS BIGINT) AS packet_count,
  CAST(CASE WHEN event_id % 13 = 0 THEN event_id % 250 ELSE floor(value * 10) * 64 + event_id % 1000 END AS BIGINT) AS byte_count,
  CAST(event_id % 60 AS BIGINT) AS duration_sec,
  CAST((event_id % 1000) * 1000000 AS BIGINT) AS duration_nsec,
  CASE event_type WHEN 'error' THEN 'ddos' WHEN 'signup' THEN 'portscan' ELSE 'normal' END AS label,
  CAST(CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS INT) AS is_synthetic,
  CASE WHEN event_id % 97 = 0 THEN 'unknown' ELSE concat('run_', CAST(day(ts) AS VARCHAR)) END AS run_id,
  concat(event_type, '_', CAST(user_id % 4 AS VARCHAR)) AS scenario_id FROM events)"""

FEATURE_SQL = FLOW_SQL + """,
features AS (SELECT * EXCLUDE (dur), dur AS flow_duration,
  CASE WHEN dur > 0 THEN packet_count / dur ELSE 0.0::DOUBLE END AS packet_count_per_sec,
  CASE WHEN dur > 0 THEN byte_count / dur ELSE 0.0::DOUBLE END AS byte_count_per_sec,
  CASE WHEN packet_count > 0 THEN byte_count::DOUBLE / packet_count ELSE 0.0::DOUBLE END AS packet_size_avg
  FROM (SELECT *, duration_sec + duration_nsec / 1e9::DOUBLE AS dur FROM flow_polls)),
clean AS (SELECT * FROM features WHERE is_synthetic = 0
  AND run_id NOT IN ('unknown','nan','','None','legacy_unknown')
  AND scenario_id NOT IN ('unknown','nan','','None','legacy_unknown'))"""

EARLY_SQL = FEATURE_SQL + """,
early AS (SELECT *, rn - 1 AS poll_index,
    epoch_us(timestamp) - min(epoch_us(timestamp)) OVER (PARTITION BY run_id) AS age_us FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, datapath_id, ip_src, ip_dst, ip_proto, tp_src, tp_dst
    ORDER BY timestamp, flow_id) AS rn FROM clean) WHERE rn <= 3)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'view'").selectExpr(
        "concat('run_', CAST(day(ts) AS STRING)) AS run_id", "ts AS p_ts", "event_id AS probe_id",
        "value AS rtt_mean_ms", "CAST(event_id % 21 AS DOUBLE) AS probe_loss_pct",
        "value / 10 AS throughput_mbps",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 13 AS DOUBLE) END AS udp_lost_pct",
        "value * 0.5 AS rtt_min_ms", "value * 2 AS rtt_max_ms",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 100 END AS jitter_ms",
    )


PROBE_SQL = """probes AS (SELECT concat('run_', CAST(day(ts) AS VARCHAR)) AS run_id, ts AS p_ts, event_id AS probe_id,
  value AS rtt_mean_ms, CAST(event_id % 21 AS DOUBLE) AS probe_loss_pct, value / 10 AS throughput_mbps,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 13 AS DOUBLE) END AS udp_lost_pct,
  value * 0.5::DOUBLE AS rtt_min_ms, value * 2 AS rtt_max_ms,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 100 END AS jitter_ms
  FROM events WHERE event_type = 'view')"""

_INTERVAL_ROWS = """(0, {k} '2024-01-02 00:00:00', {k} '2024-01-05 00:00:00', 'ddos'),
  (1, {k} '2024-01-04 12:00:00', {k} '2024-01-06 00:00:00', 'portscan'),
  (2, {k} '2024-01-20 00:00:00', {k} '2024-01-21 00:00:00', 'ddos')"""


def label_intervals(spark: SparkSession) -> DataFrame:
    rows = _INTERVAL_ROWS.format(k="TIMESTAMP_NTZ")
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t(idx, start_time, end_time, label)")


INTERVAL_SQL = f"""label_intervals AS (SELECT * FROM (VALUES {_INTERVAL_ROWS.format(k="TIMESTAMP")})
  AS t(idx, start_time, end_time, label))"""


def port_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Port counters: a daily-restarting cumulative one, and some that fall at every second poll."""
    return table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr(
        "ts AS timestamp", "concat('run_', CAST(day(ts) AS STRING)) AS run_id",
        "CAST(1 + user_id % 2 AS INT) AS datapath_id", "CAST(1 + user_id % 4 AS INT) AS port_no",
        "event_id AS row_id",
        "CAST(event_id * 50 + floor(value * 10) AS BIGINT) AS rx_packets",
        "CAST(floor(value * 10) AS BIGINT) AS tx_packets",
        "CAST(event_id * 3200 + floor(value * 640) AS BIGINT) AS rx_bytes",
        "CAST(floor(value * 640) AS BIGINT) AS tx_bytes",
        "CAST(event_id % 5 AS BIGINT) AS rx_dropped", "CAST(event_id % 3 AS BIGINT) AS tx_dropped",
        "CAST(event_id % 2 AS BIGINT) AS rx_errors", "CAST(0 AS BIGINT) AS tx_errors",
    )


PORT_SQL = """port_polls AS (SELECT ts AS timestamp, concat('run_', CAST(day(ts) AS VARCHAR)) AS run_id,
  CAST(1 + user_id % 2 AS INT) AS datapath_id, CAST(1 + user_id % 4 AS INT) AS port_no, event_id AS row_id,
  CAST(event_id * 50 + floor(value * 10) AS BIGINT) AS rx_packets,
  CAST(floor(value * 10) AS BIGINT) AS tx_packets,
  CAST(event_id * 3200 + floor(value * 640) AS BIGINT) AS rx_bytes,
  CAST(floor(value * 640) AS BIGINT) AS tx_bytes,
  CAST(event_id % 5 AS BIGINT) AS rx_dropped, CAST(event_id % 3 AS BIGINT) AS tx_dropped,
  CAST(event_id % 2 AS BIGINT) AS rx_errors, CAST(0 AS BIGINT) AS tx_errors
  FROM events WHERE event_type = 'click')"""


def fault_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run dimension: one row per capture day."""
    days = table(spark, sf_dir, "events").selectExpr("day(ts) AS d").distinct()
    return days.selectExpr(
        "concat('run_', CAST(d AS STRING)) AS run_id", "concat('sc_', CAST(d % 7 AS STRING)) AS scenario_id",
        "concat('f_', CAST(d % 4 AS STRING)) AS fault_label",
        "CASE d % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'bandwidth' WHEN 2 THEN 'loss' ELSE 'delay' END AS fault_family",
        "CASE WHEN d % 2 = 0 THEN 'low' ELSE 'high' END AS fault_severity",
        "CASE WHEN d % 5 = 0 THEN NULL ELSE 's1-s2' END AS affected_link",
        "CAST(d AS DOUBLE) AS configured_bw", "CAST(d % 3 AS DOUBLE) AS configured_loss",
        "CAST(NULL AS STRING) AS configured_delay", "CAST(NULL AS STRING) AS traffic",
        "CAST(NULL AS STRING) AS traffic_pair", "CASE WHEN d % 2 = 0 THEN 'e' ELSE 'd' END AS protocol",
        "CAST(NULL AS STRING) AS source",
        "CAST(CASE WHEN d % 6 = 0 THEN NULL ELSE 1 END AS INT) AS s1_core_port", "CAST(3 AS INT) AS s2_core_port",
    )


META_SQL = """fault_meta AS (SELECT concat('run_', CAST(d AS VARCHAR)) AS run_id,
  concat('sc_', CAST(d % 7 AS VARCHAR)) AS scenario_id, concat('f_', CAST(d % 4 AS VARCHAR)) AS fault_label,
  CASE d % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'bandwidth' WHEN 2 THEN 'loss' ELSE 'delay' END AS fault_family,
  CASE WHEN d % 2 = 0 THEN 'low' ELSE 'high' END AS fault_severity,
  CASE WHEN d % 5 = 0 THEN NULL ELSE 's1-s2' END AS affected_link,
  CAST(d AS DOUBLE) AS configured_bw, CAST(d % 3 AS DOUBLE) AS configured_loss,
  CAST(NULL AS VARCHAR) AS configured_delay, CAST(NULL AS VARCHAR) AS traffic,
  CAST(NULL AS VARCHAR) AS traffic_pair, CASE WHEN d % 2 = 0 THEN 'e' ELSE 'd' END AS protocol,
  CAST(NULL AS VARCHAR) AS source,
  CAST(CASE WHEN d % 6 = 0 THEN NULL ELSE 1 END AS INT) AS s1_core_port, CAST(3 AS INT) AS s2_core_port
  FROM (SELECT DISTINCT day(ts) AS d FROM events))"""


def fault_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe rows with run ground truth: input of the calibrated rule and the fault evaluation."""
    rows = probes(spark, sf_dir).join(fault_meta(spark, sf_dir), "run_id")
    return rows.withColumn("n_flows", F.col("probe_id") % 9)


SAMPLE_SQL = PROBE_SQL + ", " + META_SQL + """,
fault_samples AS (SELECT p.*, m.* EXCLUDE (run_id), p.probe_id % 9 AS n_flows
  FROM probes p JOIN fault_meta m ON p.run_id = m.run_id)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'rule' AS model", "concat('g', CAST(l_linenumber AS STRING)) AS grp", "l_returnflag AS y",
        "CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS p", "l_quantity AS score")


PREDICTION_SQL = """predictions AS (SELECT 'rule' AS model, concat('g', CAST(l_linenumber AS VARCHAR)) AS grp,
  l_returnflag AS y, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS p,
  l_quantity AS score FROM lineitem)"""


def rule_predictions(early: DataFrame) -> DataFrame:
    """Multi-rule verdicts on early polls as a binary prediction table."""
    from pollwarden.operators.rules import multi_rule

    return early.select(
        F.lit("multi_rule").alias("model"), F.col("scenario_id").alias("grp"), F.col("label").alias("heldout_label"),
        (F.col("label") != "normal").cast("int").alias("y"), multi_rule().alias("p"),
        F.col("packet_count_per_sec").alias("score"))


RULE_SQL = EARLY_SQL + """,
rule_pred AS (SELECT 'multi_rule' AS model, scenario_id AS grp, label AS heldout_label,
  CAST(label <> 'normal' AS INT) AS y,
  CAST((packet_count_per_sec > 10000) OR (byte_count < 200 AND packet_count >= 2) AS INT) AS p,
  packet_count_per_sec AS score FROM early)"""
