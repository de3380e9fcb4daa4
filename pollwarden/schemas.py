"""Logical schemas and fixed value lists shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- Fixed values: the feature vector, the key of a flow, provenance defaults ---------------------
FEATURES = [
    "ip_proto", "tp_src", "tp_dst", "packet_count", "byte_count", "duration_sec",
    "packet_count_per_sec", "byte_count_per_sec", "packet_size_avg", "flow_duration",
]
PORT_FREE_FEATURES = [c for c in FEATURES if c not in ("tp_src", "tp_dst")]
BEHAVIOUR_FEATURES = ["win_unique_dst_ports", "win_unique_dst_ips", "win_flow_count"]
FEATURE_SETS = {
    "with_raw_ports": FEATURES,
    "no_raw_ports": PORT_FREE_FEATURES,
    "behavior_window": PORT_FREE_FEATURES + BEHAVIOUR_FEATURES,
}
# Models that do not take the full list.
MODEL_FEATURE_SETS = {"random_forest_binary": "no_raw_ports"}
FLOW_KEY = ["run_id", "datapath_id", "ip_src", "ip_dst", "ip_proto", "tp_src", "tp_dst"]

BASE_COLUMNS = [
    "timestamp", "datapath_id", "flow_id", "ip_src", "ip_dst", "ip_proto", "tp_src", "tp_dst",
    "packet_count", "byte_count", "duration_sec", "duration_nsec", "packet_count_per_sec",
    "byte_count_per_sec", "packet_size_avg", "flow_duration", "label", "is_synthetic", "source",
]
PROVENANCE_DEFAULTS = {
    "run_id": "unknown",
    "scenario_id": "legacy_unknown",
    "capture_session_id": "legacy_unknown",
    "topology_id": "legacy_unknown",
    "traffic_tool": "unknown",
    "attack_protocol": "unknown",
    "attack_rate": "unknown",
    "attacker_count": -1,
    "target_host": "unknown",
    "collection_timestamp": "",
}

# Ids that mark a row as not belonging to a known run; a NULL prints as 'nan'.
INVALID_IDS = {
    "realtime": ["unknown", "nan", "", "None", "legacy_unknown"],
    "grouped_run": ["unknown", "nan", "", "None"],
    "audit_run": ["unknown", "nan", ""],
    "scenario_run": ["unknown", "nan", "", "None"],
    "scenario": ["unknown", "nan", "", "None", "legacy_unknown"],
}

LABELS = ["ddos", "normal", "portscan"]
FAULT_FAMILIES = ["normal", "bandwidth", "loss", "delay"]
ALERT_LABELS = ["DDOS", "PORTSCAN", "ANOMALY"]

LAB_HOSTS = [f"10.0.0.{i}" for i in range(1, 7)]
LAB_CIDR = "10.0.0.0/24"
SEGMENT_A = LAB_HOSTS[:3]
SEGMENT_B = LAB_HOSTS[3:]

SOURCE_INDEPENDENT = "mininet_lab_independent_run"
SOURCE_FAULT = "mininet_lab_fault_run"
TOPOLOGY_DEFAULT = "custom_topo_2s6h_v1"

FLOW_SUMS = [
    "packet_count_sum", "byte_count_sum", "delta_packet_sum", "delta_byte_sum",
    "packet_rate_window_sum", "byte_rate_window_sum", "packet_size_avg_mean",
    "duration_sec_mean", "n_flows",
]
PROTOCOL_SUMS = [
    "n_tcp_flows", "n_udp_flows", "tcp_delta_packet_sum", "udp_delta_packet_sum",
    "tcp_byte_rate_window_sum", "udp_byte_rate_window_sum", "tcp_share",
]
CORE_PORT_SUMS = [
    "rx_bps_core", "tx_bps_core", "core_bps", "delta_rx_dropped_core", "delta_tx_dropped_core",
    "drop_rate_core", "delta_rx_errors_core", "delta_tx_errors_core",
]
PROBE_VALUES = [
    "rtt_mean_ms", "rtt_min_ms", "rtt_max_ms", "probe_loss_pct", "throughput_mbps",
    "jitter_ms", "udp_lost_pct",
]
FAULT_FEATURES = FLOW_SUMS + PROTOCOL_SUMS + CORE_PORT_SUMS + PROBE_VALUES
FAULT_FORBIDDEN = [
    "run_id", "scenario_id", "fault_label", "fault_family", "fault_severity", "affected_link",
    "configured_bw", "configured_loss", "configured_delay", "traffic", "traffic_pair", "protocol",
    "ip_src", "ip_dst", "tp_src", "tp_dst", "capture_session_id", "start_time", "end_time",
]
# ---------------------------------------------------------------------------------------------------

TIMESTAMP, STRING, INTEGER, LONG, DOUBLE = T.TimestampType(), T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

# Column names, order and types of the files and tables.
FLOW_POLL = T.StructType([
    T.StructField("timestamp", TIMESTAMP),
    T.StructField("datapath_id", INTEGER),
    T.StructField("flow_id", LONG),
    T.StructField("ip_src", STRING),
    T.StructField("ip_dst", STRING),
    T.StructField("ip_proto", INTEGER),
    T.StructField("tp_src", INTEGER),
    T.StructField("tp_dst", INTEGER),
    T.StructField("packet_count", LONG),
    T.StructField("byte_count", LONG),
    T.StructField("duration_sec", LONG),
    T.StructField("duration_nsec", LONG),
    T.StructField("packet_count_per_sec", DOUBLE),
    T.StructField("byte_count_per_sec", DOUBLE),
    T.StructField("packet_size_avg", DOUBLE),
    T.StructField("flow_duration", DOUBLE),
    T.StructField("label", STRING),
    T.StructField("is_synthetic", INTEGER),
    T.StructField("source", STRING),
    T.StructField("run_id", STRING),
    T.StructField("scenario_id", STRING),
    T.StructField("capture_session_id", STRING),
    T.StructField("topology_id", STRING),
    T.StructField("traffic_tool", STRING),
    T.StructField("attack_protocol", STRING),
    T.StructField("attack_rate", STRING),
    T.StructField("attacker_count", INTEGER),
    T.StructField("target_host", STRING),
    T.StructField("collection_timestamp", STRING),
])
FAULT_FLOW_POLL = T.StructType([
    T.StructField("timestamp", TIMESTAMP),
    T.StructField("datapath_id", INTEGER),
    T.StructField("ip_src", STRING),
    T.StructField("ip_dst", STRING),
    T.StructField("ip_proto", INTEGER),
    T.StructField("tp_src", INTEGER),
    T.StructField("tp_dst", INTEGER),
    T.StructField("packet_count", LONG),
    T.StructField("byte_count", LONG),
    T.StructField("duration_sec", DOUBLE),
    T.StructField("packet_size_avg", DOUBLE),
    T.StructField("delta_packet", DOUBLE),
    T.StructField("delta_byte", DOUBLE),
    T.StructField("packet_rate_window", DOUBLE),
    T.StructField("byte_rate_window", DOUBLE),
    T.StructField("dt_sec", DOUBLE),
    T.StructField("has_delta", INTEGER),
])
PORT_COUNTERS = [
    "rx_packets", "tx_packets", "rx_bytes", "tx_bytes",
    "rx_dropped", "tx_dropped", "rx_errors", "tx_errors",
]
PORT_POLL = T.StructType([
    T.StructField("timestamp", TIMESTAMP),
    T.StructField("datapath_id", INTEGER),
    T.StructField("port_no", LONG),
    T.StructField("rx_packets", LONG),
    T.StructField("tx_packets", LONG),
    T.StructField("rx_bytes", LONG),
    T.StructField("tx_bytes", LONG),
    T.StructField("rx_dropped", LONG),
    T.StructField("tx_dropped", LONG),
    T.StructField("rx_errors", LONG),
    T.StructField("tx_errors", LONG),
    T.StructField("delta_rx_packets", LONG),
    T.StructField("delta_tx_packets", LONG),
    T.StructField("delta_rx_bytes", LONG),
    T.StructField("delta_tx_bytes", LONG),
    T.StructField("delta_rx_dropped", LONG),
    T.StructField("delta_tx_dropped", LONG),
    T.StructField("delta_rx_errors", LONG),
    T.StructField("delta_tx_errors", LONG),
    T.StructField("rx_bps", DOUBLE),
    T.StructField("tx_bps", DOUBLE),
    T.StructField("drop_rate", DOUBLE),
    T.StructField("dt_sec", DOUBLE),
    T.StructField("has_delta", INTEGER),
])
# Column order of the probe file (the CSV reader matches by position).
PROBE = T.StructType([
    T.StructField("timestamp", TIMESTAMP),
    T.StructField("rtt_min_ms", DOUBLE),
    T.StructField("rtt_mean_ms", DOUBLE),
    T.StructField("rtt_max_ms", DOUBLE),
    T.StructField("probe_loss_pct", DOUBLE),
    T.StructField("throughput_mbps", DOUBLE),
    T.StructField("jitter_ms", DOUBLE),
    T.StructField("udp_lost_pct", DOUBLE),
])
LABEL_INTERVAL = T.StructType([
    T.StructField("start_time", TIMESTAMP),
    T.StructField("end_time", TIMESTAMP),
    T.StructField("label", STRING),
])
RUN_META = T.StructType([
    T.StructField("run_id", STRING),
    T.StructField("scenario_id", STRING),
    T.StructField("fault_label", STRING),
    T.StructField("fault_family", STRING),
    T.StructField("fault_severity", STRING),
    T.StructField("affected_link", STRING),
    T.StructField("configured_bw", DOUBLE),
    T.StructField("configured_loss", DOUBLE),
    T.StructField("configured_delay", STRING),
    T.StructField("source", STRING),
    T.StructField("topology_id", STRING),
    T.StructField("protocol", STRING),
    T.StructField("start_time", STRING),
    T.StructField("end_time", STRING),
    T.StructField("duration_sec", DOUBLE),
    T.StructField("repeat_idx", INTEGER),
    T.StructField("traffic", STRING),
    T.StructField("traffic_pair", STRING),
    T.StructField("s1_core_intf", STRING),
    T.StructField("s1_core_port", INTEGER),
    T.StructField("s2_core_intf", STRING),
    T.StructField("s2_core_port", INTEGER),
    T.StructField("qdisc", STRING),
    T.StructField("notes", STRING),
])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail early, on the driver, when an input lacks a required column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input is missing required columns: {missing}")
    return df


def assert_no_leak(feature_columns: list[str]) -> list[str]:
    """Refuse ground-truth and identity columns as model inputs."""
    leaked = sorted(set(feature_columns) & set(FAULT_FORBIDDEN))
    if leaked:
        raise RuntimeError(f"ground-truth columns offered as features: {leaked}")
    return feature_columns


def model_features(model: str) -> list[str]:
    """Ordered feature list of a model by its name, in any case; a model without a list of its own takes the full one."""
    return list(FEATURE_SETS[MODEL_FEATURE_SETS.get(str(model).lower(), "with_raw_ports")])


def feature_columns(feature_set: str) -> list[str]:
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {feature_set!r}, have {sorted(FEATURE_SETS)}")
    return list(FEATURE_SETS[feature_set])
