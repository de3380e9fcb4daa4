"""Row filters, label and provenance clean-up, public-file mapping. All narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwarden.functions.features import infer_protocol, numeric, numeric_column
from pollwarden.schemas import (
    ALERT_LABELS, BASE_COLUMNS, FEATURES, INVALID_IDS, PROVENANCE_DEFAULTS, SEGMENT_A, SEGMENT_B,
    SOURCE_INDEPENDENT, model_features, require_columns,
)


def project_features(df: DataFrame, model: str) -> DataFrame:
    """The columns a model takes, in the order it was fitted with; a missing one fails before any row is read."""
    names = model_features(model)
    return require_columns(df, names).select(*names)


def printed(c: Column) -> Column:
    """Text of an id as the invalid-id lists see it: NULL reads 'nan'."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def real_only(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("is_synthetic"), F.lit(0)).cast("int") == 0)


def valid_id(column: str, variant: str) -> Column:
    return ~printed(F.col(column)).isin(INVALID_IDS[variant])


def known_runs(df: DataFrame, protocol: str = "realtime") -> DataFrame:
    """Drop rows without a known run (and, for scenario protocols, scenario)."""
    if protocol == "realtime":
        return df.where(valid_id("run_id", "realtime") & valid_id("scenario_id", "realtime"))
    if protocol == "scenario":
        return df.where(valid_id("run_id", "scenario_run") & valid_id("scenario_id", "scenario"))
    return df.where(valid_id("run_id", {"grouped": "grouped_run", "audit": "audit_run"}[protocol]))


def without_generated_runs(df: DataFrame, prefix: str = "run_normal_massive_") -> DataFrame:
    return df.where(~F.coalesce(F.col("run_id").startswith(prefix), F.lit(False)))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def normalise_labels(df: DataFrame) -> DataFrame:
    """Lower-case labels; times that cannot be read drop the row."""
    ts = F.col("timestamp")
    if dict(df.dtypes)["timestamp"] == "string":
        ts = F.try_to_timestamp(ts)
    return df.withColumns({"label": F.lower("label"), "timestamp": ts}).where(F.col("timestamp").isNotNull())


def clean_polls(df: DataFrame, protocol: str = "realtime") -> DataFrame:
    """The shared entry filter of the evaluation protocols."""
    require_columns(df, FEATURES + ["label", "run_id", "scenario_id", "timestamp"])
    needed = FEATURES + ["label", "run_id", "scenario_id", "timestamp"]
    return normalise_labels(complete_rows(known_runs(real_only(df), protocol), needed))


def _nonzero_port() -> Column:
    return (numeric(F.col("tp_src"), 0.0) != 0) | (numeric(F.col("tp_dst"), 0.0) != 0)


def attack_traffic(df: DataFrame, attackers: list[str], targets: list[str] | Column,
                   require_packets: bool = False) -> DataFrame:
    """L4 flows between attackers and targets, in either direction."""
    def is_target(ip: str) -> Column:
        if isinstance(targets, Column):
            return F.coalesce(F.array_contains(targets, F.col(ip)), F.lit(False))
        return F.col(ip).isin(targets)

    pair = (F.col("ip_src").isin(attackers) & is_target("ip_dst")) | (
        is_target("ip_src") & F.col("ip_dst").isin(attackers))
    out = df.where(pair & _nonzero_port())
    return out.where(numeric(F.col("packet_count"), 0.0) > 0) if require_packets else out


def scan_traffic(df: DataFrame, attackers: list[str], targets: list[str]) -> DataFrame:
    return df.where(F.col("ip_src").isin(attackers) & F.col("ip_dst").isin(targets) & _nonzero_port())


def inside_hosts(df: DataFrame, hosts: list[str]) -> DataFrame:
    return df.where(F.col("ip_src").isin(hosts) & F.col("ip_dst").isin(hosts))


def cross_segment(df: DataFrame, side_a: list[str] = SEGMENT_A, side_b: list[str] = SEGMENT_B) -> DataFrame:
    src, dst = F.col("ip_src"), F.col("ip_dst")
    return df.where((src.isin(side_a) & dst.isin(side_b)) | (src.isin(side_b) & dst.isin(side_a)))


def core_ports(ports: DataFrame, meta: DataFrame) -> DataFrame:
    """Ports on the link between the segments; a run that does not name both keeps every port."""
    wanted = meta.select("run_id", "s1_core_port", "s2_core_port")
    joined = ports.join(wanted, "run_id")
    unnamed = F.col("s1_core_port").isNull() | F.col("s2_core_port").isNull()
    named = (F.col("port_no") == F.col("s1_core_port")) | (F.col("port_no") == F.col("s2_core_port"))
    return joined.where(unnamed | named).drop("s1_core_port", "s2_core_port")


def with_delta(df: DataFrame) -> DataFrame:
    if "has_delta" not in df.columns:
        return df
    return df.where(F.coalesce(F.col("has_delta"), F.lit(0)).cast("int") == 1)


def between_times(df: DataFrame, start: str, end: str, grace_sec: int = 0, ts: str = "timestamp") -> DataFrame:
    kind = dict(df.dtypes)[ts]
    lo, hi = F.lit(start).cast(kind), F.lit(end).cast(kind) + F.expr(f"INTERVAL {grace_sec} SECONDS")
    return df.where((F.col(ts) >= lo) & (F.col(ts) <= hi))


def both_endpoints(df: DataFrame) -> DataFrame:
    return df.where(F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull())


# Fixed values of the switch protocol: the LOCAL port and the last physical port number.
LOCAL_PORT = 0xFFFFFFFE
LAST_PHYSICAL_PORT = 0xFFFFFF00


def physical_ports(df: DataFrame) -> DataFrame:
    port = F.col("port_no").cast("long")
    return df.where((port != LOCAL_PORT) & (port <= LAST_PHYSICAL_PORT))


def map_labels(df: DataFrame, mapping: dict[str, str], source: str, out: str = "label") -> DataFrame:
    """Allow-list and rename labels; anything not listed drops the row."""
    text = F.trim(F.col(source).cast("string"))
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), text)).where(F.col(out).isNotNull())


def fill_provenance(df: DataFrame, blank_is_missing: bool = True) -> DataFrame:
    """Default every provenance column, put the columns in the standard order, keep extras last."""
    have = set(df.columns)
    new: dict[str, Column] = {}
    for name, default in {"is_synthetic": 0, "source": ""}.items():
        new[name] = F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    for name, default in PROVENANCE_DEFAULTS.items():
        if name not in have:
            new[name] = F.lit(default)
        elif name == "attacker_count":
            new[name] = F.coalesce(numeric(F.col(name)).cast("int"), F.lit(-1))
        else:
            text = F.col(name).cast("string")
            new[name] = F.coalesce(F.nullif(text, F.lit("")) if blank_is_missing else text, F.lit(default))
    out = df.withColumns(new)
    if blank_is_missing:
        unknown = F.col("run_id").isin("", "unknown", "nan")
        out = out.withColumns({
            "scenario_id": F.when(unknown & F.col("scenario_id").isin("", "unknown", "nan"),
                                  F.lit("legacy_unknown")).otherwise(F.col("scenario_id")),
            "run_id": F.when(unknown, F.lit("unknown")).otherwise(F.col("run_id")),
        })
    standard = [c for c in BASE_COLUMNS + list(PROVENANCE_DEFAULTS) if c in out.columns]
    return out.select(*standard, *[c for c in out.columns if c not in standard])


# Fixed values that mark rows made by the two augmentation jobs.
HANDMADE_DATE, HANDMADE_SOURCE, BOOTSTRAP_SOURCE = "2026-05-15", "handcraft_augment", "real_seed_bootstrap"


def mark_synthetic(df: DataFrame, date_prefix: str = HANDMADE_DATE) -> DataFrame:
    """Set is_synthetic by rule: attack rows of the augmentation day, and bootstrap rows."""
    source = F.coalesce(F.col("source"), F.lit(""))
    made = (F.lower("label") == "ddos") & F.col("timestamp").cast("string").startswith(date_prefix)
    made = F.coalesce(made, F.lit(False))
    return df.withColumns({
        "is_synthetic": F.when(made | (source == BOOTSTRAP_SOURCE), 1).otherwise(0),
        "source": F.when(made & (F.trim(source) == ""), F.lit(HANDMADE_SOURCE)).otherwise(source),
    })


def binary_target(c: Column) -> Column:
    return (c != "normal").cast("int")


def fault_target(c: Column) -> Column:
    return F.when(c == "normal", F.lit("normal")).otherwise(F.lit("fault"))


def decode_prediction(model: str, raw: Column, threshold: Column | float | None = None) -> Column:
    """Raw model output to a live label, by the family the model belongs to."""
    if model.endswith("_binary"):
        return F.when(raw == 0, "NORMAL").when(raw == 1, "ANOMALY").otherwise("UNKNOWN")
    if model == "isolation_forest":
        return F.when(raw == -1, "ANOMALY").when(raw == 1, "NORMAL").otherwise("UNKNOWN")
    if model == "autoencoder":
        limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold or 0.0))
        return F.when(raw > limit, "ANOMALY").otherwise("NORMAL")
    return F.when(raw == 0, "DDOS").when(raw == 1, "NORMAL").when(raw == 2, "PORTSCAN").otherwise("UNKNOWN")


def is_alert(label: Column) -> Column:
    return label.isin(ALERT_LABELS)


# Fixed values of the public three-class flow file.
PUBLIC_LABELS = {"BENIGN": "normal", "PortScan": "portscan", "DDoS": "ddos"}
PUBLIC_REQUIRED = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Flow Bytes/s", "Flow Packets/s",
    "Average Packet Size", "Label",
]
PUBLIC_TCP_FLAGS = [f"{f} Flag Count" for f in ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWE")]
# Fixed values of the public binary flow file.
BINARY_LABELS = {"0": "normal", "1": "anomaly"}
BINARY_COLUMNS = [
    "Src Port", "Dst Port", "Protocol", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts",
    "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Flow Byts/s", "Flow Pkts/s", "Pkt Size Avg", "target",
]


def _both(df: DataFrame, a: str, b: str) -> Column:
    return numeric_column(df, a, 0.0) + numeric_column(df, b, 0.0)


def _constants(source: str, run: str, topology: str, file_name: Column) -> dict[str, Column]:
    return {
        "timestamp": F.lit(""), "datapath_id": F.lit(0), "flow_id": F.lit(""), "ip_src": F.lit(""),
        "ip_dst": F.lit(""), "duration_nsec": F.lit(0), "is_synthetic": F.lit(0), "source": F.lit(source),
        "run_id": F.lit(run), "scenario_id": F.lit(run), "capture_session_id": file_name,
        "topology_id": F.lit(topology), "traffic_tool": F.lit("cicflowmeter"),
        "attack_protocol": F.lit("mixed"), "attack_rate": F.lit("unknown"), "attacker_count": F.lit(-1),
        "target_host": F.lit("unknown"), "collection_timestamp": F.lit(""), "source_file": file_name,
    }


def map_public_flows(df: DataFrame, source_key: str, file_name: Column) -> DataFrame:
    """Public three-class file to the shared schema: one projection over the scan."""
    require_columns(df, PUBLIC_REQUIRED)
    kept = map_labels(df, PUBLIC_LABELS, "Label", out="_label")
    duration = numeric_column(df, "Flow Duration") / F.lit(1_000_000.0)
    tp_src = numeric_column(df, "Source Port") if "Source Port" in df.columns else F.lit(-1.0)
    features = {
        "ip_proto": infer_protocol(df, PUBLIC_TCP_FLAGS),
        "tp_src": tp_src,
        "tp_dst": numeric_column(df, "Destination Port"),
        "packet_count": _both(df, "Total Fwd Packets", "Total Backward Packets"),
        "byte_count": _both(df, "Total Length of Fwd Packets", "Total Length of Bwd Packets"),
        "duration_sec": duration,
        "packet_count_per_sec": numeric_column(df, "Flow Packets/s"),
        "byte_count_per_sec": numeric_column(df, "Flow Bytes/s"),
        "packet_size_avg": numeric_column(df, "Average Packet Size"),
        "flow_duration": duration,
        "label": F.col("_label"),
    }
    run = f"cicids2017_{source_key}"
    rest = _constants("cicids2017_public", run, "external_cicids2017", file_name)
    out = kept.select(*[c.alias(n) for n, c in {**features, **rest}.items()])
    return out.dropna(subset=FEATURES + ["label"])


def map_public_binary(df: DataFrame) -> DataFrame:
    """Public binary file to the shared features plus a normal/anomaly label."""
    require_columns(df, BINARY_COLUMNS)
    kept = map_labels(df, BINARY_LABELS, "target", out="_label")
    duration = numeric_column(df, "Flow Duration") / F.lit(1_000_000.0)
    features = {
        "ip_proto": numeric_column(df, "Protocol"),
        "tp_src": numeric_column(df, "Src Port"),
        "tp_dst": numeric_column(df, "Dst Port"),
        "packet_count": _both(df, "Tot Fwd Pkts", "Tot Bwd Pkts"),
        "byte_count": _both(df, "TotLen Fwd Pkts", "TotLen Bwd Pkts"),
        "duration_sec": duration,
        "packet_count_per_sec": numeric_column(df, "Flow Pkts/s"),
        "byte_count_per_sec": numeric_column(df, "Flow Byts/s"),
        "packet_size_avg": numeric_column(df, "Pkt Size Avg"),
        "flow_duration": duration,
        "label": F.col("_label"),
        "is_synthetic": F.lit(0),
        "source": F.lit("insdn_public_binary"),
        "run_id": F.lit("insdn_binary_mirror"),
    }
    return kept.select(*[c.alias(n) for n, c in features.items()]).dropna(subset=FEATURES + ["label"])


def tag_independent(df: DataFrame) -> DataFrame:
    """Mark rows of a collected run as real and fill whatever provenance is missing."""
    marked = df.withColumns({"is_synthetic": F.lit(0), "source": F.lit(SOURCE_INDEPENDENT)})
    return fill_provenance(marked, blank_is_missing=False)


