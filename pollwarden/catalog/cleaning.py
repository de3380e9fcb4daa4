"""Scans, filters, projections, scalar functions, set operations and report writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollwarden.catalog import query
from pollwarden.catalog import views as V
from pollwarden.functions import features as X
from pollwarden.functions.netaddr import allowed_host
from pollwarden.functions.probetext import dotted_quads, iperf_values, ping_values
from pollwarden.operators import cleaning as C
from pollwarden.operators import metrics as M
from pollwarden.operators import splits as S
from pollwarden.schemas import INVALID_IDS, LAB_CIDR, PORT_FREE_FEATURES, model_features

HOSTS = [f"10.0.0.{i}" for i in range(1, 7)]
ATTACKERS, TARGETS = [f"10.0.0.{i}" for i in range(8)], ["10.0.1.0", "10.0.1.2"]
ATT_SQL = "(" + ", ".join(f"'{x}'" for x in ATTACKERS) + ")"


def flows(spark, sf):
    return V.flow_polls(spark, sf)


@query("s1_p1_p5_clean_polls", f"""WITH {V.FEATURE_SQL}
SELECT label, count(*) AS n, CAST(sum(packet_count) AS BIGINT) AS packets, round(sum(flow_duration), 3) AS seconds
FROM clean GROUP BY 1""")
def s1(spark, sf):
    out = C.clean_polls(X.flow_features(flows(spark, sf)))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("packet_count").alias("packets"),
                                    F.round(F.sum("flow_duration"), 3).alias("seconds"))


@query("p1_real_only", f"WITH {V.FLOW_SQL} SELECT flow_id FROM flow_polls WHERE is_synthetic = 0")
def p1(spark, sf):
    gaps = F.when(F.col("flow_id") % 3 != 0, F.col("is_synthetic"))
    marked = flows(spark, sf).withColumn("is_synthetic", F.when(F.col("is_synthetic") == 1, 1).otherwise(gaps))
    return C.real_only(marked).select("flow_id")


_IDS = "CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'nan' WHEN 3 THEN 'None' WHEN 4 THEN 'unknown' " \
       "WHEN 5 THEN 'legacy_unknown' ELSE 'r1' END"


def _variant(name):
    return ", ".join(f"'{x}'" for x in INVALID_IDS[name])


@query("p2_invalid_id_variants", f"""WITH t AS (SELECT event_id, coalesce({_IDS}, 'nan') AS id FROM events)
SELECT event_id, id NOT IN ({_variant("realtime")}) AS realtime, id NOT IN ({_variant("grouped_run")}) AS grouped_run,
  id NOT IN ({_variant("audit_run")}) AS audit_run, id NOT IN ({_variant("scenario_run")}) AS scenario_run,
  id NOT IN ({_variant("scenario")}) AS scenario FROM t""")
def p2(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr("event_id", f"{_IDS} AS id")
    return rows.select("event_id", *[C.valid_id("id", v).alias(v) for v in INVALID_IDS])


@query("p3_generated_runs", """SELECT event_id FROM events
WHERE NOT (user_id % 5 = 0) OR user_id IS NULL""")
def p3(spark, sf):
    rows = V.table(spark, sf, "events").withColumn("run_id", F.when(
        F.col("user_id") % 5 == 0, F.concat(F.lit("run_normal_massive_"), "user_id")).when(
        F.col("user_id") % 5 == 1, F.concat(F.lit("run_"), "user_id")))
    return C.without_generated_runs(rows).select("event_id")


@query("p4_complete_rows", f"WITH {V.PROBE_SQL} SELECT probe_id FROM probes WHERE udp_lost_pct IS NOT NULL AND jitter_ms IS NOT NULL")
def p4(spark, sf):
    return C.complete_rows(V.probes(spark, sf), ["udp_lost_pct", "jitter_ms"]).select("probe_id")


@query("p5_label_and_time_coercion", """SELECT event_id, lower(upper(event_type)) AS label, ts AS timestamp FROM events
WHERE event_id % 13 <> 0""")
def p5(spark, sf):
    rows = V.table(spark, sf, "events").select(
        "event_id", F.upper("event_type").alias("label"),
        F.when(F.col("event_id") % 13 == 0, F.lit("not a time")).otherwise(F.col("ts").cast("string")).alias("timestamp"))
    out = C.normalise_labels(rows)
    return out.select("event_id", "label", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("p6_attack_traffic", f"""WITH {V.FLOW_SQL} SELECT flow_id FROM flow_polls
WHERE ((ip_src IN {ATT_SQL} AND ip_dst IN ('10.0.1.0','10.0.1.2')) OR (ip_src IN ('10.0.1.0','10.0.1.2') AND ip_dst IN {ATT_SQL}))
  AND (tp_src <> 0 OR tp_dst <> 0) AND packet_count > 0""")
def p6(spark, sf):
    return C.attack_traffic(flows(spark, sf), ATTACKERS, TARGETS, require_packets=True).select("flow_id")


@query("p7_scan_traffic", f"""WITH {V.FLOW_SQL} SELECT flow_id FROM flow_polls
WHERE ip_src IN {ATT_SQL} AND ip_dst IN ('10.0.1.0','10.0.1.2') AND (tp_src <> 0 OR tp_dst <> 0)""")
def p7(spark, sf):
    return C.scan_traffic(flows(spark, sf), ATTACKERS, TARGETS).select("flow_id")


@query("p8_inside_hosts", f"""WITH {V.FLOW_SQL} SELECT flow_id FROM flow_polls
WHERE ip_src IN ('10.0.0.1','10.0.0.2','10.0.1.1') AND ip_dst IN ('10.0.0.1','10.0.0.2','10.0.1.1')""")
def p8(spark, sf):
    return C.inside_hosts(flows(spark, sf), ["10.0.0.1", "10.0.0.2", "10.0.1.1"]).select("flow_id")


@query("p9_cross_segment", f"""WITH {V.FLOW_SQL} SELECT flow_id FROM flow_polls
WHERE (ip_src IN {ATT_SQL} AND ip_dst IN ('10.0.1.0','10.0.1.2')) OR (ip_src IN ('10.0.1.0','10.0.1.2') AND ip_dst IN {ATT_SQL})""")
def p9(spark, sf):
    return C.cross_segment(flows(spark, sf), ATTACKERS, TARGETS).select("flow_id")


@query("p11_with_delta", "SELECT event_id FROM events WHERE event_id % 3 = 1")
def p11(spark, sf):
    return C.with_delta(V.table(spark, sf, "events").selectExpr(
        "event_id", "CASE event_id % 3 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS has_delta")).select("event_id")


@query("p12_time_window", """SELECT event_id FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-05 06:00:00' + INTERVAL 15 SECOND""")
def p12(spark, sf):
    rows = V.table(spark, sf, "events")
    return C.between_times(rows, "2024-01-03 00:00:00", "2024-01-05 06:00:00", 15, "ts").select("event_id")


@query("p13_both_endpoints", "SELECT event_id FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def p13(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 5 <> 0 THEN 'a' END AS ip_src", "CASE WHEN event_id % 7 <> 0 THEN 'b' END AS ip_dst")
    return C.both_endpoints(rows).select("event_id")


@query("p14_physical_ports", "SELECT event_id FROM events WHERE user_id % 3 = 1 OR user_id % 3 = 2 AND event_id % 2 = 0")
def p14(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN user_id % 3 = 0 THEN 4294967294 WHEN user_id % 3 = 1 THEN user_id "
        "ELSE 4294967040 + event_id % 2 END AS port_no")
    return C.physical_ports(rows).select("event_id")


# --- public flow files: the same columns, derived from lineitem ------------------------------------

_PUBLIC = """l_orderkey, l_linenumber, CAST(l_partkey % 65536 AS {s}) AS `Destination Port`, l_extendedprice * 1000 AS `Flow Duration`,
  l_quantity AS `Total Fwd Packets`, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey END AS `Total Backward Packets`,
  l_extendedprice AS `Total Length of Fwd Packets`, l_tax * 1000 AS `Total Length of Bwd Packets`,
  CASE WHEN l_orderkey % 50 = 0 THEN 'Infinity' ELSE CAST(l_quantity * 100 AS {s}) END AS `Flow Bytes/s`,
  CASE WHEN l_orderkey % 70 = 0 THEN 'NaN' ELSE CAST(l_quantity AS {s}) END AS `Flow Packets/s`,
  l_discount * 1000 AS `Average Packet Size`, l_suppkey % 2 AS `SYN Flag Count`,
  concat(' ', CASE l_returnflag WHEN 'A' THEN 'BENIGN' WHEN 'N' THEN 'DDoS' ELSE
    CASE WHEN l_linestatus = 'O' THEN 'Other' ELSE 'PortScan' END END, ' ') AS `Label`"""


def public_flows(spark, sf):
    return V.table(spark, sf, "lineitem").selectExpr(*_split_columns(_PUBLIC.format(s="STRING")))


def _split_columns(text):
    parts, depth, cur, quoted = [], 0, "", False
    for ch in text:
        quoted = quoted != (ch == "`")
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0 and not quoted:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*parts, cur.strip()]


_PUBLIC_SQL = f"""pub AS (SELECT {_PUBLIC.format(s="VARCHAR").replace("`", '"')} FROM lineitem),
mapped AS (SELECT CASE WHEN "SYN Flag Count" > 0 THEN 6 ELSE 0 END::DOUBLE AS ip_proto, -1::DOUBLE AS tp_src,
  "Destination Port"::DOUBLE AS tp_dst, "Total Fwd Packets" + coalesce("Total Backward Packets", 0) AS packet_count,
  "Total Length of Fwd Packets" + "Total Length of Bwd Packets" AS byte_count, "Flow Duration" / 1e6::DOUBLE AS duration_sec,
  CASE WHEN isfinite(try_cast("Flow Packets/s" AS DOUBLE)) THEN try_cast("Flow Packets/s" AS DOUBLE) END AS packet_count_per_sec,
  CASE WHEN isfinite(try_cast("Flow Bytes/s" AS DOUBLE)) THEN try_cast("Flow Bytes/s" AS DOUBLE) END AS byte_count_per_sec,
  "Average Packet Size" AS packet_size_avg, CASE trim("Label") WHEN 'BENIGN' THEN 'normal' WHEN 'DDoS' THEN 'ddos'
    WHEN 'PortScan' THEN 'portscan' END AS label FROM pub)"""


@query("s4_p15_p16_p22_public_three_class", f"""WITH {_PUBLIC_SQL}
SELECT ip_proto, tp_src, tp_dst, round(packet_count, 4) AS packet_count, round(byte_count, 4) AS byte_count,
  round(duration_sec, 6) AS duration_sec, packet_count_per_sec, byte_count_per_sec, round(packet_size_avg, 4) AS packet_size_avg, label
FROM mapped WHERE label IS NOT NULL AND packet_count_per_sec IS NOT NULL AND byte_count_per_sec IS NOT NULL""")
def p22(spark, sf):
    out = C.map_public_flows(public_flows(spark, sf), "ddos", F.lit("f.parquet"))
    return out.select("ip_proto", "tp_src", "tp_dst", F.round("packet_count", 4).alias("packet_count"),
                      F.round("byte_count", 4).alias("byte_count"), F.round("duration_sec", 6).alias("duration_sec"),
                      "packet_count_per_sec", "byte_count_per_sec", F.round("packet_size_avg", 4).alias("packet_size_avg"), "label")


def binary_flows(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 65536).alias("Src Port"), (F.col("l_partkey") % 65536).alias("Dst Port"),
        F.lit(6).alias("Protocol"), F.col("l_extendedprice").alias("Flow Duration"), F.col("l_quantity").alias("Tot Fwd Pkts"),
        F.col("l_suppkey").alias("Tot Bwd Pkts"), F.col("l_extendedprice").alias("TotLen Fwd Pkts"),
        F.col("l_tax").alias("TotLen Bwd Pkts"), F.col("l_quantity").alias("Flow Byts/s"), F.col("l_quantity").alias("Flow Pkts/s"),
        F.col("l_discount").alias("Pkt Size Avg"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("target"))


@query("s3_f5_f7_public_binary", """SELECT l_orderkey % 65536::DOUBLE AS tp_src, l_quantity + l_suppkey AS packet_count,
  round(l_extendedprice + l_tax, 4) AS byte_count, round(l_extendedprice / 1e6::DOUBLE, 8) AS flow_duration,
  CASE WHEN l_linestatus = 'O' THEN 'normal' ELSE 'anomaly' END AS label FROM lineitem""")
def s3(spark, sf):
    out = C.map_public_binary(binary_flows(spark, sf))
    return out.select("tp_src", "packet_count", F.round("byte_count", 4).alias("byte_count"),
                      F.round("flow_duration", 8).alias("flow_duration"), "label")


@query("f6_protocol_inference", """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_suppkey % 2 > 0 THEN 6 ELSE 0 END::DOUBLE AS ip_proto FROM lineitem""")
def f6(spark, sf):
    rows = public_flows(spark, sf)
    return rows.select("l_orderkey", "l_linenumber", X.infer_protocol(rows, C.PUBLIC_TCP_FLAGS).alias("ip_proto"))


@query("p17_feature_projection", f"WITH {V.FEATURE_SQL} SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in ("packet_count_per_sec", "byte_count_per_sec", "packet_size_avg", "flow_duration") else c
    for c in PORT_FREE_FEATURES) + " FROM clean")
def p17(spark, sf):
    out = C.clean_polls(X.flow_features(flows(spark, sf))).select(*PORT_FREE_FEATURES)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("p17_model_projection", f"WITH {V.FEATURE_SQL} SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in ("packet_count_per_sec", "byte_count_per_sec", "packet_size_avg", "flow_duration") else c
    for c in model_features("xgboost")) + " FROM clean")
def p17b(spark, sf):
    """A model by name takes its own list: the three-class models the full one, with ports."""
    out = C.project_features(C.clean_polls(X.flow_features(flows(spark, sf))), "XGBoost")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_PROV = """event_id, event_type AS label, CAST(NULL AS {s}) AS source,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '' WHEN event_id % 4 = 2 THEN 'unknown' ELSE concat('r', CAST(user_id AS {s})) END AS run_id,
  CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'nan' ELSE 'sc' END AS scenario_id,
  CASE WHEN event_id % 5 = 0 THEN 'two' ELSE CAST(event_id % 5 AS {s}) END AS attacker_count,
  CASE WHEN event_id % 2 = 0 THEN '' ELSE 'hping3' END AS traffic_tool"""


@query("p19_fill_provenance", f"""WITH t AS (SELECT {_PROV.format(s="VARCHAR")} FROM events),
f AS (SELECT *, coalesce(nullif(run_id, ''), 'unknown') AS rid, coalesce(nullif(scenario_id, ''), 'legacy_unknown') AS sid FROM t)
SELECT event_id, CASE WHEN rid IN ('', 'unknown', 'nan') THEN 'unknown' ELSE rid END AS run_id,
  CASE WHEN rid IN ('', 'unknown', 'nan') AND sid IN ('', 'unknown', 'nan') THEN 'legacy_unknown' ELSE sid END AS scenario_id,
  coalesce(try_cast(attacker_count AS INT), -1) AS attacker_count, coalesce(nullif(traffic_tool, ''), 'unknown') AS traffic_tool,
  'legacy_unknown' AS topology_id, '' AS source, 0 AS is_synthetic FROM f""")
def p19(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr(*_split_columns(_PROV.format(s="STRING")))
    return C.fill_provenance(rows).select("event_id", "run_id", "scenario_id", "attacker_count", "traffic_tool",
                                          "topology_id", "source", "is_synthetic")


@query("p19_fill_provenance_keep_blank", f"""WITH t AS (SELECT {_PROV.format(s="VARCHAR")} FROM events)
SELECT event_id, coalesce(run_id, 'unknown') AS run_id, scenario_id, coalesce(try_cast(attacker_count AS INT), -1) AS attacker_count,
  traffic_tool, 'mininet_lab_independent_run' AS source, 0 AS is_synthetic FROM t""")
def p19b(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr(*_split_columns(_PROV.format(s="STRING")))
    return C.tag_independent(rows).select("event_id", "run_id", "scenario_id", "attacker_count", "traffic_tool", "source", "is_synthetic")


_MARK = """event_id, CASE event_type WHEN 'error' THEN 'DDoS' ELSE event_type END AS label,
  CASE WHEN event_id % 3 = 0 THEN '2026-05-15 10:00:00' ELSE '2026-05-16 10:00:00' END AS timestamp,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'real_seed_bootstrap' ELSE 'lab' END AS source"""


@query("p20_mark_synthetic", f"""WITH t AS (SELECT {_MARK} FROM events),
u AS (SELECT *, label = 'DDoS' AND timestamp LIKE '2026-05-15%' AS made FROM t)
SELECT event_id, CAST(made OR coalesce(source, '') = 'real_seed_bootstrap' AS INT) AS is_synthetic,
  CASE WHEN made AND trim(coalesce(source, '')) = '' THEN 'handcraft_augment' ELSE coalesce(source, '') END AS source FROM u""")
def p20(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr(*_split_columns(_MARK))
    return C.mark_synthetic(rows).select("event_id", "is_synthetic", "source")


@query("p21_p24_targets", f"""WITH {V.FLOW_SQL} SELECT flow_id, CAST(label <> 'normal' AS INT) AS y,
  CASE WHEN label = 'normal' THEN 'normal' ELSE 'fault' END AS fault, upper(label) IN ('DDOS','PORTSCAN','ANOMALY') AS alert FROM flow_polls""")
def p21(spark, sf):
    return flows(spark, sf).select("flow_id", C.binary_target(F.col("label")).alias("y"),
                                   C.fault_target(F.col("label")).alias("fault"), C.is_alert(F.upper("label")).alias("alert"))


@query("p23_decode_predictions", """SELECT event_id,
  CASE user_id % 4 WHEN 0 THEN 'DDOS' WHEN 1 THEN 'NORMAL' WHEN 2 THEN 'PORTSCAN' ELSE 'UNKNOWN' END AS multiclass,
  CASE user_id % 4 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'ANOMALY' ELSE 'UNKNOWN' END AS binary_model,
  CASE user_id % 3 - 1 WHEN -1 THEN 'ANOMALY' WHEN 1 THEN 'NORMAL' ELSE 'UNKNOWN' END AS forest,
  CASE WHEN value > 20 THEN 'ANOMALY' ELSE 'NORMAL' END AS autoencoder FROM events""")
def p23(spark, sf):
    u = F.col("user_id")
    return V.table(spark, sf, "events").select(
        "event_id", C.decode_prediction("random_forest", u % 4).alias("multiclass"),
        C.decode_prediction("random_forest_binary", u % 4).alias("binary_model"),
        C.decode_prediction("isolation_forest", u % 3 - 1).alias("forest"),
        C.decode_prediction("autoencoder", F.col("value"), 20.0).alias("autoencoder"))


# --- scalar functions ------------------------------------------------------------------------------

@query("f1_flow_features", f"""WITH {V.FEATURE_SQL} SELECT flow_id, round(flow_duration, 6) AS flow_duration,
  round(packet_count_per_sec, 6) AS packet_count_per_sec, round(byte_count_per_sec, 6) AS byte_count_per_sec,
  round(packet_size_avg, 6) AS packet_size_avg FROM features""")
def f1(spark, sf):
    out = X.flow_features(flows(spark, sf))
    return out.select("flow_id", *[F.round(c, 6).alias(c) for c in
                                   ("flow_duration", "packet_count_per_sec", "byte_count_per_sec", "packet_size_avg")])


@query("f2_numeric_coercion", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE value END AS v,
  CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE value END::DOUBLE AS filled FROM events""")
def f2(spark, sf):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN 'Infinity' WHEN 2 THEN NULL ELSE CAST(value AS STRING) END")
    return V.table(spark, sf, "events").select("event_id", X.numeric(raw).alias("v"), X.numeric(raw, 0.0).alias("filled"))


@query("f3_rounding", """SELECT event_id, round(value, 1) AS v1, round(value * 1.00037::DOUBLE, 3) AS v3,
  round(value * 1.0000037::DOUBLE, 6) AS v6 FROM events""")
def f3(spark, sf):
    v = F.col("value")
    return V.table(spark, sf, "events").select("event_id", F.round(v, 1).alias("v1"), F.round(v * 1.00037, 3).alias("v3"),
                                               F.round(v * 1.0000037, 6).alias("v6"))


@query("f4_flow_ids", f"""WITH {V.FLOW_SQL}, t AS (SELECT DISTINCT ip_src, ip_dst, ip_proto, tp_src, tp_dst FROM flow_polls)
SELECT count(*) AS n_rows, (SELECT count(*) FROM t) AS n_ids, true AS in_range FROM flow_polls""")
def f4(spark, sf):
    """Hash values are Spark's own; what must hold is one id per 5-tuple, below 10^8."""
    ids = flows(spark, sf).select(X.flow_id().alias("tuple_id"))
    return ids.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("tuple_id").alias("n_ids"),
                   F.bool_and(F.col("tuple_id").between(0, 99_999_999)).alias("in_range"))


@query("f8_string_tools", """SELECT doc_id, lower(trim(source)) AS source, lang LIKE 'e%' AS starts, contains(text, 'the') AS has_marker,
  len(string_split(text, ';')) AS n_parts FROM documents""")
def f8(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", F.lower(F.trim("source")).alias("source"), F.col("lang").startswith("e").alias("starts"),
        F.col("text").contains("the").alias("has_marker"), F.size(F.split("text", ";")).cast("long").alias("n_parts"))


@query("f9_fingerprints", f"""WITH {V.FLOW_SQL}
SELECT flow_id, concat_ws('|', ip_proto::VARCHAR, tp_src::VARCHAR, coalesce(CASE WHEN tp_dst <> 0 THEN tp_dst END::VARCHAR, 'nan'),
  packet_count::VARCHAR) AS fp FROM flow_polls""")
def f9(spark, sf):
    rows = flows(spark, sf).withColumn("tp_dst", F.when(F.col("tp_dst") != 0, F.col("tp_dst")))
    return rows.select("flow_id", X.fingerprint(["ip_proto", "tp_src", "tp_dst", "packet_count"]).alias("fp"))


@query("f10_time_tools", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, ts + INTERVAL 15 SECOND AS later,
  starts_with(ts::VARCHAR, '2024-01-15') AS on_day, CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', ts) END AS parsed FROM events""")
def f10(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    broken = F.when(F.col("event_id") % 9 == 0, F.lit("2024-99-99")).otherwise(text)
    return V.table(spark, sf, "events").select(
        "event_id", text.alias("text"), F.expr("ts + INTERVAL 15 SECONDS").alias("later"),
        F.col("ts").cast("string").startswith("2024-01-15").alias("on_day"),
        F.try_to_timestamp(broken).cast("timestamp_ntz").alias("parsed"))


@query("s11_f12_ping_text", """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value * 0.5::DOUBLE END AS rtt_min_ms,
  CASE WHEN event_id % 4 <> 0 THEN value END AS rtt_mean_ms, CASE WHEN event_id % 4 <> 0 THEN value * 2 END AS rtt_max_ms,
  CASE WHEN event_id % 6 <> 0 THEN event_id % 101 END::DOUBLE AS probe_loss_pct FROM events""")
def f12(spark, sf):
    text = F.concat(
        F.expr("CASE WHEN event_id % 6 <> 0 THEN concat('5 sent, ', event_id % 101, '% packet loss, time 4006ms\n') ELSE 'unreachable\n' END"),
        F.expr("CASE WHEN event_id % 4 <> 0 THEN concat('rtt min/avg/max/mdev = ', value * 0.5D, '/', value, '/', value * 2, '/0.1 ms') ELSE '' END"))
    return V.table(spark, sf, "events").select("event_id", ping_values(text).alias("p")).select("event_id", "p.*")


@query("s11_f13_iperf_text", """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE value END AS throughput_mbps,
  CASE WHEN event_id % 5 IN (1, 2) THEN value / 100 END AS jitter_ms,
  CASE event_id % 5 WHEN 1 THEN (event_id % 21)::DOUBLE WHEN 2 THEN round(100.0::DOUBLE * (event_id % 10) / 10, 6) END AS udp_lost_pct FROM events""")
def f13(spark, sf):
    head = "concat('20240101,10.0.0.1,5001,10.0.0.4,40000,3,0.0-5.0,1000,', CAST(value * 1000000 AS STRING)"
    text = F.expr(f"""CASE event_id % 5 WHEN 0 THEN {head})
      WHEN 1 THEN {head}, ',', value / 100, ',1,10,', event_id % 21, '%')
      WHEN 2 THEN {head}, ',', value / 100, ',', event_id % 10, ',10')
      WHEN 3 THEN concat({head}), '\njunk,line\n1,2,3,4,5,6,7,8,nine') ELSE '' END""")
    return V.table(spark, sf, "events").select("event_id", iperf_values(text).alias("p")).select(
        "event_id", F.round("p.throughput_mbps", 6).alias("throughput_mbps"), "p.jitter_ms",
        F.round("p.udp_lost_pct", 6).alias("udp_lost_pct"))


@query("f14_clamped_settings", """SELECT event_id, greatest(1, least(30, coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, 5)))::DOUBLE AS polling_interval,
  greatest(1, least(20, coalesce(CASE WHEN event_id % 7 <> 0 THEN (user_id % 40)::INT END, 3))) AS alert_threshold,
  greatest(10, least(1200, coalesce(CASE WHEN event_id % 7 <> 0 THEN (user_id * 10)::INT END, 120))) AS block_timeout,
  coalesce(CASE WHEN event_id % 7 <> 0 THEN event_id % 2 = 0 END, true) AS mitigation_enabled FROM events""")
def f14(spark, sf):
    rows = V.table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 7 <> 0 THEN value END AS polling_interval",
        "CASE WHEN event_id % 7 <> 0 THEN user_id % 40 END AS alert_threshold",
        "CASE WHEN event_id % 7 <> 0 THEN user_id * 10 END AS block_timeout",
        "CASE WHEN event_id % 7 <> 0 THEN event_id % 2 = 0 END AS mitigation_enabled")
    return X.live_settings(rows)


@query("f15_address_filter", """SELECT event_id, user_id % 4 = 0 OR user_id % 4 = 1 AS allowed FROM events""")
def f15(spark, sf):
    ip = F.expr("CASE user_id % 4 WHEN 0 THEN concat('10.0.0.', user_id % 256) WHEN 1 THEN ' 10.0.0.3 ' "
                "WHEN 2 THEN concat('10.0.1.', user_id % 256) ELSE concat('10.0.0.', 256 + user_id) END")
    return V.table(spark, sf, "events").select("event_id", allowed_host(ip, HOSTS, LAB_CIDR).alias("allowed"))


@query("f17_label_codes", f"""WITH {V.FLOW_SQL} SELECT flow_id, CASE label WHEN 'ddos' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END AS code,
  label AS decoded FROM flow_polls""")
def f17(spark, sf):
    code = X.label_code(F.col("label"), ["normal", "ddos", "portscan"])
    return flows(spark, sf).select("flow_id", code.alias("code"), X.label_name(code, ["ddos", "normal", "portscan"]).alias("decoded"))


@query("f18_table_digest", "SELECT count(*) AS n_rows, true AS order_free, true AS content_bound FROM lineitem")
def f18(spark, sf):
    """The digest ignores row order and notices a changed value."""
    from pollwarden.sources.sinks import table_digest

    rows = V.table(spark, sf, "lineitem")
    here = table_digest(rows)
    dealt = rows.repartition(4 * rows.rdd.getNumPartitions(), "l_partkey")  # tasks as many as the input's size asks for
    shuffled = table_digest(dealt).select("hash_sum").scalar()
    changed = table_digest(rows.withColumn("l_tax", F.col("l_tax") + F.lit(1.0))).select("hash_sum").scalar()
    return here.select("n_rows", (F.col("hash_sum") == shuffled).alias("order_free"), (F.col("hash_sum") != changed).alias("content_bound"))


# --- dedupe, set operations, upserts ---------------------------------------------------------------

@query("o6_dedupe", f"WITH {V.FLOW_SQL} SELECT DISTINCT ip_src, ip_dst, ip_proto, tp_src, tp_dst, label FROM flow_polls")
def o6(spark, sf):
    return flows(spark, sf).select("ip_src", "ip_dst", "ip_proto", "tp_src", "tp_dst", "label").dropDuplicates()


@query("u1_union_by_name", """SELECT event_id AS id, event_type AS label, NULL::VARCHAR AS source FROM events
UNION ALL SELECT doc_id, NULL, source FROM documents""")
def u1(spark, sf):
    a = V.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("label"))
    b = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return a.unionByName(b, allowMissingColumns=True)


_OVER = """tr AS (SELECT l_quantity q, l_discount d, l_tax t, l_returnflag r, l_linestatus s FROM lineitem WHERE l_linenumber <> 1),
te AS (SELECT l_quantity q, l_discount d, l_tax t, l_returnflag r, l_linestatus s FROM lineitem WHERE l_linenumber = 1)"""


@query("u2_j6_overlap", f"""WITH {_OVER}
SELECT (SELECT count(*) FROM te) AS n_test, (SELECT count(*) FROM (SELECT DISTINCT * FROM te INTERSECT SELECT DISTINCT * FROM tr)) AS n_overlap_fingerprints,
  (SELECT count(*) FROM te SEMI JOIN tr USING (q, d, t, r, s)) AS n_test_rows_in_overlap,
  round((SELECT count(*) FROM te SEMI JOIN tr USING (q, d, t, r, s)) / (SELECT count(*) FROM te)::DOUBLE, 6) AS overlap_rate_of_test""")
def u2(spark, sf):
    rows = V.table(spark, sf, "lineitem")
    cols = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    out = S.overlap_report(rows.where("l_linenumber = 1"), rows.where("l_linenumber <> 1"), cols)
    return out.withColumn("overlap_rate_of_test", F.round("overlap_rate_of_test", 6))


@query("j6_overlap_rows", """SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_linenumber = 1 AND EXISTS (
  SELECT 1 FROM lineitem b WHERE b.l_linenumber <> 1 AND a.l_quantity = b.l_quantity AND a.l_discount = b.l_discount AND a.l_suppkey = b.l_suppkey)""")
def j6(spark, sf):
    rows = V.table(spark, sf, "lineitem")
    keys = ["l_quantity", "l_discount", "l_suppkey"]
    train = rows.where("l_linenumber <> 1").select(*keys).distinct()
    return rows.where("l_linenumber = 1").join(train, keys, "left_semi").select("l_orderkey", "l_linenumber")


@query("u3_blocked_union", f"""WITH {V.FLOW_SQL} SELECT ip_src FROM flow_polls WHERE label = 'ddos' AND packet_count > 500
UNION SELECT ip_src FROM flow_polls WHERE label = 'portscan' ORDER BY 1""")
def u3(spark, sf):
    rows = flows(spark, sf)
    a = rows.where("label = 'ddos' AND packet_count > 500").select("ip_src")
    return a.union(rows.where("label = 'portscan'").select("ip_src")).distinct().orderBy("ip_src")


_OLD = "SELECT l_returnflag AS model, l_linestatus AS part, count(*) AS n, 'old' AS gen FROM lineitem GROUP BY 1, 2"
_NEW = "SELECT l_returnflag AS model, 'all' AS part, count(*) AS n, 'new' AS gen FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1"


@query("k7_j7_upsert", f"WITH o AS ({_OLD}), w AS ({_NEW}) SELECT * FROM o WHERE model NOT IN (SELECT model FROM w) UNION ALL SELECT * FROM w")
def k7(spark, sf):
    rows = V.table(spark, sf, "lineitem")
    one = F.count(F.lit(1)).alias("n")
    old = rows.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("part")).agg(one)
    new = rows.where("l_returnflag <> 'A'").groupBy(F.col("l_returnflag").alias("model")).agg(one).withColumn("part", F.lit("all"))
    return M.upsert(old.withColumn("gen", F.lit("old")), new.withColumn("gen", F.lit("new"))).select("model", "part", "n", "gen")


@query("k7_patch_columns", """WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def k7b(spark, sf):
    old = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.lit(0).cast("long").alias("n_orders"))
    new = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return M.patch(old, new, "c_custkey", ["n_orders"])


_INNER = [*HOSTS, *TARGETS, "10.0.1.1"]
_INNER_SQL = "(" + ", ".join(f"'{h}'" for h in _INNER) + ")"


@query("k8_run_export_rows", f"""WITH {V.FLOW_SQL}, r AS (SELECT o_orderkey, concat('run_', o_orderkey::VARCHAR) AS run_id,
  TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 700) HOUR AS a, ['ddos', 'portscan', 'normal', 'mesh'][o_orderkey % 4 + 1] AS kind FROM orders)
SELECT r.run_id, count(*) AS n_flows, if(r.kind IN ('ddos', 'portscan'), r.kind, 'normal') AS label, 'hping3' AS traffic_tool,
  CAST(sum(f.flow_id) AS BIGINT) AS id_sum FROM flow_polls f JOIN r ON f.timestamp BETWEEN r.a AND r.a + INTERVAL 20 MINUTE
WHERE CASE r.kind
  WHEN 'ddos' THEN (f.ip_src IN {ATT_SQL} AND f.ip_dst IN ('10.0.1.0','10.0.1.2') OR f.ip_dst IN {ATT_SQL} AND f.ip_src IN ('10.0.1.0','10.0.1.2'))
    AND (f.tp_src <> 0 OR f.tp_dst <> 0)
  WHEN 'portscan' THEN f.ip_src IN {ATT_SQL} AND f.ip_dst IN ('10.0.1.0','10.0.1.2') AND (f.tp_src <> 0 OR f.tp_dst <> 0)
  WHEN 'normal' THEN f.ip_src IN {_INNER_SQL} AND f.ip_dst IN {_INNER_SQL}
  ELSE TRUE END GROUP BY 1, 3""")
def k8(spark, sf):
    """Runs of all four kinds."""
    from pollwarden.operators.runs import runs_alike
    from pollwarden.sources.sinks import run_export

    runs = V.table(spark, sf, "orders").selectExpr(
        "concat('run_', CAST(o_orderkey AS STRING)) AS run_id", "'sc' AS scenario_id",
        "element_at(array('ddos', 'portscan', 'normal', 'mesh'), CAST(o_orderkey % 4 AS INT) + 1) AS kind",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(o_orderkey % 700 AS INT)) AS start_time",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(o_orderkey % 700 AS INT), 20) AS end_time",
        "array('10.0.1.0', '10.0.1.2') AS targets", "'hping3' AS traffic_tool")
    different, members = runs_alike(runs)
    out = run_export(flows(spark, sf).drop("run_id", "scenario_id"), different, ATTACKERS, _INNER)
    # Constant columns of a run are keys: any_value of a string would sort all exported rows instead of hashing them.
    totals = out.groupBy(F.col("run_id").alias("alike"), "label", "traffic_tool").agg(F.count(F.lit(1)).alias("n_flows"), F.sum("flow_id").alias("id_sum"))
    sums = members.join(totals, "alike").groupBy("run_id", "label", "traffic_tool").agg(
        F.sum("n_flows").alias("n_flows"), F.sum("id_sum").alias("id_sum"))
    return sums.select("run_id", "n_flows", "label", "traffic_tool", "id_sum")


@query("k10_manifest_update", """WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey::VARCHAR AS run_id, coalesce(n, 7) AS n_flows_exported,
  CASE WHEN n IS NULL THEN c_mktsegment ELSE concat(c_mktsegment, '; recovered') END AS notes
FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def k10(spark, sf):
    from pollwarden.sources.sinks import update_manifest

    manifest = V.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("run_id"), F.lit(7).cast("long").alias("n_flows_exported"), F.col("c_mktsegment").alias("notes"))
    counts = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
    return update_manifest(manifest, counts, "recovered")


@query("s8_command_targets", r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\d+\.\d+\.\d+\.\d+'))) AS n_targets FROM documents""")
def s8(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", F.size(F.array_distinct(dotted_quads(F.col("text")))).cast("long").alias("n_targets"))


@query("a6_distributions", f"""WITH {V.FLOW_SQL} SELECT label, count(*) FILTER (WHERE is_synthetic = 0) AS "0",
  count(*) FILTER (WHERE is_synthetic = 1) AS "1" FROM flow_polls GROUP BY 1""")
def a6(spark, sf):
    return flows(spark, sf).groupBy("label").pivot("is_synthetic", [0, 1]).count().fillna(0)


@query("j9_report_join", """WITH t AS (SELECT l_returnflag AS model, l_linestatus AS protocol, avg(l_discount) AS acc FROM lineitem GROUP BY 1, 2)
SELECT model, round(max(CASE WHEN protocol = 'O' THEN acc END), 8) AS random_split, round(max(CASE WHEN protocol = 'F' THEN acc END), 8) AS grouped,
  round(coalesce(max(CASE WHEN protocol = 'O' THEN acc END), 0) - coalesce(max(CASE WHEN protocol = 'F' THEN acc END), 0), 8) AS gap FROM t GROUP BY 1""")
def j9(spark, sf):
    from pollwarden.plans.reports import compare_protocols

    rows = V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("protocol")).agg(
        F.avg("l_discount").alias("accuracy"))
    out = compare_protocols(rows, {"O": "random_split", "F": "grouped"}, "accuracy")
    return out.select("model", *[F.round(c, 8).alias(c) for c in ("random_split", "grouped", "gap")])


