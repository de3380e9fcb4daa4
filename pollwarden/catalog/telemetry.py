"""Temporal operators: poll selection, deltas, as-of and interval joins, poll aggregates, streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollwarden.catalog import query
from pollwarden.catalog import views as V
from pollwarden.functions.features import epoch_micros, flow_features, fresh
from pollwarden.operators import cleaning as C
from pollwarden.operators import ordered as O
from pollwarden.operators import telemetry as T
from pollwarden.operators.runs import runs_alike

KEY = "run_id, datapath_id, ip_src, ip_dst, ip_proto, tp_src, tp_dst"
STATE = "datapath_id, ip_src, ip_dst, ip_proto, tp_src, tp_dst"


def clean(spark, sf):
    return C.clean_polls(flow_features(V.flow_polls(spark, sf)))


def early(spark, sf):
    return T.early_polls(clean(spark, sf))


@query("w1_poll_index", f"""WITH {V.FEATURE_SQL}
SELECT flow_id, row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp, flow_id) - 1 AS poll_index FROM clean""")
def w1(spark, sf):
    return T.poll_index(clean(spark, sf)).select("flow_id", "poll_index")


@query("w2_w3_early_polls", f"""WITH {V.EARLY_SQL}
SELECT flow_id, poll_index, round(age_us / 1e6::DOUBLE, 3) AS seconds_from_run_start FROM early""")
def w2(spark, sf):
    return early(spark, sf).select(
        "flow_id", "poll_index", F.round("seconds_from_run_start", 3).alias("seconds_from_run_start"))


@query("w3_seconds_from_run_start", f"""WITH {V.FLOW_SQL}
SELECT flow_id, round((epoch_us(timestamp) - min(epoch_us(timestamp)) OVER (PARTITION BY run_id)) / 1e6::DOUBLE, 3)
  AS seconds_from_run_start FROM flow_polls""")
def w3(spark, sf):
    out = T.seconds_from_run_start(V.flow_polls(spark, sf))
    return out.select("flow_id", F.round("seconds_from_run_start", 3).alias("seconds_from_run_start"))


@query("w4_last_poll_per_key", f"""WITH {V.FEATURE_SQL},
t AS (SELECT * REPLACE (CASE WHEN flow_id % 31 = 0 THEN NULL ELSE timestamp END AS timestamp) FROM clean)
SELECT flow_id, label FROM (SELECT *, row_number() OVER (PARTITION BY {KEY}
  ORDER BY timestamp DESC NULLS FIRST, flow_id DESC) AS rn FROM t) WHERE rn = 1""")
def w4(spark, sf):
    # Some times are made unreadable: such a row sorts last and therefore wins.
    unread = F.when(F.col("flow_id") % 31 != 0, F.col("timestamp"))
    return T.last_polls(clean(spark, sf).withColumn("timestamp", unread)).select("flow_id", "label")


@query("w5_flow_deltas", f"""WITH {V.FLOW_SQL},
p AS (SELECT *, lag(packet_count) OVER w AS pp, lag(byte_count) OVER w AS pb, lag(epoch_us(timestamp)) OVER w AS pt
  FROM flow_polls WINDOW w AS (PARTITION BY {STATE} ORDER BY timestamp, flow_id)),
d AS (SELECT *, greatest((epoch_us(timestamp) - pt) / 1e6::DOUBLE, 1e-6::DOUBLE) AS dt,
  pt IS NOT NULL AND packet_count >= pp AND byte_count >= pb AS ok FROM p)
SELECT flow_id, CASE WHEN ok THEN packet_count - pp ELSE 0 END::DOUBLE AS delta_packet,
  CASE WHEN ok THEN byte_count - pb ELSE 0 END::DOUBLE AS delta_byte,
  round(CASE WHEN ok THEN (packet_count - pp) / dt ELSE 0 END, 6) AS packet_rate_window,
  round(CASE WHEN ok THEN (byte_count - pb) / dt ELSE 0 END, 6) AS byte_rate_window,
  round(CASE WHEN pt IS NULL THEN 0 ELSE dt END, 6) AS dt_sec, CAST(ok AS INT) AS has_delta FROM d""")
def w5(spark, sf):
    out = T.flow_deltas(V.flow_polls(spark, sf))
    return out.select("flow_id", "delta_packet", "delta_byte", *[
        F.round(c, 6).alias(c) for c in ("packet_rate_window", "byte_rate_window", "dt_sec")], "has_delta")


_PORT_DELTA = f"""{V.PORT_SQL},
pp AS (SELECT *, {", ".join(f"lag({c}) OVER w AS p_{c}" for c in
    ["rx_packets", "tx_packets", "rx_bytes", "tx_bytes", "rx_dropped", "tx_dropped", "rx_errors", "tx_errors"])},
  lag(epoch_us(timestamp)) OVER w AS pt
  FROM port_polls WINDOW w AS (PARTITION BY datapath_id, port_no ORDER BY timestamp, row_id)),
pd AS (SELECT *, {", ".join(f"CASE WHEN pt IS NULL THEN 0 ELSE greatest({c} - p_{c}, 0) END AS delta_{c}" for c in
    ["rx_packets", "tx_packets", "rx_bytes", "tx_bytes", "rx_dropped", "tx_dropped", "rx_errors", "tx_errors"])},
  CASE WHEN pt IS NULL THEN 0 ELSE greatest((epoch_us(timestamp) - pt) / 1e6::DOUBLE, 1e-6::DOUBLE) END AS dt_sec FROM pp),
port_deltas AS (SELECT *, CASE WHEN dt_sec > 0 THEN 8.0::DOUBLE * delta_rx_bytes / dt_sec ELSE 0 END AS rx_bps,
  CASE WHEN dt_sec > 0 THEN 8.0::DOUBLE * delta_tx_bytes / dt_sec ELSE 0 END AS tx_bps,
  CASE WHEN delta_rx_packets + delta_tx_packets > 0 THEN (delta_rx_dropped + delta_tx_dropped)::DOUBLE
    / (delta_rx_packets + delta_tx_packets) ELSE 0 END AS drop_rate,
  CAST(pt IS NOT NULL AS INT) AS has_delta FROM pd)"""


@query("w6_port_deltas", f"""WITH {_PORT_DELTA}
SELECT row_id, delta_rx_packets, delta_tx_packets, delta_rx_bytes, delta_rx_dropped, round(rx_bps, 4) AS rx_bps,
  round(tx_bps, 4) AS tx_bps, round(drop_rate, 6) AS drop_rate, round(dt_sec, 6) AS dt_sec, has_delta FROM port_deltas""")
def w6(spark, sf):
    out = T.port_deltas(V.port_polls(spark, sf))
    return out.select("row_id", "delta_rx_packets", "delta_tx_packets", "delta_rx_bytes", "delta_rx_dropped",
                      F.round("rx_bps", 4).alias("rx_bps"), F.round("tx_bps", 4).alias("tx_bps"),
                      F.round("drop_rate", 6).alias("drop_rate"), F.round("dt_sec", 6).alias("dt_sec"), "has_delta")


@query("w7_live_packet_rate", f"""WITH {V.FLOW_SQL}
SELECT flow_id, coalesce(greatest(packet_count - lag(packet_count) OVER (PARTITION BY {STATE} ORDER BY timestamp, flow_id),
  0) / 5.0::DOUBLE, 0) AS packet_delta_per_sec FROM flow_polls""")
def w7(spark, sf):
    return T.live_packet_rate(V.flow_polls(spark, sf)).select("flow_id", "packet_delta_per_sec")


@query("w8_steady_state", f"""WITH {V.SAMPLE_SQL},
t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p_ts, probe_id) AS rn,
  count(*) OVER (PARTITION BY run_id) AS n FROM fault_samples)
SELECT run_id, probe_id, n_flows FROM t WHERE n_flows > 0 AND (n <= 2 OR (n <= 4 AND rn > 1 AND rn < n)
  OR (n > 4 AND rn > 2 AND rn < n - 1))""")
def w8(spark, sf):
    rows = V.fault_samples(spark, sf).withColumnRenamed("p_ts", "timestamp")
    return T.steady_state(rows, "probe_id").select("run_id", "probe_id", "n_flows")


_HOUR = "CAST(floor(epoch_us(timestamp) / 3600000000) AS BIGINT)"


def hourly(spark, sf):
    """Live predictions on hourly polls: the upper-cased label plays the model's answer."""
    return V.flow_polls(spark, sf).withColumns({
        "poll_id": F.floor(epoch_micros(F.col("timestamp")) / F.lit(3_600_000_000)),
        "prediction": F.upper("label")})


OBS_SQL = f"""{V.FLOW_SQL},
obs AS (SELECT {_HOUR} AS poll_id, ip_src, bool_or(label <> 'normal') AS anomalous,
  string_agg(DISTINCT upper(label), '/' ORDER BY upper(label)) AS labels, count(*) AS n_flows
  FROM flow_polls GROUP BY 1, 2)"""


@query("a25_poll_observations", f"WITH {OBS_SQL} SELECT * FROM obs")
def a25(spark, sf):
    return T.poll_observations(hourly(spark, sf))


@query("w9_alert_streaks", f"""WITH {OBS_SQL},
n AS (SELECT poll_id, row_number() OVER (ORDER BY poll_id) AS pn FROM (SELECT DISTINCT poll_id FROM obs)),
h AS (SELECT o.*, n.pn, n.pn - row_number() OVER (PARTITION BY ip_src ORDER BY n.pn) AS island
  FROM obs o JOIN n USING (poll_id) WHERE anomalous)
SELECT poll_id, ip_src, labels, row_number() OVER (PARTITION BY ip_src, island ORDER BY pn) AS streak FROM h""")
def w9(spark, sf):
    obs = T.poll_observations(hourly(spark, sf))
    return T.alert_streaks(obs, obs)


@query("w10_probe_dedupe_keep_last", f"""WITH {V.PROBE_SQL}
SELECT run_id, t AS second, probe_id, round(rtt_mean_ms, 6) AS rtt_mean_ms FROM (SELECT *, date_trunc('hour', p_ts) AS t,
  row_number() OVER (PARTITION BY run_id, date_trunc('hour', p_ts) ORDER BY probe_id DESC) AS rn FROM probes) WHERE rn = 1""")
def w10(spark, sf):
    rows = V.probes(spark, sf).withColumn("second", F.date_trunc("hour", "p_ts").cast("timestamp_ntz"))
    out = T.keep_last(rows, ["run_id", "second"], ["probe_id"])
    return out.select("run_id", "second", "probe_id", F.round("rtt_mean_ms", 6).alias("rtt_mean_ms"))


_ASOF = f"""WITH {V.FLOW_SQL}, {V.PROBE_SQL},
l AS (SELECT flow_id, concat('run_', CAST(day(timestamp) AS VARCHAR)) AS run_day, epoch_us(timestamp) AS t FROM flow_polls),
c AS (SELECT l.flow_id, r.probe_id, r.rtt_mean_ms, row_number() OVER (PARTITION BY l.flow_id
  ORDER BY abs(l.t - epoch_us(r.p_ts)), r.p_ts, r.probe_id) AS rn
  FROM l JOIN probes r ON l.run_day = r.run_id AND abs(l.t - epoch_us(r.p_ts)) <= 600000000)
SELECT l.flow_id, c.probe_id, c.rtt_mean_ms FROM l LEFT JOIN c ON l.flow_id = c.flow_id AND c.rn = 1"""


@query("j1_asof_nearest", _ASOF)
def j1(spark, sf):
    left = V.flow_polls(spark, sf).select(
        "flow_id", "timestamp", F.expr("concat('run_', CAST(day(timestamp) AS STRING))").alias("run_day"))
    right = V.probes(spark, sf).withColumnRenamed("run_id", "run_day")
    out = O.asof_nearest(left, right, ["run_day"], "timestamp", "p_ts", ["probe_id", "rtt_mean_ms"], 600, ["probe_id"])
    return out.select("flow_id", "probe_id", "rtt_mean_ms")


_LABELLED = f"""{V.FLOW_SQL}, {V.INTERVAL_SQL},
labelled AS (SELECT f.flow_id, coalesce(arg_max(i.label, i.idx), 'normal') AS label
  FROM flow_polls f LEFT JOIN label_intervals i ON f.timestamp BETWEEN i.start_time AND i.end_time GROUP BY f.flow_id)"""


@query("j2_interval_label", f"WITH {_LABELLED} SELECT * FROM labelled")
def j2(spark, sf):
    return O.interval_label(V.flow_polls(spark, sf), V.label_intervals(spark), "timestamp").select("flow_id", "label")


@query("s7_label_interval_counts", f"WITH {_LABELLED} SELECT label, count(*) AS n FROM labelled GROUP BY label")
def s7(spark, sf):
    """The intervals come from a file, whose line order is their priority."""
    from pollwarden.catalog.files import fresh_folder
    from pollwarden.sources.readers import read_intervals

    path = fresh_folder(spark, "intervals")
    V.label_intervals(spark).orderBy("idx").drop("idx").coalesce(1).write.option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    polls = V.flow_polls(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    out = O.interval_label(polls, read_intervals(spark, path), "timestamp")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("j3_a5_behaviour_windows", f"""WITH {V.FLOW_SQL},
q AS (SELECT flow_id, run_id, date_trunc('day', timestamp) AS timestamp,
  CASE WHEN flow_id % 11 = 0 THEN NULL ELSE ip_src END AS ip_src, ip_dst, tp_dst FROM flow_polls),
s AS (SELECT run_id, timestamp, ip_src, count(DISTINCT tp_dst) AS win_unique_dst_ports,
  count(DISTINCT ip_dst) AS win_unique_dst_ips, count(flow_id) AS win_flow_count FROM q GROUP BY ALL)
SELECT q.flow_id, s.win_unique_dst_ports, s.win_unique_dst_ips, s.win_flow_count FROM q JOIN s
  ON q.run_id IS NOT DISTINCT FROM s.run_id AND q.timestamp = s.timestamp AND q.ip_src IS NOT DISTINCT FROM s.ip_src""")
def j3(spark, sf):
    rows = V.flow_polls(spark, sf).withColumns({
        "timestamp": F.date_trunc("day", "timestamp").cast("timestamp_ntz"),
        "ip_src": F.when(F.col("flow_id") % 11 != 0, F.col("ip_src"))})
    return T.behaviour_windows(rows).select(
        "flow_id", "win_unique_dst_ports", "win_unique_dst_ips", "win_flow_count")


_RUN_LOGS = """run_logs AS (SELECT concat('log_', CAST(o_orderkey AS VARCHAR)) AS log_id,
  TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 700) HOUR AS start_time,
  TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 700) HOUR + INTERVAL 20 MINUTE AS end_time,
  concat('10.0.1.', CAST(o_custkey % 3 AS VARCHAR)) AS target FROM orders)"""


@query("j5_run_log_recovery", f"""WITH {V.FLOW_SQL}, {_RUN_LOGS}
SELECT r.log_id, count(*) AS n_rows, CAST(sum(f.packet_count) AS BIGINT) AS packets FROM flow_polls f JOIN run_logs r
  ON f.timestamp BETWEEN r.start_time AND r.end_time + INTERVAL 15 SECOND
  AND f.ip_src IN ('10.0.0.1','10.0.0.2','10.0.0.4','10.0.0.5','10.0.0.6') AND f.ip_dst = r.target
WHERE f.tp_src <> 0 OR f.tp_dst <> 0 GROUP BY 1""")
def j5(spark, sf):
    from pollwarden.plans import jobs

    logs = V.table(spark, sf, "orders").selectExpr(
        "concat('log_', CAST(o_orderkey AS STRING)) AS run_id", "'ddos_recovered' AS scenario_id",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(o_orderkey % 700 AS INT)) AS start_time",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(o_orderkey % 700 AS INT), 20) AS end_time",
        "array(concat('10.0.1.', CAST(o_custkey % 3 AS STRING))) AS targets")
    hosts = [f"10.0.0.{i}" for i in (1, 2, 4, 5, 6)]
    different, members = runs_alike(logs)
    kept = jobs.recover_runs(V.flow_polls(spark, sf), different, hosts)
    totals = kept.groupBy(F.col("run_id").alias("alike")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("packet_count").alias("packets"))
    return members.join(totals, "alike").groupBy(F.col("run_id").alias("log_id")).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("packets").alias("packets"))


@query("a7_j8_scenario_inventory", f"""WITH {V.FEATURE_SQL},
tup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, flow_id DESC) rn FROM clean)
  WHERE rn = 1),
p AS (SELECT scenario_id, mode(label) AS label, count(DISTINCT run_id) AS n_runs, count(*) AS n_poll_rows FROM clean GROUP BY 1),
t AS (SELECT scenario_id, count(*) AS n FROM tup GROUP BY 1)
SELECT p.*, coalesce(t.n, 0) AS n_unique_5tuples, round(n_poll_rows::DOUBLE / nullif(t.n, 0), 6) AS poll_to_tuple_ratio
FROM p LEFT JOIN t USING (scenario_id)""")
def a7(spark, sf):
    rows = clean(spark, sf)
    out = T.scenario_inventory(rows, T.last_polls(rows))
    return out.withColumn("poll_to_tuple_ratio", F.round("poll_to_tuple_ratio", 6))


# --- fault snapshot parts --------------------------------------------------------------------------

def delta_flows(spark, sf):
    """Fault flow polls with deltas, stamped on 10-minute polls so that several flows share one."""
    rows = T.flow_deltas(flow_features(V.flow_polls(spark, sf)))
    return rows.withColumns({
        "run_id": F.expr("concat('run_', CAST(day(timestamp) AS STRING))"),
        "timestamp": F.expr("timestampadd(MINUTE, 10 * CAST(floor(minute(timestamp) / 10) AS INT), date_trunc('hour', timestamp))")
        .cast("timestamp_ntz")})


_DELTA_FLOWS = f"""{V.FEATURE_SQL},
fp AS (SELECT *, lag(packet_count) OVER w AS pp, lag(byte_count) OVER w AS pb, lag(epoch_us(timestamp)) OVER w AS pt
  FROM features WINDOW w AS (PARTITION BY {STATE} ORDER BY timestamp, flow_id)),
fd AS (SELECT *, greatest((epoch_us(timestamp) - pt) / 1e6::DOUBLE, 1e-6::DOUBLE) AS dt,
  pt IS NOT NULL AND packet_count >= pp AND byte_count >= pb AS ok FROM fp),
delta_flows AS (SELECT * REPLACE (time_bucket(INTERVAL 10 MINUTE, timestamp) AS timestamp,
   concat('run_', CAST(day(timestamp) AS VARCHAR)) AS run_id), CAST(ok AS INT) AS has_delta,
  CASE WHEN ok THEN packet_count - pp ELSE 0 END::DOUBLE AS delta_packet,
  CASE WHEN ok THEN byte_count - pb ELSE 0 END::DOUBLE AS delta_byte,
  CASE WHEN ok THEN (packet_count - pp) / dt ELSE 0 END AS packet_rate_window,
  CASE WHEN ok THEN (byte_count - pb) / dt ELSE 0 END AS byte_rate_window FROM fd)"""

_POLL_SUMS = """poll_sums AS (SELECT run_id, timestamp, CAST(sum(packet_count) AS BIGINT) AS packet_count_sum,
  CAST(sum(byte_count) AS BIGINT) AS byte_count_sum, sum(delta_packet) AS delta_packet_sum,
  sum(delta_byte) AS delta_byte_sum, sum(packet_rate_window) AS packet_rate_window_sum,
  sum(byte_rate_window) AS byte_rate_window_sum, avg(packet_size_avg) AS packet_size_avg_mean,
  avg(duration_sec) AS duration_sec_mean, count(ip_src) AS n_flows FROM delta_flows WHERE has_delta = 1 GROUP BY 1, 2)"""


# Means are rounded finely (their halves are exact), sums of large rates coarsely (their last bits are not).
DIGITS = {c: 7 for c in ("packet_size_avg_mean", "duration_sec_mean", "tcp_share", "drop_rate_core")}


def digits(name):
    return DIGITS.get(name, 3)


def _rounded(df, names):
    return df.select(*[F.round(c, digits(c)).alias(c) if c in names else F.col(c) for c in df.columns])


FLOATS = ["packet_rate_window_sum", "byte_rate_window_sum", "packet_size_avg_mean", "duration_sec_mean",
          "tcp_byte_rate_window_sum", "udp_byte_rate_window_sum", "tcp_share"]


@query("a1_poll_flow_sums", f"""WITH {_DELTA_FLOWS}, {_POLL_SUMS}
SELECT * REPLACE ({", ".join(f"round({c}, {digits(c)}) AS {c}" for c in FLOATS[:4])}) FROM poll_sums""")
def a1(spark, sf):
    return _rounded(T.poll_flow_sums(C.with_delta(delta_flows(spark, sf))), FLOATS)


def _proto_sql(number, prefix):
    return f"""{prefix} AS (SELECT run_id, timestamp AS ts, sum(delta_packet) AS {prefix}_delta_packet_sum,
  sum(byte_rate_window) AS {prefix}_byte_rate_window_sum, count(ip_src) AS n_{prefix}_flows
  FROM delta_flows WHERE has_delta = 1 AND ip_proto = {number} GROUP BY 1, 2),
{prefix}_near AS (SELECT * FROM (SELECT g.run_id, g.timestamp, x.* EXCLUDE (run_id, ts), row_number() OVER (
    PARTITION BY g.run_id, g.timestamp ORDER BY abs(epoch_us(g.timestamp) - epoch_us(x.ts)), x.ts) AS rn
  FROM poll_sums g JOIN {prefix} x ON g.run_id = x.run_id
    AND abs(epoch_us(g.timestamp) - epoch_us(x.ts)) <= 1200000000) WHERE rn = 1)"""


_BY_PROTO = f"""{_DELTA_FLOWS}, {_POLL_SUMS}, {_proto_sql(6, "tcp")}, {_proto_sql(17, "udp")},
by_proto AS (SELECT g.*, coalesce(tcp_delta_packet_sum, 0) AS tcp_delta_packet_sum,
  coalesce(tcp_byte_rate_window_sum, 0) AS tcp_byte_rate_window_sum, coalesce(n_tcp_flows, 0) AS n_tcp_flows,
  coalesce(udp_delta_packet_sum, 0) AS udp_delta_packet_sum,
  coalesce(udp_byte_rate_window_sum, 0) AS udp_byte_rate_window_sum, coalesce(n_udp_flows, 0) AS n_udp_flows,
  coalesce(coalesce(tcp_delta_packet_sum, 0) / nullif(coalesce(tcp_delta_packet_sum, 0)
    + coalesce(udp_delta_packet_sum, 0), 0), 0) AS tcp_share
  FROM poll_sums g LEFT JOIN tcp_near t ON g.run_id = t.run_id AND g.timestamp = t.timestamp
  LEFT JOIN udp_near u ON g.run_id = u.run_id AND g.timestamp = u.timestamp)"""
_ROUND = ", ".join(f"round({c}, {digits(c)}) AS {c}" for c in FLOATS)


@query("a2_a3_protocol_sums_asof", f"WITH {_BY_PROTO} SELECT * REPLACE ({_ROUND}) FROM by_proto")
def a2(spark, sf):
    return _rounded(T.poll_sums_by_protocol(C.with_delta(delta_flows(spark, sf)), "asof", 1200), FLOATS)


@query("a2_protocol_sums_exact", f"""WITH {_DELTA_FLOWS}
SELECT run_id, timestamp, count(CASE WHEN ip_proto = 6 THEN ip_src END) AS n_tcp_flows,
  count(CASE WHEN ip_proto = 17 THEN ip_src END) AS n_udp_flows,
  sum(CASE WHEN ip_proto = 6 THEN delta_packet ELSE 0 END) AS tcp_delta_packet_sum,
  sum(CASE WHEN ip_proto = 17 THEN delta_packet ELSE 0 END) AS udp_delta_packet_sum
FROM delta_flows WHERE has_delta = 1 GROUP BY 1, 2""")
def a2_exact(spark, sf):
    out = T.poll_sums_by_protocol(C.with_delta(delta_flows(spark, sf)), "exact")
    return out.select("run_id", "timestamp", "n_tcp_flows", "n_udp_flows", "tcp_delta_packet_sum", "udp_delta_packet_sum")


_CORE = f"""{_PORT_DELTA}, {V.META_SQL},
core AS (SELECT p.run_id, date_trunc('hour', p.timestamp) AS timestamp, sum(rx_bps) AS rx_bps_core, sum(tx_bps) AS tx_bps_core,
  CAST(sum(delta_rx_dropped) AS BIGINT) AS delta_rx_dropped_core, CAST(sum(delta_tx_dropped) AS BIGINT) AS delta_tx_dropped_core,
  avg(drop_rate) AS drop_rate_core, CAST(sum(delta_rx_errors) AS BIGINT) AS delta_rx_errors_core,
  CAST(sum(delta_tx_errors) AS BIGINT) AS delta_tx_errors_core, coalesce(sum(rx_bps), 0) + coalesce(sum(tx_bps), 0) AS core_bps
  FROM port_deltas p JOIN fault_meta m ON p.run_id = m.run_id
  WHERE has_delta = 1 AND (s1_core_port IS NULL OR s2_core_port IS NULL OR port_no IN (s1_core_port, s2_core_port))
  GROUP BY 1, 2)"""
CORE_FLOATS = ["rx_bps_core", "tx_bps_core", "core_bps", "drop_rate_core"]


def hourly_ports(spark, sf):
    rows = T.port_deltas(V.port_polls(spark, sf))
    return rows.withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))


@query("a4_p10_core_port_sums", f"""WITH {_CORE}
SELECT * REPLACE ({", ".join(f"round({c}, {digits(c)}) AS {c}" for c in CORE_FLOATS)}) FROM core""")
def a4(spark, sf):
    ports = C.with_delta(C.core_ports(hourly_ports(spark, sf), V.fault_meta(spark, sf)))
    return _rounded(T.core_port_sums(ports), CORE_FLOATS)


def _near_sql(name, left, right, cols, tol):
    picks = ", ".join(f"x.{c}" for c in cols)
    return f"""{name} AS (SELECT g.*, {", ".join(f"n.{c}" for c in cols)} FROM {left} g LEFT JOIN (SELECT * FROM (
  SELECT g.run_id AS k_run, g.timestamp AS k_ts, {picks}, row_number() OVER (PARTITION BY g.run_id, g.timestamp
    ORDER BY abs(epoch_us(g.timestamp) - epoch_us(x.timestamp)), x.timestamp) AS rn
  FROM {left} g JOIN {right} x ON g.run_id = x.run_id
    AND abs(epoch_us(g.timestamp) - epoch_us(x.timestamp)) <= {tol}) WHERE rn = 1) n
  ON g.run_id = n.k_run AND g.timestamp = n.k_ts)"""


_CORE_COLS = ["rx_bps_core", "tx_bps_core", "core_bps", "delta_rx_dropped_core", "delta_tx_dropped_core",
              "drop_rate_core", "delta_rx_errors_core", "delta_tx_errors_core"]
_PROBE_COLS = ["rtt_mean_ms", "rtt_min_ms", "rtt_max_ms", "probe_loss_pct", "throughput_mbps", "jitter_ms", "udp_lost_pct"]
_SNAP_ROUND = ", ".join(f"round({c}, {digits(c)}) AS {c}" for c in [*FLOATS, *CORE_FLOATS, *_PROBE_COLS])


@query("fault_snapshots", f"""WITH {_BY_PROTO.replace("WHERE has_delta = 1", "WHERE has_delta = 1 AND ip_dst <> '10.0.1.2'")}, {_CORE}, {V.PROBE_SQL},
probe1 AS (SELECT run_id, p_ts AS timestamp, * EXCLUDE (run_id, p_ts) FROM probes),
{_near_sql("with_core", "by_proto", "core", _CORE_COLS, 1200000000)},
{_near_sql("with_probe", "with_core", "probe1", _PROBE_COLS, 1200000000)}
SELECT s.* REPLACE ({_SNAP_ROUND.replace("round(", "round(s.")}), m.scenario_id, m.fault_label, m.fault_family, m.fault_severity,
  coalesce(m.affected_link, 's1-s2') AS affected_link, m.configured_bw, m.configured_loss, m.configured_delay,
  coalesce(m.traffic, '') AS traffic, coalesce(m.traffic_pair, '') AS traffic_pair, m.protocol,
  coalesce(m.source, 'mininet_lab_fault_run') AS source, 0 AS is_synthetic
FROM with_probe s JOIN fault_meta m ON s.run_id = m.run_id""")
def snapshots(spark, sf):
    """The whole merge: deltas, cross-segment filter, poll sums, core ports, probes, ground truth."""
    flows = delta_flows(spark, sf).where("ip_dst <> '10.0.1.2'")
    out = T.poll_sums_by_protocol(C.with_delta(flows).persist(), "asof", 1200)
    core = T.core_port_sums(C.with_delta(C.core_ports(hourly_ports(spark, sf), V.fault_meta(spark, sf))))
    core = core.withColumnRenamed("timestamp", "port_ts")
    out = O.asof_nearest(out, core, ["run_id"], "timestamp", "port_ts", _CORE_COLS, 1200, left_is_unique=True)
    out = O.asof_nearest(out, V.probes(spark, sf), ["run_id"], "timestamp", "p_ts", _PROBE_COLS, 1200, ["probe_id"],
                         left_is_unique=True)
    return _rounded(T.add_run_metadata(out, V.fault_meta(spark, sf)), [*FLOATS, *CORE_FLOATS, *_PROBE_COLS])


@query("j4_run_metadata", f"""WITH {V.PROBE_SQL}, {V.META_SQL}
SELECT p.probe_id, m.scenario_id, m.fault_family, coalesce(m.affected_link, 's1-s2') AS affected_link,
  coalesce(m.source, 'mininet_lab_fault_run') AS source, coalesce(m.traffic, '') AS traffic, m.configured_bw
FROM probes p JOIN fault_meta m ON p.run_id = m.run_id""")
def j4(spark, sf):
    out = T.add_run_metadata(V.probes(spark, sf), V.fault_meta(spark, sf))
    return out.select("probe_id", "scenario_id", "fault_family", "affected_link", "source", "traffic", "configured_bw")


@query("o2_newest_alerts", f"""WITH {V.FLOW_SQL}
SELECT flow_id, ip_src, label FROM flow_polls WHERE label <> 'normal' ORDER BY timestamp DESC, flow_id DESC LIMIT 500""")
def o2(spark, sf):
    alerts = V.flow_polls(spark, sf).where(C.is_alert(F.upper("label")))
    return T.newest(alerts, 500, ["timestamp", "flow_id"]).select("flow_id", "ip_src", "label")


@query("o1_sorted_polls", f"WITH {V.FEATURE_SQL} SELECT run_id, timestamp, flow_id FROM clean ORDER BY 1, 2, 3")
def o1(spark, sf):
    return clean(spark, sf).select("run_id", "timestamp", "flow_id").orderBy("run_id", "timestamp", "flow_id")


@query("st1_poll_ids", f"""WITH {V.FLOW_SQL}
SELECT CAST(floor(epoch_us(timestamp) / 5000000) AS BIGINT) AS poll_id, count(*) AS n,
  count(DISTINCT datapath_id) AS n_switches FROM flow_polls GROUP BY 1""")
def st1(spark, sf):
    from pollwarden.functions.features import poll_id

    return V.flow_polls(spark, sf).groupBy(poll_id(F.col("timestamp")).alias("poll_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("datapath_id").alias("n_switches"))


@query("f11_freshness", f"""WITH {V.FLOW_SQL}
SELECT ip_src, max(timestamp) >= TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 20 HOUR AS is_fresh FROM flow_polls GROUP BY 1""")
def f11(spark, sf):
    now = F.lit("2024-01-30 20:00:00").cast("timestamp_ntz")
    return V.flow_polls(spark, sf).groupBy("ip_src").agg(F.max("timestamp").alias("t")).select(
        "ip_src", fresh(F.col("t"), now, 20 * 3600).alias("is_fresh"))


