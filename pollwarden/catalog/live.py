"""Streaming operators, run as one drain of the event table, and the live report views."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollwarden.catalog import query
from pollwarden.catalog import views as V
from pollwarden.catalog.telemetry import OBS_SQL, STATE, _PORT_DELTA, hourly
from pollwarden.functions.features import flow_features
from pollwarden.operators import cleaning as C
from pollwarden.operators import telemetry as T
from pollwarden.streaming import deltas as D
from pollwarden.streaming import live as L
from pollwarden.streaming import stateful as S

HOUR = 3600


class FeedSession:
    """A session look-alike whose `read` is the streaming reader, so the batch views serve a live feed."""

    def __init__(self, spark):
        self.spark = spark
        self.read = self

    def parquet(self, path):
        schema = self.spark.read.parquet(path).schema
        return self.spark.readStream.schema(schema).parquet(path.replace(".parquet", "*.parquet"))


def feed(spark, sf, view):
    return view(FeedSession(spark), sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def scored_feed(spark, sf):
    return feed(spark, sf, V.flow_polls).withColumn("prediction", F.upper("label"))


@query("st2_stream_flow_deltas", f"""WITH {V.FLOW_SQL},
p AS (SELECT *, lag(packet_count) OVER w AS pp, lag(byte_count) OVER w AS pb, lag(epoch_us(timestamp)) OVER w AS pt
  FROM flow_polls WINDOW w AS (PARTITION BY {STATE} ORDER BY timestamp, flow_id)),
d AS (SELECT *, greatest((epoch_us(timestamp) - pt) / 1e6::DOUBLE, 1e-6::DOUBLE) AS dt,
  pt IS NOT NULL AND packet_count >= pp AND byte_count >= pb AS ok FROM p)
SELECT flow_id, CASE WHEN ok THEN packet_count - pp ELSE 0 END::DOUBLE AS delta_packet,
  CASE WHEN ok THEN byte_count - pb ELSE 0 END::DOUBLE AS delta_byte,
  round(CASE WHEN ok THEN (packet_count - pp) / dt ELSE 0 END, 6) AS packet_rate_window,
  round(CASE WHEN pt IS NULL THEN 0 ELSE dt END, 6) AS dt_sec, CAST(ok AS INT) AS has_delta FROM d""")
def st2(spark, sf):
    out = D.drain(feed(spark, sf, V.flow_polls), D.write_flow_deltas)
    return out.select("flow_id", "delta_packet", "delta_byte", F.round("packet_rate_window", 6).alias("packet_rate_window"),
                      F.round("dt_sec", 6).alias("dt_sec"), "has_delta")


@query("st3_stream_port_deltas", f"""WITH {_PORT_DELTA}
SELECT row_id, delta_rx_packets, delta_tx_packets, delta_rx_bytes, round(rx_bps, 4) AS rx_bps, round(drop_rate, 6) AS drop_rate, has_delta
FROM port_deltas""")
def st3(spark, sf):
    out = D.drain(feed(spark, sf, V.port_polls), D.write_port_deltas)
    return out.select("row_id", "delta_rx_packets", "delta_tx_packets", "delta_rx_bytes", F.round("rx_bps", 4).alias("rx_bps"),
                      F.round("drop_rate", 6).alias("drop_rate"), "has_delta")


@query("st5_stream_poll_barrier", f"""WITH {V.FLOW_SQL},
p AS (SELECT CAST(floor(epoch_us(timestamp) / 3600000000) AS BIGINT) AS poll_id, count(DISTINCT datapath_id) AS n FROM flow_polls GROUP BY 1)
SELECT poll_id, n::INT AS n_switches, CASE WHEN n = 2 THEN 'barrier' ELSE 'forced' END AS closed_by FROM p""")
def st5(spark, sf):
    """The feed has ended, so a poll that still waits for a switch is closed by force."""
    rows = feed(spark, sf, V.flow_polls).select("timestamp", "datapath_id")
    return L.run_closed_to_table(rows, lambda polls: S.stream_poll_barrier(polls, [1, 2], HOUR), {"timestamp": L.CLOSING, "datapath_id": -1})


@query("st1_stream_poll_windows", f"""WITH {OBS_SQL} SELECT poll_id, ip_src, anomalous, labels, n_flows FROM obs""")
def st1(spark, sf):
    """Polls of a feed that has ended, the last ones included."""
    out = L.closed_poll_windows(scored_feed(spark, sf), HOUR)
    return out.select("poll_id", "ip_src", "anomalous", "labels", "n_flows")


@query("st6_stream_streaks", f"""WITH {OBS_SQL},
h AS (SELECT *, poll_id - row_number() OVER (PARTITION BY ip_src ORDER BY poll_id) AS island FROM obs WHERE anomalous)
SELECT poll_id, ip_src, labels, row_number() OVER (PARTITION BY ip_src, island ORDER BY poll_id)::INT AS streak FROM h""")
def st6c(spark, sf):
    """With blocking switched off the state machine's streaks are islands of consecutive poll numbers."""
    out = L.drain_mitigation(scored_feed(spark, sf), HOUR, finished=True, enabled=False)
    return out.select("poll_id", "ip_src", "labels", "streak")


# The policy poll by poll: `free` is the end of a block that is over, `ends` the end of one that is not.
POLICY_SQL = f"""WITH RECURSIVE {OBS_SQL},
o AS (SELECT ip_src, poll_id, anomalous, labels, (poll_id + 1) * 3600000000 AS closed, row_number() OVER (PARTITION BY ip_src ORDER BY poll_id) AS n FROM obs),
s AS (SELECT DISTINCT ip_src, 0::BIGINT AS n, -2::BIGINT AS poll_id, '' AS labels, 0::BIGINT AS closed, 0 AS streak, false AS alert, 0::BIGINT AS free, 0::BIGINT AS ends FROM obs
  UNION ALL
  SELECT ip_src, n, poll_id, labels, closed, streak, alert, free, CASE WHEN alert AND streak >= 3 THEN closed + 21600000000 ELSE ends END
  FROM (SELECT *, anomalous AND ends = 0 AS alert, CASE WHEN anomalous AND ends = 0 THEN going + 1 ELSE 0 END AS streak
    FROM (SELECT o.*, CASE WHEN s.ends > 0 AND o.closed >= s.ends THEN s.ends ELSE 0 END AS free, CASE WHEN o.closed >= s.ends THEN 0 ELSE s.ends END AS ends,
            CASE WHEN o.poll_id = s.poll_id + 1 AND s.streak < 3 THEN s.streak ELSE 0 END AS going
          FROM s JOIN o ON o.ip_src = s.ip_src AND o.n = s.n + 1))),
e AS (SELECT ip_src, poll_id, 'UNBLOCK' AS event, 0 AS streak, '' AS labels, free AS at_micros, NULL::BIGINT AS until_micros FROM s WHERE free > 0
  UNION ALL SELECT ip_src, poll_id, 'ALERT', streak, labels, closed, NULL FROM s WHERE alert
  UNION ALL SELECT ip_src, poll_id, 'BLOCK', streak, labels, closed, ends FROM s WHERE alert AND streak >= 3
  UNION ALL SELECT ip_src, poll_id, 'UNBLOCK', 0, '', ends, NULL FROM s WHERE ends > 0 AND n = (SELECT max(n) FROM o WHERE o.ip_src = s.ip_src))
SELECT ip_src, poll_id, event, streak, labels, at_micros, until_micros FROM e"""


@query("st6_batch_mitigation", POLICY_SQL)
def st6b(spark, sf):
    out = S.batch_mitigation(T.poll_observations(hourly(spark, sf)), HOUR, block_sec=6 * HOUR)
    return out.select("ip_src", "poll_id", "event", "streak", "labels", F.unix_micros("at").alias("at_micros"), F.unix_micros("until").alias("until_micros"))


@query("st6_st7_stream_mitigation", POLICY_SQL)
def st6(spark, sf):
    """The feed has ended, so its last polls are closed too: the same events as the batch policy's."""
    out = L.drain_mitigation(scored_feed(spark, sf), HOUR, finished=True, block_sec=6 * HOUR)
    return out.select("ip_src", "poll_id", "event", "streak", "labels", F.unix_micros("at").alias("at_micros"), F.unix_micros("until").alias("until_micros"))


@query("st4_stream_scoring", f"WITH {V.FLOW_SQL} SELECT flow_id, ip_src, true AS is_answer FROM flow_polls")
def st4(spark, sf):
    """A forest of the published size, fitted on the recorded polls, scores the same polls as a feed: one answer a poll."""
    from pollwarden.plans.jobs import fit_final_model

    model = fit_final_model(flow_features(V.flow_polls(spark, sf)))["model"]
    out = L.score(feed(spark, sf, V.flow_polls), model)
    return L.run_to_table(out.select("flow_id", "ip_src", F.col("prediction").isin("NORMAL", "ANOMALY").alias("is_answer")))


@query("st10_model_switch", f"WITH {V.FLOW_SQL} SELECT count(*) AS n_flows, count(*) AS n_answers, 1::BIGINT AS generation FROM flow_polls")
def st10(spark, sf):
    """A live job loads the model that its settings name, and goes on with it when a later setting names one that cannot be loaded."""
    from pollwarden.catalog.files import fresh_folder
    from pollwarden.plans.jobs import Effort, fit_final_model

    base = fresh_folder(spark, "switch")
    fit_final_model(flow_features(V.flow_polls(spark, sf)), effort=Effort(trees=20, depth=6))["model"].save(f"{base}/model")
    asked = iter([f"{base}/model"])
    switch = L.ModelSwitch(spark, lambda: {"model_path": next(asked, f"{base}/none")})

    def keep(rows, epoch, state):
        rows.select("flow_id", "prediction", F.lit(state.generation).alias("generation")).write.mode("overwrite").parquet(f"{base}/rows/batch={epoch}")

    parts = V.flow_polls(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    parts.repartitionByRange(3, "timestamp").write.parquet(f"{base}/feed")
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/feed")
    switch.run(stream, keep, f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/rows").agg(
        F.count(F.lit(1)).alias("n_flows"), F.count(F.when(F.col("prediction").isin("NORMAL", "ANOMALY"), 1)).alias("n_answers"),
        F.max("generation").cast("long").alias("generation"))

@query("st8_stream_alerts", f"""WITH {V.FEATURE_SQL} SELECT ip_src, ip_dst, tp_dst, ip_proto, round(packet_count_per_sec, 6) AS packet_count_per_sec,
  upper(label) AS prediction, false AS blocked FROM features WHERE label <> 'normal'""")
def st8(spark, sf):
    out = L.run_to_table(L.alert_rows(flow_features(scored_feed(spark, sf))))
    return out.select("ip_src", "ip_dst", "tp_dst", "ip_proto", F.round("packet_count_per_sec", 6).alias("packet_count_per_sec"),
                      "prediction", "blocked")


@query("k4_st8_bounded_alert_log", f"""WITH {V.FEATURE_SQL} SELECT flow_id, ip_src, upper(label) AS prediction FROM features WHERE label <> 'normal'
ORDER BY timestamp DESC, flow_id DESC LIMIT 500""")
def k4(spark, sf):
    from pollwarden.session import ensure_checkpoint_dir
    from pollwarden.sources.sinks import read_current

    base = f"{ensure_checkpoint_dir(spark)}/alerts-{L.uuid.uuid4().hex}"
    alerts = flow_features(scored_feed(spark, sf)).where(C.is_alert(F.col("prediction")))
    L.write_alert_log(alerts, base, f"{base}/checkpoint", ["timestamp", "flow_id"]).awaitTermination()
    return read_current(spark, base).select("flow_id", "ip_src", "prediction")


@query("k5_st9_live_snapshot", f"""WITH {V.FLOW_SQL} SELECT count(*) AS flows_analyzed, count(*) FILTER (label='normal') AS normal_count,
  count(*) FILTER (label='ddos') AS ddos_count, count(*) FILTER (label='portscan') AS portscan_count, 0::BIGINT AS anomaly_count, 30 AS n_recent FROM flow_polls""")
def k5(spark, sf):
    from pollwarden.session import ensure_checkpoint_dir
    from pollwarden.sources.sinks import read_current

    base = f"{ensure_checkpoint_dir(spark)}/snapshot-{L.uuid.uuid4().hex}"
    rows = flow_features(scored_feed(spark, sf))
    L.write_snapshot(rows, base, f"{base}/checkpoint", {"polling_interval": 5.0}).awaitTermination()
    return read_current(spark, base).select("flows_analyzed", "normal_count", "ddos_count", "portscan_count", "anomaly_count",
                                            F.size("recent_flows").alias("n_recent"))


@query("st11_label_at_ingest", f"""WITH {V.FLOW_SQL}, {V.INTERVAL_SQL}
SELECT f.flow_id, coalesce(arg_max(i.label, i.idx), 'normal') AS label FROM flow_polls f LEFT JOIN label_intervals i
  ON f.timestamp >= i.start_time AND (i.idx = 2 OR f.timestamp <= i.end_time) GROUP BY 1""")
def st11(spark, sf):
    """The last interval is still open when the feed is read."""
    intervals = V.label_intervals(spark).withColumn("end_time", F.when(F.col("idx") != 2, F.col("end_time")))
    out = L.label_at_ingest(feed(spark, sf, V.flow_polls).drop("label"), intervals)
    return L.run_to_table(out.select("flow_id", "label"))


def alerts(spark, sf):
    rows = flow_features(V.flow_polls(spark, sf)).where("label <> 'normal'")
    return rows.withColumns({"prediction": F.upper("label"), "blocked": F.col("packet_count") > 900_000,
                             "flows_analyzed": F.col("flow_id")})


_ALERT_SQL = f"""{V.FLOW_SQL}, alerts AS (SELECT *, upper(label) AS prediction, packet_count > 900000 AS blocked FROM flow_polls WHERE label <> 'normal')"""


def no_counters(spark, sf):
    """Counters of a feed that has classified nothing yet."""
    return L.live_counters(V.flow_polls(spark, sf).select(F.lit("PENDING").alias("prediction"))).withColumn("flows_analyzed", F.lit(0))


@query("a26_counters_with_fallback", f"""WITH {_ALERT_SQL} SELECT max(flow_id) AS flows_analyzed, 0 AS normal_count,
  count(*) FILTER (prediction='DDOS') AS ddos_count, count(*) FILTER (prediction='PORTSCAN') AS portscan_count, 0 AS anomaly_count FROM alerts""")
def a26(spark, sf):
    return L.counters_with_fallback(no_counters(spark, sf), alerts(spark, sf))


@query("a26_live_counters", f"""WITH {V.FLOW_SQL} SELECT count(*) AS flows_analyzed, count(*) FILTER (label='normal') AS normal_count,
  count(*) FILTER (label='ddos') AS ddos_count, count(*) FILTER (label='portscan') AS portscan_count, 0::BIGINT AS anomaly_count FROM flow_polls""")
def a26b(spark, sf):
    return L.live_counters(V.flow_polls(spark, sf).withColumn("prediction", F.upper("label")))


def _state(spark, sf):
    blocked = V.flow_polls(spark, sf).where("label = 'ddos' AND packet_count > 990000")
    hosts = V.flow_polls(spark, sf).select(F.col("ip_src").alias("ip")).distinct()
    return L.live_state(alerts(spark, sf), no_counters(spark, sf), blocked, hosts, ["timestamp", "flow_id"])


_BLOCKED = "bl AS (SELECT ip_src FROM alerts WHERE blocked UNION SELECT ip_src FROM flow_polls WHERE label = 'ddos' AND packet_count > 990000)"


@query("f16_st12_host_status", f"""WITH {_ALERT_SQL}, {_BLOCKED}, att AS (SELECT DISTINCT ip_src FROM (SELECT ip_src FROM alerts ORDER BY timestamp DESC, flow_id DESC LIMIT 5))
SELECT h.ip, CASE WHEN h.ip IN (SELECT ip_src FROM bl) THEN 'BLOCKED' WHEN h.ip IN (SELECT ip_src FROM att) THEN 'ATTACKING' ELSE 'NORMAL' END AS status
FROM (SELECT DISTINCT ip_src AS ip FROM flow_polls) h""")
def f16(spark, sf):
    return _state(spark, sf)["hosts"]


@query("st12_recent_alerts", f"""WITH {_ALERT_SQL} SELECT flow_id, ip_src, prediction, blocked FROM alerts ORDER BY timestamp DESC, flow_id DESC LIMIT 30""")
def st12(spark, sf):
    return _state(spark, sf)["alerts"].select("flow_id", "ip_src", "prediction", "blocked")


@query("st12_blocked_sources", f"WITH {_ALERT_SQL}, {_BLOCKED} SELECT ip_src FROM bl")
def st12b(spark, sf):
    return _state(spark, sf)["blocked_sources"]
