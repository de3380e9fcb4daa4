"""Streams must give what the batch twins give, also when state crosses micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pollwarden.catalog import views as V
from pollwarden.operators import telemetry as T
from pollwarden.sources.sinks import append_bounded, current_version, read_current, write_version
from pollwarden.streaming import deltas as D
from pollwarden.streaming import live as L
from pollwarden.streaming import stateful as S

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def feed_of(spark, df, folder, parts=3):
    """Write a frame in time order as several files and read it as a stream, one file per batch."""
    rows = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    low, high = rows.agg(F.min("timestamp").cast("double"), F.max("timestamp").cast("double")).first()
    for i in range(parts):
        a, b = low + (high - low) * i / parts, low + (high - low) * (i + 1) / parts
        sec = F.col("timestamp").cast("double")
        part = rows.where((sec >= a) & ((sec < b) | F.lit(i == parts - 1)))
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_flow_deltas_across_batches(spark, sf, tmp_path):
    polls = V.flow_polls(spark, sf)
    stream = D.drain(feed_of(spark, polls, tmp_path / "f"), D.write_flow_deltas, 10**8)
    names = ["flow_id", "delta_packet", "delta_byte", "has_delta"]
    got = sorted(map(tuple, stream.select(*names).collect()))
    assert got == sorted(map(tuple, T.flow_deltas(polls).select(*names).collect()))


def test_port_deltas_across_batches(spark, sf, tmp_path):
    polls = V.port_polls(spark, sf)
    stream = D.drain(feed_of(spark, polls, tmp_path / "p"), D.write_port_deltas, 10**8)
    names = ["row_id", "delta_rx_packets", "delta_tx_bytes", "delta_rx_dropped", "has_delta"]
    got = sorted(map(tuple, stream.select(*names).collect()))
    assert got == sorted(map(tuple, T.port_deltas(polls).select(*names).collect()))


def deltas_of(spark, batches, folder, idle_sec=3600):
    """Packet deltas by flow_id of files of (flow_id, second, source, packets), one micro-batch a file."""
    schema = "flow_id long, sec double, ip_src string, packet_count long"
    for rows in batches:
        df = spark.createDataFrame([(i, None if t is None else float(t), s, p) for i, t, s, p in rows], schema)
        df = df.select("flow_id", F.timestamp_seconds("sec").alias("timestamp"), F.lit(1).alias("datapath_id"), "ip_src", F.lit("d").alias("ip_dst"),
                       *[F.lit(1).alias(c) for c in ("ip_proto", "tp_src", "tp_dst")], "packet_count", F.col("packet_count").alias("byte_count"),
                       F.lit("extra").alias("_old"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return {r.flow_id: (r.delta_packet, r.has_delta) for r in D.drain(feed, D.write_flow_deltas, idle_sec).collect()}


def test_delta_table_forgets_idle_keys_and_takes_late_rows(spark, tmp_path):
    """Silent keys leave the table; late rows, null keys, repeated rows, rows without a time and an empty feed have defined results."""
    got = deltas_of(spark, [[(1, 0, "a", 10), (2, 0, "b", 5), (3, 5, None, 1)], [(4, 10, "a", 25), (5, 12, None, 4)],
                            [(6, 4, "a", 99), (7, 20, "a", 20)], [(8, 5000, "c", 1), (8, 5000, "c", 1)], [(9, 5010, "b", 50), (10, None, "c", 3)]], tmp_path / "f")
    assert got[1] == got[2] == got[3] == (0.0, 0)
    assert got[4] == (15.0, 1) and got[5] == (3.0, 1)
    assert got[6] == (0.0, 0)            # older than the key's last row
    assert got[7] == (0.0, 0)            # the counter fell: a reset
    assert got[8] in [(0.0, 0), (0.0, 1)] and got[9] == (0.0, 0) and got[10] == (0.0, 0)
    assert deltas_of(spark, [[]], tmp_path / "none") == {}


def test_delta_table_keeps_two_versions(spark, tmp_path):
    import os

    polls = V.flow_polls(spark, "/root/testdata/sf0.001")
    feed = feed_of(spark, polls, tmp_path / "f", parts=5)
    D.write_flow_deltas(feed, str(tmp_path / "out"), 10**8).awaitTermination()
    assert len([f for f in os.listdir(tmp_path / "out" / "last") if not f.startswith(".")]) <= 2
    assert D.read_deltas(spark, str(tmp_path / "out")).count() == polls.count()


def sequential_policy(polls, threshold, block, interval):
    """The published policy, poll by poll, over sets of observed and anomalous sources."""
    streak, until, out = {}, {}, []
    for poll in range(min(polls), max(polls) + 1):
        seen = polls.get(poll, {})
        end = (poll + 1) * interval
        for ip in [i for i, u in until.items() if end >= u]:
            del until[ip]
        for ip in set(streak) | set(seen):
            if not seen.get(ip, False):
                streak[ip] = 0
            elif ip not in until:
                streak[ip] = streak.get(ip, 0) + 1
                out.append((ip, poll, "ALERT", streak[ip]))
                if streak[ip] >= threshold:
                    out.append((ip, poll, "BLOCK", streak[ip]))
                    until[ip] = end + block
                    streak[ip] = 0
    return sorted(out)


@pytest.fixture(scope="module")
def observed(spark):
    rng = random.Random(9)
    polls = {p: {f"ip{i}": rng.random() < 0.7 for i in range(6) if rng.random() < 0.9} for p in range(0, 120)}
    rows = [(p, ip, bad, "DDOS") for p, seen in polls.items() for ip, bad in seen.items()]
    return polls, spark.createDataFrame(rows, "poll_id long, ip_src string, anomalous boolean, labels string")


@pytest.mark.parametrize("block", [10, 120])
def test_batch_mitigation_equals_sequential_policy(observed, block):
    polls, df = observed
    out = S.batch_mitigation(df, 5, block_sec=block).where("event <> 'UNBLOCK'").collect()
    assert sorted((r["ip_src"], r["poll_id"], r["event"], r["streak"]) for r in out) == sequential_policy(polls, 3, block, 5)


@pytest.mark.parametrize("threshold, block", [(1, 5), (1, 0), (2, 35), (3, 7), (4, 600)])
def test_policy_automaton_equals_the_state_machine(spark, monkeypatch, threshold, block):
    """Long runs, gaps and chunk borders, every column, against the row-by-row policy that the stream uses; one source holds most polls."""
    from pollwarden.streaming import policy

    monkeypatch.setattr(policy, "CHUNK_POLLS", 8)
    rng = random.Random(threshold * 1000 + block)
    rows = []
    for ip, polls, risk in [("hot", 400, 0.93), ("a", 60, 0.5), ("b", 60, 0.99), ("c", 5, 1.0), ("d", 40, 0.0)]:
        rows += [(p, ip, rng.random() < risk, f"L{p % 3}") for p in range(polls) if rng.random() < 0.97]
    rows.append((7, None, True, "x"))
    want = []
    for ip in "hot a b c d".split():
        state = S.SourcePolicy(5, threshold, block, True)
        for p, _, bad, labels in sorted(r for r in rows if r[1] == ip):
            want += [(ip, *e) for e in state.observe(p, bad, labels)]
        if state.until:
            want += [(ip, *e) for e in state.expire(state.until, state.last)]
    df = spark.createDataFrame(rows, "poll_id long, ip_src string, anomalous boolean, labels string").repartition(3)
    got = [(r.ip_src, r.poll_id, r.event, r.streak, r.labels, r.at, r.until) for r in S.batch_mitigation(df, 5, threshold, block).collect()]
    plain = lambda e: (e[0], e[1], e[2], e[3], e[4], str(e[5]), str(e[6] or None))
    assert sorted(map(plain, got)) == sorted(map(plain, want))


def test_every_block_ends_once(spark, observed):
    """Also where the source is not seen again, and where two sources of one task follow each other."""
    for block in (10, 120, 10_000):
        rows = S.batch_mitigation(observed[1], 5, block_sec=block)
        ends = sorted((r["ip_src"], r["until"]) for r in rows.where("event = 'BLOCK'").collect())
        assert ends and ends == sorted((r["ip_src"], r["at"]) for r in rows.where("event = 'UNBLOCK'").collect())
    short = spark.createDataFrame([(p, "a", True, "DDOS") for p in range(3)], "poll_id long, ip_src string, anomalous boolean, labels string")
    got = S.batch_mitigation(short, 5, block_sec=120).orderBy("at", "event").collect()
    assert [r["event"] for r in got] == ["ALERT", "ALERT", "ALERT", "BLOCK", "UNBLOCK"] and (got[4]["at"] - got[3]["at"]).seconds == 120


def test_disabled_mitigation_never_blocks(observed):
    assert S.batch_mitigation(observed[1], 5, enabled=False).where("event = 'BLOCK'").count() == 0


def test_stream_mitigation_equals_batch(spark, observed, tmp_path):
    polls, df = observed
    # Two flows per observation: a poll with several alerting flows still counts once.
    flows = df.withColumn("prediction", F.when(F.col("anomalous"), "DDOS").otherwise("NORMAL")).select(
        F.timestamp_micros(F.col("poll_id") * 5_000_000 + 1_000_000).alias("timestamp"), "ip_src", "prediction")
    end = spark.createDataFrame([("sentinel", "NORMAL")], "ip_src string, prediction string").withColumn(
        "timestamp", F.timestamp_micros(F.lit(10_000_000_000)))
    stream = feed_of(spark, flows.union(flows).unionByName(end), tmp_path / "m", parts=1)
    out = L.drain_mitigation(stream, 5, block_sec=30).where("ip_src <> 'sentinel'")
    want = S.batch_mitigation(df, 5, block_sec=30)
    names = ["ip_src", "poll_id", "event", "streak"]
    got = sorted(map(tuple, out.where("event <> 'UNBLOCK'").select(*names).collect()))
    assert got == sorted(map(tuple, want.where("event <> 'UNBLOCK'").select(*names).collect()))
    blocks = out.where("event = 'BLOCK'").count()
    assert blocks > 0 and blocks - 6 <= out.where("event = 'UNBLOCK'").count() <= blocks


def test_policy_constants_and_cases():
    assert (S.ALERT_THRESHOLD, S.BLOCK_SECONDS) == (3, 120)
    policy = S.SourcePolicy(5, 3, 120, True)
    events = [policy.observe(p, bad, "DDOS") for p, bad in enumerate([True, True, False, True, True, True, True])]
    assert [e[1] for rows in events for e in rows] == ["ALERT", "ALERT", "ALERT", "ALERT", "ALERT", "BLOCK"]
    assert policy.until and policy.streak == 0


def test_poll_barrier_closes_once(spark, tmp_path):
    rows = [(at(0), 1), (at(1), 2), (at(2), 1), (at(5), 1), (at(6), 1), (at(100), 1), (at(101), 2)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, datapath_id int")
    out = L.run_to_table(S.stream_poll_barrier(feed_of(spark, df, tmp_path / "b", parts=2), [1, 2], 5)).collect()
    start = int(BASE.replace(tzinfo=dt.timezone.utc).timestamp()) // 5
    assert sorted((r["poll_id"] - start, r["closed_by"], r["n_switches"]) for r in out) == [(0, "barrier", 2), (1, "forced", 1), (20, "barrier", 2)]


def test_alert_log_is_bounded_and_replay_safe(spark, tmp_path):
    rows = spark.range(700).select(F.timestamp_micros(F.col("id") * 1_000_000).alias("timestamp"), F.col("id").alias("flow_id"))
    stream = feed_of(spark, rows, tmp_path / "a")
    base = str(tmp_path / "log")
    L.write_alert_log(stream, base, str(tmp_path / "c"), ["timestamp"]).awaitTermination()
    kept = read_current(spark, base)
    assert kept.count() == 500 and kept.agg(F.min("flow_id")).first()[0] == 200


def test_versions_swap(spark, tmp_path):
    base = str(tmp_path / "v")
    assert current_version(spark, base) == (0, None) and read_current(spark, base) is None
    write_version(spark.range(3), base)
    write_version(read_current(spark, base).where("id > 0"), base)
    assert read_current(spark, base).count() == 2 and current_version(spark, base)[0] == 2
    append_bounded(spark, spark.range(10, 20), base, 5, ["id"])
    assert sorted(r["id"] for r in read_current(spark, base).collect()) == [15, 16, 17, 18, 19]


def test_model_switch_keeps_the_last_good_model(spark):
    wanted = {"selected_model": "a", "model_path": "good", "alert_threshold": 99}
    now = [0.0]

    def load(path):
        if path == "bad":
            raise OSError("cannot read")
        return f"model:{path}"

    switch = L.ModelSwitch(spark, lambda: wanted, load, lambda: now[0])
    assert switch.refresh() == "model:good" and switch.settings["alert_threshold"] == 20
    store = switch.counters({})
    store["DDOS"] = 5
    wanted.update(model_path="bad")
    assert switch.refresh() == "model:good" and "cannot read" in switch.error
    assert switch.counters(store)["DDOS"] == 5
    wanted.update(model_path="next")
    now[0] = 44.0
    assert switch.refresh() == "model:good"
    now[0] = 45.0
    assert switch.refresh() == "model:next" and switch.counters(store)["DDOS"] == 0


def test_alerts_carry_the_block_of_their_moment(spark):
    alerts = spark.createDataFrame([("a", at(1)), ("a", at(50)), ("b", at(50)), ("a", at(500))], "ip_src string, timestamp timestamp_ntz")
    events = spark.createDataFrame([("a", "BLOCK", at(10), at(130))], "ip_src string, event string, at timestamp_ntz, until timestamp_ntz")
    out = L.alerts_with_block_state(alerts, events)
    assert sorted((r["ip_src"], r["timestamp"], r["blocked"]) for r in out.collect()) == [
        ("a", at(1), False), ("a", at(50), True), ("a", at(500), False), ("b", at(50), False)]


def test_live_state_views(spark):
    rows = [("10.0.0.4", "DDOS", True, at(1), 9), ("10.0.0.5", "PORTSCAN", False, at(2), 12), ("10.0.0.5", "DDOS", False, at(3), 11)]
    alerts = spark.createDataFrame(rows, "ip_src string, prediction string, blocked boolean, timestamp timestamp_ntz, flows_analyzed long")
    counters = spark.createDataFrame([(0, 0, 0, 0, 0)], "flows_analyzed long, normal_count long, ddos_count long, portscan_count long, anomaly_count long")
    hosts = spark.createDataFrame([(f"10.0.0.{i}",) for i in range(3, 7)], "ip string")
    live = spark.createDataFrame([("10.0.0.6",)], "ip_src string")
    state = L.live_state(alerts, counters, live, hosts, ["timestamp"], spark.createDataFrame(
        [(99.0, None, 5, None)], "polling_interval double, alert_threshold int, block_timeout int, mitigation_enabled boolean"))
    assert {r["ip"]: r["status"] for r in state["hosts"].collect()} == {
        "10.0.0.3": "NORMAL", "10.0.0.4": "BLOCKED", "10.0.0.5": "ATTACKING", "10.0.0.6": "BLOCKED"}
    assert state["traffic_stats"].first().asDict() == {"flows_analyzed": 12, "normal_count": 0, "ddos_count": 2, "portscan_count": 1, "anomaly_count": 0}
    assert state["settings"].first()["polling_interval"] == 30.0 and state["settings"].first()["block_timeout"] == 10
    assert state["alerts"].count() == 3 and state["blocked"].count() == 1
