"""Live jobs: scoring, alert log, counters, recent flows, snapshot, configuration and model swap."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.functions.features import flow_features, live_settings
from pollwarden.operators.cleaning import both_endpoints, decode_prediction, is_alert
from pollwarden.operators.ordered import interval_label, window_join
from pollwarden.schemas import ALERT_LABELS
from pollwarden.session import ensure_checkpoint_dir
from pollwarden.sources.sinks import append_bounded, read_current, write_version
from pollwarden.streaming.stateful import poll_windows, stream_mitigation

# Fixed sizes of the live views.
KEEP_ALERTS, KEEP_RECENT, SHOW_RECENT, SHOW_ALERTS, SHOW_BLOCKED, ATTACK_WINDOW = 500, 50, 30, 30, 20, 5
RELOAD_COOLDOWN_SEC = 45
# Event time of the row that closes a finished feed: later than any feed, and within pandas' range.
CLOSING = "2200-01-01"


def run_to_table(stream: DataFrame, schema_mode: str = "append") -> DataFrame:
    """Drain a stream once into files of the shared folder and read them back."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(schema_mode).option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_closed_to_table(feed: DataFrame, build, heartbeat: dict) -> DataFrame:
    """Drain build(feed), then one closing row past all windows and timers, so that what is open at the end of the feed is written too.

    The closing row is read only after the whole feed, whatever its micro-batches; its own window stays open.
    """
    spark = feed.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/closed-{uuid.uuid4().hex}"
    row = spark.range(1).select(*[F.lit(heartbeat.get(f.name)).cast(f.dataType).alias(f.name) for f in feed.schema])
    row.limit(0).write.parquet(f"{base}/closing")
    out = build(feed.unionByName(spark.readStream.schema(feed.schema).parquet(f"{base}/closing")))
    for ended in (False, True):
        if ended:
            row.write.mode("append").parquet(f"{base}/closing")
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(
            availableNow=True).start(f"{base}/rows").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


def closed_poll_windows(scored: DataFrame, interval_sec: int = 5, watermark: str = "10 seconds") -> DataFrame:
    """Poll windows of a finished feed, those still open at its end included."""
    feed = scored.select("timestamp", "ip_src", "prediction")
    return run_closed_to_table(feed, lambda rows: poll_windows(rows, interval_sec, watermark), {"timestamp": CLOSING})


def drain_mitigation(scored: DataFrame, interval_sec: int = 5, watermark: str = "10 seconds", finished: bool = False, **policy) -> DataFrame:
    """Two chained streams: closed polls to a table, then that table to mitigation events.

    A `finished` feed is closed at its end, so its last polls and the ends of its last blocks are in the result; otherwise they stay open.
    """
    spark = scored.sparkSession
    if finished:
        path = f"{ensure_checkpoint_dir(spark)}/polls-{uuid.uuid4().hex}"
        table = closed_poll_windows(scored, interval_sec, watermark)
        table.write.parquet(path)
        last = int(datetime.fromisoformat(CLOSING).replace(tzinfo=timezone.utc).timestamp()) // interval_sec
        return run_closed_to_table(spark.readStream.schema(table.schema).parquet(path), lambda rows: stream_mitigation(
            rows, interval_sec, watermark, **policy), {"poll_id": last, "anomalous": False, "labels": "", "n_flows": 0})
    base = f"{ensure_checkpoint_dir(spark)}/polls-{uuid.uuid4().hex}"
    polls = poll_windows(scored, interval_sec, watermark)
    polls.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(
        availableNow=True).start(f"{base}/rows").awaitTermination()
    closed = spark.readStream.schema(polls.schema).parquet(f"{base}/rows")
    return run_to_table(stream_mitigation(closed, interval_sec, watermark, **policy))


def score(df: DataFrame, model: PipelineModel, name: str = "random_forest_binary") -> DataFrame:
    """Stateless scoring: features, model, live label. Works on batch and streaming frames alike."""
    rows = flow_features(both_endpoints(df))
    out = model.transform(rows)
    return out.withColumn("prediction", decode_prediction(name, F.col("prediction")))


def label_at_ingest(stream: DataFrame, intervals: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Stamp the label that was current at the row's time; an interval without an end is still open."""
    kind = dict(intervals.dtypes)["start_time"]
    open_ended = intervals.withColumn("end_time", F.coalesce("end_time", F.lit("9999-12-31 00:00:00").cast(kind)))
    return interval_label(stream, open_ended, ts)


def alert_rows(scored: DataFrame, blocked: Column | None = None) -> DataFrame:
    """Per-flow alerts with the block state as of that moment."""
    flag = F.lit(False) if blocked is None else blocked
    return scored.where(is_alert(F.col("prediction"))).select(
        "timestamp", "ip_src", "ip_dst", "tp_dst", "ip_proto", "packet_count_per_sec", "byte_count_per_sec", "prediction",
        flag.alias("blocked"))


def alerts_with_block_state(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Mark an alert as blocked when it falls between a BLOCK of its source and the block's end."""
    spans = events.where("event = 'BLOCK'").select("ip_src", F.col("at").alias("_from_ts"), F.col("until").alias("_to_ts"))
    rows = alerts.withColumn("_row", F.xxhash64(*alerts.columns))
    hit = window_join(rows, spans, "timestamp", "_from_ts", "_to_ts", on=["ip_src"])
    inside = hit.where(F.col("timestamp") < F.col("_to_ts")).select("_row").distinct().withColumn("_hit", F.lit(True))
    return rows.join(inside, "_row", "left").withColumn("blocked", F.coalesce("_hit", F.lit(False))).drop("_row", "_hit")


def live_counters(scored: DataFrame) -> DataFrame:
    """Flows analysed and rows per live label; in `complete` mode on a stream."""
    def of(label: str) -> Column:
        return F.count(F.when(F.col("prediction") == label, 1))

    return scored.agg(F.count(F.lit(1)).alias("flows_analyzed"), of("NORMAL").alias("normal_count"), of("DDOS").alias("ddos_count"),
                      of("PORTSCAN").alias("portscan_count"), of("ANOMALY").alias("anomaly_count"))


def counters_with_fallback(counters: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counters as reported; all zero falls back to counting the alert log, flows to its largest count."""
    names = ["normal_count", "ddos_count", "portscan_count", "anomaly_count"]
    seen = alerts.agg(*[F.count(F.when(F.upper("prediction") == n.split("_")[0].upper(), 1)).alias(n) for n in names],
                      F.coalesce(F.max("flows_analyzed"), F.lit(0)).alias("flows_analyzed"))
    empty = F.lit(True)
    for n in names:
        empty = empty & (F.coalesce(F.col(n), F.lit(0)) == 0)
    flows = F.coalesce(F.col("flows_analyzed"), F.lit(0))
    return counters.select(
        F.when(flows > 0, flows).otherwise(seen.select("flows_analyzed").scalar()).alias("flows_analyzed"),
        *[F.when(empty, seen.select(n).scalar()).otherwise(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in names])


def blocked_sources(alerts: DataFrame, live_blocked: DataFrame) -> DataFrame:
    """Sources blocked according to the alert log or the live state, sorted."""
    named = alerts.where(F.col("blocked") & F.col("ip_src").isNotNull() & (F.col("ip_src") != "")).select("ip_src")
    return named.union(live_blocked.select("ip_src")).distinct().orderBy("ip_src")


def latest_attackers(alerts: DataFrame, order: list[str], n: int = ATTACK_WINDOW) -> DataFrame:
    return alerts.orderBy(*[F.desc(c) for c in order]).limit(n).select("ip_src").distinct()


def host_status(hosts: DataFrame, alerts: DataFrame, blocked: DataFrame, order: list[str]) -> DataFrame:
    """BLOCKED over ATTACKING (among the newest alerts) over NORMAL."""
    b = blocked.select(F.col("ip_src").alias("ip")).distinct().withColumn("_b", F.lit(True))
    a = latest_attackers(alerts, order).select(F.col("ip_src").alias("ip")).withColumn("_a", F.lit(True))
    status = F.when(F.col("_b"), "BLOCKED").when(F.col("_a"), "ATTACKING").otherwise("NORMAL")
    return hosts.join(b, "ip", "left").join(a, "ip", "left").withColumn("status", status).drop("_a", "_b")


def live_state(alerts: DataFrame, counters: DataFrame, live_blocked: DataFrame, hosts: DataFrame, order: list[str],
               settings: DataFrame | None = None) -> dict[str, DataFrame]:
    """The views behind the live report: stats, alerts, blocked alerts, hosts, blocked sources, settings."""
    newest = alerts.orderBy(*[F.desc(c) for c in order]).limit(SHOW_ALERTS)
    blocked = blocked_sources(alerts, live_blocked)
    out = {
        "traffic_stats": counters_with_fallback(counters, alerts), "alerts": newest,
        "blocked": newest.where("blocked").orderBy(*[F.desc(c) for c in order]).limit(SHOW_BLOCKED),
        "blocked_sources": blocked, "hosts": host_status(hosts, alerts, blocked, order),
    }
    if settings is not None:
        out["settings"] = live_settings(settings)
    return out


def write_alert_log(stream: DataFrame, base: str, checkpoint: str, order: list[str] | None = None):
    """Bounded alert log: each micro-batch merges its newest alerts and publishes a new version.

    A replayed micro-batch is recognised by its epoch column and changes nothing.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = read_current(spark, base)
        if old is not None and not old.where(F.col("epoch") == epoch).isEmpty():
            return
        append_bounded(spark, batch.withColumn("epoch", F.lit(epoch).cast("long")), base, KEEP_ALERTS, order or ["timestamp"])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_snapshot(stream: DataFrame, base: str, checkpoint: str, settings: dict, model: str = "random_forest_binary"):
    """Live snapshot: counters so far, newest flows, configuration; one small table per micro-batch."""
    def publish(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        counts = live_counters(rows)
        recent = rows.orderBy(F.desc("timestamp"), F.desc("flow_id")).limit(SHOW_RECENT).select(
            F.struct("timestamp", "ip_src", "ip_dst", F.round("packet_count_per_sec", 1).alias("packet_count_per_sec"),
                     F.round("byte_count_per_sec", 1).alias("byte_count_per_sec"), "prediction").alias("r"))
        old = read_current(spark, base)
        names = counts.columns
        if old is not None:
            before = old.first()
            if before["epoch"] >= epoch:
                rows.unpersist()
                return
            counts = counts.select(*[(F.col(n) + F.lit(before[n])).alias(n) for n in names])
            earlier = old.select(F.explode("recent_flows").alias("r"))
            recent = recent.unionByName(earlier).orderBy(F.desc("r.timestamp")).limit(SHOW_RECENT)
        kept = recent.agg(F.sort_array(F.collect_list("r"), asc=False).alias("l"))
        out = counts.withColumns({
            "recent_flows": kept.scalar(), "epoch": F.lit(epoch).cast("long"), "active_model": F.lit(model),
            "config": F.to_json(F.create_map(*[x for k, v in settings.items() for x in (F.lit(k), F.lit(str(v)))])),
        })
        write_version(out, base)
        rows.unpersist()

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ModelSwitch:
    """Model in use for a live job: re-read the settings each micro-batch, load on change, keep the last good one.

    A failed load keeps the old model and waits out a cool-down; a swap resets the label counters.
    """

    def __init__(self, spark: SparkSession, read_settings, load=PipelineModel.load, clock=time.monotonic):
        self.spark, self.read_settings, self.load, self.clock = spark, read_settings, load, clock
        self.name: str | None = None
        self.model = None
        self.settings: dict = {}
        self.error: str | None = None
        self.retry_at = float("-inf")
        self.generation = 0

    def refresh(self):
        raw = self.read_settings() or {}
        kinds = {"polling_interval": "double", "alert_threshold": "int", "block_timeout": "int", "mitigation_enabled": "boolean"}
        row = self.spark.createDataFrame([tuple(raw.get(k) for k in kinds)], ", ".join(f"{k} {t}" for k, t in kinds.items()))
        self.settings = live_settings(row).first().asDict()
        wanted, path = raw.get("selected_model", "random_forest_binary"), raw.get("model_path")
        if path and (wanted, path) != self.name and self.clock() >= self.retry_at:
            try:
                self.model = self.load(path)
                self.name, self.error = (wanted, path), None
                self.generation += 1
            except Exception as exc:  # noqa: BLE001 - the live job goes on with the last good model
                self.error, self.retry_at = f"{type(exc).__name__}: {exc}", self.clock() + RELOAD_COOLDOWN_SEC
        return self.model

    def counters(self, store: dict) -> dict:
        """Label counters of the current model; a swap starts them again."""
        if store.get("generation") != self.generation:
            store.clear()
            store.update({"generation": self.generation, **{k: 0 for k in ("NORMAL", *ALERT_LABELS)}})
        return store

    def run(self, stream: DataFrame, sink, checkpoint: str):
        """foreachBatch job: refresh, score with whatever model is good, hand the rows to the sink."""
        def step(batch: DataFrame, epoch: int) -> None:
            model = self.refresh()
            if model is not None:
                sink(score(batch, model, self.name[0]), epoch, self)

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
