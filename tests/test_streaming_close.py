"""A finished feed is closed at its end: stream rows equal batch rows."""

from collections import Counter

from pyspark.sql import functions as F

from pollwarden import catalog
from pollwarden.catalog import live
from pollwarden.catalog.telemetry import hourly
from pollwarden.operators import telemetry as T
from pollwarden.streaming import live as L


def test_closed_windows_equal_batch(spark, sf):
    columns = ["poll_id", "ip_src", "anomalous", "labels"]
    got = L.closed_poll_windows(live.scored_feed(spark, sf), live.HOUR).select(*columns).collect()
    want = T.poll_observations(hourly(spark, sf)).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_mitigation_of_a_finished_feed_equals_batch(spark, sf):
    columns = ["ip_src", "poll_id", "event", "streak", "labels"]
    queries = catalog.load()[0]
    got = queries["st6_st7_stream_mitigation"](spark, sf).select(*columns).collect()
    want = queries["st6_batch_mitigation"](spark, sf).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_block_at_the_end_of_a_finished_feed(spark, tmp_path):
    rows = [(1_000_000 + k, "10.0.0.1", "DDOS") for k in (0, 5, 10)]
    df = spark.createDataFrame(rows, "t long, ip_src string, prediction string")
    df = df.select(F.timestamp_seconds("t").alias("timestamp"), "ip_src", "prediction")
    df.write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed"))
    events = [(r.event, r.streak) for r in L.drain_mitigation(feed, 5, finished=True).orderBy("at", "event").collect()]
    assert events == [("ALERT", 1), ("ALERT", 2), ("ALERT", 3), ("BLOCK", 3), ("UNBLOCK", 0)]
    assert L.drain_mitigation(feed, 5).count() == 0  # a live feed leaves them open
