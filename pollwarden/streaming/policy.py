"""The mitigation policy over recorded polls as a finite automaton, in DataFrame operations.

Anomalous polls in a row form a run. Inside a run the policy repeats itself: `threshold` alerts, the last of them a block, then silence
while the block holds. So all that passes from one run to the next is the poll at which the last block is over, and that lies less than one block
length past the run's start: an automaton with as many states as a block has polls. Every chunk of a source's runs becomes a table from the
state it may be entered in to the state it is left in; the tables, one row to a chunk, are applied one after the other along the source;
then every chunk, knowing its entry state, fills in its events. The fact rows of a hot source are spread over its chunks and runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollwarden.operators.ordered import number_rows

MICROS = 1_000_000
#: Polls of a chunk: one hour of 5-second polls, or a block's length where that is longer.
CHUNK_POLLS = 720


def _appended(entries: Column, one: Column) -> Column:
    return F.concat(entries, F.array(one))


def mitigation_events(observed: DataFrame, interval_sec: float, threshold: int, block_sec: int, enabled: bool) -> DataFrame:
    """ALERT, BLOCK and UNBLOCK rows of `observed` (ip_src, poll_id, anomalous, labels; one row per poll and source).

    A poll in which a source is missing counts as benign. A block ends at the first poll of its source that closes at or after its end, or with its
    source's last poll. Rows without a source are left out.
    """
    width = int(interval_sec * MICROS)
    length = max(1, -(-block_sec * MICROS // width))  # polls from a block to the first that it no longer covers
    period = threshold - 1 + length
    size = max(CHUNK_POLLS, length)
    seen = observed.where("ip_src IS NOT NULL").select("ip_src", F.col("poll_id").cast("long").alias("poll_id"), "anomalous", "labels")
    chunk = lambda c: F.floor(F.col(c) / F.lit(size))
    hits = number_rows(seen.where("anomalous"), ["ip_src"], [F.col("poll_id")], chunk("poll_id"), "_n")
    hits = hits.withColumn("_island", F.col("poll_id") - F.col("_n"))
    runs = hits.groupBy("ip_src", "_island").agg(F.min("poll_id").alias("start"), F.max("poll_id").alias("end"))
    if enabled:
        runs = _with_release(runs.withColumn("_c", chunk("start")), threshold, length, period)
    else:
        runs = runs.withColumn("_free", F.col("start"))
    rows = hits.join(runs.select("ip_src", "_island", F.greatest("start", "_free").alias("_from")), ["ip_src", "_island"])
    at = F.col("poll_id") - F.col("_from")
    phase = F.pmod(at, F.lit(period)) if enabled else at
    alerts = rows.where(at >= 0).withColumn("streak", (phase + 1).cast("int"))
    if enabled:
        alerts = alerts.where(F.col("streak") <= threshold)
    closed = (F.col("poll_id") + 1) * width
    none = F.lit(None).cast("timestamp")
    kinds = F.array(F.lit("ALERT"), F.when((F.col("streak") == threshold) & F.lit(enabled), F.lit("BLOCK")))
    events = alerts.withColumn("event", F.explode(F.array_compact(kinds))).select(
        "ip_src", "poll_id", "event", "streak", "labels", F.timestamp_micros(closed).alias("at"),
        F.when(F.col("event") == "BLOCK", F.timestamp_micros(closed + block_sec * MICROS)).alias("until"))
    if not enabled:
        return events
    blocks = alerts.where(F.col("streak") == threshold).select("ip_src", F.col("poll_id").alias("_block"))
    ends = _next_poll(seen.select("ip_src", "poll_id"), blocks.withColumn("_x", F.col("_block") + length), chunk)
    over = F.timestamp_micros((F.col("_block") + 1) * width + block_sec * MICROS)
    return events.unionByName(ends.select("ip_src", "poll_id", F.lit("UNBLOCK").alias("event"), F.lit(0).alias("streak"), F.lit("").alias("labels"),
                                          over.alias("at"), none.alias("until")))


def _with_release(runs: DataFrame, threshold: int, length: int, period: int) -> DataFrame:
    """runs (ip_src, _island, start, end, _c) with `_free`: the first poll that blocks of earlier runs no longer cover."""
    def left(free: Column, run: Column) -> Column:
        """State after a run that is entered with `free`."""
        first = F.greatest(run["start"], free)
        blocks = F.floor((run["end"] - first - (threshold - 1)) / F.lit(period)) + 1
        return F.when(run["end"] - first + 1 >= threshold, first + (blocks - 1) * period + (threshold - 1) + length).otherwise(free).cast("long")

    parts = runs.groupBy("ip_src", "_c").agg(F.array_sort(F.collect_list(F.struct("start", "end", "_island"))).alias("runs"))  # at most half a chunk
    parts = parts.withColumn("first", F.get("runs", F.lit(0))["start"])
    states = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")), lambda o: F.col("first") + o)
    tables = parts.select("ip_src", "_c", "first", F.aggregate(
        "runs", states, lambda all_, run: F.transform(all_, lambda free: left(free, run))).alias("leaves"))
    entry = "array<struct<_c:bigint,free:bigint>>"

    def follow(so_far: Column, part: Column) -> Column:
        into = F.greatest(so_far["free"], part["first"]) - part["first"]
        return F.struct(F.get(part["leaves"], into.cast("int")).alias("free"),
                        _appended(so_far["entries"], F.struct(part["_c"].alias("_c"), so_far["free"].alias("free"))).cast(entry).alias("entries"))

    along = tables.groupBy("ip_src").agg(F.array_sort(F.collect_list(F.struct("_c", "first", "leaves"))).alias("parts"))  # a row for each chunk
    start = F.struct(F.lit(-(2**62)).cast("long").alias("free"), F.array().cast(entry).alias("entries"))
    entered = along.select("ip_src", F.explode(F.aggregate("parts", start, follow)["entries"]).alias("e")).select("ip_src", "e._c", "e.free")
    run_entry = "array<struct<_island:bigint,start:bigint,free:bigint>>"

    def fill(so_far: Column, run: Column) -> Column:
        return F.struct(left(so_far["free"], run).alias("free"), _appended(so_far["entries"], F.struct(
            run["_island"].alias("_island"), run["start"].alias("start"), so_far["free"].alias("free"))).cast(run_entry).alias("entries"))

    begin = F.struct(F.col("free").alias("free"), F.array().cast(run_entry).alias("entries"))
    filled = parts.join(entered, ["ip_src", "_c"]).select("ip_src", F.explode(F.aggregate("runs", begin, fill)["entries"]).alias("e"))
    return filled.select("ip_src", "e._island", "e.start", F.col("e.free").alias("_free"))


def _next_poll(seen: DataFrame, probes: DataFrame, chunk) -> DataFrame:
    """probes (ip_src, _x, ...) with poll_id: the source's first poll at or after _x, or its last one."""
    rest = [c for c in probes.columns if c not in ("ip_src", "_x")]
    both = seen.select("ip_src", F.col("poll_id").alias("_x"), "poll_id").unionByName(
        probes.withColumn("poll_id", F.lit(None).cast("long")), allowMissingColumns=True).withColumn("_c", chunk("_x"))
    inside = Window.partitionBy("ip_src", "_c").orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, 0)
    asked = both.withColumn("_in", F.min("poll_id").over(inside)).where(F.col(rest[0]).isNotNull())
    later = Window.partitionBy("ip_src").orderBy("_c").rowsBetween(1, Window.unboundedFollowing)
    heads = both.groupBy("ip_src", "_c").agg(F.min("poll_id").alias("_head")).withColumn("_after", F.first("_head", ignorenulls=True).over(later))
    last = seen.groupBy("ip_src").agg(F.max("poll_id").alias("_last"))
    found = asked.drop("poll_id").join(heads.drop("_head"), ["ip_src", "_c"]).join(last, "ip_src")
    return found.select("ip_src", *rest, F.coalesce("_in", "_after", "_last").alias("poll_id"))
