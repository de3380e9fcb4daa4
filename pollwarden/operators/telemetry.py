"""Counter deltas, poll selection, behaviour windows and the per-poll fault snapshot."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwarden.functions.features import numeric, ratio, seconds_between, tcp_share
from pollwarden.operators.cleaning import core_ports, cross_segment, is_alert, with_delta
from pollwarden.operators.ordered import HOUR, asof_nearest, first_rows, number_rows, previous_row, time_chunk
from pollwarden.schemas import (
    CORE_PORT_SUMS, FLOW_KEY, FLOW_SUMS, PORT_COUNTERS, PROBE_VALUES, PROTOCOL_SUMS, SOURCE_FAULT,
    require_columns,
)
from pollwarden.session import sized

FLOW_STATE_KEY = ["datapath_id", "ip_src", "ip_dst", "ip_proto", "tp_src", "tp_dst"]
PORT_STATE_KEY = ["datapath_id", "port_no"]


# --- polls of a flow -------------------------------------------------------------------------------

def poll_index(df: DataFrame, tie_break: str = "flow_id", chunk_seconds: int = HOUR) -> DataFrame:
    """0-based number of each poll of a flow key within its run."""
    require_columns(df, FLOW_KEY)
    order = [F.col("timestamp"), F.col(tie_break)]
    return number_rows(df, FLOW_KEY, order, time_chunk(F.col("timestamp"), chunk_seconds), "poll_index")


def seconds_from_run_start(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Age of each row within its run. The per-run minimum is a small aggregate (of `of`, if given) joined back."""
    start = (of or df).groupBy("run_id").agg(F.min("timestamp").alias("_start"))
    out = df.join(sized(start), "run_id", "left")
    out = out.withColumn("seconds_from_run_start", seconds_between(F.col("timestamp"), F.col("_start")))
    return out.select(*df.columns, "seconds_from_run_start")


def early_polls(df: DataFrame, max_polls: int = 3, tie_break: str = "flow_id") -> DataFrame:
    """First polls of each flow key, with their number and their age in the run."""
    if max_polls < 1:
        raise ValueError("max_polls must be at least 1")
    require_columns(df, FLOW_KEY)
    order = [F.col("timestamp"), F.col(tie_break)]
    kept = first_rows(df, FLOW_KEY, order, max_polls, rank="_rank")
    kept = kept.withColumn("poll_index", (F.col("_rank") - 1).cast("int")).drop("_rank")
    # A run's first row is always a first poll, so its start can be read off the unranked rows.
    return seconds_from_run_start(kept, of=df)


def last_polls(df: DataFrame, keys: list[str] = FLOW_KEY, tie_break: str = "flow_id") -> DataFrame:
    """Last poll of each flow key; a row without a readable time counts as last."""
    return first_rows(df, keys, [F.desc_nulls_first("timestamp"), F.desc(tie_break)], 1)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the given order."""
    return first_rows(df, keys, [F.desc(c) for c in order], 1)


# --- counter deltas --------------------------------------------------------------------------------

def flow_deltas(df: DataFrame, tie_break: str = "flow_id", chunk_seconds: int = HOUR) -> DataFrame:
    """Change since the previous poll of (switch, 5-tuple). A counter that fell is a reset: no delta."""
    rows = previous_row(df, FLOW_STATE_KEY, ["timestamp", tie_break],
                        ["timestamp", "packet_count", "byte_count"],
                        time_chunk(F.col("timestamp"), chunk_seconds))
    prev = F.col("previous")
    packets = F.col("packet_count") - prev["packet_count"]
    octets = F.col("byte_count") - prev["byte_count"]
    dt = F.greatest(seconds_between(F.col("timestamp"), prev["timestamp"]), F.lit(1e-6))
    usable = prev.isNotNull() & (packets >= 0) & (octets >= 0)
    return rows.withColumns({
        "delta_packet": F.when(usable, packets).otherwise(0).cast("double"),
        "delta_byte": F.when(usable, octets).otherwise(0).cast("double"),
        "packet_rate_window": F.when(usable, packets / dt).otherwise(0.0),
        "byte_rate_window": F.when(usable, octets / dt).otherwise(0.0),
        "dt_sec": F.when(prev.isNotNull(), dt).otherwise(0.0),
        "has_delta": usable.cast("int"),
    }).drop("previous")


def port_deltas(df: DataFrame, tie_break: str = "row_id", chunk_seconds: int = HOUR) -> DataFrame:
    """Change of every port counter, each clamped at zero on its own; rates from the clamped values."""
    rows = previous_row(df, PORT_STATE_KEY, ["timestamp", tie_break], ["timestamp", *PORT_COUNTERS],
                        time_chunk(F.col("timestamp"), chunk_seconds))
    prev = F.col("previous")
    seen = prev.isNotNull()
    rows = rows.withColumns({
        f"delta_{c}": F.when(seen, F.greatest(F.col(c) - prev[c], F.lit(0))).otherwise(0).cast("long")
        for c in PORT_COUNTERS
    })
    dt = F.greatest(seconds_between(F.col("timestamp"), prev["timestamp"]), F.lit(1e-6))
    dropped = F.col("delta_rx_dropped") + F.col("delta_tx_dropped")
    return rows.withColumns({
        "rx_bps": F.when(seen, F.col("delta_rx_bytes") * 8.0 / dt).otherwise(0.0),
        "tx_bps": F.when(seen, F.col("delta_tx_bytes") * 8.0 / dt).otherwise(0.0),
        "drop_rate": ratio(dropped, F.col("delta_rx_packets") + F.col("delta_tx_packets")),
        "dt_sec": F.when(seen, dt).otherwise(0.0),
        "has_delta": seen.cast("int"),
    }).drop("previous")


def live_packet_rate(df: DataFrame, interval_sec: float = 5.0, tie_break: str = "flow_id",
                     chunk_seconds: int = HOUR) -> DataFrame:
    """Packet change per configured poll interval, as the live view shows it; 0 on first sight."""
    rows = previous_row(df, FLOW_STATE_KEY, ["timestamp", tie_break], ["packet_count"],
                        time_chunk(F.col("timestamp"), chunk_seconds))
    change = F.greatest(F.col("packet_count") - F.col("previous.packet_count"), F.lit(0))
    rate = F.coalesce(change / F.lit(max(0.1, float(interval_sec))), F.lit(0.0))
    return rows.withColumn("packet_delta_per_sec", rate).drop("previous")


# --- behaviour windows and inventories -------------------------------------------------------------

def behaviour_windows(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct ports, distinct peers and flow count of a source at one poll; NULL keys group and match."""
    keys = ["run_id", "timestamp", "ip_src"]
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    stats = df.groupBy(F.struct(*keys).alias("_k")).agg(
        distinct(F.col("tp_dst")).alias("win_unique_dst_ports"),
        distinct(F.col("ip_dst")).alias("win_unique_dst_ips"),
        F.count("flow_id").alias("win_flow_count"),
    )
    return df.withColumn("_k", F.struct(*keys)).join(stats, "_k", "left").drop("_k")


def scenario_inventory(polls: DataFrame, tuples: DataFrame) -> DataFrame:
    """Per scenario: label, runs, poll rows, tuples and their ratio."""
    named = polls.where(F.col("scenario_id").isNotNull())
    rows = named.groupBy("scenario_id").agg(
        F.mode("label", deterministic=True).alias("label"),
        F.count_distinct("run_id").alias("n_runs"),
        F.count(F.lit(1)).alias("n_poll_rows"),
    )
    uniq = tuples.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("_t"))
    return rows.join(uniq, "scenario_id", "left").select(
        "scenario_id", "label", "n_runs", "n_poll_rows",
        F.coalesce("_t", F.lit(0)).alias("n_unique_5tuples"),
        ratio(F.col("n_poll_rows"), F.col("_t"), None).alias("poll_to_tuple_ratio"),
    )


# --- fault snapshot --------------------------------------------------------------------------------

def poll_flow_sums(flows: DataFrame) -> DataFrame:
    """Flow counters summed per run and poll time."""
    duration = F.avg("duration_sec") if "duration_sec" in flows.columns else F.lit(0.0)
    return flows.where(F.col("timestamp").isNotNull()).groupBy("run_id", "timestamp").agg(
        F.sum("packet_count").alias("packet_count_sum"),
        F.sum("byte_count").alias("byte_count_sum"),
        F.sum("delta_packet").alias("delta_packet_sum"),
        F.sum("delta_byte").alias("delta_byte_sum"),
        F.sum("packet_rate_window").alias("packet_rate_window_sum"),
        F.sum("byte_rate_window").alias("byte_rate_window_sum"),
        F.avg("packet_size_avg").alias("packet_size_avg_mean"),
        duration.alias("duration_sec_mean"),
        F.count("ip_src").alias("n_flows"),
    )


def protocol_sums(flows: DataFrame, proto: int, prefix: str) -> DataFrame:
    """The same poll sums for one transport protocol."""
    sub = flows.where(F.col("timestamp").isNotNull() & (numeric(F.col("ip_proto"), 0.0) == proto))
    return sub.groupBy("run_id", F.col("timestamp").alias(f"{prefix}_ts")).agg(
        F.sum("delta_packet").alias(f"{prefix}_delta_packet_sum"),
        F.sum("byte_rate_window").alias(f"{prefix}_byte_rate_window_sum"),
        F.count("ip_src").alias(f"n_{prefix}_flows"),
    )


def poll_sums_by_protocol(flows: DataFrame, mode: str = "asof", tolerance_sec: float = 4.0) -> DataFrame:
    """Poll sums plus TCP and UDP parts.

    `asof` lets a poll without a protocol borrow the nearest one within the tolerance (the published
    behaviour); `exact` counts only the poll's own rows, in a single aggregation.
    """
    if mode == "exact":
        proto = numeric(F.col("ip_proto"), 0.0)
        parts = []
        for number, prefix in ((6, "tcp"), (17, "udp")):
            mine = proto == number
            parts += [
                F.sum(F.when(mine, F.col("delta_packet")).otherwise(0.0)).alias(f"{prefix}_delta_packet_sum"),
                F.sum(F.when(mine, F.col("byte_rate_window")).otherwise(0.0)).alias(f"{prefix}_byte_rate_window_sum"),
                F.count(F.when(mine, F.col("ip_src"))).alias(f"n_{prefix}_flows"),
            ]
        split = flows.groupBy("run_id", "timestamp").agg(*parts)
        out = poll_flow_sums(flows).join(split, ["run_id", "timestamp"])
    else:
        out = poll_flow_sums(flows)
        for number, prefix in ((6, "tcp"), (17, "udp")):
            values = [f"{prefix}_delta_packet_sum", f"{prefix}_byte_rate_window_sum", f"n_{prefix}_flows"]
            out = asof_nearest(out, protocol_sums(flows, number, prefix), ["run_id"], "timestamp",
                               f"{prefix}_ts", values, tolerance_sec, left_is_unique=True)
    filled = [c for c in PROTOCOL_SUMS if c != "tcp_share"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in filled})
    return out.withColumn("tcp_share", tcp_share(F.col("tcp_delta_packet_sum"), F.col("udp_delta_packet_sum")))


def core_port_sums(ports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Core-link counters per run and poll time; the drop rate is a mean."""
    return ports.where(F.col("timestamp").isNotNull()).groupBy(*(by or ["run_id", "timestamp"])).agg(
        F.sum("rx_bps").alias("rx_bps_core"),
        F.sum("tx_bps").alias("tx_bps_core"),
        F.sum("delta_rx_dropped").alias("delta_rx_dropped_core"),
        F.sum("delta_tx_dropped").alias("delta_tx_dropped_core"),
        F.avg("drop_rate").alias("drop_rate_core"),
        F.sum("delta_rx_errors").alias("delta_rx_errors_core"),
        F.sum("delta_tx_errors").alias("delta_tx_errors_core"),
    ).withColumn("core_bps", F.coalesce("rx_bps_core", F.lit(0.0)) + F.coalesce("tx_bps_core", F.lit(0.0)))


# Fixed default values of run metadata fields.
META_DEFAULTS = {
    "affected_link": "s1-s2", "traffic": "", "traffic_pair": "", "protocol": "", "source": SOURCE_FAULT,
}
# Fixed field names of run metadata.
META_FIELDS = [
    "scenario_id", "fault_label", "fault_family", "fault_severity", "affected_link", "configured_bw",
    "configured_loss", "configured_delay", "traffic", "traffic_pair", "protocol", "source",
]


def add_run_metadata(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Ground truth of the run on every snapshot, with per-field defaults."""
    fields = [
        F.coalesce(F.col(c), F.lit(META_DEFAULTS[c])).alias(c) if c in META_DEFAULTS else F.col(c)
        for c in META_FIELDS
    ]
    return df.join(meta.select("run_id", *fields), "run_id").withColumn("is_synthetic", F.lit(0))


def fault_snapshots(flows: DataFrame, ports: DataFrame, probes: DataFrame, meta: DataFrame,
                    mode: str = "asof", tolerance_sec: float = 4.0) -> DataFrame:
    """One row per run and poll: flow sums, protocol parts, core ports, probe values, run metadata.

    A run that has probes but no cross-segment flows yields its probe times with zero flow counters.
    """
    probes = keep_last(probes.where(F.col("timestamp").isNotNull()), ["run_id", "timestamp"], ["probe_id"])
    # The filtered flows feed several aggregates; keep them instead of repeating the delta pipeline.
    used = cross_segment(with_delta(flows)).persist(StorageLevel.MEMORY_AND_DISK)
    base = poll_sums_by_protocol(used, mode, tolerance_sec)
    quiet = probes.join(used.select("run_id").distinct(), "run_id", "left_anti")
    zero = {c: F.lit(0.0).alias(c) for c in FLOW_SUMS + PROTOCOL_SUMS}
    base = base.unionByName(quiet.select("run_id", "timestamp", *[
        zero[c].cast(base.schema[c].dataType).alias(c) for c in FLOW_SUMS + PROTOCOL_SUMS
    ]))
    core = core_port_sums(with_delta(core_ports(ports, meta))).withColumnRenamed("timestamp", "port_ts")
    out = asof_nearest(base, core, ["run_id"], "timestamp", "port_ts", CORE_PORT_SUMS, tolerance_sec,
                       left_is_unique=True)
    right = probes.withColumnRenamed("timestamp", "probe_ts")
    out = asof_nearest(out, right, ["run_id"], "timestamp", "probe_ts", PROBE_VALUES, tolerance_sec,
                       left_is_unique=True)
    return add_run_metadata(out, meta)


def steady_state(df: DataFrame, tie_break: str = "row_id") -> DataFrame:
    """Drop the ragged ends of each run: two polls at each end, one in runs of 3-4, none below; then empty polls.

    Only the two outermost rows per end are ranked, so a long run never lands in one window partition.
    """
    rows = df.where(F.col("run_id").isNotNull()).withColumn(
        "_o", F.struct(F.col("timestamp").isNull().alias("late"), F.col("timestamp").alias("t"),
                       F.col(tie_break).alias("b")))
    edge = F.when(F.col("_n") > 4, 2).when(F.col("_n") > 2, 1).otherwise(0)
    size = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_edge", edge)

    def bound(order: Column, pick) -> DataFrame:
        ends = first_rows(rows.select("run_id", "_o"), ["run_id"], [order], 2, rank="_r")
        ends = ends.join(size, "run_id").where(F.col("_r") <= F.col("_edge"))
        return ends.groupBy("run_id").agg(pick("_o"))

    low = bound(F.asc("_o"), lambda c: F.max(c).alias("_low"))
    high = bound(F.desc("_o"), lambda c: F.min(c).alias("_high"))
    limits = sized(size.join(low, "run_id", "left").join(high, "run_id", "left"))
    kept = rows.join(limits, "run_id").where(
        (F.col("_edge") == 0) | ((F.col("_o") > F.col("_low")) & (F.col("_o") < F.col("_high"))))
    out = kept.select(*df.columns)
    if "n_flows" in df.columns:
        out = out.where(F.coalesce(F.col("n_flows"), F.lit(0)).cast("double") > 0)
    return out


# --- per-source poll observations and streaks ------------------------------------------------------

def poll_observations(scored: DataFrame, poll: str = "poll_id", label: str = "prediction") -> DataFrame:
    """One decision per poll and source: was any flow alerting, and under which labels."""
    return scored.groupBy(poll, "ip_src").agg(
        F.bool_or(is_alert(F.col(label))).alias("anomalous"),
        F.array_join(F.sort_array(F.collect_set(label)), "/").alias("labels"),
        F.count(F.lit(1)).alias("n_flows"),
    )


def alert_streaks(observed: DataFrame, polls: DataFrame, poll: str = "poll_id",
                  chunk_polls: int = 720) -> DataFrame:
    """Consecutive-poll streak of each alerting source, while nothing is blocked.

    `polls` lists the completed polls. A streak breaks on any completed poll without an alert, seen or
    not, so polls are numbered densely and a run of alerts is an island of `poll number - alert number`.
    """
    number = number_rows(polls.select(poll).distinct(), [], [F.col(poll)],
                         F.floor(F.col(poll) / F.lit(chunk_polls)), "_poll_no")
    hits = observed.where("anomalous").join(number, poll)
    hits = number_rows(hits, ["ip_src"], [F.col("_poll_no")], F.floor(F.col("_poll_no") / F.lit(chunk_polls)), "_hit_no")
    hits = hits.withColumn("_island", F.col("_poll_no") - F.col("_hit_no"))
    start = hits.groupBy("ip_src", "_island").agg(F.min("_poll_no").alias("_start"))
    return hits.join(start, ["ip_src", "_island"]).select(
        poll, "ip_src", "labels", (F.col("_poll_no") - F.col("_start") + 1).cast("long").alias("streak"))


def newest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Newest n rows: a per-task top-n, then one merge."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


