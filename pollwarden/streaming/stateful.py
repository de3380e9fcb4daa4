"""Keyed state for live feeds: the poll barrier and the mitigation policy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pollwarden.functions.features import poll_id
from pollwarden.operators.cleaning import is_alert
from pollwarden.streaming.policy import mitigation_events

MICROS = 1_000_000


def _stamp(micros: int) -> pd.Timestamp:
    return pd.Timestamp(int(micros), unit="us")


# --- poll barrier ----------------------------------------------------------------------------------

def stream_poll_barrier(df: DataFrame, switches: list[int], interval_sec: float = 5.0, watermark: str = "10 seconds") -> DataFrame:
    """Close a poll when every registered switch has answered, or when event time has moved past it.

    Rows are reduced to one per (poll, switch) before the per-poll state, which holds a switch list.
    """
    expected = set(switches)
    answers = df.withWatermark("timestamp", watermark).withColumn("poll_id", poll_id(F.col("timestamp"), interval_sec))
    answers = answers.select("timestamp", "poll_id", "datapath_id").dropDuplicatesWithinWatermark(["poll_id", "datapath_id"])

    def close(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done = state.get if state.exists else ([], False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame({"poll_id": [key[0]], "n_switches": [len(seen)], "closed_by": ["forced"]})
            return
        found = set(seen)
        for pdf in frames:
            found |= set(int(v) for v in pdf["datapath_id"])
        if not done and expected and found >= expected:
            done = True
            yield pd.DataFrame({"poll_id": [key[0]], "n_switches": [len(found)], "closed_by": ["barrier"]})
        state.update((sorted(found), done))
        ends = int((key[0] + 1) * interval_sec * 1000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))

    return answers.groupBy("poll_id").applyInPandasWithState(
        close, "poll_id long, n_switches int, closed_by string", "seen array<int>, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


# --- mitigation policy -----------------------------------------------------------------------------

EVENT_SCHEMA = "ip_src string, poll_id long, event string, streak int, labels string, at timestamp, until timestamp"
# Polls in a row before a block, and its length.
ALERT_THRESHOLD, BLOCK_SECONDS = 3, 120


class SourcePolicy:
    """State of one source: last poll seen, streak, end of its block (0 = not blocked)."""

    def __init__(self, interval_sec: float, threshold: int, block_sec: int, enabled: bool, state: tuple | None = None):
        self.interval, self.threshold, self.enabled = int(interval_sec * MICROS), threshold, enabled
        self.block = block_sec * MICROS
        self.last, self.streak, self.until = state or (-2, 0, 0)

    @property
    def state(self) -> tuple:
        return (self.last, self.streak, self.until)

    def expire(self, now: int, poll: int) -> list[tuple]:
        if self.until and now >= self.until:
            at, self.until = self.until, 0
            return [(poll, "UNBLOCK", 0, "", _stamp(at), None)]
        return []

    def observe(self, poll: int, anomalous: bool, labels: str) -> list[tuple]:
        """One completed poll in which the source was seen; polls in between count as benign."""
        end = (poll + 1) * self.interval
        out = self.expire(end, poll)
        blocked = self.until > 0
        if poll != self.last + 1 and not blocked:
            self.streak = 0
        if not anomalous:
            self.streak = 0
        elif not blocked:
            self.streak += 1
            out.append((poll, "ALERT", self.streak, labels, _stamp(end), None))
            if self.enabled and self.streak >= self.threshold:
                self.until = end + self.block
                out.append((poll, "BLOCK", self.streak, labels, _stamp(end), _stamp(self.until)))
                self.streak = 0
        self.last = poll
        return out


def _frame(ip: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["poll_id", "event", "streak", "labels", "at", "until"])
    out.insert(0, "ip_src", ip)
    out["at"], out["until"] = pd.to_datetime(out["at"]), pd.to_datetime(out["until"])
    return out


def poll_windows(scored: DataFrame, interval_sec: int = 5, watermark: str = "10 seconds") -> DataFrame:
    """Per-source observation of each poll, emitted once event time has passed it (the forced close)."""
    labels = F.array_join(F.sort_array(F.collect_set("prediction")), "/")
    rows = scored.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", f"{interval_sec} seconds"), "ip_src").agg(
        F.bool_or(is_alert(F.col("prediction"))).alias("anomalous"), labels.alias("labels"), F.count(F.lit(1)).alias("n_flows"))
    return rows.select("ip_src", "anomalous", "labels", "n_flows", poll_id(F.col("window.start"), interval_sec).alias("poll_id"))


def stream_mitigation(observed: DataFrame, interval_sec: int = 5, watermark: str = "10 seconds", threshold: int = ALERT_THRESHOLD,
                      block_sec: int = BLOCK_SECONDS, enabled: bool = True) -> DataFrame:
    """ALERT, BLOCK and UNBLOCK rows per source from a stream of closed polls; blocks expire on an event-time timer.

    The input is the output table of `poll_windows`, read as a stream: the windowed aggregation combines a
    source's flows map-side, so a source with most of the flows still reaches its state as one row per poll.
    """
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        policy = SourcePolicy(interval_sec, threshold, block_sec, enabled, tuple(state.get) if state.exists else None)
        out = []
        if state.hasTimedOut:
            out += policy.expire(state.getCurrentWatermarkMs() * 1000, policy.last)
            if not out:
                state.remove()
                return
        else:
            rows = pd.concat(list(frames), ignore_index=True).sort_values("poll_id")
            for poll, anomalous, labels in zip(rows["poll_id"], rows["anomalous"], rows["labels"]):
                out += policy.observe(int(poll), bool(anomalous), labels)
        state.update(policy.state)
        # Wake up when the block ends; an idle, unblocked source is forgotten after two polls.
        wake = policy.until // 1000 if policy.until else int((policy.last + 3) * interval_sec * 1000)
        state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        if out:
            yield _frame(key[0], out)

    rows = observed.withColumn("closed_at", F.timestamp_micros((F.col("poll_id") + 1) * int(interval_sec * MICROS)))
    rows = rows.withWatermark("closed_at", watermark).select("ip_src", "closed_at", "poll_id", "anomalous", "labels")
    return rows.groupBy("ip_src").applyInPandasWithState(
        run, EVENT_SCHEMA, "last long, streak int, until long", "append", GroupStateTimeout.EventTimeTimeout)


def batch_mitigation(observed: DataFrame, interval_sec: float = 5.0, threshold: int = ALERT_THRESHOLD,
                     block_sec: int = BLOCK_SECONDS, enabled: bool = True) -> DataFrame:
    """The same policy over recorded observations (one row per poll and source), without a row-by-row loop: see policy.py.

    A block that outlasts its source's last poll ends in an UNBLOCK of its own, so every BLOCK has one.
    """
    return mitigation_events(observed, interval_sec, threshold, block_sec, enabled)
