"""Numbers out of ping and iperf text, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the two tools' output.
LOSS = r"(\d+(?:\.\d+)?)% packet loss"
RTT = r"rtt min/avg/max(?:/mdev)? = ([\d.]+)/([\d.]+)/([\d.]+)"


def _capture(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def ping_values(text: Column) -> Column:
    return F.struct(
        _capture(text, RTT, 1).alias("rtt_min_ms"),
        _capture(text, RTT, 2).alias("rtt_mean_ms"),
        _capture(text, RTT, 3).alias("rtt_max_ms"),
        _capture(text, LOSS, 1).alias("probe_loss_pct"),
    )


def iperf_values(text: Column) -> Column:
    """Throughput (Mbit/s), jitter (ms) and loss (%) after reading a report line by line.

    Each line updates the running answer: a line needs nine fields and a readable rate to count; jitter
    is the tenth field where there are eleven; the loss percentage is the thirteenth field, or, while
    no percentage is known, lost/total of a line that has twelve.
    """
    empty = F.struct(*[
        F.lit(None).cast("double").alias(n) for n in ("throughput_mbps", "jitter_ms", "udp_lost_pct")
    ])

    def read(state: Column, line: Column) -> Column:
        f = F.split(line, ",")
        n = F.size(f)

        def field(i: int) -> Column:
            return F.trim(F.try_element_at(f, F.lit(i + 1))).try_cast("double")

        bps = field(8)
        percent = F.trim(F.replace(F.try_element_at(f, F.lit(13)), F.lit("%"), F.lit(""))).try_cast("double")
        counted = F.when((n >= 12) & (field(11) > 0), field(10) * 100.0 / field(11))
        lost = F.coalesce(F.when(n >= 13, percent).otherwise(state["udp_lost_pct"]), counted)
        return F.when((n >= 9) & bps.isNotNull(), F.struct(
            (bps / F.lit(1e6)).alias("throughput_mbps"),
            F.when(n >= 11, F.coalesce(field(9), state["jitter_ms"]))
            .otherwise(state["jitter_ms"]).alias("jitter_ms"),
            lost.alias("udp_lost_pct"),
        )).otherwise(state)

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), empty, read)


def dotted_quads(text: Column) -> Column:
    """Every IPv4-looking token of a command line."""
    return F.regexp_extract_all(text, F.lit(r"\b\d+\.\d+\.\d+\.\d+\b"), F.lit(0))
