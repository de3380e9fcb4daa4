"""Scalar expressions over flow polls: rates, coercion, ids, clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den, with a default where the denominator is zero or either side is NULL."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities to NULL; times zero they are NaN, which equals no number."""
    return F.when(c * 0.0 == 0.0, c)


def numeric(c: Column, fill: float | None = None) -> Column:
    """Text or number to double; anything unreadable, NaN or infinite becomes NULL, then the fill."""
    d = finite_or_null(c.try_cast("double"))
    return d if fill is None else F.coalesce(d, F.lit(float(fill)))


def numeric_column(df: DataFrame, name: str, fill: float | None = None) -> Column:
    """`numeric` for a column of known type, without the casts and tests its type makes needless.

    Wide projections of generated code stay small enough for the JVM to compile.
    """
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        d = c.cast("double")
    elif kind in ("double", "float"):
        d = finite_or_null(c.cast("double"))
    else:
        return numeric(c, fill)
    return d if fill is None else F.coalesce(d, F.lit(float(fill)))


def flow_features(df: DataFrame) -> DataFrame:
    """Duration, per-second rates and mean packet size from the raw counters; zero when undefined."""
    duration = F.col("duration_sec") + F.col("duration_nsec") / F.lit(1e9)
    positive = duration > 0
    return df.withColumns({
        "flow_duration": duration,
        "packet_count_per_sec": F.when(positive, F.col("packet_count") / duration).otherwise(0.0),
        "byte_count_per_sec": F.when(positive, F.col("byte_count") / duration).otherwise(0.0),
        "packet_size_avg": F.when(
            F.col("packet_count") > 0, F.col("byte_count") / F.col("packet_count")
        ).otherwise(0.0),
    })


def flow_id() -> Column:
    """Stable 5-tuple id below 10^8 (hash values are Spark's own)."""
    key = F.xxhash64("ip_src", "ip_dst", "ip_proto", "tp_src", "tp_dst")
    return F.pmod(key, F.lit(100_000_000))


def clamp(c: Column, lo, hi, default) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(c, F.lit(default))))


def live_settings(df: DataFrame) -> DataFrame:
    """Defaults and hard limits of the live configuration row."""
    return df.withColumns({
        "polling_interval": clamp(F.col("polling_interval").cast("double"), 1.0, 30.0, 5.0),
        "alert_threshold": clamp(F.col("alert_threshold").cast("int"), 1, 20, 3),
        "block_timeout": clamp(F.col("block_timeout").cast("int"), 10, 1200, 120),
        "mitigation_enabled": F.coalesce(F.col("mitigation_enabled"), F.lit(True)),
    })


def label_code(c: Column, labels: list[str]) -> Column:
    """Position of a label in the alphabetical list; NULL for an unknown label."""
    pos = F.array_position(F.array(*[F.lit(x) for x in sorted(labels)]), c)
    return F.when(pos > 0, (pos - 1).cast("int"))


def label_name(c: Column, labels: list[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in sorted(labels)]), (c + 1).cast("int"))


def tcp_share(tcp: Column, udp: Column) -> Column:
    return ratio(tcp, tcp + udp, 0.0)


def infer_protocol(df: DataFrame, flag_columns: list[str]) -> Column:
    """The protocol column when the file has one, else TCP where any TCP flag was counted."""
    if "Protocol" in df.columns:
        return numeric_column(df, "Protocol")
    present = [c for c in flag_columns if c in df.columns]
    if not present:
        return F.lit(0.0)
    total = sum((numeric_column(df, c, 0.0) for c in present[1:]), numeric_column(df, present[0], 0.0))
    return F.when(total > 0, 6.0).otherwise(0.0)


def poll_id(ts: Column, interval_sec: float = 5.0) -> Column:
    """Number of the poll a timestamp falls in."""
    return F.floor(epoch_micros(ts) / F.lit(int(interval_sec * 1_000_000))).cast("long")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(1_000_000.0)


def fingerprint(columns: list[str], null_text: str = "nan") -> Column:
    """Readable row fingerprint; a NULL prints as 'nan' instead of vanishing."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(null_text)) for c in columns])


def fresh(ts: Column, now: Column, max_age_sec: int = 20) -> Column:
    return F.coalesce(seconds_between(now, ts) <= F.lit(float(max_age_sec)), F.lit(False))
