"""Ordered operations that stay exact and parallel when one key holds a large share of the rows.

A plain window sends every row of a key to one task. Here a key is cut into *chunks* that follow the
order (an hour of polls, a range of hash values, a range of scores). The row-level window runs inside
(key, chunk); only one small summary row per chunk travels along the key, and its carry is joined back.
The fact table is shuffled once, by (key, chunk), for both the window and the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollwarden.functions.features import epoch_micros
from pollwarden.session import sized

HOUR = 3600


def time_chunk(ts: Column, seconds: int = HOUR) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(seconds * 1_000_000))


def hash_chunk(hashed: Column, bits: int = 12) -> Column:
    """Leading bits of a 64-bit hash: follows the order of the hash."""
    return F.shiftright(hashed, 64 - bits)


def _keyed(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    # One struct key: NULL fields compare equal, in the window as in the join.
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(1).alias("all"))
    return df.withColumns({"__k": key, "__c": chunk})


def number_rows(df: DataFrame, keys: list[str], order: list[Column], chunk: Column,
                out: str = "row_index") -> DataFrame:
    """0-based position of every row inside its key."""
    base = _keyed(df, keys, chunk)
    inner = base.withColumn("__n", F.row_number().over(Window.partitionBy("__k", "__c").orderBy(*order)))
    along = Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        base.groupBy("__k", "__c").agg(F.count(F.lit(1)).alias("__m"))
        .select("__k", "__c", F.coalesce(F.sum("__m").over(along), F.lit(0)).alias("__before"))
    )
    return (
        inner.join(before, ["__k", "__c"], "left")
        .withColumn(out, F.col("__before") + F.col("__n") - 1)
        .drop("__k", "__c", "__n", "__before")
    )


def running_sums(df: DataFrame, keys: list[str], order: list[Column], chunk: Column,
                 sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums `{output: input}` inside each key; rows with equal order share a value."""
    base = _keyed(df, keys, chunk)
    window = Window.partitionBy("__k", "__c").orderBy(*order)
    inner = base.withColumns({f"__in_{o}": F.sum(i).over(window) for o, i in sums.items()})
    along = Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    before = base.groupBy("__k", "__c").agg(*[F.sum(i).alias(f"__m_{o}") for o, i in sums.items()])
    before = before.select("__k", "__c", *[
        F.coalesce(F.sum(f"__m_{o}").over(along), F.lit(0)).alias(f"__b_{o}") for o in sums
    ])
    joined = inner.join(before, ["__k", "__c"], "left")
    return joined.withColumns({o: F.col(f"__in_{o}") + F.col(f"__b_{o}") for o in sums}).drop(
        "__k", "__c", *[f"__in_{o}" for o in sums], *[f"__b_{o}" for o in sums]
    )


def previous_row(df: DataFrame, keys: list[str], order: list[str], values: list[str], chunk: Column,
                 out: str = "previous") -> DataFrame:
    """Struct of `values` from the row before, in `order`, of the same key; NULL on the first row."""
    base = _keyed(df, keys, chunk)
    payload = F.struct(*[F.col(v) for v in values])
    rank = F.struct(*[F.col(o) for o in order])
    window = Window.partitionBy("__k", "__c").orderBy(*order)
    inner = base.withColumns({
        "__n": F.row_number().over(window),
        "__inner": F.lag(payload).over(window),
    })
    tails = base.groupBy("__k", "__c").agg(F.max_by(payload, rank).alias("__tail"))
    carried = tails.select(
        "__k", "__c", F.lag("__tail").over(Window.partitionBy("__k").orderBy("__c")).alias("__carry")
    )
    return (
        inner.join(carried, ["__k", "__c"], "left")
        .withColumn(out, F.when(F.col("__n") == 1, F.col("__carry")).otherwise(F.col("__inner")))
        .drop("__k", "__c", "__n", "__inner", "__carry")
    )


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per key.

    Written as `row_number <= n`, which Spark turns into a per-task group limit before the shuffle, so a
    hot key sends at most n rows per map task. Keep n small (below the optimizer's threshold of 1000).
    """
    keep = rank or "_rank"
    out = df.withColumn(keep, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(keep) <= n)
    return out if rank else out.drop(keep)


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
                 values: list[str], tolerance_sec: float = 4.0, tie_break: list[str] | None = None,
                 left_is_unique: bool = False) -> DataFrame:
    """Left join to the nearest right row in time: tolerance inclusive, an exact tie goes to the earlier.

    No pair is formed. Right rows are reduced to one per (by, time) and copied to the slice of `tolerance`
    seconds they fall in and its two neighbours, which is as far as the tolerance reaches; left times join
    the same slices and look both ways with two running windows. The match depends on (by, time) only, so
    left rows that share a time are looked up once and joined back; unique left rows ride along instead.
    """
    width = max(int(round(tolerance_sec * 1_000_000)), 1)
    key = F.struct(*[F.col(b) for b in by])
    time = epoch_micros(F.col(left_ts))
    slice_of = F.floor(F.col("_t") / F.lit(width))

    if left_is_unique:
        probes = left.select(key.alias("_k"), time.alias("_t"), F.struct(*left.columns).alias("_l"))
    else:
        probes = left.where(F.col(left_ts).isNotNull()).select(key.alias("_k"), time.alias("_t")).distinct()
        probes = probes.withColumn("_l", F.struct(F.lit(1).alias("one")))

    rows = right.where(F.col(right_ts).isNotNull()).select(
        key.alias("_k"), epoch_micros(F.col(right_ts)).alias("_t"),
        F.struct(*[F.col(v) for v in values]).alias("_v"),
        F.struct(*[F.col(c) for c in (tie_break or values)]).alias("_b"))
    rows = rows.groupBy("_k", "_t").agg(F.min_by("_v", "_b").alias("_v"))
    rows = rows.withColumns({
        "_h": F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")),
        "_s": F.explode(F.array(slice_of - 1, slice_of, slice_of + 1))}).drop("_v")

    merged = probes.withColumns({"_s": slice_of, "_h": F.lit(None).cast(rows.schema["_h"].dataType)}).unionByName(
        rows.withColumn("_l", F.lit(None).cast(probes.schema["_l"].dataType)))
    window = Window.partitionBy("_k", "_s")
    last_seen = F.last("_h", ignorenulls=True)
    found = merged.withColumns({
        "_back": last_seen.over(window.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)),
        "_ahead": last_seen.over(window.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0)),
    }).where(F.col("_l").isNotNull())
    found = found.withColumns({"_gb": F.col("_t") - F.col("_back.t"), "_ga": F.col("_ahead.t") - F.col("_t")})
    near_back, near_ahead = F.col("_gb") <= width, F.col("_ga") <= width
    match = (
        F.when(near_back & (~F.coalesce(near_ahead, F.lit(False)) | (F.col("_gb") <= F.col("_ga"))), F.col("_back.v"))
        .when(near_ahead, F.col("_ahead.v")))
    kept = [c for c in left.columns if c not in values]
    if left_is_unique:
        found = found.select("_l", match.alias("_m"))
        return found.select(*[F.col("_l")[c].alias(c) for c in kept], *[F.col("_m")[v].alias(v) for v in values])
    found = found.select("_k", "_t", match.alias("_m"))
    joined = left.withColumns({"_k": key, "_t": time}).join(found, ["_k", "_t"], "left")
    return joined.select(*kept, *[F.col("_m")[v].alias(v) for v in values])


def interval_segments(intervals: DataFrame, start: str, end: str, priority: str, label: str) -> DataFrame:
    """Closed, overlapping intervals to disjoint half-open segments carrying the highest-priority label.

    Boundaries are numbered; an interval covers a run of numbers and is cut into aligned power-of-two
    blocks (at most two per size). A block keeps only its best interval, and a segment asks its enclosing
    blocks, so the work is n log n even when all intervals overlap.
    """
    rows = intervals.select(
        epoch_micros(F.col(start)).alias("_from"), (epoch_micros(F.col(end)) + 1).alias("_to"),
        F.struct(F.col(priority).alias("p"), F.col(label).alias("l")).alias("_best"),
    ).where(F.col("_from") < F.col("_to"))
    bounds = rows.select(F.explode(F.array("_from", "_to")).alias("_t")).distinct()
    # One chunk per day of boundaries keeps the numbering parallel.
    day = 86_400_000_000
    numbered = number_rows(bounds, [], [F.col("_t")], F.floor(F.col("_t") / F.lit(day)), out="_i")
    numbered = numbered.withColumn("_chunk", F.floor(F.col("_t") / F.lit(day)))
    window = Window.partitionBy("_chunk").orderBy("_t")
    heads = numbered.groupBy("_chunk").agg(F.min("_t").alias("_head"))
    heads = heads.select("_chunk", F.lead("_head").over(Window.orderBy("_chunk")).alias("_after"))
    spans = numbered.withColumn("_lead", F.lead("_t").over(window)).join(heads, "_chunk").select(
        "_i", F.col("_t").alias("seg_from"), F.coalesce("_lead", "_after").alias("seg_to")
    ).where(F.col("seg_to").isNotNull())
    ranks = numbered.select(F.col("_t"), F.col("_i"))
    placed = (
        rows.join(ranks.select(F.col("_t").alias("_from"), F.col("_i").alias("_lo")), "_from")
        .join(ranks.select(F.col("_t").alias("_to"), F.col("_i").alias("_hi")), "_to")
    )
    levels = F.sequence(F.lit(0), F.lit(40))

    def blocks(level: Column) -> Column:
        # At each size: the left block if the low end is unaligned there, the right one if the high end is.
        size = F.pow(F.lit(2.0), level).cast("long")
        lo = F.ceil(F.col("_lo") / size)
        hi = F.floor(F.col("_hi") / size)
        left = F.when((lo < hi) & (lo % 2 == 1), lo)
        right = F.when((lo < hi) & (hi % 2 == 1), hi - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda b: F.struct(
            level.alias("level"), b.cast("long").alias("block")))

    cover = placed.select("_best", F.explode(F.flatten(F.transform(levels, blocks))).alias("_b"))
    best = cover.groupBy("_b").agg(F.max("_best").alias("_best"))
    asked = spans.select("*", F.explode(F.transform(levels, lambda level: F.struct(
        level.alias("level"), F.floor(F.col("_i") / F.pow(F.lit(2.0), level).cast("long")).cast("long").alias("block"),
    ))).alias("_b"))
    won = asked.join(best, "_b").groupBy("seg_from", "seg_to").agg(F.max("_best").alias("_best"))
    return won.select("seg_from", "seg_to", F.col("_best.l").alias(label))


def interval_label(df: DataFrame, intervals: DataFrame, ts: str, start: str = "start_time",
                   end: str = "end_time", priority: str = "idx", label: str = "label",
                   default: str | None = "normal", out: str = "label") -> DataFrame:
    """Label of the last listed interval that contains the row's time; the default elsewhere.

    Intervals become disjoint segments first, so a row meets at most one and the join needs no second
    aggregation. It is an equi-join on the time bucket plus a range test: Spark broadcasts the segments
    when they are below its size threshold and otherwise shuffles by bucket, splitting hot buckets. The
    bucket is as wide as the mean segment: disjoint segments then fill at most twice their number of buckets,
    and a bucket holds one or two of them on average.
    """
    segments = sized(interval_segments(intervals, start, end, priority, label))
    n, low, high = segments.agg(F.count(F.lit(1)), F.min("seg_from"), F.max("seg_to")).first()
    width = max((high - low) // n, 1_000_000) if n else 1_000_000
    segments = segments.select(
        F.explode(F.sequence(F.floor(F.col("seg_from") / F.lit(width)),
                             F.floor((F.col("seg_to") - 1) / F.lit(width)))).alias("_bucket"),
        "seg_from", "seg_to", F.col(label).alias("_label"))
    segments = sized(segments)
    rows = df.withColumns({"_t": epoch_micros(F.col(ts)), "_bucket": F.floor(epoch_micros(F.col(ts)) / F.lit(width))})
    inside = (
        (rows["_bucket"] == segments["_bucket"])
        & (rows["_t"] >= segments["seg_from"]) & (rows["_t"] < segments["seg_to"])
    )
    picked = F.col("_label") if default is None else F.coalesce(F.col("_label"), F.lit(default))
    kept = [c for c in df.columns if c != out]
    return rows.join(segments, inside, "left").select(*kept, picked.alias(out))


def window_join(df: DataFrame, windows: DataFrame, ts: str, start: str, end: str,
                grace_sec: int = 0, on: list[str] | None = None) -> DataFrame:
    """Rows joined to every closed time window [start, end + grace] that contains them (and equals them in `on`).

    An equi-join on time buckets as wide as the mean window: a window covers about two buckets, so the rows
    tested are a small multiple of the rows returned.
    """
    spans = windows.withColumns({
        "_from": epoch_micros(F.col(start)),
        "_to": epoch_micros(F.col(end)) + F.lit(grace_sec * 1_000_000),
    }).where(F.col("_from") <= F.col("_to"))
    mean = spans.agg(F.avg(F.col("_to") - F.col("_from"))).first()[0]
    width = max(int(mean or 0), 1_000_000)
    spans = spans.withColumn("_bucket", F.explode(F.sequence(
        F.floor(F.col("_from") / F.lit(width)), F.floor(F.col("_to") / F.lit(width)))))
    rows = df.withColumns({"_t": epoch_micros(F.col(ts)), "_bucket": F.floor(epoch_micros(F.col(ts)) / F.lit(width))})
    return (
        rows.join(spans, ["_bucket", *(on or [])])
        .where((F.col("_t") >= F.col("_from")) & (F.col("_t") <= F.col("_to")))
        .drop("_bucket", "_t", "_from", "_to")
    )
