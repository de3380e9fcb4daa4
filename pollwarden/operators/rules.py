"""Train-fold-only preprocessing and the rule detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwarden.operators.metrics import best_setting, binary_report, confusion_counts, threshold_sweep
from pollwarden.operators.percentiles import column_percentiles, exact_percentiles, left_out_percentiles
from pollwarden.session import sized


# --- preprocessing ---------------------------------------------------------------------------------

def _one_row(df: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """Attach a one-row table of fitted numbers as literals: no join, and the plan folds them away."""
    row = stats.select(*names).first()
    return df.withColumns({n: F.lit(row[n]).cast("double") for n in names})


def scaler_stats(train: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of the train rows; a constant column scales by one."""
    aggs = [x for c in columns for x in (
        F.avg(c).alias(f"{c}_mean"),
        F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std"))]
    return train.groupBy(*(by or [])).agg(*aggs)


def scale(df: DataFrame, stats: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    names = [f"{c}_{s}" for c in columns for s in ("mean", "std")]
    joined = df.join(sized(stats), by) if by else _one_row(df, stats, names)
    return joined.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).drop(*names)


def median_fills(train: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact train medians, one column each; 0 for a column that is NULL throughout."""
    by = by or []
    long = column_percentiles(train, by, columns, 0.5)
    wide = [F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"{c}_fill") for c in columns]
    if by:
        filled = train.select(*by).distinct().join(long.groupBy(*by).agg(*wide), by, "left")
    else:
        filled = long.groupBy().agg(*wide)
    return filled.withColumns({f"{c}_fill": F.coalesce(f"{c}_fill", F.lit(0.0)) for c in columns})


def impute(df: DataFrame, fills: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    names = [f"{c}_fill" for c in columns]
    joined = df.join(sized(fills), by) if by else _one_row(df, fills, names)
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_fill")) for c in columns}).drop(*names)


def normal_rows(train: DataFrame, label: str = "label", normal: str = "normal") -> DataFrame:
    """Normal rows of a train fold; a fold without any cannot fit a one-class model."""
    rows = train.where(F.col(label) == normal)
    if rows.isEmpty():
        raise RuntimeError("train fold has no normal rows for a one-class fit")
    return rows


# --- calibrated fault rule -------------------------------------------------------------------------

RULE_INPUTS = ["probe_loss_pct", "udp_lost_pct", "rtt_mean_ms", "throughput_mbps"]


def fault_rule_thresholds(train: DataFrame, by: list[str], label: str = "fault_family") -> DataFrame:
    """Limits from the normal rows of each train fold (all its rows if it has fewer than three normals)."""
    normals = train.groupBy(*by).agg(F.count(F.when(F.col(label) == "normal", 1)).alias("_normals"))
    rows = train.join(sized(normals), by) if by else train.withColumn("_normals", normals.scalar())
    rows = rows.where((F.col("_normals") < 3) | (F.col(label) == "normal"))
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in RULE_INPUTS[:3]})
    high = column_percentiles(rows, by, RULE_INPUTS[:3], 0.95)
    pick = {c: F.max(F.when(F.col("feature") == c, F.col("value"))) for c in RULE_INPUTS[:3]}
    limits = high.groupBy(*by).agg(
        F.greatest(F.lit(2.0), pick["probe_loss_pct"]).alias("lim_loss"),
        F.greatest(F.lit(3.0), pick["udp_lost_pct"]).alias("lim_uloss"),
        F.greatest(F.lit(20.0), pick["rtt_mean_ms"] * 2.0).alias("lim_rtt"))
    low = exact_percentiles(rows, by, "throughput_mbps", {"_p25": 0.25})
    low = low.select(*by, F.greatest(F.lit(0.5), F.col("_p25") * 0.5).alias("lim_thr"))
    if by:
        out = limits.join(low, by, "left")
    else:
        out = limits.withColumn("lim_thr", low.scalar())
    return out.withColumn("lim_thr", F.coalesce("lim_thr", F.lit(1.0)))


def held_out_rule_limits(df: DataFrame, group: str, label: str = "fault_family") -> DataFrame:
    """`fault_rule_thresholds` of every leave-one-group-out fold at once: one row per group, from the rows of the others.

    Rows become counts per (group, input, value) for all rows and for normal ones; a fold subtracts its own counts.
    Rows without a group take no part, and a table of one group has no fold.
    """
    known = df.where(F.col(group).isNotNull())
    normal = F.col(label) == "normal"
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"), F.count(F.when(normal, 1)).alias("_normals"))
    sizes = sized(sizes)
    total = sizes.agg(F.sum("_rows").alias("r"), F.sum("_normals").alias("n"))
    folds = sizes.withColumns({"_rows": total.select("r").scalar() - F.col("_rows"),
                               "_normals": total.select("n").scalar() - F.col("_normals")}).where(F.col("_rows") > 0)
    probs = dict.fromkeys(RULE_INPUTS[:3], 0.95) | {"throughput_mbps": 0.25}
    wanted = folds.select(group, F.when(F.col("_normals") < 3, "all").otherwise("normal").alias("rows"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(p).alias("prob")) for c, p in probs.items()])).alias("_w")).select(
        group, "rows", "_w.feature", "_w.prob")
    values = F.array(*[F.struct(F.lit(c).alias("feature"), (
        F.col(c).cast("double") if c == "throughput_mbps" else F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias("value")) for c in RULE_INPUTS])
    cells = known.select(group, normal.alias("_normal"), F.explode(values).alias("_c")).groupBy(group, "_c.feature", "_c.value").agg(
        F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("_normal"), 1)).alias("_some"))
    cells = cells.select(group, "feature", "value", F.explode(F.array(
        F.struct(F.lit("all").alias("rows"), F.col("_all").alias("n")),
        F.struct(F.lit("normal").alias("rows"), F.col("_some").alias("n")))).alias("_c")).select(group, "feature", "value", "_c.rows", "_c.n")
    found = left_out_percentiles(cells, wanted, ["rows", "feature"], group)
    pick = {c: F.max(F.when(F.col("feature") == c, F.col("percentile"))) for c in RULE_INPUTS}
    return found.groupBy(group).agg(
        F.greatest(F.lit(2.0), pick["probe_loss_pct"]).alias("lim_loss"),
        F.greatest(F.lit(3.0), pick["udp_lost_pct"]).alias("lim_uloss"),
        F.greatest(F.lit(20.0), pick["rtt_mean_ms"] * 2.0).alias("lim_rtt"),
        F.coalesce(F.when(pick["throughput_mbps"].isNotNull(), F.greatest(F.lit(0.5), pick["throughput_mbps"] * 0.5)), F.lit(1.0)).alias("lim_thr"))


def fault_rule(df: DataFrame, limits: DataFrame, by: list[str], out: str = "p") -> DataFrame:
    """Loss over delay over bandwidth over normal; an unknown throughput never means bandwidth."""
    names = ["lim_loss", "lim_uloss", "lim_rtt", "lim_thr"]
    rows = df.join(sized(limits), by) if by else _one_row(df, limits, names)

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    lossy = (filled("probe_loss_pct") >= F.col("lim_loss")) | (filled("udp_lost_pct") >= F.col("lim_uloss"))
    verdict = (
        F.when(lossy, "loss")
        .when(filled("rtt_mean_ms") >= F.col("lim_rtt"), "delay")
        .when(F.col("throughput_mbps").cast("double") <= F.col("lim_thr"), "bandwidth")
        .otherwise("normal"))
    return rows.withColumn(out, verdict).drop(*names)


# --- traffic rules ---------------------------------------------------------------------------------

# Fixed candidate values of the static-threshold sweep.
STATIC_THRESHOLDS = [100, 500, 1000, 5000, 10000, 50000, 100000]


def static_threshold(df: DataFrame, rate: str = "packet_count_per_sec", y: str = "y",
                     thresholds: list[float] = STATIC_THRESHOLDS) -> DataFrame:
    """Best packet-rate threshold by accuracy, chosen on the scored rows themselves (an upper bound)."""
    return best_setting(threshold_sweep(df, rate, y, thresholds), "accuracy").withColumn("tuned_on", F.lit("test"))


def multi_rule() -> Column:
    """Flood by rate, or many tiny packets."""
    hit = (F.col("packet_count_per_sec") > 10000) | ((F.col("byte_count") < 200) & (F.col("packet_count") >= 2))
    return F.coalesce(hit, F.lit(False)).cast("int")


def z_score(df: DataFrame, rate: str = "packet_count_per_sec", y: str = "y", sigmas: float = 2.0) -> DataFrame:
    """Rate above mean + sigmas * sample deviation of the scored rows (tuned on test)."""
    limit = df.agg((F.avg(rate) + sigmas * F.stddev_samp(rate)).alias("t"))
    scored = df.withColumn("_limit", limit.scalar())
    scored = scored.withColumn("p", F.coalesce(F.col(rate) > F.col("_limit"), F.lit(False)).cast("int"))
    report = binary_report(confusion_counts(scored, [], y), [])
    return report.withColumns({"threshold": limit.scalar(), "tuned_on": F.lit("test")})
