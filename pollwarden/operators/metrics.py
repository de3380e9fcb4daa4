"""Every evaluation report as a query over one prediction table.

Predictions hold (model, grp, y, p) and, for curves, a score. The fact table is read once into counts per
(by, y, p); every report below works on those counts.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwarden.functions.features import ratio
from pollwarden.operators.ordered import hash_chunk, number_rows, running_sums
from pollwarden.operators.percentiles import column_percentiles, exact_percentiles
from pollwarden.session import cut_lineage, sized

POOLED = "_pooled"


def confusion_counts(pred: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return pred.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def with_pooled(counts: DataFrame, column: str) -> DataFrame:
    """Repeat the (small) counts under the pooled group, so pooled rows are not a mean of folds."""
    both = F.explode(F.array(F.col(column), F.lit(POOLED)))
    rest = [c for c in counts.columns if c not in (column, "n")]
    return counts.withColumn(column, both).groupBy(column, *rest).agg(F.sum("n").alias("n"))


def confusion_matrix(counts: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """Long form with every (y, p) of the label list present, zero where unseen."""
    all_labels = F.array(*[F.lit(x) for x in labels])
    grid = counts.select(*by).distinct() if by else counts.groupBy().agg(F.count(F.lit(1)).alias("_one"))
    grid = grid.withColumn("y", F.explode(all_labels)).withColumn("p", F.explode(all_labels)).drop("_one")
    return grid.join(counts, [*by, "y", "p"], "left").select(
        *by, "y", "p", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_wide(counts: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    cells = [F.coalesce(F.sum(F.when(F.col("p") == x, F.col("n"))), F.lit(0)).alias(f"pred_{x}") for x in labels]
    return counts.groupBy(*by, "y").agg(*cells)


def per_class(counts: DataFrame, by: list[str], labels: list | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label; zero where undefined.

    Without a label list the labels are those seen in truth or prediction of each group.
    """
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("c"), hit.alias("h")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("c"),
                 F.lit(0).cast("long").alias("h")))
    sums = counts.select(*by, F.explode(sides).alias("_s")).groupBy(*by, F.col("_s.label").alias("label")).agg(
        F.sum("_s.t").alias("support"), F.sum("_s.c").alias("predicted"), F.sum("_s.h").alias("hits"))
    if labels is not None:
        grid = counts.select(*by).distinct() if by else counts.groupBy().agg(F.count(F.lit(1)).alias("_one"))
        grid = grid.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels]))).drop("_one")
        sums = grid.join(sums, [*by, "label"], "left").fillna(0, ["support", "predicted", "hits"])
    precision = ratio(F.col("hits"), F.col("predicted"))
    recall = ratio(F.col("hits"), F.col("support"))
    return sums.select(
        *by, "label", precision.alias("precision"), recall.alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"), "support")


def averages(classes: DataFrame, by: list[str]) -> DataFrame:
    """Macro and support-weighted means of the per-class table."""
    weight = F.sum("support")
    out = [F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")]
    out += [ratio(F.sum(F.col(m) * F.col("support")), weight).alias(f"{m}_weighted")
            for m in ("precision", "recall", "f1")]
    return classes.groupBy(*by).agg(*out)


def accuracy(counts: DataFrame, by: list[str]) -> DataFrame:
    right = F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0))
    return counts.groupBy(*by).agg(F.sum("n").alias("n_test"), ratio(right, F.sum("n")).alias("accuracy"))


def binary_cells(n: Column | str = "n") -> dict[str, Column]:
    def total(y: int, p: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col(n) if isinstance(n, str) else n)),
                          F.lit(0))

    return {"tp": total(1, 1), "fp": total(0, 1), "fn": total(1, 0), "tn": total(0, 0)}


def binary_report(counts: DataFrame, by: list[str]) -> DataFrame:
    """0/1 truth and prediction: accuracy, precision, recall, F1, false-positive and -negative rates.

    The normal false-positive rate is NULL without normals; `fpr` and `fnr` are 0 there.
    """
    cells = binary_cells()
    sums = counts.groupBy(*by).agg(*[c.alias(k) for k, c in cells.items()])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return sums.select(
        *by, (tp + fp + fn + tn).alias("n_test"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision_anomaly"),
        ratio(tp, tp + fn).alias("recall_anomaly"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_anomaly"),
        ratio(fp, fp + tn, None).alias("false_positive_rate_normal"),
        ratio(fp, fp + tn).alias("fpr"), ratio(fn, fn + tp).alias("fnr"))


def fold_report(pred: DataFrame, model: str = "model", grp: str = "grp", labels: list | None = None) -> DataFrame:
    """Per-group rows plus the pooled row: size, accuracy, macro F1."""
    by = [model, grp]
    counts = with_pooled(confusion_counts(pred, by), grp)
    f1 = averages(per_class(counts, by, labels), by).select(*by, "f1_macro")
    return accuracy(counts, by).join(f1, by)


def loso_summary(pred: DataFrame, labels: DataFrame, model: str = "model", grp: str = "grp") -> DataFrame:
    """Pooled binary metrics next to means over held-out attack and normal scenarios."""
    counts = with_pooled(confusion_counts(pred, [model, grp]), grp)
    report = binary_report(counts, [model, grp])
    pooled = report.where(F.col(grp) == POOLED).select(
        model, F.col("accuracy").alias("pooled_snapshot_accuracy"), F.col("f1_anomaly").alias("pooled_f1_anomaly"),
        F.col("precision_anomaly").alias("pooled_precision_anomaly"),
        F.col("recall_anomaly").alias("pooled_recall_anomaly"))
    folds = report.where(F.col(grp) != POOLED).join(labels, grp)
    attack, normal = F.col("heldout_label") != "normal", F.col("heldout_label") == "normal"
    recall, fpr = F.col("recall_anomaly"), F.col("false_positive_rate_normal")
    spread = folds.groupBy(model).agg(
        F.avg(F.when(attack, recall)).alias("attack_scenario_recall_mean"),
        F.min(F.when(attack, recall)).alias("attack_scenario_recall_min"),
        F.avg(F.when(normal, fpr)).alias("normal_scenario_fpr_mean"),
        F.max(F.when(normal, fpr)).alias("normal_scenario_fpr_max"),
        F.count_distinct(grp).alias("n_scenarios"))
    return pooled.join(spread, model)


def heldout_recall(pred: DataFrame, labels: list[str], model: str = "model", grp: str = "grp",
                   held: str = "heldout_label") -> DataFrame:
    """Recall of the held-out label and of every class, NULL for a class absent from the fold."""
    hit = F.when(F.col("y") == F.col("p"), F.col("n"))
    counts = confusion_counts(pred, [model, grp, held])
    out = []
    for x in labels:
        mine = F.when(F.col("y") == x, F.col("n"))
        out += [F.coalesce(F.sum(mine), F.lit(0)).alias(f"support_{x}"),
                ratio(F.coalesce(F.sum(F.when(F.col("y") == x, hit)), F.lit(0)), F.sum(mine), None).alias(f"recall_{x}")]
    own = F.when(F.col("y") == F.col(held), F.col("n"))
    own_hit = F.when(F.col("y") == F.col(held), hit)
    return counts.groupBy(model, grp, held).agg(
        ratio(F.coalesce(F.sum(own_hit), F.lit(0)), F.sum(own), None).alias("recall_heldout_label"), *out)


def multiclass_summary(folds: DataFrame) -> DataFrame:
    """Spread over scenarios by (feature set, model), and again by held-out label; sample std, 0 for one."""
    def spread(c: str) -> list[Column]:
        return [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"),
                F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]

    by = ["feature_set", "model"]
    return folds.groupingSets([by, [*by, "heldout_label"]], *by, "heldout_label").agg(
        F.count(F.lit(1)).alias("n_scenarios"), *spread("recall_heldout_label"), *spread("f1_macro"),
        F.avg("accuracy").alias("accuracy_mean"))


def fold_spread(folds: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """mean, sample std (NULL for one fold) and count of each metric."""
    return folds.groupBy(*by).agg(*[
        x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"),
                                     F.count(m).alias(f"{m}_count"))])


def scenario_dispersion(folds: DataFrame, metrics: list[str], model: str = "model", grp: str = "grp") -> DataFrame:
    """Spread over scenarios without the pooled row: population std, minimum, exact median."""
    rows = folds.where(F.col(grp) != POOLED).dropna(subset=metrics)
    stats = rows.groupBy(model).agg(F.count(F.lit(1)).alias("n_scenarios"), *[
        x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"),
                                     F.min(m).alias(f"{m}_min"))])
    medians = column_percentiles(rows, [model], metrics, 0.5).groupBy(model).agg(*[
        F.max(F.when(F.col("feature") == m, F.col("value"))).alias(f"{m}_median") for m in metrics])
    return stats.join(medians, model)


#: Neighbouring rows that a bootstrap task adds up at once; their draws of all resamples are one group (two bytes a draw).
DRAW_BLOCK = 4096
#: Draws of one resample that a task makes at once.
DRAW_SLOTS = 1_000_000


def _chained_hashes(slots: np.ndarray, seeds: int) -> np.ndarray:
    """XXH64 of longs on top of the hash of the columns before them: what `xxhash64` gives with one long column more."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(v: np.ndarray, by: int) -> np.ndarray:
        return (v << np.uint64(by)) | (v >> np.uint64(64 - by))

    with np.errstate(over="ignore"):
        h = np.uint64(seeds % 2**64) + p5 + np.uint64(8)
        h = turned(h ^ (turned(slots.astype(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def _dealt_draws(batches):
    """Row numbers drawn by slots of one resample, dealt by block of rows: two bytes a draw."""
    for batch in batches:
        for row in batch.to_pylist():
            slots = np.arange(row["_slot"], min(row["_slot"] + DRAW_SLOTS, row["_n"] + 1))
            # The same draw on every attempt of a task, so a lost executor changes nothing.
            unit = (_chained_hashes(slots, row["_h"]) & np.uint64(2**40 - 1)) / float(2**40)
            drawn = np.sort(np.floor(unit * row["_n"]).astype(np.int64))
            blocks = np.arange(drawn[0] // DRAW_BLOCK, drawn[-1] // DRAW_BLOCK + 1)
            cuts = np.searchsorted(drawn, np.append(blocks, blocks[-1] + 1) * DRAW_BLOCK)
            cells = [(int(b), drawn[i:j] - b * DRAW_BLOCK) for b, i, j in zip(blocks, cuts, cuts[1:]) if i < j]
            for at in range(0, len(cells), 1024):
                part = cells[at:at + 1024]
                yield pa.RecordBatch.from_pydict({
                    "_model": pa.array([row["_model"]] * len(part), batch.schema.field("_model").type),
                    "_boot": pa.array([row["_boot"]] * len(part), pa.int32()),
                    "_block": pa.array([b for b, _ in part], pa.int64()),
                    "_at": pa.array([d.astype(np.uint16).tobytes() for _, d in part], pa.binary())})


def _drawn_sums(draws: pd.DataFrame, rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """Exact sums over one block of rows for each resample, in units of 10^-18 kept as three whole parts."""
    names = ["_model", "_boot", *[f"_s{i}" for i in range(n)]]
    if draws.empty or rows.empty:
        return pd.DataFrame(columns=names)
    table = np.zeros((DRAW_BLOCK, 3 * n))
    for slot, *cells in rows[["_i", *[f"_v{i}" for i in range(n)]]].itertuples(index=False):
        for i, v in enumerate(cells):
            rest, low = divmod(int(v.scaleb(18)), 10**9)
            table[slot % DRAW_BLOCK, 3 * i:3 * i + 3] = (*divmod(rest, 10**9), low)
    out = []
    for model, boot, at in draws[["_model", "_boot", "_at"]].itertuples(index=False):
        # Whole numbers far below 2^53: the sums are the same in any order.
        sums = [int(v) for v in np.bincount(np.frombuffer(at, np.uint16), minlength=DRAW_BLOCK) @ table]
        out.append([model, boot, *[Decimal(f"{(sums[j] * 10**9 + sums[j + 1]) * 10**9 + sums[j + 2]}E-18") for j in range(0, 3 * n, 3)]])
    return pd.DataFrame(out, columns=names)


def resampled_means(rows: DataFrame, metrics: list[str], n_boot: int, seed: int, model: str = "model") -> DataFrame:
    """Means of `n_boot` resamples of each model's rows (numbered from 0 in `_i`), kept as one row per resample.

    Draws travel packed, dealt by block of the rows they hit; a block meets its draws once, and only its sums go on.
    Work and shuffle grow with rows times resamples, memory is bounded by one block.
    """
    values = rows.select(F.col(model).alias("_model"), F.floor(F.col("_i") / DRAW_BLOCK).alias("_block"), "_i",
                         *[F.col(m).cast("decimal(28,18)").alias(f"_v{i}") for i, m in enumerate(metrics)])
    sizes = rows.where(F.col(model).isNotNull()).groupBy(F.col(model).alias("_model")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sized(sizes)
    # One row for each resample and run of slots, spread by number: rows this short would be put together in one task otherwise.
    tasks = -(-n_boot * (sizes.agg(F.sum("_n")).first()[0] or 1) // (4 * DRAW_SLOTS))
    runs = sizes.withColumn("_boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn(
        "_slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(DRAW_SLOTS).cast("long"))))
    runs = runs.repartition(tasks, "_model", "_boot", "_slot").withColumn("_h", F.xxhash64(F.lit(seed), "_model", "_boot"))
    kind = rows.schema[model].dataType.simpleString()
    draws = runs.mapInArrow(_dealt_draws, f"_model {kind}, _boot int, _block long, _at binary")
    n = len(metrics)
    parts = draws.groupBy("_model", "_block").cogroup(values.groupBy("_model", "_block")).applyInPandas(
        lambda a, b: _drawn_sums(a, b, n), ", ".join([f"_model {kind}, _boot int", *[f"_s{i} decimal(38,18)" for i in range(n)]]))
    sums = parts.groupBy("_model", "_boot").agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(n)]).join(sizes, "_model")
    return sums.select(F.col("_model").alias(model), "_boot", *[
        (F.col(f"_s{i}").cast("double") / F.col("_n")).alias(m) for i, m in enumerate(metrics)])


def bootstrap_interval(folds: DataFrame, metrics: list[str], n_boot: int = 2500, seed: int = 4200,
                       model: str = "model", grp: str = "grp") -> DataFrame:
    """Cluster bootstrap: scenarios are drawn with replacement, 95 % interval of the resampled means."""
    rows = folds.where(F.col(grp) != POOLED).dropna(subset=metrics).select(model, grp, *metrics)
    hashed = F.xxhash64(model, grp)
    rows = cut_lineage(number_rows(rows, [model], [hashed, F.col(grp)], hash_chunk(hashed, 6), "_i"))
    # Each percentile reads the means several times; the draws are made once.
    means = cut_lineage(resampled_means(rows, metrics, n_boot, seed, model))
    out = None
    for m in metrics:
        part = exact_percentiles(means, [model], m, {f"{m}_ci95_low": 0.025, f"{m}_ci95_high": 0.975})
        out = part if out is None else out.join(part, model)
    return out


def dispersion_report(folds: DataFrame, metrics: list[str], n_boot: int = 2500, seed: int = 4200) -> DataFrame:
    """Spread over held-out scenarios with its bootstrap interval, and how that was drawn: unit, number and seed of the draws."""
    spread = scenario_dispersion(folds, metrics).join(bootstrap_interval(folds, metrics, n_boot, seed), "model")
    return spread.withColumns({"bootstrap_unit": F.lit("held_out_scenario"), "n_bootstrap": F.lit(n_boot), "bootstrap_seed": F.lit(seed)})


# --- score curves ----------------------------------------------------------------------------------

def curve_points(pred: DataFrame, by: list[str], score: str = "score", positive: str = "y") -> DataFrame:
    """Cumulative true and false positives at each distinct score, from the highest down.

    Rows are reduced to distinct scores first; the running sums work in slices cut at sketched quantiles.
    """
    counts = pred.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.when(F.col(positive) == 1, 1)).alias("pos"), F.count(F.when(F.col(positive) != 1, 1)).alias("neg"))
    parts = [i / 64 for i in range(1, 64)]
    stats = counts.groupBy(*by).agg(F.percentile_approx("score", parts, 1000).alias("_cuts"),
                                    F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    stats = sized(stats)
    rows = counts.join(stats, by) if by else counts.withColumns({
        c: stats.select(c).scalar() for c in ("_cuts", "n_pos", "n_neg")})
    rows = rows.withColumn("_part", F.size(F.filter("_cuts", lambda c: c > F.col("score")))).drop("_cuts")
    return running_sums(rows, by, [F.desc("score")], F.col("_part"), {"tp": "pos", "fp": "neg"}).drop("_part")


def roc_points(points: DataFrame, by: list[str]) -> DataFrame:
    return points.select(*by, "score", ratio(F.col("fp"), F.col("n_neg"), None).alias("fpr"),
                         ratio(F.col("tp"), F.col("n_pos"), None).alias("tpr"))


def pr_points(points: DataFrame, by: list[str]) -> DataFrame:
    return points.select(*by, "score", ratio(F.col("tp"), F.col("tp") + F.col("fp"), None).alias("precision"),
                         ratio(F.col("tp"), F.col("n_pos"), None).alias("recall"))


def curve_areas(points: DataFrame, by: list[str]) -> DataFrame:
    """ROC area by trapezoids and average precision by steps."""
    both = F.any_value((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    return points.groupBy(*by).agg(
        F.when(both, F.try_divide(
            F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)),
            F.any_value(F.col("n_pos") * F.col("n_neg")).cast("double"))).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))),
                     F.any_value(F.col("n_pos")).cast("double")).alias("average_precision"))


def one_vs_rest_auc(pred: DataFrame, by: list[str], classes: list, scores: dict, y: str = "y") -> DataFrame:
    """Macro mean of the one-against-rest ROC areas; `scores` maps a class to its score column."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("cls"), F.col(scores[c]).cast("double").alias("score"),
                 (F.col(y) == F.lit(c)).cast("int").alias("hit")) for c in classes])
    long = pred.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.cls", "_c.score", "_c.hit")
    areas = curve_areas(curve_points(long, [*by, "cls"], "score", "hit"), [*by, "cls"])
    return areas.groupBy(*by).agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def score_histogram(pred: DataFrame, by: list[str], score: str = "score", bins: int = 50) -> DataFrame:
    """Equal-width histogram per group over the group's own range; the top edge belongs to the last bin."""
    s = F.col(score).cast("double")
    span = pred.groupBy(*by).agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"), F.count(s).alias("_n"))
    flat = F.col("_lo") == F.col("_hi")
    span = span.select(*by, "_n", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    slot = F.least(F.floor((s - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    width = (F.any_value("_hi") - F.any_value("_lo")) / bins
    return pred.where(s.isNotNull()).join(sized(span), by).groupBy(*by, slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / (F.any_value("_n") * width)).alias("density"))


# --- sweeps ----------------------------------------------------------------------------------------

def threshold_sweep(df: DataFrame, score: str, y: str, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """Binary metrics at many thresholds in one pass.

    A row only matters by how many thresholds it exceeds, so the fact table shrinks to counts per
    (y, level) and every threshold is read off those. `idx` is the position in the given list.
    """
    by = by or []
    s = F.col(score)
    level = sum((F.coalesce((s > F.lit(float(t))).cast("int"), F.lit(0)) for t in thresholds), F.lit(0))
    levels = df.groupBy(*by, F.col(y).alias("y"), level.alias("_level")).agg(F.count(F.lit(1)).alias("n"))
    settings = F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(float(t)).alias("threshold"), F.lit(sum(u < t for u in thresholds)).alias("rank"))
        for i, t in enumerate(thresholds)])
    rows = levels.withColumn("_t", F.explode(settings))
    counts = rows.groupBy(*by, "_t.idx", "_t.threshold", "y", (F.col("_level") > F.col("_t.rank")).cast("int").alias("p")).agg(
        F.sum("n").alias("n"))
    return binary_report(counts, [*by, "idx", "threshold"])


def best_setting(sweep: DataFrame, metric: str, by: list[str] | None = None) -> DataFrame:
    """Best row of a sweep; the first setting wins a tie."""
    score = F.struct(F.col(metric), (-F.col("idx")).alias("_first"))
    row = F.struct(*[F.col(c) for c in sweep.columns if c not in (by or [])])
    return sweep.groupBy(*(by or [])).agg(F.max_by(row, score).alias("_best")).select(*(by or []), "_best.*")


def comparison_table(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """Model comparison: rows of several reports under their metric scope."""
    out = None
    for part, scope in parts:
        tagged = part.withColumn("metric_scope", F.lit(scope))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """Replace the rows of every key that was run again."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def patch(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrite some columns of matching rows, keep everything else."""
    fresh = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(fresh, key, "left").select(*[
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
