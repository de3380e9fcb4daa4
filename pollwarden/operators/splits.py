"""Train/test splits, caps, weights and balanced samples.

"Random" choices are ranks of a seeded hash of the row id: the same rows on every attempt and on any
number of executors. Ranks come from `number_rows`, so a class with most of the rows is still parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollwarden.operators.ordered import hash_chunk, number_rows
from pollwarden.session import sized


def seeded_hash(row_id: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(row_id))


def _ranked(df: DataFrame, keys: list[str], row_id: str, seed: int, out: str = "_rank") -> DataFrame:
    hashed = seeded_hash(row_id, seed)
    return number_rows(df, keys, [hashed, F.col(row_id)], hash_chunk(hashed), out)


def split_by_rank(df: DataFrame, label: str, order: Column, chunk: Column, test_size: float = 0.2) -> DataFrame:
    """First round(test_size * n) rows of each class, in the given order, become the test part."""
    sizes = sized(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    ranked = number_rows(df, [label], [order], chunk, "_rank").join(sizes, label)
    part = F.when(F.col("_rank") < F.round(F.col("_n") * test_size), "test").otherwise("train")
    return ranked.select(*df.columns, part.alias("split"))


def stratified_split(df: DataFrame, label: str, row_id: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Stratified train/test parts with a note; unstratified when a class has one row, none when n < 2."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    smallest, total = sizes.agg(F.min("_n"), F.sum("_n")).first()
    if (total or 0) < 2:
        return df.withColumns({"split": F.lit("train"), "split_note": F.lit("no split")})
    hashed = seeded_hash(row_id, seed)
    if smallest >= 2:
        out = split_by_rank(df, label, F.struct(hashed, F.col(row_id)), hash_chunk(hashed), test_size)
        return out.withColumn("split_note", F.lit("stratified"))
    ranked = _ranked(df, [], row_id, seed)
    part = F.when(F.col("_rank") < round(total * test_size), "test").otherwise("train")
    return ranked.select(*df.columns, part.alias("split"), F.lit("unstratified").alias("split_note"))


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int = 10, seed: int = 42) -> DataFrame:
    ranked = _ranked(df, [label], row_id, seed)
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """Fold number of each group, in sorted order. One row per group: every group is one model fit."""
    return df.select(group).where(F.col(group).isNotNull()).distinct().withColumn(
        "fold", (F.dense_rank().over(Window.orderBy(group)) - 1).cast("int"))


def greedy_phases(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Largest-first placement into the lightest of k folds, for (size, how many groups) in falling size.

    Groups of one size fill the lightest folds in a fixed rotation until the next fold is level, so a size
    needs at most k phases (size, first rank, number placed, fold rotation) however many groups it has.
    """
    loads = [0] * k
    phases = []
    for size, count in sizes:
        start = 0
        while start < count:
            # These folds take turns until the lightest of the others is level with the next pick.
            low = min(loads)
            group = sorted((j for j in range(k) if loads[j] < low + size), key=lambda j: (loads[j], j))
            others = [loads[j] for j in range(k) if j not in group]
            placed = count - start
            if others:
                placed = min(placed, sum(-(-(min(others) - loads[j]) // size) for j in group))
            phases.append((size, start, placed, group))
            for i, j in enumerate(group):
                loads[j] += size * (placed // len(group) + (1 if i < placed % len(group) else 0))
            start += placed
    return phases


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Balanced group folds: groups by falling size, each into the lightest fold.

    The driver sees distinct sizes with their multiplicity, never the groups: n rows have at most
    sqrt(2n) distinct group sizes. Groups of one size are told apart by a ranked hash.
    """
    counts = sized(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("size")))
    rows = counts.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()
    phases = greedy_phases([(r["size"], r["n"]) for r in rows], k)
    table = df.sparkSession.createDataFrame(
        phases or [(0, 0, 0, [0])], "size long, first long, placed long, rotation array<int>")
    hashed = F.xxhash64(group)
    ranked = number_rows(counts, ["size"], [hashed, F.col(group)], hash_chunk(hashed), "_rank")
    mine = (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("placed"))
    slot = ((F.col("_rank") - F.col("first")) % F.size("rotation")).cast("int")
    return ranked.join(table, "size").where(mine).select(group, "size", F.get("rotation", slot).alias("fold"))


def choose_splitter(n_groups: int, min_groups: int = 3) -> tuple[str | None, str]:
    """Refuse, leave one group out, or five group folds."""
    if n_groups < min_groups:
        return None, f"insufficient groups: have {n_groups}, need {min_groups}"
    return ("leave_one_out", "LeaveOneGroupOut") if n_groups <= 5 else ("group_kfold", "GroupKFold(n_splits=5)")


def readiness(df: DataFrame, min_groups: int = 3, group: str = "run_id", label: str = "label") -> DataFrame:
    """One status row: how many groups and labels, and whether a grouped evaluation may run."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"),
        F.count_distinct(label).alias("n_labels"),
    ).withColumn("status", F.when(F.col("n_groups") < min_groups, "insufficient_groups")
                 .when(F.col("n_labels") < 2, "insufficient_labels").otherwise("ok"))


def _lowest_ranked(df: DataFrame, label: str, row_id: str, seed: int, quotas: DataFrame) -> DataFrame:
    """Rows whose rank in their class is below the class's `_quota`.

    Counts by chunk of the hash tell in which chunk a quota ends: rows of later chunks are never ordered or shuffled.
    """
    chunk = hash_chunk(seeded_hash(row_id, seed))
    counts = df.where(F.col(label).isNotNull()).groupBy(label, chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_m"))
    along = Window.partitionBy(label).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(along), F.lit(0)))
    ends = counts.join(quotas, label).where(F.col("_before") < F.col("_quota")).groupBy(label).agg(
        F.max("_chunk").alias("_last"), F.max("_quota").alias("_quota"))
    near = df.join(sized(ends), label).where(chunk <= F.col("_last"))
    return _ranked(near, [label], row_id, seed).where(F.col("_rank") < F.col("_quota")).select(*df.columns)


def proportional_cap(df: DataFrame, label: str, row_id: str, cap: int, seed: int = 42) -> DataFrame:
    """At most `cap` training rows, shared over classes by size (half-even rounding, at least one each)."""
    if cap <= 0:
        return df
    sizes = sized(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.sum("_n").alias("t")).scalar()
    quota = F.when(total <= cap, F.col("_n")).otherwise(F.least(F.col("_n"), F.greatest(
        F.lit(1), F.bround(F.col("_n") * F.lit(float(cap)) / total).cast("long"))))
    return _lowest_ranked(df, label, row_id, seed, sizes.select(label, quota.alias("_quota")))


def class_cap(df: DataFrame, label: str, row_id: str, cap: int, only: list[str] | None = None,
              seed: int = 42) -> DataFrame:
    """At most `cap` rows of each class, or of the listed classes."""
    if cap <= 0:
        return df
    limited = F.lit(True) if only is None else F.col(label).isin(only)
    return _ranked(df, [label], row_id, seed).where(~limited | (F.col("_rank") < cap)).select(*df.columns)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * rows of the class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return sizes.withColumn("weight", whole.select("t").scalar() / (whole.select("k").scalar() * F.col("n")))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    return df.join(sized(class_weights(df, label)).select(label, F.col("weight").alias(out)), label)


def overlap_report(test: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """How many test rows, and distinct feature vectors, also occur in train."""
    def vectors(df: DataFrame) -> DataFrame:
        return df.select(F.xxhash64(*columns).alias("_h"), F.struct(*columns).alias("_f"))

    # Counts per distinct vector: a vector copied a billion times is one row of the join.
    seen = vectors(train).groupBy("_h", "_f").agg(F.count(F.lit(1)).alias("_tr"))
    asked = vectors(test).groupBy("_h", "_f").agg(F.count(F.lit(1)).alias("_te"))
    both = asked.join(seen, ["_h", "_f"], "left")
    hit = F.col("_tr").isNotNull()
    return both.agg(
        F.coalesce(F.sum("_te"), F.lit(0)).alias("n_test"),
        F.count(F.when(hit, 1)).alias("n_overlap_fingerprints"),
        F.coalesce(F.sum(F.when(hit, F.col("_te"))), F.lit(0)).alias("n_test_rows_in_overlap"),
    ).withColumn("overlap_rate_of_test", F.coalesce(F.try_divide("n_test_rows_in_overlap", "n_test"), F.lit(0.0)))

