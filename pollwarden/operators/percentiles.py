"""Exact interpolated percentiles without collecting a group in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwarden.operators.ordered import running_sums
from pollwarden.session import cut_lineage, sized


def _ranks_around(rows: DataFrame, brackets: DataFrame, n: int) -> DataFrame:
    """Rows below and inside each bracket of a group."""
    placed = rows.join(brackets, "_k")
    v = F.col("_v")
    return placed.groupBy("_k").agg(F.any_value("_n").alias("_n"), *[x for i in range(n) for x in (
        F.count(F.when(v < F.col(f"_b{i}.lo"), 1)).alias(f"_below{i}"),
        F.count(F.when(v.between(F.col(f"_b{i}.lo"), F.col(f"_b{i}.hi")), 1)).alias(f"_inside{i}"))])


def _misses(prob: float, i: int) -> Column:
    """Whether a bracket lacks one of the two ranks between which its percentile lies."""
    at = F.lit(float(prob)) * (F.col("_n") - 1)
    return (F.floor(at) < F.col(f"_below{i}")) | (F.ceil(at) >= F.col(f"_below{i}") + F.col(f"_inside{i}"))


def _widened(brackets: DataFrame, counted: DataFrame, probs: list[float]) -> DataFrame:
    joined = brackets.join(counted.drop("_n"), "_k")
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        early = F.floor(at) < F.col(f"_below{i}")
        late = F.ceil(at) >= F.col(f"_below{i}") + F.col(f"_inside{i}")
        joined = joined.withColumn(f"_b{i}", F.struct(
            F.when(early, F.col("_min")).otherwise(F.col(f"_b{i}.lo")).alias("lo"),
            F.when(late, F.col("_max")).otherwise(F.col(f"_b{i}.hi")).alias("hi")))
    return joined.select(*brackets.columns)


def exact_percentiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                      accuracy: int = 10_000) -> DataFrame:
    """Linear-interpolated percentiles (the numpy rule), one column per entry of `probs`.

    A bounded-size quantile sketch brackets each wanted rank; rows below the bracket are only counted,
    and the few distinct values inside it are ranked exactly. Up to `accuracy` rows the bracket is the
    whole group, beyond that it spans six times the sketch's error. The counts below and inside a bracket
    prove that its rank lies in it; one that misses is widened to the group's end and counted again, so the
    answer never depends on the sketch. NULL and NaN values are ignored.
    """
    names = list(probs)
    margin = 3.0 / accuracy
    cuts = [c for n in names for c in (max(probs[n] - margin, 0.0), min(probs[n] + margin, 1.0))]
    v = F.col(value).cast("double")
    key = F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(1).alias("all"))
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(key.alias("_k"), v.alias("_v"))
    sketch = rows.groupBy("_k").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", cuts, accuracy).alias("_q"))
    small = F.col("_n") <= accuracy
    brackets = sketch.select("_k", "_n", *[
        F.struct(
            F.when(small | F.lit(probs[n] - margin <= 0), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"),
            F.when(small | F.lit(probs[n] + margin >= 1), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
        ).alias(f"_b{i}") for i, n in enumerate(names)], "_min", "_max")
    brackets = sized(brackets)
    largest = brackets.agg(F.max("_n")).first()[0] or 0
    if largest <= accuracy:
        # Every group is proven small: the built-in exact aggregate does it in one pass.
        plain = rows.groupBy("_k").agg(*[F.percentile("_v", F.lit(probs[n])).alias(n) for n in names])
        return plain.select(*[F.col("_k")[b].alias(b) for b in by], *names)
    below = sized(_ranks_around(rows, brackets, len(names)))
    missed = [_misses(probs[n], i) for i, n in enumerate(names)]
    if not below.where(reduce(lambda a, b: a | b, missed)).isEmpty():
        # The sketch was off by more than its guarantee: a bracket opens towards the side on which its rank lies.
        brackets = sized(_widened(brackets, below, [probs[n] for n in names]))
        below = sized(_ranks_around(rows, brackets, len(names)))
    placed = rows.join(brackets, "_k")
    inside = [F.col("_v").between(F.col(f"_b{i}.lo"), F.col(f"_b{i}.hi")) for i in range(len(names))]
    any_inside = inside[0]
    for test in inside[1:]:
        any_inside = any_inside | test
    near = placed.where(any_inside).groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_m"))
    wanted = F.array_compact(F.array(*[
        F.when(inside[i], F.struct(F.lit(i).alias("i"), F.col(f"_b{i}.lo").alias("lo"), F.col(f"_b{i}.hi").alias("hi")))
        for i in range(len(names))]))
    near = near.join(brackets, "_k").select("_k", "_v", "_m", F.explode(wanted).alias("_w"))
    near = near.select("_k", "_v", "_m", F.col("_w.i").alias("_i"), F.coalesce(F.floor(F.try_divide(
        F.col("_v") - F.col("_w.lo"), F.col("_w.hi") - F.col("_w.lo")) * 1024), F.lit(0)).alias("_part"))
    ranked = running_sums(near, ["_k", "_i"], [F.col("_v")], F.col("_part"), {"_upto": "_m"})
    ranked = ranked.select(F.col("_k").alias("_g"), "_v", "_m", "_i", "_upto").join(
        below.withColumnRenamed("_k", "_g"), "_g")
    prob = F.array(*[F.lit(float(probs[n])) for n in names])[F.col("_i")]
    skipped = F.array(*[F.col(f"_below{i}") for i in range(len(names))])[F.col("_i")]
    at = prob * (F.col("_n") - 1)
    first, last = skipped + F.col("_upto") - F.col("_m"), skipped + F.col("_upto")

    def holds(rank):
        return F.max(F.when((rank >= first) & (rank < last), F.col("_v")))

    found = ranked.groupBy("_g", "_i").agg(
        holds(F.floor(at)).alias("_a"), holds(F.ceil(at)).alias("_z"), F.max(at - F.floor(at)).alias("_f"))
    found = found.withColumn("_p", F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f"))
    out = found.groupBy("_g").agg(*[
        F.max(F.when(F.col("_i") == i, F.col("_p"))).alias(n) for i, n in enumerate(names)])
    return out.select(*[F.col("_g")[b].alias(b) for b in by], *names)


def column_percentiles(df: DataFrame, by: list[str], columns: list[str], prob: float) -> DataFrame:
    """One percentile of many columns at once, long form (by..., feature, value)."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.feature", "_c.v")
    return exact_percentiles(long, [*by, "feature"], "v", {"value": prob})


def left_out_percentiles(cells: DataFrame, wanted: DataFrame, by: list[str], group: str, value: str = "value",
                         count: str = "n", out: str = "percentile") -> DataFrame:
    """Exact percentile of all rows but those of one group, for every group, from counts alone.

    `cells` holds counts per (by..., group, value), `wanted` rows of (by..., group, prob). A rank among the others
    is a rank among all rows once the group's own rows before it are added. With C(v) rows up to v in all and c(v) of
    the group's own, that shift is the largest c(v) of own values with C(v) - c(v) <= rank. So cells are shuffled
    once per running sum whatever the number of groups, and no row is copied to the folds that train on it.
    `out` is NULL where no row is left. NULL and NaN values are ignored.
    """
    v = F.col(value).cast("double")
    cells = cells.where(v.isNotNull() & ~F.isnan(v) & F.col(group).isNotNull() & (F.col(count) > 0))
    cells = cut_lineage(cells.groupBy(*by, group, v.alias("_v")).agg(F.sum(count).alias("_m")))
    totals = cells.groupBy(*by, "_v").agg(F.sum("_m").alias("_all"))
    cuts = sized(totals.groupBy(*by).agg(F.percentile_approx("_v", [i / 64 for i in range(1, 64)], 1000).alias("_cuts"),
                                         F.sum("_all").alias("_rows"), F.count(F.lit(1)).alias("_values")))
    placed = totals.join(cuts, by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    ranked = cut_lineage(running_sums(placed, by, [F.col("_v")], F.col("_part"), {"_upto": "_all"}))

    own = cells.join(ranked.select(*by, "_v", "_upto", "_part"), [*by, "_v"])
    own = running_sums(own, [*by, group], [F.col("_v")], F.col("_part"), {"_own": "_m"})
    sizes = cells.groupBy(*by, group).agg(F.sum("_m").alias("_mine"))
    at = F.col("prob") * (F.col("_left") - 1)
    asked = wanted.join(cuts.drop("_cuts"), by).join(sizes, [*by, group], "left").withColumn(
        "_left", F.col("_rows") - F.coalesce("_mine", F.lit(0))).where(F.col("_left") > 0)
    asked = sized(asked.select(*by, group, "_rows", "_values", F.floor(at).alias("_low"), F.ceil(at).alias("_high"),
                               (at - F.floor(at)).alias("_share")))
    shifts = own.join(asked, [*by, group]).groupBy(*by, group).agg(*[
        F.max(F.when(F.col("_upto") - F.col("_own") <= F.col(r), F.col("_own"))).alias(f"{r}_shift") for r in ("_low", "_high")])
    points = asked.join(shifts, [*by, group], "left").select("*", F.explode(F.array(*[
        F.struct(F.lit(r).alias("end"), (F.col(r) + F.coalesce(f"{r}_shift", F.lit(0))).alias("rank")) for r in ("_low", "_high")])).alias("_p"))

    # Blocks of ranks as wide as the mean value's run: the values fill at most twice as many blocks as there are values.
    width = F.ceil(F.col("_rows") / F.col("_values"))
    runs = ranked.withColumn("_first", F.col("_upto") - F.col("_all")).select(*by, "_v", "_first", "_upto", F.explode(F.sequence(
        F.floor(F.col("_first") / width), F.floor((F.col("_upto") - 1) / width))).alias("_block"))
    points = points.withColumn("_block", F.floor(F.col("_p.rank") / width))
    found = points.join(runs, [*by, "_block"]).where((F.col("_p.rank") >= F.col("_first")) & (F.col("_p.rank") < F.col("_upto")))
    ends = found.groupBy(*by, group).agg(F.any_value("_share").alias("_share"), *[
        F.max(F.when(F.col("_p.end") == r, F.col("_v"))).alias(r) for r in ("_low", "_high")])
    ends = ends.select(*by, group, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias(out))
    return wanted.select(*by, group).join(ends, [*by, group], "left")
