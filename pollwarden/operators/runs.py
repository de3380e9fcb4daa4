"""Flow rows of logged runs: an interval index dealt by time slice and by the address that a run asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollwarden.functions.features import numeric
from pollwarden.operators.ordered import window_join
from pollwarden.session import sized

#: Roles in which a flow can belong to a run: towards a target, back from one, inside the host set, or any.
TOWARDS, BACK, INSIDE, ANY = "towards", "back", "inside", "any"


def rows_of_runs(flows: DataFrame, runs: DataFrame, attackers: list[str], hosts: list[str] | None = None,
                 grace_sec: int = 0) -> DataFrame:
    """Pairs of flow and run: the flow lies in the run's window and fits the run's `kind` and `targets`.

    `ddos` runs take L4 flows between attackers and targets both ways, `portscan` runs those towards targets,
    `normal` runs flows inside the host set, runs of any other kind (NULL too) everything in the window.
    Role and address are part of the join key next to the time slice, so a flow meets only the runs that want
    it and the range test drops nothing but the edges of slices. A flow that no run could want is not shuffled.
    A flow is given once to a run, also when both of its ends are attackers and targets. Runs without targets
    that need them, and flows without a time, match nothing.
    """
    src, dst, hosts = F.col("ip_src"), F.col("ip_dst"), hosts or []
    ports = (numeric(F.col("tp_src"), 0.0) != 0) | (numeric(F.col("tp_dst"), 0.0) != 0)

    def role(name: str, peer=None):
        return F.struct(F.lit(name).alias("role"), (F.lit("") if peer is None else peer).alias("peer"))

    kind = F.col("kind")
    targets = F.array_distinct(F.coalesce("targets", F.array().cast("array<string>")))
    towards, back = F.transform(targets, lambda t: role(TOWARDS, t)), F.transform(targets, lambda t: role(BACK, t))
    asked = runs.withColumn("_want", F.explode(
        F.when(kind == "ddos", F.concat(towards, back)).when(kind == "portscan", towards)
        .when(kind == "normal", F.array(role(INSIDE))).otherwise(F.array(role(ANY)))))
    used = {r[0] for r in asked.select("_want.role").distinct().collect()}  # of the four roles
    offers = {
        TOWARDS: F.when(src.isin(attackers) & ports, role(TOWARDS, dst)),
        BACK: F.when(dst.isin(attackers) & ports, role(BACK, src)),
        INSIDE: F.when(src.isin(hosts) & dst.isin(hosts), role(INSIDE)),
        ANY: role(ANY)}
    empty = F.array().cast("array<struct<role:string,peer:string>>")
    offered = F.array_compact(F.array(*[offers[r] for r in offers if r in used])) if used else empty
    joined = window_join(flows.withColumn("_want", F.explode(offered)), asked, "timestamp", "start_time", "end_time",
                         grace_sec=grace_sec, on=["_want"])
    twice = (F.col("_want.role") == BACK) & src.isin(attackers) & F.array_contains("targets", dst)
    return joined.where(~F.coalesce(twice, F.lit(False))).drop("_want")


def runs_alike(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different runs, each under an id of what it asks for, and the members: `run_id` and the id it belongs to (`alike`).

    Runs that agree in every column but `run_id` are given the same rows. Work on the rows is done once for each
    different run and joined to its members, so copies of a run do not multiply the flows.
    """
    asked = [F.col(c) if c == "targets" else F.col(c).cast("string").alias(c) for c in runs.columns if c != "run_id"]
    alike = F.to_json(F.struct(*asked))
    return sized(runs.withColumn("run_id", alike).distinct()), runs.select("run_id", alike.alias("alike"))
