"""Synthetic rows: neighbour interpolation, noisy bootstrap, parametric floods.

Every random draw is a seeded hash of row and column, so a retried task writes the same rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pollwarden.functions.features import flow_features
from pollwarden.operators.cleaning import BOOTSTRAP_SOURCE, HANDMADE_SOURCE, mark_synthetic
from pollwarden.operators.ordered import first_rows, hash_chunk, number_rows
from pollwarden.operators.splits import seeded_hash, stratified_split
from pollwarden.session import cut_lineage, sized

_STEPS = 2**40


def uniform(seed: int, *parts: Column | str) -> Column:
    """Uniform draw in [0, 1) fixed by the seed and the given columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(_STEPS)) / F.lit(float(_STEPS))


def hashed_bits(h: np.ndarray, salt: int) -> np.ndarray:
    """64 bits fixed by an unsigned row hash and a salt (splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def hashed_draws(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform draws in [0, 1) inside a task, fixed by row hash and salt."""
    return (hashed_bits(h, salt) >> np.uint64(11)) / float(2**53)


def shuffled_number(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where each row number below n goes in a seeded permutation of 0 .. n - 1, computed without sorting.

    Four Feistel rounds permute the numbers of as many bits as n needs; one that lands at n or above is sent on until it lands below.
    """
    bits = max(2, (n - 1).bit_length())
    out, open_ = numbers.astype(np.uint64), np.arange(len(numbers))
    while len(open_):
        value, low = out[open_], bits // 2
        for k in range(4):  # the halves change places, and so do their widths
            high, right = value >> np.uint64(low), value & np.uint64((1 << low) - 1)
            mask = np.uint64((1 << (bits - low)) - 1)
            value = (right << np.uint64(bits - low)) | (high ^ (hashed_bits(right, seed * 4 + k) & mask))
            low = bits - low
        out[open_] = value
        open_ = open_[value >= n]
    return out.astype(np.int64)


def normal(seed: int, *parts: Column | str) -> Column:
    """Standard normal draw (Box-Muller) fixed by the seed and the given columns."""
    u = F.greatest(uniform(seed, *parts), F.lit(1.0 / _STEPS))
    v = uniform(seed + 7919, *parts)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)


# --- SMOTE -----------------------------------------------------------------------------------------

#: Rows of a class that place its splitting planes; few enough for Spark to limit them per map task.
PLANE_ROWS = 900


@dataclass
class _Splits:
    """Planes of one class: for each table directions, and where the class's sample is cut in half along them."""

    directions: list[np.ndarray]
    middle: list[np.ndarray]
    spread: list[np.ndarray]

    def cells(self, x: np.ndarray) -> list[np.ndarray]:
        """Cell codes of every table: the row's own cell, and the one beyond the plane that the row is nearest to."""
        out = []
        for w, middle, spread in zip(self.directions, self.middle, self.spread):
            side = (x @ w - middle) / spread
            bits = 1 << np.arange(w.shape[1], dtype=np.int64)
            own = (side > 0) @ bits if w.shape[1] else np.zeros(len(x), np.int64)
            out.append(np.stack([own, own ^ bits[np.abs(side).argmin(axis=1)]], axis=1) if w.shape[1] else own[:, None])
        return out


def _splits(sample: np.ndarray, n: int, cell_rows: int, tables: int, seed: int) -> _Splits:
    planes = max(0, math.ceil(math.log2(n / cell_rows)))
    rng = np.random.default_rng(seed)
    found = _Splits([], [], [])
    for _ in range(tables if planes else 1):  # without planes every table would be the same single cell
        w = rng.normal(size=(sample.shape[1], planes))
        at = sample @ w
        found.directions.append(w)
        found.middle.append(np.median(at, axis=0))
        found.spread.append(np.maximum(at.std(axis=0), 1e-12))
    return found


def _nearest(ids: np.ndarray, points: np.ndarray, k: int, block: int = 512) -> list[list[dict]]:
    """The k nearest other rows of every row as (d, id), d the squared distance."""
    out = []
    norms = (points**2).sum(axis=1)
    for start in range(0, len(points), block):
        part = points[start:start + block]
        dist = norms[None, :] - 2.0 * part @ points.T
        dist[np.arange(len(part)), np.arange(start, start + len(part))] = np.inf
        near = np.argpartition(dist, k - 1, axis=1)[:, :k]
        true = ((part[:, None, :] - points[near]) ** 2).sum(axis=2)
        out += [[{"d": float(d), "id": ids[j]} for d, j in zip(ds, js)] for ds, js in zip(true, near)]
    return out


def nearest_in_class(rows: DataFrame, label: str, k: int, sizes: dict, cell_rows: int = 2000, tables: int = 6, seed: int = 42) -> DataFrame:
    """(label, _id, near): up to k nearest rows of the same class, nearest first, for rows (label, _id, x).

    Each class is cut by seeded planes through the middle of a hashed sample, in several tables with planes of their own; the number of planes
    follows the class size, so that a cell holds about `cell_rows` rows. Cells overlap: a row also enters the cell beyond its nearest plane.
    Neighbours are searched inside cells; the candidates of all tables are united and the nearest by true distance are kept. A class of one
    cell is searched exactly. A cell of more than four times its share (many equal rows) is dealt by hash into parts of that size.
    """
    sample = first_rows(rows, [label], [F.xxhash64(F.lit(seed), "_id"), F.col("_id")], PLANE_ROWS).select(label, "x").toPandas()
    splits = {value: _splits(np.array(own["x"].to_list(), dtype=float), sizes[value], cell_rows, tables, seed)
              for value, own in sample.groupby(label)}
    kind, id_kind = (rows.schema[c].dataType.simpleString() for c in (label, "_id"))

    def deal(batches):
        for pdf in batches:
            for value, own in pdf.groupby(label):
                x = np.array(own["x"].to_list(), dtype=float)
                for table, codes in enumerate(splits[value].cells(x)):
                    for code in codes.T:
                        yield pd.DataFrame({label: own[label], "_table": table, "_code": code, "_id": own["_id"], "x": own["x"]})

    dealt = rows.select(label, "_id", "x").mapInPandas(deal, f"`{label}` {kind}, _table int, _code long, _id {id_kind}, x array<double>")
    cell = [label, "_table", "_code"]
    parts = sized(dealt.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / (4 * cell_rows)).cast("int").alias("_parts")))
    dealt = dealt.join(parts, cell).withColumn("_part", F.pmod(F.xxhash64("_id", "_table"), F.col("_parts")).cast("int"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        points, ids = np.array(pdf["x"].to_list(), dtype=float), pdf["_id"].to_numpy().tolist()
        near = _nearest(ids, points, min(k, len(points) - 1)) if len(points) > 1 else [[]]
        return pd.DataFrame({label: pdf[label], "_id": pdf["_id"], "near": near})

    found = dealt.groupBy(*cell, "_part").applyInPandas(search, f"`{label}` {kind}, _id {id_kind}, near array<struct<d:double,id:{id_kind}>>")
    united = found.groupBy(label, "_id").agg(F.flatten(F.collect_list("near")).alias("near"))  # at most 2 * tables * k candidates
    return united.select(label, "_id", F.transform(F.slice(F.array_sort(F.array_distinct("near")), 1, k), lambda c: c["id"]).alias("near"))


def smote(df: DataFrame, label: str, row_id: str, features: list[str], k: int = 5, seed: int = 42,
          cell_rows: int = 2000, tables: int = 6) -> DataFrame:
    """Grow every class to the size of the largest by interpolating towards near rows of the same class.

    Neighbours come from nearest_in_class; row_id must tell rows apart. Returns originals plus new rows, whose other columns are null.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    sizes = {r[label]: r["_n"] for r in counts.collect()}  # one number for each class
    if not sizes or min(sizes.values()) < 2 or len(set(sizes.values())) == 1:
        return df
    big, k = max(sizes.values()), max(1, min(k, min(sizes.values()) - 1))
    small = [value for value, n in sizes.items() if n < big]
    size = F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair if v is not None])[F.col(label)]
    rows = cut_lineage(df.where(F.col(label).isin(small)).select(
        label, F.col(row_id).alias("_id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x")))
    near = nearest_in_class(rows, label, k, sizes, cell_rows, tables, seed)
    hashed = F.xxhash64(F.lit(seed), "_id")
    ranked = number_rows(rows, [label], [hashed, F.col("_id")], hash_chunk(hashed), "_rank")
    share = lambda rank: F.floor(F.lit(big) * rank / size)  # noqa: E731 - new rows up to a rank, spread evenly
    ranked = ranked.withColumn("_add", share(F.col("_rank") + 1) - share(F.col("_rank")) - 1)
    copies = ranked.where(F.col("_add") > 0).join(near.drop(label), "_id").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_add"))))
    pick = F.floor(uniform(seed + 1, "_id", "_copy") * F.size("near")).cast("int")
    copies = copies.withColumn("_other", F.coalesce(F.get("near", pick), F.col("_id")))  # a row alone in its cells repeats itself
    both = copies.join(rows.select(F.col("_id").alias("_other"), F.col("x").alias("z")), "_other")
    step = uniform(seed + 2, "_id", "_copy")
    made = both.select(label, F.zip_with("x", "z", lambda a, b: a + step * (b - a)).alias("x"))
    made = made.select(label, *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(features)])
    return df.unionByName(made, allowMissingColumns=True)


# --- noisy bootstrap of real attack rows -----------------------------------------------------------

# Fixed noise scale per counter; rates are recomputed from the noisy counters.
COUNTER_NOISE = {"packet_count": 0.08, "byte_count": 0.08, "duration_sec": 0.05}
DURATION_NOISE = 0.05


def _noise(scale: float, seed: int, name: str) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(1.5), 1.0 + scale * normal(seed, F.lit(name), F.col("_slot"))))


def bootstrap_rows(seeds: DataFrame, row_id: str, n: int, seed: int = 42, base_time: str = "2026-01-01 00:00:00") -> DataFrame:
    """n rows drawn with replacement from the seed rows, with clamped noise and recomputed rates."""
    total = seeds.count()
    if total == 0:
        raise ValueError("no real attack rows to draw from")
    hashed = seeded_hash(row_id, seed)
    pool = number_rows(seeds, [], [hashed, F.col(row_id)], hash_chunk(hashed), "_index")
    slots = seeds.sparkSession.range(n).select(F.col("id").alias("_slot"))
    slots = slots.withColumn("_index", F.floor(uniform(seed, F.lit("draw"), "_slot") * total))
    rows = pool.join(slots, "_index")
    counters = {
        c: F.when(F.col(c) == 0, F.col(c)).otherwise(
            F.greatest(F.lit(1), F.bround(F.col(c) * _noise(s, seed, c)).cast("long"))).cast("long")
        for c, s in COUNTER_NOISE.items()}
    duration = F.col("flow_duration") * _noise(DURATION_NOISE, seed, "flow_duration")
    rows = rows.withColumns({**counters, "flow_duration": duration})
    alive = F.when(F.col("flow_duration") > 0, F.col("flow_duration")).otherwise(
        F.greatest(F.col("duration_sec").cast("double"), F.lit(1.0)))
    rows = rows.withColumn("flow_duration", alive)
    stamp = F.timestamp_add("SECOND", F.floor(uniform(seed, F.lit("time"), "_slot") * 600).cast("int"), F.lit(base_time).cast("timestamp_ntz"))
    return rows.withColumns({
        "packet_count_per_sec": F.col("packet_count") / F.col("flow_duration"),
        "byte_count_per_sec": F.col("byte_count") / F.col("flow_duration"),
        "packet_size_avg": F.coalesce(F.try_divide("byte_count", "packet_count"), F.lit(0.0)),
        "flow_id": F.floor(F.lit(10**6) + uniform(seed, F.lit("id"), "_slot") * (10**8 - 10**6)),
        "timestamp": stamp, "is_synthetic": F.lit(1), "source": F.lit(BOOTSTRAP_SOURCE),
    }).drop("_index", "_slot")


def with_bootstrap(df: DataFrame, row_id: str = "flow_id", target: int = 400, seed: int = 42,
                   replace_handmade: bool = False) -> DataFrame:
    """Replace earlier bootstrap rows by a fresh draw from the real attack rows."""
    marked = mark_synthetic(df)
    kept = marked.where(F.col("source") != BOOTSTRAP_SOURCE)
    if replace_handmade:
        kept = kept.where(F.col("source") != HANDMADE_SOURCE)
    real = kept.where((F.lower("label") == "ddos") & (F.col("is_synthetic") == 0))
    return kept.unionByName(bootstrap_rows(real, row_id, target, seed), allowMissingColumns=True)


# --- parametric floods -----------------------------------------------------------------------------

# Fixed ranges [low, high) per flood kind: protocol, packets, bytes per packet, target ports, start.
FLOODS = {
    "tcp": {"proto": 6, "packets": (50_000, 8_000_000), "size": (40, 66), "ports": [80, 443, 8080, 8443], "minute": 0},
    "udp": {"proto": 17, "packets": (100_000, 7_000_000), "size": (512, 1500), "ports": [53, 123, 161, 500, 1900], "minute": 5},
    "icmp": {"proto": 1, "packets": (200_000, 9_000_000), "size": (64, 128), "ports": [0], "minute": 10},
}
# Fixed addresses of generated floods.
FLOOD_SOURCES = ["10.0.0.4", "10.0.0.5", "10.0.0.6"]
FLOOD_TARGETS = ["10.0.0.1", "10.0.0.2", "10.0.0.3"]


def flood_rows(spark: SparkSession, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """Generated flood polls of each kind, marked synthetic."""
    out = None
    for kind, n in counts.items():
        spec = FLOODS[kind]

        def draw(name: str, low: int, high: int, kind=kind) -> Column:
            return (F.lit(low) + F.floor(uniform(seed, F.lit(kind), F.lit(name), "id") * (high - low))).cast("long")

        def choose(name: str, values: list, kind=kind) -> Column:
            slot = F.floor(uniform(seed, F.lit(kind), F.lit(name), "id") * len(values)).cast("int")
            return F.get(F.array(*[F.lit(v) for v in values]), slot)

        start = F.lit(f"2026-05-15 14:{spec['minute']:02d}:00").cast("timestamp_ntz")
        rows = spark.range(n).select(
            F.timestamp_add("SECOND", draw("time", 0, 300).cast("int"), start).alias("timestamp"),
            choose("switch", [1, 2]).alias("datapath_id"), choose("src", FLOOD_SOURCES).alias("ip_src"),
            choose("dst", FLOOD_TARGETS).alias("ip_dst"), F.lit(spec["proto"]).alias("ip_proto"),
            (F.lit(0) if kind == "icmp" else draw("sport", 1024, 65535)).cast("int").alias("tp_src"),
            choose("dport", spec["ports"]).cast("int").alias("tp_dst"),
            draw("packets", *spec["packets"]).alias("packet_count"), draw("size", *spec["size"]).alias("_size"),
            draw("sec", 5, 90).alias("duration_sec"), draw("nsec", 0, 999_999_999).alias("duration_nsec"),
            F.lit("ddos").alias("label"), F.lit(1).alias("is_synthetic"))
        rows = rows.withColumn("byte_count", F.col("packet_count") * F.col("_size")).drop("_size")
        out = rows if out is None else out.unionByName(rows)
    return flow_features(out)


def domain_shift_set(real: DataFrame, row_id: str, label: str = "label", n_bootstrap: int = 400, seed: int = 42,
                     attack: str = "ddos") -> DataFrame:
    """Train part of the real rows; a test of the other real rows plus bootstrapped attack rows."""
    parts = stratified_split(real, label, row_id, 0.2, seed).drop("split_note")
    part = F.when(F.col("split") == "test", "real_test").otherwise("train")
    parts = parts.withColumn("part", part).drop("split")
    drawn = bootstrap_rows(real.where(F.col(label) == attack), row_id, n_bootstrap, seed).withColumn("part", F.lit("bootstrap"))
    return parts.unionByName(drawn, allowMissingColumns=True)
