"""Writes: reports, versioned tables, run exports, bounded logs, digests."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollwarden.operators.runs import rows_of_runs
from pollwarden.schemas import SOURCE_INDEPENDENT, TOPOLOGY_DEFAULT


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


class VersionConflict(RuntimeError):
    """Another writer committed first; read the current version again and retry."""


def _place(spark, path: str):
    """File system and path object of a folder or file of a versioned table."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def remove_path(spark, path: str) -> None:
    """Delete a folder of the shared file system; one that is not there is left alone."""
    fs, found = _place(spark, path)
    fs.delete(found, True)


def move_single(spark, folder: str, target: str) -> None:
    """Give the one part file that a job wrote into `folder` a name of its own; more or fewer parts are refused."""
    parts = [name for name, _ in _listed(spark, folder) if name.startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{folder} holds {len(parts)} part files, not one")
    fs, source = _place(spark, f"{folder}/{parts[0]}")
    place = _place(spark, target)[1]
    fs.mkdirs(place.getParent())
    if not fs.rename(source, place):
        raise OSError(f"{target} could not be written")


def _listed(spark, path: str) -> list[tuple[str, int]]:
    """(name, time of change in seconds) of what lies in a folder; nothing where it is missing."""
    fs, folder = _place(spark, path)
    found = fs.listStatus(folder) if fs.exists(folder) else []
    return [(s.getPath().getName(), s.getModificationTime() // 1000) for s in found]


def _manifests(spark, base: str) -> dict[int, tuple[str, int]]:
    """File name and time by version number."""
    return {int(name): (name, at) for name, at in _listed(spark, f"{base}/versions") if name.isdigit()}


def _target(spark, base: str, name: str) -> str:
    fs, path = _place(spark, f"{base}/versions/{name}")
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_version(df: DataFrame, base: str, expected: int | None = None, retain: int = 10, min_age_sec: int = 600,
                  orphan_sec: int = 86_400) -> str:
    """Write a fresh version, then commit it under the next number; readers never see a half-written table.

    The commit creates one small file named by the number and fails with VersionConflict where that number, or one
    after `expected`, is taken already, so no writer overwrites another's version (the file system must create files
    exclusively, as HDFS and local ones do). Of older versions the newest `retain` stay, and all younger than
    `min_age_sec`, so that readers of them can finish; data that no version names, left by lost jobs, goes after
    `orphan_sec`. The number of files is thus bounded however often a table is written.
    """
    spark = df.sparkSession
    newest = max(_manifests(spark, base), default=0)
    if expected is not None and newest != expected:
        raise VersionConflict(f"{base} is at version {newest}, not {expected}")
    folder = uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{base}/data/{folder}")
    fs, path = _place(spark, f"{base}/versions/{newest + 1:020d}")
    try:
        out = fs.create(path, False)
    except Py4JJavaError as exc:
        if "AlreadyExists" not in str(exc.java_exception):
            raise
        raise VersionConflict(f"version {newest + 1} of {base} was committed by another writer") from exc
    out.write(folder.encode())
    out.close()
    _expire(spark, base, retain, min_age_sec, orphan_sec)
    return f"{base}/data/{folder}"


def _expire(spark, base: str, retain: int, min_age_sec: int, orphan_sec: int) -> None:
    """Remove versions that are neither among the newest nor young, then their data and old data without a version."""
    now, kept, gone = time.time(), _manifests(spark, base), set()
    for number in sorted(kept)[:-max(1, retain)]:
        name, at = kept[number]
        if now - at >= min_age_sec:
            gone.add(_target(spark, base, name))
            fs, path = _place(spark, f"{base}/versions/{name}")
            fs.delete(path, False)
            del kept[number]
    named = {_target(spark, base, name) for name, _ in kept.values()}
    for folder, at in _listed(spark, f"{base}/data"):
        if folder not in named and (folder in gone or now - at >= orphan_sec):
            fs, path = _place(spark, f"{base}/data/{folder}")
            fs.delete(path, True)


def current_version(spark, base: str) -> tuple[int, str | None]:
    """Newest version whose commit is whole; a writer lost between the two steps leaves an empty file, which is passed over."""
    found = _manifests(spark, base)
    for number in sorted(found, reverse=True):
        folder = _target(spark, base, found[number][0])
        if folder:
            return number, f"{base}/data/{folder}"
    return 0, None


def read_current(spark, base: str) -> DataFrame | None:
    target = current_version(spark, base)[1]
    return spark.read.parquet(target) if target else None


def append_bounded(spark, new: DataFrame, base: str, keep: int = 500, order: list[str] | None = None, attempts: int = 20) -> None:
    """Alert log: old and new rows together, newest `keep` survive. A conflict with another writer is merged anew."""
    for attempt in range(attempts):
        seen = max(_manifests(spark, base), default=0)
        old = read_current(spark, base)
        rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
        try:
            write_version(rows.orderBy(*[F.desc(c) for c in (order or ["timestamp"])]).limit(keep), base, expected=seen)
            return
        except VersionConflict:
            if attempt == attempts - 1:
                raise


def append_polls(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def write_split(df: DataFrame, path: str, by: str = "split") -> None:
    """Train, test and raw parts as partitions of one table."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def run_export(flows: DataFrame, runs: DataFrame, attackers: list[str], hosts: list[str]) -> DataFrame:
    """Rows of every collected run: its time window, the filter of its kind, constant run columns.

    Attack runs keep attacker/target L4 flows both ways, scans one way, normal runs flows inside the host
    set, support and mesh runs everything in the window.
    """
    joined = rows_of_runs(flows, runs, attackers, hosts)
    label = F.when(F.col("kind").isin("ddos", "portscan"), F.col("kind")).otherwise("normal")
    return joined.withColumns({
        "label": label, "is_synthetic": F.lit(0), "source": F.lit(SOURCE_INDEPENDENT),
        "topology_id": F.lit(TOPOLOGY_DEFAULT), "collection_timestamp": F.col("start_time").cast("string"),
    }).drop("targets", "kind", "end_time", "start_time")


def write_runs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("run_id").parquet(path)


def update_manifest(manifest: DataFrame, counts: DataFrame, note: str) -> DataFrame:
    """New row counts where a run was exported again, with a note; other rows stay as they are."""
    joined = manifest.join(counts.select("run_id", F.col("n").alias("_n")), "run_id", "left")
    noted = F.when(F.col("notes").isNull() | (F.col("notes") == ""), F.lit(note)).otherwise(
        F.concat_ws("; ", "notes", F.lit(note)))
    return joined.withColumns({
        "notes": F.when(F.col("_n").isNotNull(), noted).otherwise(F.col("notes")),
        "n_flows_exported": F.coalesce("_n", "n_flows_exported"),
    }).drop("_n")


def table_digest(df: DataFrame) -> DataFrame:
    """Order-insensitive content digest: row count and the sum and xor of the row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
                  F.bit_xor(h).alias("hash_xor"))


def file_digests(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def model_manifest(spark, task: str, features: list[str], counts: dict[str, int], runs: int, scenarios: int,
                   params: dict[str, str], digest: str) -> DataFrame:
    """One-row description of a fitted model."""
    row = (task, features, counts, runs, scenarios, {k: str(v) for k, v in params.items()}, digest)
    return spark.createDataFrame([row], "task string, features array<string>, class_counts map<string,long>, "
                                        "n_runs long, n_scenarios long, params map<string,string>, dataset_digest string")

