"""Scans: poll files, run folders, sidecars, run logs, label intervals, live feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pollwarden.functions.probetext import dotted_quads, iperf_values, ping_values
from pollwarden.operators.ordered import number_rows
from pollwarden.schemas import (
    BASE_COLUMNS, FAULT_FLOW_POLL, FLOW_POLL, LABEL_INTERVAL, PORT_POLL, PROBE, RUN_META, require_columns,
)


def read_polls(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """Poll CSV with a header. A header-only file gives an empty, typed frame.

    The columns are those of the first file's header; a file of the folder with another header fails the read instead of shifting its values.
    """
    names = spark.read.option("header", True).csv(path).schema
    raw = spark.read.schema(names).option("header", True).option("enforceSchema", False).csv(path)
    require_columns(raw, required or ["timestamp", "label"])
    typed = {f.name: f.dataType for f in FLOW_POLL.fields}
    return raw.select(*[typed_column(c, typed.get(c)) for c in raw.columns])


def typed_column(name: str, kind: T.DataType | None):
    c = F.col(f"`{name}`")
    if kind is None or isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(c).alias(name)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        # pandas-written integers may carry a decimal point.
        return c.try_cast("double").cast(kind).alias(name)
    return c.try_cast(kind).alias(name)


def read_unheaded_polls(spark: SparkSession, path: str) -> DataFrame:
    """Poll CSV that may lack its header: 17 fixed names, and any header line is dropped as a row."""
    names = BASE_COLUMNS[:17]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(text).option("header", False).option("mode", "PERMISSIVE").csv(path)
    typed = {f.name: f.dataType for f in FLOW_POLL.fields}
    rows = raw.where(~F.coalesce(F.col("timestamp") == "timestamp", F.lit(False)))
    return rows.select(*[typed_column(n, typed[n]) for n in names])


def read_run_folder(spark: SparkSession, folder: str, skip_prefix: str = "run_normal_massive_",
                    skip_marker: str = "normal_massive") -> DataFrame:
    """All collected runs of a folder; a file is left out whole if its name holds the marker, in any case, or a run id has the prefix."""
    raw = spark.read.option("header", True).schema(text_schema(FLOW_POLL)).option("enforceSchema", False).csv(
        folder, pathGlobFilter="run_*.csv")
    raw = raw.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    raw = raw.where(~F.lower("source_file").contains(skip_marker))
    marked = raw.where(F.col("run_id").startswith(skip_prefix)).select("source_file").distinct()
    kept = raw.join(marked, "source_file", "left_anti")
    return kept.select(*[typed_column(f.name, f.dataType) for f in FLOW_POLL.fields], "source_file")


def text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def _run_files(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    # enforceSchema=False: a file whose header differs fails instead of shifting its columns.
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(text_schema(schema)).csv(f"{folder}/fault_*/{name}")
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    # The line number is taken here, at the scan: after a join it would follow the join's row order.
    return raw.select(run.alias("run_folder"), F.monotonically_increasing_id().alias("line"),
                      *[typed_column(f.name, f.dataType) for f in schema.fields])


def read_fault_runs(spark: SparkSession, folder: str, protocol: str = "") -> dict[str, DataFrame]:
    """Flows, ports, probes and sidecar metadata of every run folder; empty files are fine."""
    meta = spark.read.schema(RUN_META).option("multiLine", True).json(f"{folder}/fault_*/meta.json")
    meta = meta.withColumn("run_folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    if protocol:
        meta = meta.where(F.lower("protocol") == protocol.lower())
    named = meta.select("run_folder", "run_id")
    out = {"meta": meta.drop("run_folder")}
    for name, schema in (("flows", FAULT_FLOW_POLL), ("ports", PORT_POLL), ("probes", PROBE)):
        out[name] = _run_files(spark, folder, f"{name}.csv", schema).join(named, "run_folder").drop("run_folder")
        if name == "probes":
            out[name] = out[name].withColumn("probe_id", F.col("line"))
        out[name] = out[name].drop("line")
    return out


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Label intervals; the order of file names, then of lines, is the priority `idx`, counted from 0."""
    rows = spark.read.schema(text_schema(LABEL_INTERVAL)).option("header", True).option("enforceSchema", False).csv(path)
    rows = rows.select(*[typed_column(f.name, f.dataType) for f in LABEL_INTERVAL.fields], F.monotonically_increasing_id().alias("line"),
                       F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"))
    return number_rows(rows, [], [F.col("line")], F.col("block"), "idx").drop("line", "block")


_LOG = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("scenario_id", T.StringType()),
    T.StructField("start_time", T.StringType()), T.StructField("end_time", T.StringType()),
    T.StructField("commands", T.ArrayType(T.ArrayType(T.StringType()))),
])


def read_run_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Run logs with the distinct addresses named in their commands."""
    raw = spark.read.schema(_LOG).option("multiLine", True).json(folder, pathGlobFilter="run_*.json")
    texts = F.transform(F.coalesce("commands", F.array()), lambda c: F.coalesce(F.get(c, F.lit(1)), F.lit("")))
    found = F.array_distinct(F.flatten(F.transform(texts, dotted_quads)))
    return raw.select("run_id", "scenario_id", F.try_to_timestamp("start_time").alias("start_time"),
                      F.try_to_timestamp("end_time").alias("end_time"), found.alias("targets"))


def read_probe_log(df: DataFrame, ping: str = "ping_text", tcp: str = "tcp_text", udp: str = "udp_text") -> DataFrame:
    """Raw tool output per probe to numbers: ping, TCP throughput, UDP jitter and loss."""
    p, t, u = ping_values(F.col(ping)), iperf_values(F.col(tcp)), iperf_values(F.col(udp))
    out = df.withColumns({"_p": p, "_t": t, "_u": u})
    return out.select(*df.columns, "_p.rtt_min_ms", "_p.rtt_mean_ms", "_p.rtt_max_ms", "_p.probe_loss_pct",
                      F.col("_t.throughput_mbps"), F.col("_u.jitter_ms"), F.col("_u.udp_lost_pct")).drop(ping, tcp, udp)


def stream_polls(spark: SparkSession, path: str, schema: T.StructType = FLOW_POLL, fmt: str = "parquet",
                 max_files: int | None = None) -> DataFrame:
    """Live feed: new files of poll rows."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_ports(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    return stream_polls(spark, path, PORT_POLL, fmt, max_files)
