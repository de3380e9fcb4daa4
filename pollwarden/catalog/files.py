"""File scans and sinks: tables written to the shared folder and read back through the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pollwarden.catalog import query
from pollwarden.catalog import views as V
from pollwarden.functions.features import flow_features
from pollwarden.operators import splits as S
from pollwarden.operators.cleaning import fill_provenance
from pollwarden.schemas import BASE_COLUMNS, FLOW_POLL, RUN_META
from pollwarden.session import ensure_checkpoint_dir
from pollwarden.sources import readers as R
from pollwarden.sources import sinks as K


def fresh_folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def full_polls(spark, sf):
    rows = flow_features(V.flow_polls(spark, sf)).withColumn("source", F.lit("lab"))
    return fill_provenance(rows).select(*[f.name for f in FLOW_POLL.fields])


_SUMS = """label, count(*) AS n, CAST(sum(packet_count) AS BIGINT) AS packets, count(DISTINCT timestamp) AS n_times"""


def sums(df):
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("packet_count").alias("packets"),
                                   F.count_distinct("timestamp").alias("n_times"))


@query("s1_csv_scan", f"WITH {V.FLOW_SQL} SELECT {_SUMS} FROM flow_polls GROUP BY 1")
def s1(spark, sf):
    path = fresh_folder(spark, "polls")
    full_polls(spark, sf).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return sums(R.read_polls(spark, path))


@query("s2_unheaded_csv_scan", f"WITH {V.FLOW_SQL} SELECT {_SUMS} FROM flow_polls GROUP BY 1")
def s2(spark, sf):
    """Half of the files carry a header line, half do not."""
    path = fresh_folder(spark, "bare")
    rows = full_polls(spark, sf).select(*BASE_COLUMNS[:17])
    for head in (True, False):
        rows.where((F.col("flow_id") % 2 == 0) == F.lit(head)).write.mode("append").option("header", head).option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return sums(R.read_unheaded_polls(spark, path))


@query("k1_k9_split_export", """WITH t AS (SELECT event_type AS label, count(*) AS n, round(count(*) * 0.2::DOUBLE)::BIGINT AS k FROM events GROUP BY 1)
SELECT 'test' AS split, sum(k)::BIGINT AS n FROM t UNION ALL SELECT 'train', sum(n - k)::BIGINT FROM t""")
def k9(spark, sf):
    path = fresh_folder(spark, "split")
    parts = S.stratified_split(V.table(spark, sf, "events"), "event_type", "event_id")
    K.write_split(parts, path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("k2_versioned_replace", "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders WHERE o_orderkey % 2 = 0")
def k2(spark, sf):
    """Publish a table, then replace it by a version computed from itself."""
    base = fresh_folder(spark, "versions")
    K.write_version(V.table(spark, sf, "orders"), base)
    K.write_version(K.read_current(spark, base).where("o_orderkey % 2 = 0"), base)
    return K.read_current(spark, base).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"))


@query("k3_s9_append_polls_sink", f"WITH {V.FLOW_SQL} SELECT {_SUMS} FROM flow_polls GROUP BY 1")
def k3(spark, sf):
    source, target = fresh_folder(spark, "feed"), fresh_folder(spark, "appended")
    rows = full_polls(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows.repartitionByRange(4, "timestamp").write.parquet(source)
    stream = R.stream_polls(spark, source, rows.schema, max_files=2)
    K.append_polls(stream, f"{target}/rows", f"{target}/checkpoint").awaitTermination()
    return sums(spark.read.parquet(f"{target}/rows"))


@query("s6_run_sidecars", f"""WITH {V.FLOW_SQL} SELECT concat('run_', CAST(day(timestamp) AS VARCHAR)) AS run_id, count(*) AS n,
  CAST(sum(packet_count) AS BIGINT) AS packets FROM flow_polls WHERE day(timestamp) % 2 = 0 GROUP BY 1""")
def s6(spark, sf):
    """Run metadata as JSON next to the polls; only the runs of one protocol are merged."""
    path = fresh_folder(spark, "meta")
    V.fault_meta(spark, sf).write.json(path)
    meta = spark.read.schema(RUN_META).json(path).where("protocol = 'e'").select("run_id")
    rows = V.flow_polls(spark, sf).withColumn("run_id", F.expr("concat('run_', CAST(day(timestamp) AS STRING))"))
    return rows.join(meta, "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("packet_count").alias("packets"))
