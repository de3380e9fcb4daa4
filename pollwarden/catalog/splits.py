"""Splits, caps, weights and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollwarden.catalog import query
from pollwarden.catalog import views as V
from pollwarden.catalog.evaluation import rounded
from pollwarden.operators import augment as G
from pollwarden.operators import splits as S


def events(spark, sf):
    return V.table(spark, sf, "events")


@query("m1_split_by_id_order", """WITH t AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, CASE WHEN r <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM t""")
def m1(spark, sf):
    chunk = F.floor(F.col("event_id") / 100_000)
    return S.split_by_rank(events(spark, sf), "event_type", F.col("event_id"), chunk).select("event_id", "split")


@query("m1_stratified_split_sizes", """WITH t AS (SELECT event_type, count(*) AS n, round(count(*) * 0.2::DOUBLE)::BIGINT AS k FROM events GROUP BY 1)
SELECT event_type, 'test' AS split, k AS n FROM t UNION ALL SELECT event_type, 'train', n - k FROM t""")
def m1b(spark, sf):
    out = S.stratified_split(events(spark, sf), "event_type", "event_id")
    return out.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("n"))


@query("m2_stratified_folds", """WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, f::INT AS fold, (n // 10 + (CASE WHEN f < n % 10 THEN 1 ELSE 0 END))::BIGINT AS n FROM t, range(10) r(f)""")
def m2(spark, sf):
    out = S.stratified_folds(events(spark, sf), "event_type", "event_id", 10)
    return out.groupBy("event_type", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("m3_group_folds")
def m3(spark, sf):
    return S.group_folds(events(spark, sf), "user_id", 5)


@query("m3_group_fold_loads", """WITH RECURSIVE g AS (SELECT row_number() OVER (ORDER BY count(*) DESC, user_id) AS i, count(*) AS n FROM events GROUP BY user_id),
r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, 0::BIGINT AS d, 0::BIGINT AS e UNION ALL
  SELECT g.i, CASE WHEN a = m THEN a + n ELSE a END, CASE WHEN a > m AND b = m THEN b + n ELSE b END,
    CASE WHEN a > m AND b > m AND c = m THEN c + n ELSE c END, CASE WHEN a > m AND b > m AND c > m AND d = m THEN d + n ELSE d END,
    CASE WHEN a > m AND b > m AND c > m AND d > m THEN e + n ELSE e END
  FROM (SELECT *, least(a, b, c, d, e) AS m FROM r) r JOIN g ON g.i = r.i + 1),
f AS (SELECT * FROM r ORDER BY i DESC LIMIT 1)
SELECT 0 AS fold, a AS n FROM f UNION ALL SELECT 1, b FROM f UNION ALL SELECT 2, c FROM f UNION ALL SELECT 3, d FROM f UNION ALL SELECT 4, e FROM f""")
def m3b(spark, sf):
    out = S.group_folds(events(spark, sf), "user_id", 5)
    return out.groupBy("fold").agg(F.sum("size").alias("n"))


@query("m4_leave_one_group_out", f"""WITH {V.FLOW_SQL} SELECT scenario_id, (dense_rank() OVER (ORDER BY scenario_id) - 1)::INT AS fold
FROM (SELECT DISTINCT scenario_id FROM flow_polls)""")
def m4(spark, sf):
    return S.leave_one_group_out(V.flow_polls(spark, sf), "scenario_id")


@query("j10_train_without_heldout", f"""WITH {V.FLOW_SQL}, g AS (SELECT scenario_id, count(*) AS n FROM flow_polls GROUP BY 1)
SELECT scenario_id AS held_out, n AS n_test, (SELECT sum(n) FROM g)::BIGINT - n AS n_train FROM g""")
def j10(spark, sf):
    counts = V.flow_polls(spark, sf).groupBy(F.col("scenario_id").alias("held_out")).agg(F.count(F.lit(1)).alias("n_test"))
    return counts.withColumn("n_train", counts.agg(F.sum("n_test").alias("t")).scalar() - F.col("n_test"))


@query("m6_proportional_cap", """WITH t AS (SELECT l_returnflag, count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY 1)
SELECT l_returnflag, least(n, greatest(1, round_even(4000::DOUBLE * n / t, 0)))::BIGINT AS n FROM t""")
def m6(spark, sf):
    rows = V.table(spark, sf, "lineitem").withColumn("row_id", F.xxhash64("l_orderkey", "l_linenumber"))
    out = S.proportional_cap(rows, "l_returnflag", "row_id", 4000)
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("m7_class_cap", """SELECT event_type, least(count(*), CASE WHEN event_type = 'view' THEN 1500 ELSE 1000000000 END)::BIGINT AS n FROM events GROUP BY 1""")
def m7(spark, sf):
    out = S.class_cap(events(spark, sf), "event_type", "event_id", 1500, only=["view"])
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("m12_class_weights", """SELECT event_type, count(*) AS n, round((SELECT count(*) FROM events)::DOUBLE /
  ((SELECT count(DISTINCT event_type) FROM events) * count(*)), 6) AS weight FROM events GROUP BY 1""")
def m12(spark, sf):
    return rounded(S.class_weights(events(spark, sf), "event_type"))


@query("m8_smote_class_sizes", """WITH t AS (SELECT CASE WHEN label < 5 THEN 0 WHEN label < 8 THEN 1 ELSE 2 END AS label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, (SELECT max(n) FROM t) AS n FROM t""")
def m8(spark, sf):
    rows = V.table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("label") < 5, 0).when(F.col("label") < 8, 1).otherwise(2).alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    out = G.smote(rows, "label", "vec_id", [f"x{i}" for i in range(64)])
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("m8_smote_neighbours", """WITH d AS (SELECT a.label, a.vec_id, b.vec_id AS near_id, row_number() OVER (PARTITION BY a.vec_id
    ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id)::INT AS rank
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT label, vec_id, rank, near_id FROM d WHERE rank <= 5""")
def m8n(spark, sf):
    """The neighbour lists that SMOTE interpolates along; a class that fits one cell has its exact ones."""
    rows = V.table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("_id"), F.col("embedding").cast("array<double>").alias("x"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = G.nearest_in_class(rows, "label", 5, sizes)
    return found.select("label", F.col("_id").alias("vec_id"), F.posexplode("near").alias("at", "near_id")).select(
        "label", "vec_id", (F.col("at") + 1).alias("rank"), "near_id")


@query("m9_bootstrap_rows")
def m9(spark, sf):
    from pollwarden.catalog.telemetry import clean

    rows = clean(spark, sf).withColumn("source", F.lit(""))
    return G.bootstrap_rows(rows.where("label = 'ddos'"), "flow_id", 400).select(
        "flow_id", "packet_count", "byte_count", "packet_count_per_sec", "packet_size_avg", "flow_duration", "is_synthetic", "source")


@query("m10_flood_rows_appended", f"""WITH {V.FLOW_SQL} SELECT label, is_synthetic, count(*) AS n FROM flow_polls GROUP BY 1, 2
UNION ALL SELECT 'flood', 1, 2 * (SELECT count(*) FROM flow_polls WHERE label = 'ddos' AND is_synthetic = 0)""")
def m10(spark, sf):
    """Two generated flood rows per real attack row, appended to the polls."""
    rows = V.flow_polls(spark, sf)
    n = rows.where("label = 'ddos' AND is_synthetic = 0").count()
    floods = G.flood_rows(spark, {"tcp": n, "udp": n // 2, "icmp": n - n // 2}).withColumn("label", F.lit("flood"))
    return rows.unionByName(floods, allowMissingColumns=True).groupBy("label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("m11_domain_shift_parts", f"""WITH {V.FEATURE_SQL}, t AS (SELECT label, count(*) AS n, round(count(*) * 0.2::DOUBLE)::BIGINT AS k FROM clean GROUP BY 1)
SELECT 'bootstrap' AS part, 400 AS n UNION ALL SELECT 'real_test', sum(k)::BIGINT FROM t UNION ALL SELECT 'train', sum(n - k)::BIGINT FROM t""")
def m11(spark, sf):
    from pollwarden.catalog.telemetry import clean

    out = G.domain_shift_set(clean(spark, sf).withColumn("source", F.lit("")), "flow_id", n_bootstrap=400)
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("m11_domain_shift_report", f"""WITH {V.FEATURE_SQL}, t AS (SELECT label, count(*) AS n, round(count(*) * 0.2::DOUBLE)::BIGINT AS k FROM clean GROUP BY 1),
s AS (SELECT sum(k)::BIGINT AS test, sum(n - k)::BIGINT AS train FROM t)
SELECT part, CASE part WHEN 'bootstrap' THEN 400 WHEN 'real_test' THEN test ELSE test + 400 END AS n_test, train AS n_train, true AS is_rate
FROM s, (VALUES ('real_test'), ('bootstrap'), ('all')) v(part)""")
def m11b(spark, sf):
    """A forest of the published size, scored on each part by itself; the bootstrap rows are all of one class."""
    from pollwarden.catalog.telemetry import clean
    from pollwarden.plans.jobs import domain_shift_report

    out = domain_shift_report(clean(spark, sf).withColumn("source", F.lit("")))
    return out.select("part", "n_test", "n_train", F.col("accuracy").between(0, 1).alias("is_rate"))


@query("m5_splitter_choice", f"""WITH {V.FEATURE_SQL}, g AS (SELECT count(DISTINCT run_id) AS n_groups FROM clean)
SELECT n_groups, CASE WHEN n_groups < 3 THEN NULL WHEN n_groups <= 5 THEN 'leave_one_out' ELSE 'group_kfold' END AS splitter FROM g""")
def m5(spark, sf):
    from pollwarden.catalog.telemetry import clean

    row = S.readiness(clean(spark, sf)).select("n_groups")
    return row.withColumn("splitter", F.lit(S.choose_splitter(row.first()[0])[0]))
