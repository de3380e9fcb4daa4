"""Work that must spread over tasks and grow no faster than its input, with the same results as the plain way."""

from __future__ import annotations

from pyspark.sql import functions as F

from pollwarden.operators import metrics as M


def test_resampled_means_are_those_of_a_plain_join_and_draws_are_spread(spark):
    n, boots = 10_000, 500  # three blocks of rows, five million draws: more than one task's
    rows = spark.range(n).select(F.lit("m").alias("model"), F.col("id").alias("_i"), (F.col("id") / 7 - 300).alias("a"),
                                 F.sin("id").alias("b"))
    extra = spark.createDataFrame([(None, 0, 5.0, 5.0), ("one", 0, 0.1, -0.1)], "model string, _i long, a double, b double")
    rows = rows.unionByName(extra)
    out = M.resampled_means(rows, ["a", "b"], boots, 4200)
    found = {(r["model"], r["_boot"]): (r["a"], r["b"]) for r in out.collect()}
    assert len(found) == 2 * boots and found["one", 1] == (0.1, -0.1)
    draws = spark.range(1, n + 1).select(F.lit("m").alias("model"), F.lit(499).alias("_boot"), F.col("id").alias("_slot"))
    unit = F.pmod(F.xxhash64(F.lit(4200), "model", "_boot", "_slot"), F.lit(2**40)) / F.lit(float(2**40))
    mean = [(F.sum(F.col(m).cast("decimal(28,18)")).cast("double") / F.count(m)).alias(m) for m in ("a", "b")]
    want = draws.withColumn("_i", F.floor(unit * n)).join(rows, ["model", "_i"]).agg(*mean).first()
    assert found["m", 499] == (want["a"], want["b"])


def test_slots_of_one_resample_may_be_drawn_in_several_runs(spark, monkeypatch):
    runs = spark.createDataFrame([("m", 9000, 3, 1, 12345)], "_model string, _n long, _boot int, _slot long, _h long")

    def drawn(slots):
        monkeypatch.setattr(M, "DRAW_SLOTS", slots)
        starts = runs.withColumn("_slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(slots).cast("long"))))
        dealt = [r for b in M._dealt_draws(starts.toArrow().to_batches()) for r in b.to_pylist()]
        return sorted(r["_block"] * M.DRAW_BLOCK + i for r in dealt for i in M.np.frombuffer(r["_at"], M.np.uint16).tolist())

    assert drawn(1_000_000) == drawn(1000) and len(drawn(1000)) == 9000


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_run_export_sums_are_hashed_not_sorted(spark, sf):
    from pollwarden.catalog.cleaning import k8

    assert "SortAggregate" not in plan_of(k8(spark, sf))


def test_digest_is_not_dealt_to_a_fixed_number_of_tasks(spark, sf):
    from pollwarden.catalog import load

    found = load()[0]["f18_table_digest"](spark, sf)
    row = found.first()
    assert row["order_free"] and row["content_bound"] and "l_partkey#" in plan_of(found)
    assert ", 5)" not in "".join(x for x in plan_of(found).split("\n") if "hashpartitioning(l_partkey" in x)


def test_small_train_parts_are_boosted_by_one_task_a_pass(spark):
    from pollwarden.operators.boosting import fit_boosted_trees
    from pollwarden.operators.supervised import assemble

    rows = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("a"), (F.col("id") % 7).alias("b"),
                                   ((F.col("id") % 3 == 0) & (F.col("id") % 7 > 2)).cast("int").alias("y")).repartition(24)
    spark.sparkContext.setJobGroup("boost", "boost")
    model = fit_boosted_trees(assemble(rows, ["a", "b"]).select("row_id", "y", "features"), 2, 3, 2, 0.3, 1.0, 1.0, 8, 0.0, 1, 42)
    status = spark.sparkContext.statusTracker()
    last = max(int(i) for i in status.getJobIdsForGroup("boost"))
    tasks = sum(status.getStageInfo(s).numTasks for s in status.getJobInfo(last).stageIds)
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(model.trees) == 3 and tasks <= 2


def test_capped_rows_are_the_lowest_ranks_and_later_chunks_are_not_ordered(spark):
    from pollwarden.operators import splits as S

    rows = spark.range(20_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 < 7, "n").when(F.col("id") % 10 < 9, "d").alias("y"))
    for cap in (50, 30_000):
        out = S.proportional_cap(rows, "y", "row_id", cap)
        sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect() if r["y"]}
        want = set()
        for y, n in sizes.items():
            hashed = S.seeded_hash("row_id", 42)
            take = n if cap > 20_000 else max(1, round(n * cap / 20_000))
            want |= {r["row_id"] for r in rows.where(F.col("y") == y).orderBy(hashed, "row_id").limit(take).collect()}
        assert {r["row_id"] for r in out.collect()} == want
        assert "_last" in plan_of(out)


def test_runs_that_ask_for_the_same_share_their_flows(spark, tmp_path, monkeypatch):
    """copies of a run do not multiply the flows; every run still has the totals of all its rows."""
    import datetime as dt

    from pollwarden import catalog
    from pollwarden.plans import jobs
    from pollwarden.sources import sinks

    t0 = dt.datetime(2024, 1, 1)
    events = [(i, t0 + dt.timedelta(hours=i % 2, seconds=i), 1 + 25 * (i % 6), "view", float(i), "") for i in range(40)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    # Hours 0 and 1, three targets, each order key twice and with two customers, one order without a key.
    orders = [(k, c) for k in (0, 700, 1400, 1, 701, 2801, 0, 1) for c in (2, 5, 4)] + [(None, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    own, asked = (jobs.recover_runs, sinks.run_export), []
    monkeypatch.setattr(jobs, "recover_runs", lambda flows, logs, *a: asked.append(logs.count()) or own[0](flows, logs, *a))
    monkeypatch.setattr(sinks, "run_export", lambda flows, runs, *a: asked.append(runs.count()) or own[1](flows, runs, *a))
    found, twins = catalog.load()
    for name in ("j5_run_log_recovery", "k8_run_export_rows"):
        got = found[name](spark, str(tmp_path))
        import duckdb

        db = duckdb.connect()
        for t in ("events", "orders"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({twins[name]})").fetchall()
        assert want and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert asked == [5, 3]  # of 25 logs each


def test_runs_alike_tells_requests_apart(spark):
    from pollwarden.operators.runs import runs_alike

    rows = [("a", "2024-01-01 00:00:00.000001", ["x", "y"]), ("b", "2024-01-01 00:00:00.000001", ["x", "y"]), ("a", "2024-01-01 00:00:00.000002", ["x", "y"]),
            ("a", "2024-01-01 00:00:00.000001", ["x, y"]), (None, "2024-01-01 00:00:00.000001", None), ("c", "2024-01-01 00:00:00.000001", []), (None, None, [None])]
    runs = spark.createDataFrame(rows, "run_id string, at string, targets array<string>").withColumn("at", F.col("at").cast("timestamp_ntz"))
    different, members = runs_alike(runs)
    assert different.count() == 6 == members.select("alike").distinct().count() and members.count() == 7
    assert different.join(members, different["run_id"] == members["alike"]).count() == 7
