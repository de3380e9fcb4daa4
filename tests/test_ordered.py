"""Ordered operators against plain Python, on frames where one key holds most of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pollwarden.operators import ordered as O
from pollwarden.operators import telemetry as T
from pollwarden.operators.percentiles import exact_percentiles
from pollwarden.operators.splits import greedy_phases, group_folds

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}"
        key = None if key == "k3" else key
        rows.append((i, key, at(rng.randrange(0, 200_000)), rng.randrange(1000)))
    return rows, spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v long")


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return {k: sorted(v, key=lambda r: (r[2], r[0])) for k, v in out.items()}


def test_number_rows(skewed):
    rows, df = skewed
    got = {r["id"]: r["n"] for r in O.number_rows(df, ["k"], [F.col("ts"), F.col("id")], O.time_chunk(F.col("ts")), "n").collect()}
    want = {r[0]: i for v in by_key(rows).values() for i, r in enumerate(v)}
    assert got == want


def test_previous_row(skewed):
    rows, df = skewed
    out = O.previous_row(df, ["k"], ["ts", "id"], ["v"], O.time_chunk(F.col("ts"))).collect()
    got = {r["id"]: r["previous"]["v"] if r["previous"] else None for r in out}
    want = {}
    for v in by_key(rows).values():
        for a, b in zip([None, *v], v):
            want[b[0]] = a[3] if a else None
    assert got == want


def test_running_sums(skewed):
    rows, df = skewed
    out = O.running_sums(df, ["k"], [F.col("ts"), F.col("id")], O.time_chunk(F.col("ts")), {"s": "v"}).collect()
    want = {}
    for v in by_key(rows).values():
        total = 0
        for r in v:
            total += r[3]
            want[r[0]] = total
    assert {r["id"]: r["s"] for r in out} == want


def test_first_rows_plan_limits_before_the_shuffle(skewed):
    _, df = skewed
    plan = O.first_rows(df, ["k"], [F.col("ts"), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("unique", [True, False])
def test_asof_against_brute_force(spark, unique):
    rng = random.Random(5)
    left = [(i, rng.choice(["hot", "hot", "b"]), rng.randrange(400)) for i in range(300)]
    if unique:
        left = list({(r[1], r[2]): r for r in left}.values())
    right = [(i, rng.choice(["hot", "b", "c"]), rng.randrange(400)) for i in range(60)]
    ldf = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "id long, k string, ts timestamp_ntz")
    rdf = spark.createDataFrame([(i, k, at(t)) for i, k, t in right], "rid long, k string, rts timestamp_ntz")
    out = O.asof_nearest(ldf, rdf, ["k"], "ts", "rts", ["rid"], 4, ["rid"], left_is_unique=unique).collect()
    want = {}
    for i, k, t in left:
        near = sorted((abs(t - rt), rt, r) for r, rk, rt in right if rk == k and abs(t - rt) <= 4)
        want[i] = near[0][2] if near else None
    assert {r["id"]: r["rid"] for r in out} == want


@pytest.mark.parametrize("times,expected", [([8, 12], 8), ([6], 6), ([5], None), ([], None)])
def test_asof_edges(spark, times, expected):
    left = spark.createDataFrame([("r", at(10))], "k string, ts timestamp_ntz")
    right = spark.createDataFrame([("r", at(t), t) for t in times], "k string, rts timestamp_ntz, v long")
    assert O.asof_nearest(left, right, ["k"], "ts", "rts", ["v"], 4).first()["v"] == expected


def test_intervals_against_brute_force(spark):
    rng = random.Random(11)
    spans = [(i, s := rng.randrange(900_000), s + rng.randrange(1, 300_000), rng.choice("abc")) for i in range(40)]
    rows = [(i, rng.randrange(1_300_000)) for i in range(500)] + [(1000, spans[3][1]), (1001, spans[3][2])]
    df = spark.createDataFrame([(i, at(t)) for i, t in rows], "id long, ts timestamp_ntz")
    iv = spark.createDataFrame([(i, at(a), at(b), x) for i, a, b, x in spans], "idx long, start_time timestamp_ntz, end_time timestamp_ntz, label string")
    got = {r["id"]: r["label"] for r in O.interval_label(df, iv, "ts").collect()}
    want = {}
    for i, t in rows:
        hit = [s for s in spans if s[1] <= t <= s[2]]
        want[i] = hit[-1][3] if hit else "normal"
    assert got == want


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_percentiles_on_skewed_values(spark, accuracy):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(0, 3, 3000), np.full(1500, 7.0)])
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 1.0), ("h", 2.0), ("n", None)], "g string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", probs, accuracy).collect()}
    for name, p in probs.items():
        assert got["g"][name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12)
        assert got["h"][name] == pytest.approx(1.0 + p)
    assert "n" not in got


def test_a_bracket_that_misses_its_rank_is_widened(spark, monkeypatch):
    import numpy as np

    from pollwarden.operators import percentiles as P

    values = np.concatenate([np.full(9000, 5.0), np.arange(500) / 100.0, 6 + np.arange(500.0)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    real = P.F.percentile_approx
    for wrong in (0.999, 0.001):  # a sketch whose every answer is far off
        monkeypatch.setattr(P.F, "percentile_approx", lambda c, cuts, k, q=wrong: real(c, [q] * len(cuts), k))
        row = exact_percentiles(df, [], "v", {"a": 0.02, "b": 0.5, "c": 0.96}, 100).first()
        for name, p in (("a", 0.02), ("b", 0.5), ("c", 0.96)):
            assert row[name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12)


def test_percentiles_of_all_rows_but_one_group(spark):
    import numpy as np

    from pollwarden.operators.percentiles import left_out_percentiles

    rng = np.random.default_rng(5)
    rows = [("x", "hot", 0.0)] * 400 + [("x", g, float(v)) for g in "abc" for v in rng.integers(-4, 9, 60)]
    rows += [("x", "hot", float(v)) for v in rng.normal(0, 3, 300)] + [("y", "a", 2.0), ("y", "a", 3.0), ("y", "b", None), ("y", None, 9.0)]
    cells = spark.createDataFrame([(*r, 1) for r in rows], "k string, g string, value double, n long")
    wanted = spark.createDataFrame([(k, g, p) for k, p in (("x", 0.95), ("y", 0.25)) for g in ("hot", "a", "b", "c")], "k string, g string, prob double")
    got = {(r["k"], r["g"]): r["percentile"] for r in left_out_percentiles(cells, wanted, ["k"], "g").collect()}
    assert len(got) == 8
    for (k, g), found in got.items():
        rest = [v for kk, gg, v in rows if kk == k and gg not in (g, None) and v is not None]
        if rest:
            assert found == pytest.approx(np.percentile(rest, 95 if k == "x" else 25), rel=1e-12, abs=1e-12)
        else:
            assert found is None


def brute_greedy(sizes, k):
    loads, placed = [0] * k, []
    for s in sizes:
        j = loads.index(min(loads))
        loads[j] += s
        placed.append(j)
    return loads, placed


@pytest.mark.parametrize("seed", range(6))
def test_greedy_phases_equal_one_by_one(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([1, 1, 2, 3, 7, 50, 400]) for _ in range(300)), reverse=True)
    runs = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
    placed = [f[i % len(f)] for size, first, n, f in greedy_phases(runs, 5) for i in range(n)]
    assert placed == brute_greedy(sizes, 5)[1]
    assert len(greedy_phases(runs, 5)) <= 5 * len(runs) + 5


def test_group_folds_are_balanced_and_whole(spark):
    rows = [(f"g{i}",) for i in range(60) for _ in range(1 + (i * 7) % 13)] + [("big",)] * 400
    folds = group_folds(spark.createDataFrame(rows, "g string"), "g", 5).collect()
    assert len({r["g"] for r in folds}) == len(folds) == 61
    loads = [sum(r["size"] for r in folds if r["fold"] == f) for f in range(5)]
    sizes = sorted((r["size"] for r in folds), reverse=True)
    assert sorted(loads) == sorted(brute_greedy(sizes, 5)[0])


def test_streak_breaks_on_absence(spark):
    rows = [(p, "a", True) for p in (1, 2, 3, 6, 7)] + [(p, "b", p != 4) for p in range(1, 9)] + [(p, "c", False) for p in range(1, 9)]
    obs = spark.createDataFrame([(p, ip, x, "DDOS") for p, ip, x in rows], "poll_id long, ip_src string, anomalous boolean, labels string")
    got = {(r["ip_src"], r["poll_id"]): r["streak"] for r in T.alert_streaks(obs, obs, chunk_polls=2).collect()}
    assert [got[("a", p)] for p in (1, 2, 3, 6, 7)] == [1, 2, 3, 1, 2]
    assert [got[("b", p)] for p in (1, 2, 3, 5, 6, 7, 8)] == [1, 2, 3, 1, 2, 3, 4]


@pytest.mark.parametrize("n,kept", [(1, 1), (2, 2), (3, 1), (4, 2), (5, 1), (6, 2)])
def test_steady_state_lengths(spark, n, kept):
    df = spark.createDataFrame([("r", at(5 * i), i, 1) for i in range(n)], "run_id string, timestamp timestamp_ntz, row_id long, n_flows int")
    out = [r["row_id"] for r in T.steady_state(df).orderBy("row_id").collect()]
    edge = 0 if n <= 2 else 1 if n <= 4 else 2
    assert out == list(range(n))[edge:n - edge] and len(out) == kept


def test_steady_state_drops_null_runs_and_empty_polls(spark):
    df = spark.createDataFrame([(None, at(0), 0, 1), ("r", at(1), 1, 0), ("r", at(2), 2, None)], "run_id string, timestamp timestamp_ntz, row_id long, n_flows int")
    assert T.steady_state(df).count() == 0


def test_rows_of_runs_equal_a_plain_loop(spark):
    import datetime as dt
    import random

    from pollwarden.operators.runs import rows_of_runs

    rnd, t0 = random.Random(4), dt.datetime(2024, 1, 1)
    ips = ["a1", "a2", "t1", "t2", "h1", None]
    flows = [(i, None if i == 7 else t0 + dt.timedelta(seconds=rnd.randrange(400)), rnd.choice(ips), rnd.choice(ips), rnd.choice([0, 80]), 0)
             for i in range(300)]
    runs = [(f"r{k}", kind, t0 + dt.timedelta(seconds=rnd.randrange(300)), rnd.choice([0, 5, 90]), targets)
            for k, (kind, targets) in enumerate([(k, t) for k in ("ddos", "portscan", "normal", "mesh", None)
                                                 for t in (["t1", "t2", "t1"], ["a1", "a2"], [], None)] * 2)]
    runs = [(n, k, s, s + dt.timedelta(seconds=d), t) for n, k, s, d, t in runs]
    df = spark.createDataFrame(flows, "id int, timestamp timestamp_ntz, ip_src string, ip_dst string, tp_src int, tp_dst int")
    rs = spark.createDataFrame(runs, "run_id string, kind string, start_time timestamp_ntz, end_time timestamp_ntz, targets array<string>")
    att, hosts = {"a1", "a2"}, {"h1", "t1", "a1"}

    def fits(kind, targets, src, dst, l4):
        targets = targets or []
        towards = src in att and dst in targets and l4
        if kind == "ddos":
            return towards or (dst in att and src in targets and l4)
        if kind == "portscan":
            return towards
        return src in hosts and dst in hosts if kind == "normal" else True

    grace = dt.timedelta(seconds=3)
    want = sorted((i, n) for i, t, src, dst, p, q in flows for n, k, s, e, ts in runs
                  if t is not None and s <= t <= e + grace and fits(k, ts, src, dst, p != 0))
    got = rows_of_runs(df, rs, sorted(att), sorted(hosts), grace_sec=3)
    assert sorted((r["id"], r["run_id"]) for r in got.collect()) == want
    assert rows_of_runs(df, rs.limit(0), sorted(att)).count() == 0
