"""Forecast parts against loops on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taktwerk.operators import forecast


@pytest.fixture(scope="module")
def visits(spark):
    rows, free = [], {}
    for u in range(60):
        ready = 20.0 * u
        for j in (1, 2, 3):
            start = max(ready, free.get(j, 0.0))
            proc = {1: 15.0, 2: 26.0, 3: 18.0}[j] + (u * 7 + j) % 5
            free[j] = ready = start + proc
            rows.append((u, j, 20.0 * u, start, free[j], proc))
            ready += 4.5
    return spark.createDataFrame(rows, "unit long, j int, release_s double, start_s double, depart_s double, proc_s double")


def test_normal_cdf(spark):
    df = spark.createDataFrame([(z / 10,) for z in range(-50, 51)], "z double")
    for r in df.select("z", forecast.normal_cdf(F.col("z")).alias("p")).collect():
        assert abs(r.p - math.erfc(-r.z / math.sqrt(2)) / 2) < 2e-7


def test_imputed_mean_equals_draws(spark):
    x = np.random.default_rng(1).lognormal(math.log(50) - 0.02, 0.2, 400_000)
    fits = spark.createDataFrame([(1, 50.0, 50 * math.sqrt(math.exp(0.04) - 1))], "j int, mean_s double, sd_s double")
    rows = [(1, 90.0, 45.0, True), (1, 44.0, 45.0, False), (2, 9.0, 5.0, True), (1, 9.0, -5.0, True)]
    got = forecast.impute_processing(spark.createDataFrame(rows, "j int, dwell_s double, theta_s double, blocked boolean"), fits).collect()
    by = {(r.j, r.dwell_s): r.proc_s for r in got}
    assert abs(by[1, 90.0] - x[x < 45].mean()) < 0.1
    assert (by[1, 44.0], by[2, 9.0], by[1, 9.0]) == (44.0, 5.0, 0.1)


def test_windows_of_a_unit(visits):
    got = {t: n for t, n in visits.select(F.explode(forecast.triggers_of(F.col("unit"), 10, 4, 6)).alias("t"), "unit").groupBy("t").agg(F.count_distinct("unit")).collect()}
    want = {t: sum(t - 6 <= u < t + 4 for u in range(60)) for t in range(10, 70, 10)}
    assert got == {t: n for t, n in want.items() if n}


def test_states_and_runs(visits):
    states = {r.trigger: r for r in forecast.states_at(visits, 20, 20, 15).collect()}
    assert sorted(states) == [20, 40]
    rows = {(r.unit, r.j): r for r in visits.collect()}
    s = states[20].stations[1]
    assert math.isclose(s.m, np.mean([rows[u, 2].proc_s for u in range(20)])) and s.wip[0].depart_s == rows[19, 2].depart_s
    runs = forecast.simulate(forecast.states_at(visits, 20, 20, 15), reps=2).collect()
    assert len(runs) == 2 * 2 * 15 * 3
    at = {(r.trigger, r.rep, r.unit, r.j): r for r in runs}
    for (t, rep, u, j), r in at.items():
        assert r.start_s >= (at[t, rep, u - 1, j].finish_s if u > t else rows[t - 1, j].depart_s) - 1e-9
        if j > 1:
            assert r.start_s >= at[t, rep, u, j - 1].finish_s + 4.5 - 1e-9


def test_shares_equal_the_grid_loop(spark):
    random.seed(2)
    rows = []
    for j in (1, 2, 3):
        t = 0.0
        for _ in range(12):
            t += random.choice([0.0, 1.0, 40.0])
            rows.append((7, j, t, t + random.randrange(20, 90)))
            t = rows[-1][3]
    df = spark.createDataFrame(rows, "k int, j int, start_s double, finish_s double")
    periods = {}
    for _, j, s, e in rows:
        mine = periods.setdefault(j, [])
        if mine and s <= mine[-1][1] + 2:
            mine[-1][1] = e
        else:
            mine.append([s, e])
    grid = np.arange(min(r[2] for r in rows), max(r[3] for r in rows), 30.0)
    lead, shift = {}, {}
    for t in grid:
        dur = sorted(((max([e - s for s, e in p if s <= t <= e], default=0), -j) for j, p in periods.items()), reverse=True)
        if dur[0][0] > 0:
            side = shift if dur[1][0] > 0 and dur[1][0] >= 0.85 * dur[0][0] else lead
            side[-dur[0][1]] = side.get(-dur[0][1], 0) + 1
    for r in forecast.shares(df, ["k"]).collect():
        assert math.isclose(r.sole, lead.get(r.j, 0) / len(grid)) and math.isclose(r.shifting, shift.get(r.j, 0) / len(grid))


def test_forecast_names_the_slow_station(visits):
    found = forecast.forecast(forecast.simulate(forecast.states_at(visits, 20, 20, 15)))
    out = forecast.evaluate(found, visits, 20, 15, 20).collect()
    assert {r.trigger for r in out} == {20, 40}
    assert all(r.predicted == 2 and r.actual == 2 and r.pred_correct and r.pred_in_top2 and 0 < r.confidence <= 1 for r in out)


def test_imputation_moves_no_visits(spark):
    """A fit a station is broadcast: seven keys would put each station into one task."""
    visits = spark.createDataFrame([(1, 1, 50.0, 40.0, True)], "unit long, j int, dwell_s double, theta_s double, blocked boolean")
    fits = spark.createDataFrame([(1, 45.0, 5.0)], "j int, mean_s double, sd_s double").groupBy("j").applyInPandas(lambda df: df, "j int, mean_s double, sd_s double")
    plan = forecast.impute_processing(visits, fits)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("drop", [False, True])
def test_rolling_functions_equal_those_behind_one_another(spark, visits, monkeypatch, drop):
    """Over several tiles, with a slope, units that skip a station, visits without time and triggers whose horizon isn't whole."""
    monkeypatch.setattr(forecast, "TRIGGERS", 2)
    rows = visits.crossJoin(spark.range(20).select("id")).select((F.col("unit") + 60 * F.col("id")).alias("unit"), "j", *((F.col(c) + 1200 * F.col("id")).alias(c) for c in ("release_s", "start_s", "depart_s")), "proc_s")
    rows = rows.withColumn("proc_s", F.col("proc_s") + F.when(F.col("j") == 1, F.col("unit") / 20).otherwise(0))
    if drop:
        rows = rows.filter("NOT (j = 1 AND unit = 333) AND NOT (j = 2 AND unit % 5 = 0)").withColumn("proc_s", F.expr("CASE WHEN unit % 7 <> 3 THEN proc_s END"))
    rows = rows.persist()
    scans, args = rows.select("unit", "j", "release_s", "depart_s"), (60, 300, 90)
    runs = forecast.simulate(forecast.states_at(rows, *args)).persist()
    key = lambda df, n: {tuple(r[:n]): tuple(r[n:]) for r in df.collect()}
    same = lambda a, b: a.keys() == b.keys() and all(x == pytest.approx(b[k], rel=1e-9) for k, x in a.items())
    want = key(runs, 4)
    assert want and same(key(forecast.rolling_runs(rows, scans, *args), 4), want)
    predicted = forecast.forecast(runs)
    assert same(key(forecast.rolling_forecast(rows, scans, *args), 1), key(predicted, 1))
    if not drop:  # a visit without time has none in a share either, but the windows of shares take its start
        assert same(key(forecast.rolling_evaluation(rows, scans, *args), 1), key(forecast.evaluate(predicted, rows, 60, 90, 300), 1))


def test_runs_of_a_forecast_stay_in_their_task(spark, visits):
    """Visits move once, by tile; five runs a trigger used to move for its shares, and the visits twice more for the actual ones."""
    plan = forecast.rolling_evaluation(visits, visits, 20, 20, 15)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(tile") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan  # the other is of the few scans told


def test_led_equals_shares(spark):
    rng = random.Random(3)
    rows = [(k, j, s, s + rng.choice([0.0, 5.0, 40.0, 300.0])) for k in range(30) for j in (1, 2, 5) for s in [rng.choice([rng.random() * 900, 90.0, 92.0]) for _ in range(rng.randint(0, 12))]]
    want = {}
    for r in forecast.ranked_shares(forecast.shares(spark.createDataFrame(rows, "k int, j int, start_s double, finish_s double"), ["k"], 7.0), ["k"]).orderBy("k", "r").collect():
        want.setdefault(r.k, []).append((r.j, r.total))
    for k in range(30):
        j, s, e = (np.array([r[i] for r in rows if r[0] == k], float) for i in (1, 2, 3))
        assert forecast.led(j, s, e, 7.0) == want.get(k, [])
