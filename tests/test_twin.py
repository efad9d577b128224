"""States of a line with parallel machines, soft sensors by window, bottlenecks in slots, questions, exact tests: all against loops."""

import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taktwerk.functions import ranks
from taktwerk.operators import bottleneck, causes, feed, kernels, sensors, thread


@pytest.mark.parametrize("per_slot", [15, 10**6])
def test_lag_by_a_column_carries_over_slots(spark, per_slot):
    rng = random.Random(4)
    rows = [(k, rng.choice([0.0, 1e12, *[rng.random() for _ in range(9)]]), i, {"a": 1, "b": 4, "c": 7}[k]) for i in range(200) for k in [rng.choice("abc")]]
    rows += [("d", 0.5, 1000 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, id long, step int")
    got = {r.id: r.e for r in ranks.lagged(df, ["k"], ["x", "id"], {"e": "id"}, "step", per_slot, None, [1, 4, 7]).collect()}
    for k in "abcd":
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(own):
            assert got[r[2]] == (own[i - r[3]][2] if r[3] and i >= r[3] else None)


def test_slots_of_a_skewed_order_are_even(spark):
    rows = [(i, float(i) if i else 1e15) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, x double")
    slots = ranks.slots_of(df, "x", 500)
    sizes = [r["count"] for r in slots.on(df).groupBy("__slot").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 600
    odd = spark.createDataFrame([(1, None), (2, math.nan), (3, math.inf), (4, -math.inf), (5, 1.0)], "id long, x double")
    assert {r.id: r.pos for r in ranks.positions(odd.filter("id != 2"), [], ["x"], "pos", 1).collect()} == {1: 0, 4: 1, 5: 2, 3: 3}


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    shares = [0.0, 0.005, 1 / 3, 0.5, 0.995, 1.0]
    for n in (1, 7, 50_000):
        x = np.where(rng.random(n) < 0.3, 5.0, rng.standard_cauchy(n))
        df = spark.createDataFrame(pd.DataFrame({"x": x}))
        got = {r.k: (r.n, r.value) for r in ranks.quantiles(df, [], "x", shares).collect()}
        for k, s in enumerate(shares):
            assert got[k][0] == n and math.isclose(got[k][1], np.quantile(x, s), rel_tol=1e-9)
    assert ranks.quantiles(spark.createDataFrame([("a", None)], "g string, x double"), ["g"], "x", [0.5]).count() == 0


def loop_states(visits, stations, back, rework):
    """The definition, station by station: visits[unit][j] is the scan."""
    units, last = sorted(visits), max(s["j"] for s in stations)
    dims = {s["j"]: s for s in stations}
    start, arrive, starved, theta = {}, {}, {}, {}
    order = {j: sorted(units, key=lambda u: (visits[u][j], u)) for j in dims}
    for j in sorted(dims):
        for i, u in enumerate(order[j]):
            arrive[u, j] = float(u * 20) if j == 1 else visits[u][j - 1] + dims[j - 1]["transport_s"]
            if j == rework + 1 and u in back:
                arrive[u, j] = max(arrive[u, j], back[u])
            p = dims[j]["parallel"]
            before = visits[order[j][i - p]][j] if i >= p else None
            start[u, j] = arrive[u, j] if before is None else max(arrive[u, j], before)
            starved[u, j] = 0.0 if before is None else max(start[u, j] - before, 0.0)
    for j in sorted(dims):
        if j < last:
            cap = dims[j]["buffer"] + dims[j + 1]["parallel"] - 1
            for i, u in enumerate(order[j + 1]):
                if i >= cap:
                    theta[u, j] = start[order[j + 1][i - cap], j + 1] - start[u, j]
    return {
        (u, j): (arrive[u, j], start[u, j], visits[u][j] - start[u, j], starved[u, j], theta.get((u, j)), (u, j) in theta and visits[u][j] - start[u, j] - theta[u, j] < 1.5)
        for u in units for j in dims
    }


@pytest.mark.parametrize("per_slot", [40, 10**6])
def test_states_of_parallel_machines_mixed_capacities_and_rework(spark, per_slot):
    rng = random.Random(8)
    stations = [{"j": j, "parallel": p, "buffer": b, "transport_s": t} for j, p, b, t in [(1, 1, 3, 4.0), (2, 2, 1, 5.0), (3, 3, 5, 2.5), (4, 1, 2, 0.0)]]
    visits = {}
    for u in range(120):
        at, visits[u] = u * 20.0, {}
        for j in range(1, 5):
            at += rng.choice([5.0, 17.0, 40.0])
            visits[u][j] = at
    back = {u: visits[u][2] + 300 for u in range(5, 120, 9)}
    df = spark.createDataFrame([(u, j, u * 20.0, x) for u, v in visits.items() for j, x in v.items()], "unit long, j int, release_s double, x double")
    again = spark.createDataFrame(list(back.items()), "unit long, reentry_s double")
    got = feed.reconstruct(df, "x", stations=stations, reentry=again, rework_station=2, rows_per_slot=per_slot).collect()
    want = loop_states(visits, stations, back, 2)
    assert len(got) == len(want)
    for r in got:
        for mine, own in zip((r.arrive_s, r.start_s, r.dwell_s, r.starved_s, r.theta_s, r.blocked), want[r.unit, r.j], strict=True):
            assert mine == own or math.isclose(mine, own, abs_tol=1e-9)


@pytest.mark.parametrize("per_slot", [50, 10**6])
def test_active_periods_in_slots(spark, per_slot):
    rng = random.Random(6)
    rows = []
    for sid in "ab":
        at = 0
        for i in range(300):
            at += rng.choice([0, 1, 5, 30])
            rows.append((sid, len(rows), at, at + rng.choice([0, 2, 10, 200 if i % 50 == 0 else 3])))
    df = spark.createDataFrame(rows, "sid string, id long, start long, finish long")
    got = {(r.sid, r.p): (r.s, r.e) for r in bottleneck.active_periods(df, ["sid"], ["start", "id"], "start", "finish", 2, per_slot).collect()}
    want = {}
    for sid in "ab":
        p, top = 0, -math.inf
        for _, _, s, e in sorted((r for r in rows if r[0] == sid), key=lambda r: (r[2], r[1])):
            if s > top + 2:
                p += 1
            lo, hi = want.get((sid, p), (s, e))
            want[sid, p], top = (min(lo, s), max(hi, e)), max(top, e)
    assert got == want


def test_leaders_and_regimes(spark):
    periods = spark.createDataFrame([("a", 0, 100), ("b", 10, 100), ("c", 95, 125)], "sid string, s long, e long")
    got = {r.t: (r.sid, r.shifting) for r in bottleneck.leaders(bottleneck.covered(periods, "sid", 10), "sid").collect()}
    assert got == {0: ("a", False)} | {t: ("a", True) for t in range(1, 11)} | {11: ("c", False), 12: ("c", False)}
    calls = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(zip("aabbbcccc", "aaaaabbcc", strict=True))], "t long, p string, q string")
    for per_slot in (2, 100):
        lead = {r.station: (r.predicted_first, r.present_first, r.lead_h) for r in bottleneck.regime_lead(calls, "t", "p", "q", 2.0, rows_per_slot=per_slot).collect()}
        assert lead == {"a": (None, 0, None), "b": (2, None, None), "c": (5, None, None)}


def log_likelihood(mu, ls, exact, upper):
    s = math.exp(ls)
    z = (exact - mu) / s
    out = -np.sum(0.5 * z**2) - len(exact) * ls
    return out + sum(math.log(0.5 * math.erfc(-(u - mu) / s / math.sqrt(2))) for u in upper)


def test_standard_error_is_that_of_the_observed_information():
    rng = np.random.default_rng(3)
    logs = rng.normal(4, 0.2, 400)
    bounds = rng.normal(4.05, 0.2, 400)
    exact, upper = logs[logs >= bounds], bounds[logs < bounds]
    mu, s, ok = kernels.fit_lognormal(len(exact), exact.sum(), (exact**2).sum(), upper, np.ones(len(upper)))
    se = sensors.standard_error(mu, s, len(exact), exact.sum(), (exact**2).sum(), upper, np.ones(len(upper)))
    h, at = 1e-3, (mu, math.log(s))
    f = lambda a, b: -log_likelihood(at[0] + a * h, at[1] + b * h, exact, upper)
    assert ok and abs(f(1, 0) - f(-1, 0)) / (2 * h) < 1e-2 and abs(f(0, 1) - f(0, -1)) / (2 * h) < 1e-2
    hess = np.array([[f(1, 0) - 2 * f(0, 0) + f(-1, 0), (f(1, 1) - f(1, -1) - f(-1, 1) + f(-1, -1)) / 4], [0, f(0, 1) - 2 * f(0, 0) + f(0, -1)]]) / h**2
    hess[1, 0] = hess[0, 1]
    mean = math.exp(mu + s * s / 2)
    grad = np.array([mean, mean * s * s])
    assert math.isclose(se, math.sqrt(grad @ np.linalg.inv(hess) @ grad), rel_tol=1e-3)


def test_intervals_cover_the_true_mean_and_methods(spark):
    rng = np.random.default_rng(11)
    rows = []
    for j in range(1, 41):  # forty stations of one window each, a third of the visits blocked
        proc, theta = rng.lognormal(4, 0.15, 150), rng.lognormal(3.93, 0.1, 150)
        rows += [(u, j, float(max(p, t)), float(t), bool(p < t)) for u, (p, t) in enumerate(zip(proc, theta, strict=True))]
    rows += [(u, 50, 10.0 + u % 3, None, False) for u in range(150)] + [(u, 51, 1.0, None, False) for u in range(9)] + [(u, 52, 3.0, 3.0, True) for u in range(40)]
    df = spark.createDataFrame(rows, "unit long, j int, dwell_s double, theta_s double, blocked boolean")
    got = {r.j: r for r in sensors.profiles(df, spark.createDataFrame([(1, 0, 150)], "window_id long, lo long, hi long")).collect()}
    true = math.exp(4 + 0.15**2 / 2)
    assert sum(got[j].lo95 <= true <= got[j].hi95 for j in range(1, 41)) >= 34
    assert {got[j].method for j in range(1, 41)} == {"censored-mle"} and all(0.3 < got[j].confidence < 0.98 for j in range(1, 41))
    assert (got[50].method, got[50].confidence, got[50].mean_s) == ("direct", 0.99, 11.0)
    assert math.isclose(got[50].hi95 - got[50].mean_s, 1.96 * np.std([10.0 + u % 3 for u in range(150)], ddof=1) / math.sqrt(150))
    assert (got[51].method, got[51].confidence) == ("insufficient", 0.0) and got[52].method == "direct"


def test_windows_of_any_alignment(spark):
    rng = random.Random(1)
    rows = [(u, j, rng.random() + 1, rng.random() + 1, rng.random() < 0.2) for u in range(1000) for j in (1, 2)]
    df = spark.createDataFrame(rows, "unit long, j int, dwell_s double, theta_s double, blocked boolean")
    wins = [(i, *sorted(rng.sample(range(1001), 2))) for i in range(60)] + [(60, 64, 128), (61, 0, 1000), (62, 5, 5), (63, 63, 65)]
    stats = sensors.window_statistics(df, spark.createDataFrame(wins, "window_id long, lo long, hi long"), block=8, levels=4)
    got = {(r.window_id, r.j): r for r in sensors.direct(stats).collect()}
    for i, lo, hi in wins:
        for j in (1, 2):
            own = [r for r in rows if r[1] == j and lo <= r[0] < hi]
            exact = [r[2] for r in own if not r[4]]
            assert ((i, j) in got) == bool(own)
            if own:
                assert (got[i, j].n, got[i, j].n_censored) == (len(own), len(own) - len(exact))
                assert not exact or math.isclose(got[i, j].mean_s, np.mean(exact))


def test_overlaps_and_suspects(spark):
    rng = random.Random(2)
    visits = [(u, rng.randint(1, 2), s, s + rng.choice([0.0, 3.0, 50.0])) for u in range(200) for s in [rng.random() * 300]]
    asked = [(q, rng.randint(1, 3), t, t + rng.choice([0.0, 1.0, 90.0])) for q in range(40) for t in [rng.random() * 300]]
    got = thread.overlaps(spark.createDataFrame(visits, "unit long, j int, start_s double, depart_s double"), spark.createDataFrame(asked, "question long, j int, t0 double, t1 double"), 7.0)
    want = sorted((q, u) for q, j, t0, t1 in asked for u, k, s, e in visits if j == k and t0 < t1 and e > t0 and s < t1)
    assert sorted((r.question, r.unit) for r in got.collect()) == want
    spans = spark.createDataFrame([(u, float(u)) for u in range(200)], "unit long, gone_s double")
    now = spark.createDataFrame([(q, 100.0) for q in range(40)], "question long, now_s double")
    for r in thread.suspects(got, spans, now, 3).collect():
        here = sorted(u for q, u in want if q == r.question and u > 100)
        assert (r.n_exposed, r.n_in_line, r.units) == (sum(q == r.question for q, _ in want), len(here), here[:3])


def test_suspects_with_columns_that_come_along(spark):
    """Visits bring gone_s and questions now_s, so no pair is joined; units of several parts, and those seen twice, count once."""
    rng = random.Random(4)
    gone = {u: rng.random() * 300 for u in rng.sample(range(3 * thread.PART), 150)}
    visits = [(u, j, s, s + 40.0, g) for u, g in gone.items() for j in (1, 1, 2) for s in [rng.random() * 300]]
    asked = [(q, rng.randint(1, 2), t, t + 90.0, rng.random() * 300) for q in range(30) for t in [rng.random() * 300]]
    v = spark.createDataFrame(visits, "unit long, j int, start_s double, depart_s double, gone_s double")
    q = spark.createDataFrame(asked, "question long, j int, t0 double, t1 double, now_s double")
    got = thread.suspects(thread.overlaps(v, q, 7.0, keep=("gone_s",), told=("now_s",)), None, None, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(question") == 2  # pairs, then a row for each part
    joined = thread.suspects(thread.overlaps(v, q, 7.0), v.select("unit", "gone_s").distinct(), q.select("question", "now_s"), 3)
    assert sorted(got.collect()) == sorted(joined.collect())
    want = []
    for k, j, t0, t1, now in asked:
        met = {u for u, i, s, e, _ in visits if i == j and e > t0 and s < t1}
        here = sorted(u for u in met if gone[u] > now)
        want += [(k, len(met), len(here), len(met) - len(here), here[:3])] if met else []
    assert sorted(map(tuple, got.collect())) == want

def test_fisher_at_any_size():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.choice([5, 20, 60, 400])
        nd, ne = rng.randint(0, n), rng.randint(0, n)
        a = rng.randint(0, min(nd, ne) + 1)
        want = sum(math.comb(nd, k) * math.comb(n - nd, ne - k) for k in range(a, min(nd, ne) + 1) if ne - k <= n - nd) / math.comb(n, ne)
        assert math.isclose(causes.upper_tail(n, nd, ne, a), want, rel_tol=1e-9, abs_tol=1e-12)
    start = time.process_time()
    p = causes.upper_tail(100_000_000, 50_000_000, 50_000_000, 25_000_100)
    assert time.process_time() - start < 0.1 and math.isclose(p, 0.48412628819, rel_tol=1e-8)
    assert math.isclose(causes.upper_tail(10**12, 10**11, 10**11, 10**10 + 10**5), 0.1332615, rel_tol=1e-5)


def test_false_discovery_control_over_slots_equals_the_loop(spark):
    rng = random.Random(7)
    ps = [rng.choice([rng.random(), rng.random() ** 8, 0.25, 0.0, 1e-310, 1.0]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(ps)), "id long, p double")
    got = {r.id: r.q for r in causes.benjamini_hochberg(df, ["id"]).collect()}
    order = sorted(range(len(ps)), key=lambda i: (ps[i], i))
    q = 1.0
    for rank in range(len(ps), 0, -1):
        i = order[rank - 1]
        q = min(q, ps[i] * len(ps) / rank)
        assert math.isclose(got[i], q, abs_tol=1e-15)
    assert causes.benjamini_hochberg(df.limit(0), ["id"]).count() == 0


def test_sensors_and_threads_of_nothing(spark):
    none = spark.createDataFrame([], "unit long, j int, dwell_s double, theta_s double, blocked boolean")
    assert sensors.profiles(none, spark.createDataFrame([(1, 0, 10)], "window_id long, lo long, hi long")).count() == 0
    asked = spark.createDataFrame([], "question long, j int, t0 double, t1 double")
    assert thread.overlaps(none.select("unit", "j", F.lit(0.0).alias("start_s"), F.lit(1.0).alias("depart_s")), asked).count() == 0


def test_statistics_without_cells_and_beyond_the_longest_window(spark):
    """One cell of bounds a window and station, the same direct estimates, and no ranges longer than the windows."""
    rng = random.Random(2)
    rows = [(u, j, 50 + 10 * rng.random(), 40 + 20 * rng.random(), rng.random() < 0.4) for u in range(900) for j in (1, 2)]
    visits = spark.createDataFrame(rows, "unit long, j int, dwell_s double, theta_s double, blocked boolean")
    windows = spark.createDataFrame([(1, 10, 700), (2, 128, 256), (3, 5, 6)], "window_id long, lo long, hi long")
    fine, slim = (sensors.window_statistics(visits, windows, cells=c) for c in (True, False))
    key = lambda df: sorted((r.window_id, r.j, r.n, r.n_censored, round(r.mean_s or 0, 9), round(r.sd_s or 0, 6)) for r in sensors.direct(df).collect())
    assert key(fine) == key(slim)
    assert slim.count() <= 2 * 3 * 2 < fine.count()
    assert slim._jdf.queryExecution().analyzed().toString().count("sequence(0, 3") and windows.count() == 3


def test_short_windows_cut_from_tiles_equal_those_put_together_from_ranges(spark, monkeypatch):
    """Windows over tile borders, of any length, empty and beyond the feed; visits without time, or with a bound that is none; a true column."""
    rng = np.random.default_rng(5)
    rows = []
    for u in range(0, 1000):
        for j in (1, 2, 3):
            if (u * 7 + j) % 13:
                p, t = rng.lognormal(4, 0.2), rng.lognormal(3.95, 0.2)
                rows.append((u, j, None if u % 97 == 5 else float(max(p, t)), -1.0 if u % 89 == 3 else None if u % 83 == 2 else float(t), bool(p < t) if j < 3 else False, float(p)))
    df = spark.createDataFrame(rows, "unit long, j int, dwell_s double, theta_s double, blocked boolean, proc_s double")
    pick = random.Random(1)
    wins = [(i, lo, lo + pick.randint(0, 250)) for i in range(40) for lo in [pick.randint(-20, 1000)]] + [(90, 0, 1000), (91, 64, 128), (92, 5000, 5100)]
    windows = spark.createDataFrame(wins, "window_id long, lo long, hi long")
    found = {}
    for name, tile, short in (("ranges", 64, -1), ("both", 128, 120), ("tiles", 1000, 1000)):
        monkeypatch.setattr(sensors, "TILE", tile)
        monkeypatch.setattr(sensors, "SHORT", short)
        out = sensors.profiles(df, windows, block=8, levels=5, true="proc_s")
        found[name] = {(r.window_id, r.j): r[2:] for r in out.collect()}
        assert out.columns == [*(c.split()[0] for c in sensors.SCHEMA.split(", ")), "true_mean_s"]
    assert found["ranges"].keys() == found["both"].keys() == found["tiles"].keys() and {r[6] for r in found["tiles"].values()} == {"insufficient", "direct", "censored-mle"}
    for other in ("both", "tiles"):
        for key, want in found["ranges"].items():
            for mine, own in zip(found[other][key], want, strict=True):
                assert mine == own or mine == pytest.approx(own, rel=1e-7, nan_ok=True)
    for (i, j), r in found["tiles"].items():
        _, lo, hi = next(w for w in wins if w[0] == i)
        assert r[-1] == pytest.approx(np.mean([p for u, k, _, _, _, p in rows if k == j and lo <= u < hi]))


def test_no_cells_of_short_windows_move(spark):
    """A visit moves once, and a second time near the border of a tile; it used to be a row for each cell of each window."""
    rows = spark.range(20000).select(F.col("id").alias("unit"), F.lit(1).alias("j"), (F.col("id") % 91 + 50.0).alias("dwell_s"), (F.col("id") % 89 + 50.0).alias("theta_s"), (F.col("id") % 3 == 0).alias("blocked"))
    windows = spark.range(9, 200).select(F.col("id").alias("window_id"), (F.col("id") * 100 - 900).alias("lo"), (F.col("id") * 100).alias("hi"))
    plan = sensors.profiles(rows, windows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_edges_of_windows_are_not_broadcast(spark):
    """They are many rows a window, made behind a small table, whose size Spark takes for theirs."""
    visits = spark.createDataFrame([(u, 1, 5.0, 6.0, False) for u in range(200)], "unit long, j int, dwell_s double, theta_s double, blocked boolean")
    stats = sensors.window_statistics(visits, spark.createDataFrame([(1, 3, 150)], "window_id long, lo long, hi long"))
    assert [r.n for r in stats.collect()] == [147]
    assert "Broadcast" not in stats._jdf.queryExecution().executedPlan().toString()


def test_fits_side_by_side_equal_single_ones():
    rng = np.random.default_rng(9)
    single, args = [], []
    for k in (0, 1, 25, 40, 200):
        logs, bound = rng.normal(4, 0.2, 50 if k != 25 else 3), rng.normal(4.05, 0.2, k)
        args.append((len(logs), logs.sum(), (logs**2).sum(), bound, np.ones(k)))
        single.append(kernels.fit_lognormal(*args[-1]))
    bound, weight = np.zeros((2, len(args), 200))
    for i, a in enumerate(args):
        bound[i, : len(a[3])], weight[i, : len(a[3])] = a[3], a[4]
    n, x, xx = (np.array([a[k] for a in args], float) for k in range(3))
    for got, want in zip(zip(*kernels.fit_lognormals(n, x, xx, bound, weight), strict=True), single, strict=True):
        assert got[2] == want[2] and got[:2] == pytest.approx(want[:2], rel=1e-9, nan_ok=True)


def test_soft_score_broadcasts_nothing_and_scores_against_the_window_means(spark):
    """The true means come along with the profiles; they used to be a second feed, joined with the edges of all windows."""
    from taktwerk.plans import twin

    sf = "/root/testdata/sf0.001"
    got = twin.q_soft_score(spark, sf)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    states, asked = twin.feed_states(spark, sf).filter("j IN (2, 4, 6)"), twin.windows(spark, sf)
    means = states.join(asked, (F.col("unit") >= F.col("lo")) & (F.col("unit") < F.col("hi"))).groupBy("window_id", "j").agg(F.avg("proc_s").alias("true_mean_s"))
    want = twin.rounded(sensors.score_summary(sensors.score(sensors.profiles(states, asked), means)))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 10
