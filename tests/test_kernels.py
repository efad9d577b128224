import numpy as np

from taktwerk.operators import kernels


def test_line_departures_are_monotone_and_blocked(spark):
    rows = [(r, u, j, 10.0 * u, 60.0 if j == 2 else 20.0) for r in (1, 2) for u in range(6) for j in (1, 2)]
    df = spark.createDataFrame(rows, "run long, unit long, j int, release_s double, proc_s double")
    got = {(x.run, x.unit, x.j): x for x in kernels.run_line(df).collect()}
    assert len(got) == 24 and got[1, 0, 1].depart_s == 20.0 and got[1, 0, 2].start_s == 24.5
    assert all(got[1, u, 2].start_s >= got[1, u - 1, 2].depart_s for u in range(1, 6))
    assert all(got[1, u, 1].depart_s >= got[1, u - 1, 2].start_s for u in range(1, 6))


def test_censored_fit_recovers_the_mean(spark):
    rng = np.random.default_rng(1)
    x, bound = rng.lognormal(4, 0.3, 8000), rng.lognormal(4, 0.3, 8000)
    rows = [(1, float(max(a, 1.0)), float(b), bool(a < b)) for a, b in zip(x, bound, strict=True)]
    rows += [(2, 10.0, None, False), (2, 12.0, None, False), (3, 5.0, -1.0, True)]
    df = spark.createDataFrame(rows, "j int, dwell_s double, theta_s double, blocked boolean")
    got = {r.j: r for r in kernels.censored_cycle_times(df).collect()}
    assert got[1].method == "censored-mle" and abs(got[1].mean_s / x.mean() - 1) < 0.02 and abs(got[1].sd_s / x.std() - 1) < 0.06
    assert (got[2].method, got[2].mean_s, got[2].n, got[2].n_censored) == ("direct", 11.0, 2, 0)
    assert (got[3].n, got[3].n_censored) == (1, 1) and got[3].mean_s is None


def test_binned_fit_equals_the_plain_one():
    rng = np.random.default_rng(2)
    x, bound = np.log(rng.lognormal(3, 0.2, 3000)), np.log(rng.lognormal(3, 0.2, 3000))
    exact, upper = x[x >= bound], bound[x < bound]
    plain = kernels.fit_lognormal(len(exact), exact.sum(), (exact**2).sum(), upper, np.ones(len(upper)))
    cells = np.floor(upper / 0.001)
    keys, counts = np.unique(cells, return_counts=True)
    means = np.array([upper[cells == k].mean() for k in keys])
    binned = kernels.fit_lognormal(len(exact), exact.sum(), (exact**2).sum(), means, counts.astype(float))
    assert plain[2] and binned[2] and abs(plain[0] - binned[0]) < 1e-6 and abs(plain[1] - binned[1]) < 1e-6
