"""Sequential kernels that no window expresses: the line recursion and the censored fit. Groups run in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VISITS = "run long, unit long, j int, start_s double, finish_s double, depart_s double"


def run_line(draws: DataFrame, transport_s: float = 4.5, capacity: int = 1) -> DataFrame:
    """Blocking-after-service departures from (run, unit, j, release_s, proc_s), one group for each run.

    A unit starts when it has arrived and its station is free, and leaves when the unit `capacity` places
    ahead has started at the next station. A run's recurrence is sequential, so one run must fit a task.
    """

    def one(df: pd.DataFrame) -> pd.DataFrame:
        units, stations = np.unique(df["unit"]), np.unique(df["j"])
        at = (np.searchsorted(units, df["unit"]), np.searchsorted(stations, df["j"]))
        proc, release = np.zeros((len(units), len(stations))), np.zeros(len(units))
        proc[at] = df["proc_s"]
        release[at[0]] = df["release_s"]
        start, depart = np.zeros_like(proc), np.zeros_like(proc)
        for u in range(len(units)):
            ready = release[u]
            for j in range(len(stations)):
                start[u, j] = max(ready, depart[u - 1, j] if u else ready)
                gate = start[u - capacity, j + 1] if j + 1 < len(stations) and u >= capacity else -math.inf
                depart[u, j] = max(start[u, j] + proc[u, j], gate)
                ready = depart[u, j] + transport_s
        return pd.DataFrame(
            {"run": df["run"].iloc[0], "unit": df["unit"], "j": df["j"], "start_s": start[at], "finish_s": (start + proc)[at], "depart_s": depart[at]}
        )

    return draws.groupBy("run").applyInPandas(one, VISITS)


# fixed values: a polynomial for erfc with a relative error below 1.2e-7 everywhere
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    power = np.polynomial.polynomial.polyval(t, ERFC)
    half = 0.5 * t * np.exp(np.maximum(power - x * x, -740))
    return np.where(z < 0, half, 1 - half)


def mills(z: np.ndarray) -> np.ndarray:
    """phi / Phi: how far a normal number below z lies below its mean, on average."""
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / np.clip(normal_cdf(z), 1e-12, 1)


def fit_lognormal(n: int, total: float, squares: float, bound: np.ndarray, weight: np.ndarray, rounds: int = 500) -> tuple[float, float, bool]:
    """mu and sigma of log cycle times, by EM; whether it settled.

    n, total and squares are the count and sums of the exact logs; bound and weight the upper bounds' logs (left-censored
    times) and how many have each.
    """
    every = n + float(weight.sum())
    if every < 30 or n < 2:
        return math.nan, math.nan, False
    mu = total / n
    s = max(math.sqrt(max(squares - n * mu * mu, 0.0) / (n - 1)), 1e-3)
    for _ in range(rounds):
        z = (bound - mu) / s
        ratio = mills(z)
        mean = mu - s * ratio
        square = mean**2 + s * s * (1 - z * ratio - ratio**2)
        new = float((total + weight @ mean) / every)
        new_s = math.sqrt(max(float(squares + weight @ square) / every - new * new, 1e-12))
        done = abs(new - mu) + abs(new_s - s) < 1e-9
        mu, s = new, new_s
        if done:
            return mu, s, True
    return mu, s, False


def fit_lognormals(n: np.ndarray, total: np.ndarray, squares: np.ndarray, bound: np.ndarray, weight: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fit_lognormal of many samples side by side, a row each; bounds without weight only fill a row up. A row that has settled takes no more rounds."""
    every = n + weight.sum(axis=1)
    out, out_s, ok = np.full(len(n), np.nan), np.full(len(n), np.nan), np.zeros(len(n), bool)
    left = np.flatnonzero((every >= 30) & (n >= 2))
    mu = total[left] / n[left]
    s = np.maximum(np.sqrt(np.maximum(squares[left] - n[left] * mu * mu, 0.0) / (n[left] - 1)), 1e-3)
    at = lambda: (total[left], squares[left], every[left], bound[left], weight[left])
    own = at()
    for _ in range(rounds):
        if not len(left):
            break
        sums, sums_2, count, b, w = own
        z = (b - mu[:, None]) / s[:, None]
        ratio = mills(z)
        mean = mu[:, None] - s[:, None] * ratio
        square = mean**2 + (s * s)[:, None] * (1 - z * ratio - ratio**2)
        new = (sums + (w * mean).sum(axis=1)) / count
        new_s = np.sqrt(np.maximum((sums_2 + (w * square).sum(axis=1)) / count - new * new, 1e-12))
        done = np.abs(new - mu) + np.abs(new_s - s) < 1e-9
        mu, s = new, new_s
        out[left], out_s[left] = mu, s
        if done.any():
            ok[left[done]] = True
            left, mu, s = left[~done], mu[~done], s[~done]
            own = at()
    return out, out_s, ok


def censored_cycle_times(visits: DataFrame, width: float = 0.001) -> DataFrame:
    """(j, n, n_censored, mean_s, sd_s, method) for each station, from (j, dwell_s, theta_s, blocked).

    A blocked visit only bounds its processing time from above by theta_s. The visits are pre-aggregated: exact ones to
    sums, bounds to counts in bins of `width` in the log, each at its own mean, so a station's task gets at most a few
    thousand rows however many visits it has. Where the fit fails, the mean of the exact visits stands, with method `direct`.
    """
    value = F.when(F.col("blocked"), F.col("theta_s")).otherwise(F.col("dwell_s"))
    rows = visits.select("j", "blocked", value.alias("v"))
    log = F.when(F.col("v") > 0, F.ln("v"))
    cell = F.when(F.col("blocked"), F.floor(log / width))
    sums = rows.groupBy("j", "blocked", cell.alias("cell")).agg(
        F.count("*").alias("n"), F.count(log).alias("n_log"), F.sum(log).alias("x"), F.sum(log * log).alias("xx"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
    )

    def one(df: pd.DataFrame) -> pd.DataFrame:
        exact, upper = df[~df["blocked"]], df[df["blocked"] & (df["n_log"] > 0)]
        n, x, xx = (float(exact[c].fillna(0).sum()) for c in ("n_log", "x", "xx"))
        weight = upper["n_log"].to_numpy(float)
        mu, s, ok = fit_lognormal(int(n), x, xx, upper["x"].to_numpy(float) / weight, weight)
        direct = exact[["mean", "sd"]].iloc[0] if len(exact) else {"mean": math.nan, "sd": math.nan}
        mean = math.exp(mu + s * s / 2) if ok else float(direct["mean"])
        sd = mean * math.sqrt(math.exp(s * s) - 1) if ok else float(direct["sd"])
        n_censored = int(df.loc[df["blocked"], "n"].sum())
        row = (df["j"].iloc[0], int(df["n"].sum()), n_censored, mean, sd, "censored-mle" if ok else "direct")
        return pd.DataFrame([row], columns=["j", "n", "n_censored", "mean_s", "sd_s", "method"])

    schema = "j int, n long, n_censored long, mean_s double, sd_s double, method string"
    return sums.groupBy("j").applyInPandas(one, schema)
