"""Soft sensors: cycle times of any window of units from scans alone, with interval and confidence, and their score.

Short windows are fitted where their visits lie: the visits of a range of units move once, with those just behind it, and all windows that begin
in the range are cut from them. For long ones, the statistics that a fit needs add up: they are kept for dyadic ranges of blocks of units, so a window of
any length takes two ranges of each length at most, and single visits only at its edges. All windows are one job.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taktwerk.operators.kernels import fit_lognormal, fit_lognormals, mills

BLOCK = 64
LEVELS = 16
WIDTH = 0.001  # of a bin of bounds, in the log
TILE = 8192  # units whose visits lie side by side
SHORT = TILE // 4  # units of a window at most that is cut from a tile and what follows it; a tile itself at most
SUMS = ("n", "n_log", "x", "xx", "d", "dd")
SCHEMA = "window_id long, j int, n long, n_censored long, mean_s double, sd_s double, lo95 double, hi95 double, method string, confidence double"


def statistics(visits: DataFrame, key: list[Column], cells: bool = True) -> DataFrame:
    """Sums by key, station and cell of (unit, j, dwell_s, theta_s, blocked): exact visits have a null cell, bounds one of WIDTH in the log.

    Without `cells` all bounds share one.
    """
    v = F.when(F.col("blocked"), F.col("theta_s")).otherwise(F.col("dwell_s"))
    rows = visits.select(*key, "j", "blocked", v.alias("v")).withColumn("log", F.when(F.col("v") > 0, F.ln("v")))
    cell = F.when(F.col("blocked"), F.coalesce(F.floor(F.col("log") / WIDTH), F.lit(-(1 << 40))) if cells else F.lit(0).cast("long"))
    names = [c for c in rows.columns if c not in ("j", "blocked", "v", "log")]
    return rows.groupBy(*names, "j", cell.alias("cell")).agg(
        F.count("*").alias("n"), F.count("log").alias("n_log"), F.sum("log").alias("x"), F.sum(F.col("log") * F.col("log")).alias("xx"),
        F.sum("v").alias("d"), F.sum(F.col("v") * F.col("v")).alias("dd"),
    )


def dyadic(by_block: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The statistics of blocks for all ranges of 2^level blocks that start at a multiple of their length."""
    at = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(F.col("block") / F.pow(F.lit(2.0), k)).cast("long").alias("node")))
    rows = by_block.withColumn("at", F.explode(at)).select("at.level", "at.node", "j", "cell", *SUMS)
    return rows.groupBy("level", "node", "j", "cell").agg(*(F.sum(c).alias(c) for c in SUMS))


def ranges_of(windows: DataFrame, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """(window_id, level, node): the dyadic ranges that make up the whole blocks of each window [lo, hi), each block once."""
    a, b = F.ceil(F.col("lo") / block).cast("long"), F.floor(F.col("hi") / block).cast("long")

    def at(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        left, right = F.ceil(a / size).cast("long"), F.floor(b / size).cast("long")
        none = F.array().cast("array<bigint>")
        odd = F.concat(F.when(left % 2 == 1, F.array(left)).otherwise(none), F.when(right % 2 == 1, F.array(right - 1)).otherwise(none))
        nodes = F.when(k == levels, F.sequence(left, right - 1)).otherwise(odd)
        return F.transform(F.when(left < right, nodes).otherwise(none), lambda x: F.struct(k.alias("level"), x.alias("node")))

    return windows.select("window_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))).alias("r")).select("window_id", "r.level", "r.node")


def edges_of(windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(window_id, unit): the units of each window outside of its whole blocks."""
    a, b = F.ceil(F.col("lo") / block).cast("long") * block, F.floor(F.col("hi") / block).cast("long") * block
    upto = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    lo, hi = F.col("lo").cast("long"), F.col("hi").cast("long")
    units = F.when(a < b, F.concat(upto(lo, a), upto(b, hi))).otherwise(upto(lo, hi))
    return windows.select("window_id", F.explode(units).alias("unit"))


def window_statistics(visits: DataFrame, windows: DataFrame, block: int = BLOCK, levels: int = LEVELS, cells: bool = True) -> DataFrame:
    """(window_id, j, cell, sums) of each window (window_id, lo, hi) of units; windows may overlap.

    Ranges longer than the longest window are in none, so none are made. cells: as in `statistics`; `direct` needs none. Ranges and edges are many
    rows a window, which Spark doesn't see when it weighs a broadcast, so they are never broadcast.
    """
    longest = windows.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0  # one number
    levels = min(levels, max(int(longest) // block, 1).bit_length() - 1)
    nodes = dyadic(statistics(visits, [F.floor(F.col("unit") / block).cast("long").alias("block")], cells), levels)
    whole = ranges_of(windows, block, levels).hint("merge").join(nodes, ["level", "node"]).select("window_id", "j", "cell", *SUMS)
    near = visits.join(edges_of(windows, block).hint("merge"), "unit")
    part = statistics(near, [F.col("window_id")], cells).select("window_id", "j", "cell", *SUMS)
    return whole.union(part).groupBy("window_id", "j", "cell").agg(*(F.sum(c).alias(c) for c in SUMS))


def direct(stats: DataFrame) -> DataFrame:
    """(window_id, j, n, n_censored, mean_s, sd_s, censored_frac) of the exact visits of each window, without a fit."""
    exact = lambda c: F.sum(F.when(F.col("cell").isNull(), F.col(c)))
    out = stats.groupBy("window_id", "j").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("cell").isNotNull(), F.col("n")).otherwise(0)).alias("n_censored"), exact("n").alias("m"), exact("d").alias("d"), exact("dd").alias("dd"))
    var = F.greatest((F.col("dd") - F.col("d") * F.col("d") / F.col("m")) / F.nullif(F.col("m") - 1, F.lit(0)), F.lit(0.0))
    return out.select("window_id", "j", "n", "n_censored", (F.col("d") / F.col("m")).alias("mean_s"), F.sqrt(var).alias("sd_s"), (F.col("n_censored") / F.col("n")).alias("censored_frac"))


def standard_error(mu: float, s: float, n: int, x: float, xx: float, bound: np.ndarray, weight: np.ndarray) -> float:
    """Of the mean exp(mu + s^2 / 2): the delta method on the observed information of (mu, ln s).

    n, x, xx: count and sums of the exact logs; bound, weight: the upper bounds' logs and how many have each.
    """
    z1, z2 = (x - n * mu) / s, (xx - 2 * mu * x + n * mu * mu) / (s * s)
    c = (bound - mu) / s
    r = mills(c)
    k = r * (c + r)
    h11 = (n + float(weight @ k)) / (s * s)
    h12 = (2 * z1 + float(weight @ (k * c - r))) / s
    h22 = 2 * z2 + float(weight @ (k * c * c - r * c))
    det = h11 * h22 - h12 * h12
    if not det > 0:
        return math.nan
    mean = math.exp(mu + s * s / 2)
    g1, g2 = mean, mean * s * s
    return math.sqrt(max((g1 * g1 * h22 - 2 * g1 * g2 * h12 + g2 * g2 * h11) / det, 1e-12))


def estimated(n: int, censored: int, m: int, d: float, dd: float, n_log: int, x: float, xx: float, bound: np.ndarray, weight: np.ndarray, fit: tuple[float, float, bool] | None) -> tuple:
    """(n, n_censored, mean, sd, lo95, hi95, method, confidence) from counts, the m exact visits' sums, bounds and their fit (of `fit_lognormal`)."""
    if n < 30:
        return n, censored, math.nan, math.nan, math.nan, math.nan, "insufficient", 0.0
    mean = d / m if m else math.nan
    sd = math.sqrt(max((dd - d * d / m) / (m - 1), 0.0)) if m > 1 else math.nan
    se, method = sd / math.sqrt(max(m, 1)), "direct"
    if censored:
        mu, s, ok = fit
        error = standard_error(mu, s, n_log, x, xx, bound, weight) if ok else math.nan
        if error == error:
            mean, se, method = math.exp(mu + s * s / 2), error, "censored-mle"
            sd = mean * math.sqrt(math.expm1(s * s))
        confidence = min(max((1 - censored / n) ** 0.6 * min(1.0, max(m, 1) / 90), 0.05), 0.98)
    else:
        confidence = min(max(min(1.0, m / 120), 0.05), 0.99)
    return n, censored, mean, sd, mean - 1.96 * se, mean + 1.96 * se, method, confidence


def estimate(stats: pd.DataFrame) -> tuple:
    """`estimated` of one window of a station from its sums by cell."""
    exact, upper = stats[stats["cell"].isna()], stats[stats["cell"].notna()]
    n, censored, m = int(stats["n"].sum()), int(upper["n"].sum()), int(exact["n"].sum())
    d, dd, n_log, x, xx = (float(exact[c].fillna(0).sum()) for c in ("d", "dd", "n_log", "x", "xx"))
    upper = upper[upper["n_log"] > 0]
    weight = upper["n_log"].to_numpy(float)
    bound = upper["x"].to_numpy(float) / weight
    fit = fit_lognormal(int(n_log), x, xx, bound, weight) if censored and n >= 30 else None
    return estimated(n, censored, m, d, dd, int(n_log), x, xx, bound, weight, fit)


def cut(visits: pd.DataFrame, windows: pd.DataFrame) -> list[tuple]:
    """A row of SCHEMA and the mean of `true` for each window with visits of one station; visits are (unit, v, blocked, true), v the bound of a blocked one."""
    visits = visits.sort_values("unit", kind="stable")
    unit, v, blocked, true = (visits[c].to_numpy() for c in ("unit", "v", "blocked", "true"))
    known = v > 0
    log = np.log(np.where(known, v, 1.0))
    bounds = blocked & known
    lo, hi = windows["lo"].to_numpy(), windows["hi"].to_numpy()
    of = lambda u: list(zip(np.searchsorted(u, lo), np.searchsorted(u, hi), strict=True))
    value, exact_log, has_log = np.nan_to_num(v[~blocked]), log[~blocked], known[~blocked]
    cell, bound_log = np.floor(log[bounds] / WIDTH), log[bounds]
    rows, samples = [], []
    for i, ((a, b), (ea, eb), (ba, bb)) in enumerate(zip(of(unit), of(unit[~blocked]), of(unit[bounds]), strict=True)):
        if a >= b:
            continue
        x, y = value[ea:eb], exact_log[ea:eb]
        _, at, weight = np.unique(cell[ba:bb], return_inverse=True, return_counts=True)
        bound = np.bincount(at, bound_log[ba:bb], len(weight)) / weight
        rows.append((i, int(b - a), int(b - a - (eb - ea)), int(eb - ea), float(x.sum()), float(x @ x), int(has_log[ea:eb].sum()), float(y.sum()), float(y @ y), float(np.mean(true[a:b]))))
        samples.append((bound, weight.astype(float)))
    bound, weight = np.zeros((2, len(rows), max((len(w) for _, w in samples), default=0)))
    for k, (b, w) in enumerate(samples):
        bound[k, : len(b)], weight[k, : len(w)] = b, w
    n_log, x, xx = (np.array([r[k] for r in rows], float) for k in (6, 7, 8))
    fits = zip(*fit_lognormals(n_log, x, xx, bound, weight), strict=True)
    ids = windows["window_id"].to_numpy()
    return [(ids[r[0]], *estimated(*r[1:9], *sample, fit), r[9]) for r, sample, fit in zip(rows, samples, fits, strict=True)]


def profiles(visits: DataFrame, windows: DataFrame, block: int = BLOCK, levels: int = LEVELS, true: str | None = None) -> DataFrame:
    """The cycle time of every station in each window (window_id, lo, hi) of units: a row a window and station, see SCHEMA.

    Without blocked visits the mean stands (`direct`); else a lognormal is fitted in which a blocked visit only says that its time was
    below theta_s (`censored-mle`, `direct` where the fit fails). Fewer than 30 visits are `insufficient`. The interval is 1.96
    standard errors; confidence falls with censoring and with few exact visits. A window without visits has no row.
    true: a column of the visits, whose mean over all visits of the window comes along as true_mean_s.
    """
    length = F.col("hi") - F.col("lo")
    most, longest = windows.agg(F.max(F.when(length <= SHORT, length)), F.max(length)).first()  # two numbers
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def near(key: tuple, own: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        rows = [(r[0], j, *r[1:]) for j, at in own.groupby("j") for r in cut(at, begun)] if len(begun) else []
        return pd.DataFrame(rows, columns=[*columns, "true_mean_s"])

    # a visit lies in its own tile, and before it in that whose last windows reach up to it
    own, past = F.floor(F.col("unit") / TILE).cast("long"), F.pmod(F.col("unit"), F.lit(TILE))
    tiles = F.explode(F.when(past < int(most or 0), F.array(own, own - 1)).otherwise(F.array(own))).alias("tile")
    v = F.when(F.col("blocked"), F.col("theta_s")).otherwise(F.col("dwell_s"))
    told = F.col(true).cast("double") if true else F.lit(None).cast("double")
    rows = visits.select(tiles, "unit", "j", v.alias("v"), F.coalesce("blocked", F.lit(False)).alias("blocked"), told.alias("true"))
    begun = windows.filter(length <= SHORT).select(F.floor(F.col("lo") / TILE).cast("long").alias("tile"), "window_id", "lo", "hi")
    out = rows.groupBy("tile").cogroup(begun.groupBy("tile")).applyInPandas(near, f"{SCHEMA}, true_mean_s double")

    if longest is not None and longest > SHORT:

        def one(df: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(df["window_id"].iloc[0], df["j"].iloc[0], *estimate(df))], columns=columns)

        far = windows.filter(length > SHORT)
        wide = window_statistics(visits, far, block, levels).groupBy("window_id", "j").applyInPandas(one, SCHEMA)
        if true:
            means = visits.select("unit", "j", F.lit(False).alias("blocked"), F.col(true).alias("dwell_s"), F.lit(None).cast("double").alias("theta_s"))
            means = direct(window_statistics(means, far, block, levels, cells=False)).select("window_id", "j", F.col("mean_s").alias("true_mean_s"))
            wide = wide.join(means, ["window_id", "j"], "left")
        out = out.unionByName(wide, allowMissingColumns=True)
    return out if true else out.drop("true_mean_s")


def score(estimates: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(window_id, j, abs_err_s, pct_err, in_95ci, method, confidence) against (window_id, j, true_mean_s), or the true_mean_s that came along."""
    off = F.abs(F.col("mean_s") - F.col("true_mean_s"))
    inside = (F.col("lo95") <= F.col("true_mean_s")) & (F.col("true_mean_s") <= F.col("hi95"))
    return (estimates if truth is None else estimates.join(truth, ["window_id", "j"])).select(
        "window_id", "j", "true_mean_s", "mean_s", off.alias("abs_err_s"), (100 * off / F.col("true_mean_s")).alias("pct_err"), inside.alias("in_95ci"), "method", "confidence"
    )


def score_summary(scored: DataFrame) -> DataFrame:
    """(window_id, n, median_pct_err, mean_abs_err_s, coverage) over the stations of each window."""
    return scored.groupBy("window_id").agg(
        F.count("*").alias("n"), F.median("pct_err").alias("median_pct_err"), F.avg("abs_err_s").alias("mean_abs_err_s"), F.avg(F.col("in_95ci").cast("double")).alias("coverage")
    )
