"""Rolling-horizon bottleneck forecasts: profiles of a lookback, replicated line runs, votes, and their score.

All triggers are one job. A trigger's state is one row of bounded arrays (stations, capacity, horizon), so triggers spread
over the cluster and no task depends on the length of the history. The functions named rolling_ give what those behind one another give, but
move the visits once, by tile of triggers: states, line runs, votes and actual shares of a trigger are computed where its visits lie.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIGGERS = 16  # of a tile at least; a tile is four times as long as the windows of a trigger at least
RUNS = "trigger long, rep int, unit long, j int, start_s double, finish_s double"


def normal_cdf(z: Column) -> Column:
    """Phi, with an error below 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    # fixed values: the coefficients of the formula
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def impute_processing(visits: DataFrame, fits: DataFrame) -> DataFrame:
    """Adds proc_s: the dwell where it is exact, else its mean under the station's lognormal given that it is below theta_s.

    fits is (j, mean_s, sd_s), one row a station; without a fit, or with a theta that is not positive, the lesser of
    dwell and theta stands. Never below 0.1 s.
    """
    known = fits.select("j", F.ln("mean_s").alias("lm"), F.log1p(F.pow(F.col("sd_s") / F.col("mean_s"), F.lit(2))).alias("var"))
    rows = visits.join(F.broadcast(known), "j", "left")  # a row a station
    s = F.sqrt("var")
    z = (F.ln("theta_s") - (F.col("lm") - F.col("var") / 2)) / s
    mean = F.exp("lm") * normal_cdf(z - s) / F.least(F.greatest(normal_cdf(z), F.lit(1e-9)), F.lit(1.0))
    bounded = F.coalesce(F.when((F.col("theta_s") > 0) & (F.col("var") > 0), mean), F.least("dwell_s", "theta_s"))
    proc = F.greatest(F.when(F.col("blocked"), bounded).otherwise(F.col("dwell_s")), F.lit(0.1))
    return rows.withColumn("proc_s", proc).drop("lm", "var")


def triggers_of(unit: Column, step: int, ahead: int, before: int) -> Column:
    """The triggers t, positive multiples of step with t - before <= unit < t + ahead, as an array: a unit's windows by arithmetic."""
    lo = F.greatest(F.floor((unit - ahead) / step) + 1, F.lit(1)).cast("long")
    hi = F.floor((unit + before) / step).cast("long")
    return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda k: k * step))


def states_at(visits: DataFrame, step: int, lookback: int, horizon: int, capacity: int = 1) -> DataFrame:
    """One row a trigger: profile (j, mean, sd), the last departures and starts at each station, and the releases ahead.

    visits is (unit, j, release_s, start_s, depart_s, proc_s). The mean is carried along its slope to the middle of the horizon where
    the slope is beyond two standard errors and the lookback has 240 units. Triggers whose horizon isn't whole are left out.
    """
    near = visits.withColumn("trigger", F.explode(triggers_of(F.col("unit"), step, horizon, lookback)))
    past = F.col("unit") < F.col("trigger")
    y, x = F.when(past, F.col("proc_s")), F.when(past, F.col("unit").cast("double"))
    last = past & (F.col("unit") >= F.col("trigger") - capacity)
    by_station = near.groupBy("trigger", "j").agg(
        F.count(y).alias("n"), F.avg(y).alias("m"), F.stddev_samp(y).alias("sd"),
        F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
        F.array_sort(F.collect_list(F.when(last, F.struct("unit", "depart_s", "start_s")))).alias("wip"),
        F.array_sort(F.collect_list(F.when(~past & (F.col("j") == 1), F.struct("unit", "release_s")))).alias("ahead"),
    )
    se = F.sqrt((F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / F.greatest(F.col("n") - 2, F.lit(1)) / F.col("sxx"))
    drift = F.when((F.col("n") >= 240) & (F.abs("slope") > 2 * se), F.col("slope") * (F.col("n") / 2 + horizon / 2)).otherwise(0.0)
    named = by_station.select("trigger", "ahead", F.struct("j", (F.col("m") + drift).alias("m"), F.coalesce("sd", F.lit(1.0)).alias("sd"), "wip").alias("s"))
    out = named.groupBy("trigger").agg(F.array_sort(F.collect_list("s")).alias("stations"), F.flatten(F.collect_list("ahead")).alias("ahead"))
    return out.filter((F.size("ahead") == horizon) & (F.size(F.filter("stations", lambda s: s["m"].isNull())) == 0))


def line_runs(states: list[dict], reps: int, transport_s: float, capacity: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and finishes by unit, station, state and replication, of states with equally many units ahead and stations, side by side.

    A state has trigger, m, sd and wip (unit to departure and start) by station, and release by unit. Draws depend on seed, trigger and replication alone.
    """
    n, k = len(states[0]["release"]), len(states[0]["m"])
    draws = []
    for state in states:
        mean = np.maximum(state["m"], 1e-6)
        sigma = np.maximum(np.sqrt(np.log1p((np.array(state["sd"]) / mean) ** 2)), 1e-4)
        mu = np.log(mean) - sigma**2 / 2
        draws.append(np.stack([np.random.default_rng([seed, state["trigger"], r]).lognormal(mu, sigma, (n, k)) for r in range(reps)], axis=2))
    proc = np.stack(draws, axis=2)
    release = np.stack([s["release"] for s in states], axis=1)
    # what was seen of the unit d places before the trigger: its departure and start at each station
    seen = lambda j, d, i: np.array([s["wip"][j].get(s["trigger"] - d, (-np.inf, -np.inf))[i] for s in states])[:, None]
    start, depart = np.zeros(proc.shape), np.zeros(proc.shape)
    for u in range(n):
        ready = np.repeat(release[u][:, None], reps, axis=1)
        for j in range(k):
            start[u, j] = np.maximum(ready, depart[u - 1, j] if u else seen(j, 1, 0))
            leave = start[u, j] + proc[u, j]
            if j + 1 < k:
                leave = np.maximum(leave, start[u - capacity, j + 1] if u >= capacity else seen(j + 1, capacity - u, 1))
            depart[u, j] = leave
            ready = leave + transport_s
    return start, start + proc


def run_rows(trigger: int, units: np.ndarray, stations: list[int], start: np.ndarray, finish: np.ndarray) -> pd.DataFrame:
    """Rows of RUNS from arrays by unit, station and replication."""
    unit, j, rep = (a.ravel() for a in np.meshgrid(units, stations, np.arange(start.shape[2]), indexing="ij"))
    return pd.DataFrame({"trigger": trigger, "rep": rep.astype("int32"), "unit": unit, "j": j.astype("int32"), "start_s": start.ravel(), "finish_s": finish.ravel()})


def simulate(states: DataFrame, reps: int = 5, transport_s: float = 4.5, capacity: int = 1, seed: int = 1000) -> DataFrame:
    """(trigger, rep, unit, j, start_s, finish_s): the line run ahead from each trigger, `reps` times with lognormal draws.

    Draws depend on seed, trigger and replication alone.
    """

    def one(row) -> pd.DataFrame:
        stations = sorted(row.stations, key=lambda s: s["j"])
        state = {"trigger": row.trigger, "m": [s["m"] for s in stations], "sd": [s["sd"] for s in stations], "wip": [{w["unit"]: (w["depart_s"], w["start_s"]) for w in s["wip"]} for s in stations]}
        units, release = zip(*sorted((a["unit"], a["release_s"]) for a in row.ahead), strict=True)
        start, finish = line_runs([state | {"release": np.array(release)}], reps, transport_s, capacity, seed)
        return run_rows(row.trigger, np.array(units), [s["j"] for s in stations], start[:, :, 0], finish[:, :, 0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield one(row)

    return states.repartition("trigger").mapInPandas(run, RUNS)


def shares(work: DataFrame, keys: list[str], resolution_s: float = 30.0, merge_gap_s: float = 2.0) -> DataFrame:
    """(keys, j, sole, shifting, total, n): how much of the time each station is the momentary bottleneck of its window.

    work is (keys, j, start_s, finish_s). Intervals that touch within merge_gap_s are one active period; at each point of
    the window's grid the station in the longest period leads (the first station on ties), shifting where the runner-up
    has at least 0.85 of it.
    """
    by = Window.partitionBy(*keys, "j").orderBy("start_s", "finish_s")
    earlier = F.max("finish_s").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start_s") > earlier + merge_gap_s).cast("int"), F.lit(1))
    marked = work.withColumn("new", new).withColumn("p", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    periods = marked.groupBy(*keys, "j", "p").agg(F.min("start_s").alias("s"), F.max("finish_s").alias("e"))
    ends = work.groupBy(*keys).agg(F.min("start_s").alias("t0"), F.max("finish_s").alias("t1"))
    placed = periods.join(ends, keys)
    lo = F.ceil((F.col("s") - F.col("t0")) / resolution_s)
    last = F.ceil((F.col("t1") - F.col("t0")) / resolution_s) - 1
    hi = F.least(F.floor((F.col("e") - F.col("t0")) / resolution_s), last)
    covered = placed.filter(lo <= hi).select(*keys, "j", (F.col("e") - F.col("s")).alias("dur"), F.explode(F.sequence(lo, hi)).alias("t"))
    best = covered.groupBy(*keys, "t").agg(F.max_by("j", F.struct("dur", -F.col("j"))).alias("j"), F.slice(F.sort_array(F.collect_list("dur"), False), 1, 2).alias("top"))
    shifting = F.coalesce(F.try_element_at("top", F.lit(2)) >= 0.85 * F.col("top")[0], F.lit(False))
    n = F.greatest(F.ceil((F.col("t1") - F.col("t0")) / resolution_s), F.lit(1))
    led = best.groupBy(*keys, "j").agg(F.count_if(~shifting).alias("sole"), F.count_if(shifting).alias("shifting"), F.count("*").alias("total"))
    return led.join(ends.select(*keys, n.alias("n")), keys).select(*keys, "j", *((F.col(c) / F.col("n")).alias(c) for c in ("sole", "shifting", "total")), "n")


def ranked_shares(table: DataFrame, keys: list[str]) -> DataFrame:
    """Adds r, the place of a station in its window by total share; ties go to the first station."""
    return table.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total"), "j")))


def forecast(runs: DataFrame, resolution_s: float = 30.0) -> DataFrame:
    """(trigger, predicted, confidence): the station with the largest share of the votes of each replication's first three."""
    first = ranked_shares(shares(runs, ["trigger", "rep"], resolution_s), ["trigger", "rep"]).filter("r <= 3")
    votes = first.groupBy("trigger", "j").agg(F.sum("total").alias("v"))
    return votes.groupBy("trigger").agg(
        F.max_by("j", F.struct("v", -F.col("j"))).alias("predicted"), (F.max("v") / F.sum("v")).alias("confidence")
    )


def windows(visits: DataFrame, step: int, ahead: int, before: int) -> DataFrame:
    """(trigger, j, start_s, finish_s) of the units of each trigger's window [trigger - before, trigger + ahead)."""
    near = visits.withColumn("trigger", F.explode(triggers_of(F.col("unit"), step, ahead, before)))
    return near.select("trigger", "j", "start_s", (F.col("start_s") + F.col("proc_s")).alias("finish_s"))


def evaluate(predicted: DataFrame, visits: DataFrame, step: int, horizon: int, lookback: int) -> DataFrame:
    """Of each trigger: the actual bottleneck of the horizon, the forecast, and the baseline of the lookback, with the hits."""
    actual = ranked_shares(shares(windows(visits, step, horizon, 0), ["trigger"]), ["trigger"])
    top = actual.groupBy("trigger").agg(
        F.min_by("j", "r").alias("actual"), F.array_sort(F.collect_list(F.when(F.col("r") <= 2, F.col("j")))).alias("top2")
    )
    before = ranked_shares(shares(windows(visits, step, 0, lookback), ["trigger"], 60.0), ["trigger"]).filter("r = 1")
    out = predicted.join(top, "trigger").join(before.select("trigger", F.col("j").alias("present")), "trigger", "left")
    return out.select(
        "trigger", "actual", "predicted", "present", "confidence",
        (F.col("predicted") == F.col("actual")).alias("pred_correct"),
        F.coalesce(F.col("present") == F.col("actual"), F.lit(False)).alias("present_correct"),
        F.array_contains("top2", F.col("predicted")).alias("pred_in_top2"),
    )


def led(j: np.ndarray, start: np.ndarray, finish: np.ndarray, resolution_s: float = 30.0, merge_gap_s: float = 2.0) -> list[tuple[int, float]]:
    """(j, total) of `shares` of one window, as `ranked_shares` ranks them."""
    known = ~(np.isnan(start) | np.isnan(finish))
    j, start, finish = j[known], start[known], finish[known]
    if not len(j):
        return []
    t0, t1 = start.min(), finish.max()
    points = math.ceil((t1 - t0) / resolution_s)
    stations, grid = np.unique(j), np.arange(points)
    length = np.full((len(stations), points), -np.inf)
    for k, station in enumerate(stations):
        s, e = start[j == station], finish[j == station]
        order = np.lexsort((e, s))
        s, top = s[order], np.maximum.accumulate(e[order])
        first = np.flatnonzero(np.r_[True, s[1:] > top[:-1] + merge_gap_s])
        s, e = s[first], top[np.r_[first[1:] - 1, len(s) - 1]]
        lo, hi = np.ceil((s - t0) / resolution_s), np.minimum(np.floor((e - t0) / resolution_s), points - 1)
        some = lo <= hi
        if some.any():
            lo, hi, span = lo[some], hi[some], (e - s)[some]
            at = np.searchsorted(lo, grid, side="right") - 1
            length[k] = np.where((at >= 0) & (grid <= hi[at]), span[at], -np.inf)
    if not points:
        return []
    leader = length.argmax(axis=0)[length.max(axis=0) > -np.inf]
    total = np.bincount(leader, minlength=len(stations)) / max(points, 1)
    return sorted(((int(station), float(x)) for station, x in zip(stations, total, strict=True) if x > 0), key=lambda r: (-r[1], r[0]))


def state_of(trigger: int, rows: dict[str, np.ndarray], told: pd.DataFrame, horizon: int, begin: int, at: int, end: int, capacity: int) -> dict | None:
    """The row of `states_at` from visits sorted by unit, those of the lookback from begin up to at, the horizon up to end; None where it has none."""
    unit, j, proc = (rows[c] for c in ("unit", "j", "proc_s"))
    stations = np.unique(j[begin:end])
    first = at + np.flatnonzero(j[at:end] == 1)
    if len(first) != horizon:
        return None
    state = {"trigger": trigger, "stations": stations.tolist(), "units": unit[first], "release": told["released"].reindex([(u, 1) for u in unit[first]]).to_numpy(), "m": [], "sd": [], "wip": []}
    for station in stations:
        own = begin + np.flatnonzero(j[begin:at] == station)
        late = own[unit[own] >= trigger - capacity]
        own = own[~np.isnan(proc[own])]
        n = len(own)
        if not n:
            return None
        y = proc[own]
        m, x, drift = y.mean(), unit[own] - unit[own].mean(), 0.0
        if n >= 240 and (sxx := float(x @ x)) > 0:
            slope = float(x @ (y - m)) / sxx
            rest = float((y - m) @ (y - m)) - slope * slope * sxx
            if rest >= 0 and abs(slope) > 2 * math.sqrt(rest / max(n - 2, 1) / sxx):
                drift = slope * (n / 2 + horizon / 2)
        state["m"].append(m + drift)
        state["sd"].append(y.std(ddof=1) if n > 1 else 1.0)
        state["wip"].append({int(unit[i]): (told["departed"].get((unit[i], station), np.nan), rows["start_s"][i]) for i in late})
    return state


def voted(stations: list[int], start: np.ndarray, finish: np.ndarray, resolution_s: float) -> tuple[int, float]:
    """(predicted, confidence) of `forecast` from a trigger's runs, arrays by unit, station and replication."""
    j, votes = np.tile(stations, len(start)), dict.fromkeys(stations, 0.0)
    for r in range(start.shape[2]):
        for station, total in led(j, start[:, :, r].ravel(), finish[:, :, r].ravel(), resolution_s)[:3]:
            votes[station] += total
    best = max(votes, key=lambda s: (votes[s], -s))
    return best, votes[best] / sum(votes.values())


def rolling(
    visits: DataFrame, scans: DataFrame, step: int, lookback: int, horizon: int, row: Callable[..., pd.DataFrame], schema: str, starts: bool = False,
    reps: int = 5, transport_s: float = 4.5, capacity: int = 1, seed: int = 1000,
) -> DataFrame:
    """What `row` makes of each trigger's state, starts, finishes and visits of lookback and horizon (j, start_s, finish_s); these only if `starts`.

    visits is (unit, j, start_s, proc_s), scans (unit, j, release_s, depart_s), of which only releases and the departures just before a trigger are needed.
    """
    per = max(TRIGGERS, math.ceil(4 * (lookback + horizon) / step))
    lo = F.greatest(F.floor((F.col("unit") - horizon) / step) + 1, F.lit(1)).cast("long")
    hi = F.floor((F.col("unit") + lookback) / step).cast("long")
    tiles = F.explode(F.when(lo <= hi, F.sequence(F.floor(lo / per), F.floor(hi / per)))).alias("tile")
    last = step - F.pmod("unit", F.lit(step)) <= capacity  # seen just before a trigger; the other times would move for nothing
    near = visits.select(tiles, "unit", "j", F.when(F.lit(starts) | last, F.col("start_s")).alias("start_s"), "proc_s")
    told = scans.filter((F.col("j") == 1) | last).select(tiles, "unit", "j", "release_s", "depart_s").toDF("of", "u", "at", "released", "departed")
    names = [c.split()[0] for c in schema.split(", ")]

    def tile(key: tuple, frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.set_index(["u", "at"])
        frame = frame.sort_values(["unit", "j"])
        rows = {c: frame[c].to_numpy(dtype=None if c in ("unit", "j") else float) for c in frame.columns if c != "tile"}
        place = lambda u: int(np.searchsorted(rows["unit"], u))
        alike: dict[tuple, list] = {}
        for trigger in (k * step for k in range(max(key[0] * per, 1), (key[0] + 1) * per)):
            at = (place(trigger - lookback), place(trigger), place(trigger + horizon))
            state = state_of(trigger, rows, known, horizon, *at, capacity)
            if state:
                alike.setdefault(tuple(state["stations"]), []).append((state, at))
        out = []
        for found in alike.values():
            start, finish = line_runs([s for s, _ in found], reps, transport_s, capacity, seed)
            for i, (state, (a, b, c)) in enumerate(found):
                work = [tuple(x[cut] for x in (rows["j"], rows["start_s"], rows["start_s"] + rows["proc_s"])) for cut in (slice(a, b), slice(b, c))]
                out.append(row(state, start[:, :, i], finish[:, :, i], *work))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    return near.groupBy("tile").cogroup(told.groupBy("of")).applyInPandas(tile, schema)


def rolling_runs(visits: DataFrame, scans: DataFrame, step: int, lookback: int, horizon: int, **kw) -> DataFrame:
    """simulate() of states_at()."""
    return rolling(visits, scans, step, lookback, horizon, lambda state, start, finish, *_: run_rows(state["trigger"], state["units"], state["stations"], start, finish), RUNS, **kw)


def rolling_forecast(visits: DataFrame, scans: DataFrame, step: int, lookback: int, horizon: int, resolution_s: float = 30.0, **kw) -> DataFrame:
    """forecast() of simulate() of states_at(); the runs stay in their task."""

    def row(state: dict, start: np.ndarray, finish: np.ndarray, *_) -> pd.DataFrame:
        predicted, confidence = voted(state["stations"], start, finish, resolution_s)
        return pd.DataFrame({"trigger": [state["trigger"]], "predicted": [predicted], "confidence": [confidence]})

    return rolling(visits, scans, step, lookback, horizon, row, "trigger long, predicted int, confidence double", **kw)


def rolling_evaluation(visits: DataFrame, scans: DataFrame, step: int, lookback: int, horizon: int, **kw) -> DataFrame:
    """evaluate() of that forecast; the actual shares of horizon and lookback are those of the same rows."""

    def row(state: dict, start: np.ndarray, finish: np.ndarray, past: tuple, ahead: tuple) -> pd.DataFrame:
        predicted, confidence = voted(state["stations"], start, finish, 30.0)
        top, before = [j for j, _ in led(*ahead)], [j for j, _ in led(*past, 60.0)]
        if not top:
            return pd.DataFrame()
        found = {"trigger": state["trigger"], "actual": top[0], "predicted": predicted, "present": before[0] if before else None, "confidence": confidence}
        hits = {"pred_correct": predicted == top[0], "present_correct": bool(before) and before[0] == top[0], "pred_in_top2": predicted in top[:2]}
        return pd.DataFrame([found | hits])

    schema = "trigger long, actual int, predicted int, present int, confidence double, pred_correct boolean, present_correct boolean, pred_in_top2 boolean"
    return rolling(visits, scans, step, lookback, horizon, row, schema, starts=True, **kw)
