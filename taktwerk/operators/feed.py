"""Repair of a scan feed and reconstruction of station states; every operator is a window over (unit, j).

Columns named as `keys` part feeds that share a table, such as those of a sweep.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions.ranks import ROWS_PER_SLOT, Slots, haloed, quantiles, rows_before, slots_of


def by_unit(keys: tuple[str, ...] = ()):
    return Window.partitionBy(*keys, "unit").orderBy("j")


def so_far(keys: tuple[str, ...] = ()):
    return by_unit(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def repair_duplicates(scans: DataFrame, transport_s: float = 4.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds x_dup: no scan precedes the one before it by less than the transport time, within a run without gaps.

    x'_j = C_j + max(x_k - C_k) over the run so far, with C_j the transport up to station j: one window, no loop.
    """
    c = F.col("j") * F.lit(transport_s)
    runs = scans.withColumn("__run", F.sum(F.col("x").isNull().cast("int")).over(so_far(keys)))
    w = Window.partitionBy(*keys, "unit", "__run").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.withColumn("x_dup", F.when(F.col("x").isNotNull(), c + F.max(F.col("x") - c).over(w))).drop("__run")


def late_floors(scans: DataFrame, x: str = "x_dup", least: int = 200, keys: tuple[str, ...] = ()) -> DataFrame:
    """(j, floor_s): the 0.5 % quantile of the gap to the station before, where there are `least` gaps."""
    gaps = scans.select(*keys, "j", (F.col(x) - F.lag(x).over(by_unit(keys))).alias("gap"))
    return quantiles(gaps, [*keys, "j"], "gap", [0.005]).filter(F.col("n") >= least).select(*keys, "j", F.col("value").alias("floor_s"))


def repair_late(scans: DataFrame, floors: DataFrame, x: str = "x_dup", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds x_late: a scan after which the next station follows too soon moves back to the floor before that one."""
    own = scans.join(F.broadcast(floors), [*keys, "j"], "left")  # a row for each station
    gap = F.lead(x).over(by_unit(keys)) - F.col(x)
    floor = F.lead("floor_s").over(by_unit(keys))
    return own.withColumn("x_late", F.when(gap < floor, F.lead(x).over(by_unit(keys)) - floor).otherwise(F.col(x))).drop("floor_s")


def interpolate(scans: DataFrame, x: str = "x_late", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds x_fill: linear between the reads around a gap, constant at the edges; null with fewer than two reads."""
    after = by_unit(keys).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(*keys, "unit")
    at = F.when(F.col(x).isNotNull(), F.col("j"))
    out = scans.withColumn("__n", F.count(x).over(every))
    for name, value, w, pick in (
        ("j0", at, so_far(keys), F.last), ("x0", F.col(x), so_far(keys), F.last), ("j1", at, after, F.first), ("x1", F.col(x), after, F.first)
    ):
        out = out.withColumn(f"__{name}", pick(value, ignorenulls=True).over(w))
    lerp = F.col("__x0") + (F.col("__x1") - F.col("__x0")) * (F.col("j") - F.col("__j0")) / F.nullif(F.col("__j1") - F.col("__j0"), F.lit(0))
    fill = F.coalesce(F.col(x), lerp, "__x0", "__x1")
    return out.withColumn("x_fill", F.when(F.col("__n") >= 2, fill)).drop("__n", "__j0", "__x0", "__j1", "__x1")


def fill_rest(scans: DataFrame, x: str = "x_fill") -> DataFrame:
    """Adds x_full: what interpolation left open gets the median of its station's scans, or its unit's release where there are none."""
    medians = quantiles(scans, ["j"], x, [0.5]).select("j", F.col("value").alias("__median"))  # a row for each station
    return scans.join(F.broadcast(medians), "j", "left").withColumn("x_full", F.coalesce(x, "__median", "release_s")).drop("__median")


def clock_drift(scans: DataFrame, x: str = "x", share: float = 0.01, least: int = 100, limit_s: float = 3.0) -> DataFrame:
    """(j, drift_s, drifted): by how much the smallest gaps to the station before grew from the first half of the units to the second.

    Stations with fewer than `least` gaps in a half have no row. Drift is reported, not corrected.
    """
    half = scans.agg((F.max("unit") / 2).alias("half"))  # one row, part of the query
    gaps = scans.select("j", "unit", (F.col(x) - F.lag(x).over(by_unit())).alias("gap")).crossJoin(F.broadcast(half))
    low = quantiles(gaps.withColumn("late", F.col("unit") >= F.col("half")), ["j", "late"], "gap", [share]).filter(F.col("n") >= least)
    drift = F.sum(F.when(F.col("late"), F.col("value")).otherwise(-F.col("value")))
    both = low.groupBy("j").agg(drift.alias("drift_s"), F.count("*").alias("halves")).filter("halves = 2").drop("halves")
    return both.withColumn("drifted", F.abs("drift_s") > limit_s)


def station_quality(scans: DataFrame, drift: DataFrame, x: str = "x") -> DataFrame:
    """(j, missing_rate, drift_s, drifted, quality): the share of real reads counts six times over, halved under clock drift."""
    missing = scans.groupBy("j").agg(F.avg(F.col(x).isNull().cast("double")).alias("missing_rate"))
    out = missing.join(drift, "j", "left").withColumn("drift_s", F.coalesce("drift_s", F.lit(0.0))).withColumn("drifted", F.coalesce("drifted", F.lit(False)))
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 6 * F.col("missing_rate"))) * F.when(F.col("drifted"), 0.5).otherwise(1.0)
    return out.withColumn("quality", quality)


def adjust_confidence(estimates: DataFrame, quality: DataFrame, key: str = "sid") -> DataFrame:
    """Adds confidence times the quality of the station's feed, 1 where it has none, and keeps the former as raw; quality is (key, quality)."""
    known = quality.select(F.col(key).alias("__k"), "quality")
    out = estimates.withColumn("raw", F.col("confidence")).join(F.broadcast(known), F.col(key) == F.col("__k"), "left")  # a row a station
    return out.withColumn("confidence", F.col("raw") * F.coalesce("quality", F.lit(1.0))).drop("__k", "quality")


def repair_report(repaired: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: n_missing, n_duplicates, n_late and n_drifted found, overall_quality (the mean of the stations) and notes on each.

    repaired has x, x_dup and x_late; a scan counts as repaired if a step moved it.
    """
    moved = lambda a, b: F.coalesce(F.sum((F.abs(F.col(a) - F.col(b)) > 1e-9).cast("long")), F.lit(0))
    counts = repaired.agg(
        F.coalesce(F.sum(F.col("x").isNull().cast("long")), F.lit(0)).alias("n_missing"),
        moved("x", "x_dup").alias("n_duplicates"),
        moved("x_dup", "x_late").alias("n_late"),
    )
    overall = quality.agg(F.coalesce(F.sum(F.col("drifted").cast("long")), F.lit(0)).alias("n_drifted"), F.avg("quality").alias("overall_quality"))
    said = {
        "n_missing": "%d missing reads filled in; confidence is lower there",
        "n_duplicates": "%d repeated or inverted reads moved",
        "n_late": "%d late reads moved back",
        "n_drifted": "%d readers with clock drift, not corrected",
    }
    notes = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.format_string(text, c)) for c, text in said.items())))
    return counts.crossJoin(overall).withColumn("notes", F.array_join(notes, "; "))


def score_repair(report: DataFrame, injected: DataFrame) -> DataFrame:
    """One row: what was injected (n_missed, n_duplicate, n_late) beside what the report found, and the detection rate of missed reads."""
    both = report.crossJoin(injected)
    return both.select(
        F.col("n_missed").alias("missed_injected"),
        F.col("n_missing").alias("missed_detected"),
        F.round(F.col("n_missing") / F.greatest("n_missed", F.lit(1)), 4).alias("missed_detection_rate"),
        F.col("n_duplicate").alias("duplicates_injected"),
        F.col("n_duplicates").alias("duplicates_corrected"),
        report["n_late"].alias("late_corrected"),
        injected["n_late"].alias("late_injected"),
        F.col("n_drifted").alias("drift_readers_flagged"),
    )


def reconstruct(
    visits: DataFrame, x: str = "true_s", transport_s: float = 4.5, capacity: int = 1, eps_s: float = 1.5,
    rows_per_slot: int = ROWS_PER_SLOT, keep: tuple[str, ...] = (), stations: list[dict] | None = None, reentry: DataFrame | None = None,
    rework_station: int | None = None, keys: tuple[str, ...] = (), before: str | None = None, slots: list[Slots | None] | None = None,
) -> DataFrame:
    """unit, j, arrive_s, start_s, dwell_s, starved_s, theta_s, blocked from release_s and the scans x, and the columns of `keep`.

    A station serves units in the order of their scans. With p machines it is free once the unit p places earlier has left.
    A unit is blocked if it leaves within eps_s of the moment at which the unit `capacity` places earlier, in the next station's own
    order, starts there; without such a unit it is not. A station's visits are ordered in slots, so one station may hold
    more than a task.

    stations: the line's stations as dicts of j, transport_s (to the next), parallel (machines) and buffer (places before the next
    station, the capacity to it beside its further machines); without them every station has one machine, transport_s and capacity.
    before: the column with the unit's scan at the station before (j - 1), where the feed carries it; else a window finds it.
    slots: what slots_of gave for this order, or a like one, in a list of one, if the caller has it.
    reentry: (unit, reentry_s) of units that came back from rework behind station rework_station; they arrive at the next no sooner.
    """
    last = max((s["j"] for s in stations or []), default=None)
    out = served(visits, x, transport_s, capacity, rows_per_slot, keep, stations, reentry, rework_station, keys, before, slots)
    out = out.withColumn("starved_s", F.coalesce(F.greatest(F.col("start_s") - F.col("prev_s"), F.lit(0.0)), F.lit(0.0)))
    out = out.withColumn("dwell_s", F.col(x) - F.col("start_s"))
    gate = F.lead("earlier_s").over(by_unit(keys))
    out = out.withColumn("theta_s", gate - F.col("start_s") if last is None else F.when(F.col("j") < last, gate - F.col("start_s")))
    blocked = F.coalesce(F.col("dwell_s") - F.col("theta_s") < eps_s, F.lit(False))
    return out.select(*keys, "unit", "j", "arrive_s", "start_s", "dwell_s", "starved_s", "theta_s", blocked.alias("blocked"), *keep)


def served(
    visits: DataFrame, x: str = "true_s", transport_s: float = 4.5, capacity: int = 1, rows_per_slot: int = ROWS_PER_SLOT, keep: tuple[str, ...] = (),
    stations: list[dict] | None = None, reentry: DataFrame | None = None, rework_station: int | None = None, keys: tuple[str, ...] = (),
    before: str | None = None, slots: list[Slots | None] | None = None,
) -> DataFrame:
    """What reconstruct knows before a unit's stations meet: unit, j, x, arrive_s, start_s, prev_s (when the station was free) and earlier_s, the start that
    gates the unit at the station before, and the columns of `keep`. Takes what reconstruct does."""
    order = [x, "unit"]
    slots = [cut and replace(cut, order=x) for cut in slots or [slots_of(visits, x, rows_per_slot)]]
    dims = {s["j"]: s for s in stations or []}

    def of(value, default: float, ahead: int = 0):
        pairs = [(j + ahead, value(s)) for j, s in dims.items()]
        return F.coalesce(*(F.when(F.col("j") == j, F.lit(v)) for j, v in pairs if v is not None), F.lit(None)) if pairs else F.lit(default)

    machines = {j: max(s.get("parallel", 1), 1) for j, s in dims.items()}
    # the capacity from j - 1 to j, which is looked back over in the order of j
    into = {j: dims[j - 1].get("buffer", capacity) + machines[j] - 1 for j in dims if j - 1 in dims}
    hop = lambda s: float(s.get("transport_s", transport_s))
    came = F.lag(x).over(by_unit(keys)) + F.lag(of(hop, transport_s)).over(by_unit(keys)) if before is None else F.col(before) + of(hop, transport_s, 1)
    used = dict.fromkeys((*keys, "unit", "j", x, *keep))
    out = visits.withColumn("arrive_s", F.coalesce(came, F.col("release_s"))).select(*used, "arrive_s")
    if reentry is not None and rework_station is not None:
        back = reentry.select(F.col("unit").alias("__u"), F.col("reentry_s").alias("__back")).filter("__back IS NOT NULL")
        out = out.join(back, (out["unit"] == back["__u"]) & (out["j"] == rework_station + 1), "left")
        out = out.withColumn("arrive_s", F.greatest("arrive_s", "__back")).drop("__u", "__back")
    if dims:
        out = out.withColumn("__p", of(lambda s: machines[s["j"]], 1)).withColumn("__cap", of(lambda s: into.get(s["j"]), capacity))
        near, far = ("__p", sorted(set(machines.values()))), ("__cap", sorted(set(into.values())))
    else:
        near, far = (1, [1]), (capacity, [capacity])
    out, w = haloed(out, [*keys, "j"], order, near[1][-1] + max(far[1], default=0), rows_per_slot, slots)
    if keys:  # feeds that share a visit move side by side, and what they have in common compresses
        out = out.repartition("j", *(["__at"] if "__at" in out.columns else []))
    out = out.withColumn("prev_s", rows_before(x, *near, w)).withColumn("start_s", F.greatest("arrive_s", "prev_s"))
    out = out.withColumn("earlier_s", rows_before("start_s", *far, w).cast("double")).filter("__own")
    return out.drop("__own", "__at", "__p", "__cap")
