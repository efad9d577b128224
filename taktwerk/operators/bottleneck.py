"""Momentary bottlenecks: active periods, who leads at each point of a grid, shares, timeline and regimes.

Series of any length: running maxima and sums go over slots of the order (`ranks`), never over a whole station in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions.ranks import ROWS_PER_SLOT, lagged, running_max, running_sum, slots_of

SHIFTING = 0.85


def active_periods(
    work: DataFrame, by: list[str], order: list[str], start: str, finish: str, gap: float, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """(by, p, s, e): intervals that follow each other within `gap` are one period; p counts them from 1 in each key.

    order starts with `start` and ends with what makes it unique. A new period begins where an interval starts beyond the latest end
    so far by more than the gap.
    """
    slots = [slots_of(work, order[0], rows_per_slot)]
    rows = running_max(work, by, order, {"__top": finish}, rows_per_slot, slots)
    new = F.coalesce((F.col(start) > F.col("__top") + gap).cast("long"), F.lit(1).cast("long"))
    rows = running_sum(rows.withColumn("__new", new), by, order, "__new", "p", rows_per_slot, slots)
    return rows.groupBy(*by, "p").agg(F.min(start).alias("s"), F.max(finish).alias("e"))


def covered(periods: DataFrame, station: str, step: Column | int | float) -> DataFrame:
    """(station, dur, t): the points t * step of a grid that lie in a period, with its length; an equi-join takes the place of a range join."""
    lo, hi = F.ceil(F.col("s") / step).cast("long"), F.floor(F.col("e") / step).cast("long")
    return periods.filter(lo <= hi).select(station, (F.col("e") - F.col("s")).alias("dur"), F.explode(F.sequence(lo, hi)).alias("t"))


def leaders(cover: DataFrame, station: str) -> DataFrame:
    """(t, station, shifting): at each point the station in the longest period, of equal ones the first; shifting if another has 0.85 of it."""
    place = F.struct((-F.col("dur")).alias("d"), station)
    top = F.slice(F.sort_array(F.collect_list(place)), 1, 2)  # a row for each station at most
    best = cover.groupBy("t").agg(top.alias("top"))
    second = F.coalesce(-F.get("top", F.lit(1))["d"], F.lit(0))
    return best.select("t", F.col("top")[0][station].alias(station), (second >= SHIFTING * -F.col("top")[0]["d"]).alias("shifting"))


def shares(best: DataFrame, station: str, n_points: DataFrame) -> DataFrame:
    """(station, sole_share, shifting_share, total_share) of all points of the grid; n_points is one row (n)."""
    led = best.groupBy(station).agg(F.count_if(~F.col("shifting")).alias("a"), F.count_if("shifting").alias("b"), F.count("*").alias("c"))
    names = {"sole_share": "a", "shifting_share": "b", "total_share": "c"}
    return led.crossJoin(F.broadcast(n_points)).select(station, *((F.col(c) / F.col("n")).alias(name) for name, c in names.items()))


def timeline(best: DataFrame, station: str, points: int, top: int = 4) -> DataFrame:
    """(blk, r, station, n): the stations that lead most in each block of so many points, the first `top`."""
    per = best.groupBy(F.floor(F.col("t") / points).alias("blk"), station).agg(F.count("*").alias("n"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("blk").orderBy(F.desc("n"), station)))
    return ranked.filter(F.col("r") <= top).select("blk", "r", station, "n")


def regime_starts(calls: DataFrame, order: str, station: str, k: int = 3, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """(station, first): the first of k calls in a row, by `order`, that name the station; stations without such a run have no row."""
    rows, slots = calls.select(order, station), [slots_of(calls, order, rows_per_slot)]
    for d in range(1, k):
        rows = lagged(rows, [], [order], {f"__s{d}": station} | ({"__first": order} if d == k - 1 else {}), d, rows_per_slot, slots)
    held = rows.filter(" AND ".join(f"{station} = __s{d}" for d in range(1, k))) if k > 1 else rows.withColumn("__first", F.col(order))
    return held.groupBy(station).agg(F.min("__first").alias("first"))


def regime_lead(calls: DataFrame, order: str, predicted: str, present: str, per_hour: float, k: int = 3, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """(station, predicted_first, present_first, lead_h): by how many hours the forecast named a lasting bottleneck before it was the present one.

    per_hour: units of the order in an hour. A regime that only one of the two ever names has no lead.
    """
    a, b = (regime_starts(calls.withColumn("station", F.col(c)), order, "station", k, rows_per_slot).withColumnRenamed("first", f"{n}_first") for n, c in (("predicted", predicted), ("present", present)))
    lead = (F.col("present_first") - F.col("predicted_first")) / per_hour
    return a.join(b, "station", "full").select("station", "predicted_first", "present_first", lead.alias("lead_h"))
