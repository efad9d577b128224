"""Control charts: count blocks, robust baselines, EWMA and CUSUM in closed form, and the persistence rule."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions.ranks import ROWS_PER_SLOT, positions

LAM, EWMA_L, K, H = 0.22, 5.5, 0.5, 9.35
BASELINE, PERSISTENCE = 10, 2


def blocks(rows: DataFrame, series: str, order: list[str], value: str, size: int) -> DataFrame:
    """(series, blk, m): means of consecutive blocks of `size` rows by `order`; the partial last block is left out."""
    named = rows.select(F.col(series).alias("series"), *order, F.col(value).alias("v"))
    placed = positions(named, ["series"], order, "rn")
    blk = F.floor(F.col("rn") / size).cast("long")
    return placed.groupBy("series", blk.alias("blk")).agg(F.avg("v").alias("m"), F.count("*").alias("n")).filter(F.col("n") == size).drop("n")


def baseline(means: DataFrame, first: int = BASELINE) -> DataFrame:
    """(series, mu, sd): the median of the first block means, and sigma from their median moving range."""
    w = Window.partitionBy("series").orderBy("blk")
    moved = means.withColumn("mr", F.abs(F.col("m") - F.lag("m").over(w)))
    base = F.col("blk") < first
    return (
        moved.groupBy("series")
        .agg(
            F.median(F.when(base, F.col("m"))).alias("mu"),
            F.greatest(F.median(F.when(base, F.col("mr"))) / 0.954, F.lit(1e-9)).alias("sd"),
            F.count("*").alias("n_blocks"),
        )
        .filter(F.col("n_blocks") >= first + 3)
        .drop("n_blocks")
    )


def ewma(means: DataFrame, base: DataFrame, lam: float = LAM, limit: float = EWMA_L, first: int = BASELINE) -> DataFrame:
    """(series, blk, stat, lim, flag): z_t - mu as a weighted sum of a series' block means, so no row waits for the last.

    The frame ends where a weight falls below 1e-18, which a double can't hold beside the rest.
    """
    reach = math.ceil(math.log(1e-18) / math.log(1 - lam))
    w = Window.partitionBy("series").orderBy("blk").rowsBetween(-reach, Window.currentRow)
    t = F.col("blk") + 1
    history = F.collect_list(F.col("m") - F.col("mu")).over(w)
    stat = F.aggregate(history, F.lit(0.0), lambda acc, x: F.lit(1 - lam) * acc + F.lit(lam) * x)
    lim = F.lit(limit) * F.col("sd") * F.sqrt(F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(1 - lam), 2 * t)))
    out = means.join(base, "series").withColumn("stat", stat).withColumn("lim", lim)
    flag = (F.abs("stat") > F.col("lim")) & (F.col("blk") >= first)
    return out.select("series", "blk", "stat", "lim", flag.alias("flag"))


def cusum(means: DataFrame, base: DataFrame, k: float = K, h: float = H, first: int = BASELINE) -> DataFrame:
    """(series, blk, hi, lo, stat, onset, flag): each arm is a running sum less its running minimum."""
    w = Window.partitionBy("series").orderBy("blk")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z = (F.col("m") - F.col("mu")) / F.greatest("sd", F.lit(1e-9))
    out = means.join(base, "series").withColumn("z", z)
    out = out.withColumn("s_hi", F.sum(F.col("z") - k).over(run)).withColumn("s_lo", F.sum(-F.col("z") - k).over(run))
    for arm in ("hi", "lo"):
        low = F.least(F.lit(0.0), F.min(f"s_{arm}").over(run))
        out = out.withColumn(f"low_{arm}", low).withColumn(arm, F.col(f"s_{arm}") - F.col(f"low_{arm}"))
        reset = F.max(F.when(F.col(f"s_{arm}") <= F.col(f"low_{arm}"), F.col("blk"))).over(run)
        out = out.withColumn(f"start_{arm}", F.coalesce(reset, F.lit(0)))
    return out.select(
        "series",
        "blk",
        "hi",
        "lo",
        F.greatest("hi", "lo").alias("stat"),
        F.when(F.col("hi") >= F.col("lo"), F.col("start_hi")).otherwise(F.col("start_lo")).cast("long").alias("onset"),
        ((F.greatest("hi", "lo") > h) & (F.col("blk") >= first)).alias("flag"),
    )


def first_signal(chart: DataFrame, k: int = PERSISTENCE) -> DataFrame:
    """(series, first_blk, n_signals): the first of k flags in a row (-1 if there is none) and the number of flags."""
    w = Window.partitionBy("series").orderBy("blk").rowsBetween(-(k - 1), Window.currentRow)
    held = chart.withColumn("held", F.sum(F.col("flag").cast("int")).over(w) == k)
    return held.groupBy("series").agg(
        F.coalesce(F.min(F.when(F.col("held"), F.col("blk") - (k - 1))), F.lit(-1)).alias("first_blk"),
        F.sum(F.col("flag").cast("long")).alias("n_signals")
    )


def score_against_faults(charts: DataFrame, faults: DataFrame, early: float = 0.5) -> DataFrame:
    """One row a fault of (fault_id, target, start_day): the first chart that fires at its target from start_day - early on.

    charts has (station, chart, signal, first_day, onset_day); the onset is that of the first CUSUM chart with one, else that
    of the chart that fired first. Ties go by chart, then signal. Faults without a detection stay, with nulls. Charts are few
    for each station, so the faults are the broadcast side only if Spark finds them small.
    """
    at = (F.col("station") == F.col("target")) & (F.col("first_day") >= F.col("start_day") - early)
    hits = faults.join(charts.filter(F.col("first_day").isNotNull()), at, "left")
    place = F.struct("first_day", "chart", "signal")
    onset = F.when((F.col("chart") == "CUSUM") & F.col("onset_day").isNotNull(), place)
    found = hits.groupBy("fault_id", "target", "start_day").agg(
        F.min(F.when(F.col("station").isNotNull(), F.struct("first_day", "chart", "signal", "onset_day"))).alias("b"),
        F.min_by("onset_day", onset).alias("cusum_onset"),
    )
    onset_day = F.coalesce("cusum_onset", "b.onset_day")
    return found.select(
        "fault_id", "target", "start_day", F.col("b").isNotNull().alias("detected"), F.col("b.chart").alias("chart"), F.col("b.signal").alias("signal"),
        F.col("b.first_day").alias("detect_day"), F.round(F.col("b.first_day") - F.col("start_day"), 2).alias("lag_days"),
        onset_day.alias("onset_day"), F.round(onset_day - F.col("start_day"), 2).alias("onset_error_days"),
    )


def line_series(
    signals: DataFrame, dwells: DataFrame, instrumented: DataFrame, size: int, first: int = BASELINE, sigmas: float = 4.0, rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """(station, signal, instrumented, blk, m): the block means of every series that a line can be charted on.

    signals is (unit, sid, signal, v) of stations with sensors, dwells (unit, sid, v) of all, instrumented (sid) the stations with sensors.
    Those have their signals and a stoppage rate, of their cycle_time_s or else their dwell; the others the soft dwell and its
    stoppage rate. A stoppage is a time beyond the mean and `sigmas` deviations of the first `first` blocks. Blocks are of `size` units in
    their order, a partial last one is left out.
    """
    known = instrumented.select(F.col("sid").alias("__sid")).distinct()
    seen = dwells.join(F.broadcast(known), F.col("sid") == F.col("__sid"), "left").withColumn("inst", F.col("__sid").isNotNull()).drop("__sid")  # a row a station
    timed = signals.filter("signal = 'cycle_time_s'").select(F.col("sid").alias("__sid")).distinct()
    rest = seen.filter("inst").join(F.broadcast(timed), F.col("sid") == F.col("__sid"), "left_anti").select("unit", "sid", F.lit("stoppage_rate").alias("signal"), "inst", "v")
    dark = seen.filter("NOT inst").select("unit", "sid", F.lit("soft_dwell_s").alias("signal"), "inst", "v")
    rows = signals.select("unit", "sid", "signal", F.lit(True).alias("inst"), "v").unionByName(rest).unionByName(dark)
    # a stoppage rate has the rows of the time it is of, so it joins them once they are placed
    also = F.when(F.col("inst") & (F.col("signal") == "cycle_time_s"), "stoppage_rate").when(~F.col("inst"), "soft_stoppage_rate")
    placed = positions(rows, ["sid", "signal"], ["unit"], "rn", rows_per_slot, few_keys=True)
    placed = placed.withColumn("signal", F.explode(F.array_compact(F.array("signal", also))))
    early = F.when(F.col("rn") < first * size, F.col("v"))
    # a row a series; with inst, as then both readings of `placed` share what was moved
    bars = placed.groupBy("sid", "signal", "inst").agg((F.avg(early) + sigmas * F.stddev_pop(early)).alias("bar"))
    value = F.when(F.col("signal").endswith("stoppage_rate"), (F.col("v") > F.col("bar")).cast("double")).otherwise(F.col("v"))
    blocked = placed.join(F.broadcast(bars), ["sid", "signal", "inst"]).groupBy("sid", "signal", "inst", F.floor(F.col("rn") / size).alias("blk"))
    means = blocked.agg(F.avg(value).alias("m"), F.count("*").alias("n")).filter(F.col("n") == size)
    return means.select(F.col("sid").alias("station"), "signal", F.col("inst").alias("instrumented"), "blk", "m")


def line_charts(series: DataFrame, ewma_l: float = EWMA_L, h: float = H) -> DataFrame:
    """Both charts of every series of line_series, a row a block: station, signal, instrumented, chart, blk, stat, lim, onset, flag, mu, sd.

    The series are read several times; the caller persists them, which are a row a block, where computing them is dear.
    """
    means = series.withColumn("series", F.concat_ws("|", "station", "signal")).select("series", "blk", "m")
    base = baseline(means)
    parts = [
        ewma(means, base, limit=ewma_l).select("series", F.lit("EWMA").alias("chart"), "blk", "stat", "lim", F.lit(None).cast("long").alias("onset"), "flag"),
        cusum(means, base, h=h).select("series", F.lit("CUSUM").alias("chart"), "blk", "stat", F.lit(h).alias("lim"), "onset", "flag"),
    ]
    names = series.select(F.concat_ws("|", "station", "signal").alias("series"), "station", "signal", "instrumented").distinct()
    return parts[0].union(parts[1]).join(base, "series").join(names, "series").drop("series")


def scan(charts: DataFrame, blocks_per_day: float, k: int = PERSISTENCE) -> DataFrame:
    """A row a chart of line_charts: station, signal, instrumented, chart, mu, sd, first_blk, first_day, onset_day, n_signals, peak, lim.

    The first signal is the first of k flags in a row; the onset that of a CUSUM chart then; both in days, null without a signal.
    """
    keys = ["station", "signal", "instrumented", "chart", "mu", "sd"]
    w = Window.partitionBy(*keys).orderBy("blk")  # of blocks
    ahead = F.sum(F.col("flag").cast("int")).over(w.rowsBetween(Window.currentRow, k - 1)) == k
    begun = charts.withColumn("begins", F.coalesce(ahead, F.lit(False)))
    out = begun.groupBy(*keys).agg(
        F.min(F.when(F.col("begins"), F.col("blk"))).alias("first_blk"),
        F.min_by("onset", F.when(F.col("begins"), F.col("blk"))).alias("onset"),
        F.sum(F.col("flag").cast("long")).alias("n_signals"),
        F.max(F.abs("stat")).alias("peak"),
        F.max_by("lim", "blk").alias("lim"),
    )
    first = F.col("first_blk")
    return out.select(
        *keys, F.coalesce(first, F.lit(-1)).cast("long").alias("first_blk"), F.round(first / blocks_per_day, 2).alias("first_day"),
        F.when(first.isNotNull(), F.round(F.col("onset") / blocks_per_day, 2)).alias("onset_day"), "n_signals", "peak", "lim",
    )


def false_alarm_rate(found: DataFrame, affected: DataFrame) -> DataFrame:
    """(chart, n_charts, n_firing, rate) of the charts of stations that no fault touches, by chart and over all (`ALL`).

    found is scan()'s, affected (sid), a row a touched station.
    """
    clean = found.join(affected.select(F.col("sid").alias("station")).distinct(), "station", "left_anti")
    fires = clean.withColumn("fires", (F.col("first_blk") >= 0).cast("long")).withColumn("chart", F.explode(F.array("chart", F.lit("ALL"))))
    return fires.groupBy("chart").agg(F.count("*").alias("n_charts"), F.sum("fires").alias("n_firing"), F.avg("fires").alias("rate"))


def sweep(charts: DataFrame, limits: tuple[float, ...] = (3.0, 3.5, 4.1, 4.6, 5.2), ratio: float = 1.7, k: int = PERSISTENCE, first: int = BASELINE) -> DataFrame:
    """(ewma_l, cusum_h, station, chart, signal, first_blk, n_signals) for each operating point (L, h = ratio * L).

    The statistics of line_charts don't depend on the limits, so they are computed once and held against every point.
    """
    points = charts.withColumn("ewma_l", F.explode(F.array(*map(F.lit, limits)))).withColumn("cusum_h", F.round(F.col("ewma_l") * ratio, 6))
    over = F.when(F.col("chart") == "EWMA", F.abs("stat") > F.col("lim") / EWMA_L * F.col("ewma_l")).otherwise(F.col("stat") > F.col("cusum_h"))
    rows = points.withColumn("flag", over & (F.col("blk") >= first))
    keys = ["ewma_l", "cusum_h", "station", "signal", "chart"]
    held = F.sum(F.col("flag").cast("int")).over(Window.partitionBy(*keys).orderBy("blk").rowsBetween(-(k - 1), Window.currentRow)) == k
    out = rows.withColumn("held", held).groupBy(*keys)
    return out.agg(F.coalesce(F.min(F.when(F.col("held"), F.col("blk") - (k - 1))), F.lit(-1)).cast("long").alias("first_blk"), F.sum(F.col("flag").cast("long")).alias("n_signals"))
