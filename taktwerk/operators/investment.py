"""Choice of stations to equip with sensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan_within_budget(ranked: DataFrame, budget: int, rank: list[Column], most: int = 5) -> DataFrame:
    """(place, sid, cost): greedy by `rank`, then sid, passing over what no longer fits, `most` items at most.

    The next choice is the first item behind the last one that the rest of the budget can pay: one aggregate for each choice, whatever the
    number of items, so no task orders them all.
    """
    key = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(rank)), F.col("sid").cast("string").alias("sid"))
    items = ranked.select(key.alias("key"), F.col("sid").cast("string").alias("sid"), F.col("cost").cast("long").alias("cost"))
    picks: list[DataFrame] = []
    for place in range(most):
        open_items = items.filter(F.col("cost") <= budget)
        if picks:
            last = picks[-1].select(F.col("key").alias("__key"), F.col("spent").alias("__spent"))  # one row at most
            open_items = items.crossJoin(F.broadcast(last)).filter((F.col("key") > F.col("__key")) & (F.col("__spent") + F.col("cost") <= budget))
        spent = F.col("cost") + (F.col("__spent") if picks else F.lit(0))
        first = open_items.groupBy().agg(F.min(F.struct("key", "sid", "cost", spent.alias("spent"))).alias("pick")).filter("pick IS NOT NULL")
        picks.append(first.select(F.lit(place).alias("place"), "pick.*"))
    out = picks[0]
    for pick in picks[1:]:
        out = out.union(pick)
    return out.select("place", "sid", "cost")


def information_value(stations: DataFrame, takt_s: float | None = None) -> DataFrame:
    """Adds uncertainty, exposure, ambiguity, evi and evi_per_lakh to stations (ci, mean, confidence, share, slack_s, hits, expected, cost).

    Uncertainty is 40 ci / mean and what confidence lacks, exposure the station's share of the bottleneck and its slack over takt in fives of
    a second (slack_s, or mean less takt_s), each from 0 to 1 as half of a sum up to 2; ambiguity the hits among root causes in fives
    and what is expected. evi weighs them 0.4, 0.4 and 0.2; a lakh is 100,000 of cost.
    """
    bound = lambda x, hi: F.least(F.greatest(x, F.lit(0.0)), F.lit(hi))
    slack = F.col("slack_s") if takt_s is None else F.col("mean") - takt_s
    uncertainty = bound(40 * F.col("ci") / F.col("mean") + (1 - F.col("confidence")), 2.0) / 2
    exposure = bound(F.col("share") + F.least(F.greatest(slack, F.lit(0.0)) / 5, F.lit(1.0)), 2.0) / 2
    out = stations.withColumns({"uncertainty": uncertainty, "exposure": exposure, "ambiguity": bound(F.col("hits") / 5 + F.col("expected"), 1.0)})
    out = out.withColumn("evi", 0.4 * F.col("uncertainty") + 0.4 * F.col("exposure") + 0.2 * F.col("ambiguity"))
    return out.withColumn("evi_per_lakh", F.col("evi") / (F.col("cost") / 100_000))


def rationale(uncertainty: Column, exposure: Column, limit: float = 0.3) -> Column:
    """Why a station is worth a sensor, in words."""
    said = F.when(uncertainty > limit, "wide interval").otherwise("narrow interval")
    return F.concat_ws("; ", said, F.when(exposure > limit, "limits the line"))


def top_overlap(ranked: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """(n, overlap, top1): of two orders of the same items (sid, a, b; larger is better), how many of the first k they share, and whether the first is one.

    Each first k is a top-k report of its own; ties go by sid. Fewer than four items give no row.
    """
    first = lambda c: F.slice(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("v"), "sid"))), 1, k)["sid"]
    best = {c: ranked.orderBy(F.desc(c), "sid").limit(k) for c in (a, b)}
    rows = best[a].groupBy().agg(first(a).alias("x")).crossJoin(best[b].groupBy().agg(first(b).alias("y"))).crossJoin(ranked.groupBy().agg(F.count("*").alias("n")))
    return rows.filter("n >= 4").select("n", F.size(F.array_intersect("x", "y")).alias("overlap"), (F.col("x")[0] == F.col("y")[0]).alias("top1"))
