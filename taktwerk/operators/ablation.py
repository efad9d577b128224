"""What a sensor would be worth: the risk model with and without its signals, fitted in parallel, and the value for its cost."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from taktwerk.functions import metrics
from taktwerk.operators import risk

GAIN = "candidate string, ap double, base_ap double, delta_ap double"


def gains(rows: DataFrame, base: list[str], candidates: dict[str, list[str]], fit: dict | None = None, parallel: int = 4) -> DataFrame:
    """(candidate, ap, base_ap, delta_ap): by how much the average precision on part `test` grows with a candidate's features.

    rows is (part, y, features); the models are fitted on part `train`, each with the base features and those of one candidate. A
    candidate is one fit, and `parallel` of them are jobs at a time; what comes to the driver is one number a fit.
    """
    rows = rows.select("part", "y", *dict.fromkeys([*base, *(f for own in candidates.values() for f in own)])).persist()

    def precision(features: list[str]) -> float | None:
        model = risk.fit_risk(rows.filter("part = 'train'"), features, **(fit or {}))
        return metrics.average_precision(risk.with_risk(rows.filter("part = 'test'"), model, features)).first()["ap"]

    try:
        with ThreadPoolExecutor(parallel) as pool:
            first = pool.submit(precision, base)
            found = {name: pool.submit(precision, [*base, *own]) for name, own in candidates.items()}
            least = first.result()
            out = [Row(name, ap.result(), least, None if least is None else ap.result() - least) for name, ap in found.items()]
    finally:
        rows.unpersist()
    return rows.sparkSession.createDataFrame(out, GAIN)


def retrofit_values(gain: DataFrame, stations: DataFrame) -> DataFrame:
    """(candidate, delta_ap, value, value_per_lakh, r) of gains() and (candidate, share, ci, hits, cost).

    Half of the value is the gain as a share of the base's precision, 0.35 the station's share of the bottleneck weighed by the width of its interval
    (2 s count in full), 0.15 its hits among root causes (five count in full). Candidates are a line's stations, so they are ranked at once.
    """
    rows = gain.join(stations, "candidate")
    base = F.greatest(F.coalesce("base_ap", F.lit(0.0)), F.lit(1e-9))
    value = 0.5 * F.greatest(F.coalesce("delta_ap", F.lit(0.0)), F.lit(0.0)) / base
    value = value + 0.35 * F.col("share") * F.least(F.col("ci") / 2, F.lit(1.0)) + 0.15 * F.least(F.col("hits") / 5, F.lit(1.0))
    rows = rows.withColumn("value", value).withColumn("value_per_lakh", F.col("value") / (F.col("cost") / 100_000))
    order = F.struct((-F.col("value_per_lakh")).alias("v"), "candidate")
    ranked = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "candidate", "delta_ap", "value", "value_per_lakh"))).alias("all"))
    return ranked.select(F.posexplode("all").alias("p", "c")).select("c.candidate", "c.delta_ap", "c.value", "c.value_per_lakh", (F.col("p") + 1).alias("r"))
