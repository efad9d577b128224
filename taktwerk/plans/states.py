"""Registered queries on station states, evidence and conformal levels, by the operators; their oracles are the texts of `tables`.

States come from `feed.reconstruct`, which orders a station's visits in slots, and medians, places and levels from slots
too, so no station or class must fit a task. The oracles have one window for each station instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.functions.ranks import lagged, positions, quantiles
from taktwerk.operators import feed, risk
from taktwerk.plans import tables
from taktwerk.plans.charts import rounded
from taktwerk.sources import plant

CUT = 1.5  # seconds within which a unit counts as blocked
OF_VIEW = "WITH state AS (SELECT * FROM feed_states)"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.reconstruct(plant.scans(spark, sf_dir), keep=("true_s", "proc_s"), before="before_s")


def on_states(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The text of `tables` over reconstructed states instead of its own."""
    text = tables.TEXTS[name]
    assert f"WITH {tables.STATES}" in text

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        states(spark, sf_dir).createOrReplaceTempView("feed_states")
        return plant.sql(spark, sf_dir, tables.spark_text(text.replace(f"WITH {tables.STATES}", OF_VIEW)))

    return call


def q_starved_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = lagged(states(spark, sf_dir), ["j"], ["unit"], {"left_s": "true_s"})
    starved = F.when(F.col("left_s").isNotNull(), F.greatest(F.col("start_s") - F.col("left_s"), F.lit(0.0)))
    return rounded(after.filter("unit > 0").select("unit", "j", F.coalesce(starved, F.lit(0.0)).alias("starved_s")))


def q_impute_proc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = F.when(F.col("dwell_s") - F.col("theta_s") < CUT, F.least("dwell_s", "theta_s")).otherwise(F.col("dwell_s"))
    return rounded(states(spark, sf_dir).select("unit", "j", F.greatest(bound, F.lit(0.1)).alias("proc_s")))


def q_proc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = positions(plant.scans(spark, sf_dir), ["j"], ["true_s", "unit"], "place")
    return placed.select("unit", "j", (F.col("place") + 1).alias("place"))


def q_top_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest deviations of every unit from its stations' medians, in median absolute deviations."""
    signal = plant.sql(spark, sf_dir, f"WITH {tables.SIGNAL} SELECT unit, j, v FROM signal")
    middle = lambda df, x: quantiles(df, ["j"], x, [0.5]).select("j", F.col("value").alias("__m"))
    off = signal.join(middle(signal, "v"), "j").select("unit", "j", F.abs(F.col("v") - F.col("__m")).alias("d"))
    score = off.join(middle(off, "d"), "j").select("unit", "j", (F.col("d") / (F.col("__m") + 1e-9)).alias("e"))
    best = score.withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("e"), "j")))
    return rounded(best.filter("r <= 3").select("unit", "j", "e", "r"))


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(unit, score, y) and the levels of its even units."""
    rows = plant.sql(spark, sf_dir, f"WITH {tables.RISK} SELECT unit, score, y FROM risk")
    return rows, risk.conformal_levels(rows.filter("unit % 2 = 0"))


def q_conformal_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir)[1].select("y", "n", "q"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, levels = scored(spark, sf_dir)
    level = levels.agg(F.max(F.when(F.col("y") == 1, F.col("q"))).alias("q1"), F.max(F.when(F.col("y") == 0, F.col("q"))).alias("q0"))
    out = rows.filter("unit % 2 = 1").crossJoin(F.broadcast(level))  # one row
    out = out.withColumn("in1", 1 - F.col("score") <= F.col("q1")).withColumn("in0", F.col("score") <= F.col("q0"))
    decision = F.when(F.col("in1") & F.col("in0"), "abstain").when(F.col("in0"), "pass").otherwise("flag")
    return out.select("unit", "score", "y", "in1", "in0", decision.alias("decision"))


def q_conformal_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decided(spark, sf_dir).drop("y"))


def q_conformal_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda hit, of=F.lit(True): F.avg(F.when(of, hit.cast("double")))
    return rounded(
        decided(spark, sf_dir).agg(
            F.count("*").alias("n"),
            share(F.col("in1"), F.col("y") == 1).alias("coverage1"),
            share(F.col("in0"), F.col("y") == 0).alias("coverage0"),
            share(F.col("decision") == "flag").alias("flag_rate"),
            share(F.col("decision") == "abstain").alias("abstain_rate"),
        )
    )


ON_STATES = (
    "q_arrivals", "q_soft_sensor_direct", "q_score_soft", "q_exposed_units", "q_unit_thread", "q_suspect_population",
    "q_drift_slope", "q_drift_slope_triggers", "q_context_feats",
)
QUERIES = {name: on_states(name) for name in ON_STATES} | {
    "q_starved_naive": q_starved_naive,
    "q_impute_proc": q_impute_proc,
    "q_proc_order": q_proc_order,
    "q_top_evidence": q_top_evidence,
    "q_conformal_q": q_conformal_q,
    "q_conformal_decision": q_conformal_decision,
    "q_conformal_eval": q_conformal_eval,
}
