"""Registered queries without SQL: the rolling-horizon forecast over the derived feed. Tests hold them against loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.operators import feed, forecast, kernels
from taktwerk.plans.charts import rounded
from taktwerk.sources import plant

STEP, LOOKBACK, HORIZON = 480, 480, 480


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states with proc_s. They carry what the fits need and no more, so Spark moves them once for both."""
    states = feed.reconstruct(plant.scans(spark, sf_dir), before="before_s")
    return forecast.impute_processing(states, kernels.censored_cycle_times(states))


def visits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(unit, j, start_s, proc_s), which the triggers' windows are cut from, and the scans (unit, j, release_s, depart_s)."""
    scans = plant.scans(spark, sf_dir).select("unit", "j", "release_s", F.col("true_s").alias("depart_s"))
    return imputed(spark, sf_dir).select("unit", "j", "start_s", "proc_s"), scans


QUERIES = {
    "q_impute_fitted": lambda s, d: rounded(imputed(s, d).select("unit", "j", "proc_s")),
    "q_horizon_sim": lambda s, d: rounded(forecast.rolling_runs(*visits(s, d), STEP, LOOKBACK, HORIZON)),
    "q_forecast": lambda s, d: rounded(forecast.rolling_forecast(*visits(s, d), STEP, LOOKBACK, HORIZON)),
    "q_forecast_eval": lambda s, d: rounded(forecast.rolling_evaluation(*visits(s, d), STEP, LOOKBACK, HORIZON)),
}
