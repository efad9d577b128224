"""Ranking metrics from tie tables, so that no task holds the whole order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.functions.ranks import ROWS_PER_SLOT, average_ranks, cumulated


def by_score(risk: DataFrame, score: str, y: str, by: list[str]) -> DataFrame:
    """(by, score, tp, n): the positives and rows of each score."""
    return risk.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("tp"), F.count("*").alias("n"))


def roc_auc(risk: DataFrame, score: str = "score", y: str = "y", rows_per_slot: int = ROWS_PER_SLOT, by: list[str] | None = None) -> DataFrame:
    """(by, n, auc): the chance that a positive outscores a negative, ties half; null if one class is missing."""
    by = by or []
    table = cumulated(by_score(risk, score, y, by), "score", ["tp", "n"], rows_per_slot, by)
    below = F.col("n_before") - F.col("tp_before")  # negatives with a smaller score
    won = F.col("tp") * (below + (F.col("n") - F.col("tp")) / 2)
    total = table.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("tp").alias("p"), F.sum(won).alias("won"))
    return total.select(*by, "n", (F.col("won") / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))).alias("auc"))


def average_precision(risk: DataFrame, score: str = "score", y: str = "y", rows_per_slot: int = ROWS_PER_SLOT, by: list[str] | None = None) -> DataFrame:
    """(by, ap): the precision at each score, weighted by the recall that it adds; null without positives."""
    by = by or []
    down = by_score(risk, score, y, by).withColumn("down", -F.col("score"))
    table = cumulated(down, "down", ["tp", "n"], rows_per_slot, by)
    precision = (F.col("tp_before") + F.col("tp")) / (F.col("n_before") + F.col("n"))
    return table.groupBy(*by).agg((F.sum(precision * F.col("tp")) / F.nullif(F.sum("tp"), F.lit(0))).alias("ap"))


def spearman(df: DataFrame, a: str, b: str, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """(n, rho): the correlation of the average ranks of two columns.

    The two columns are computed once, before the query: rows meet their ranks by value, and a mean of doubles that is computed again
    may differ in its last bit, as its parts come in any order. A lost executor ends the query instead of changing the values.
    """
    pairs = df.select(a, b).localCheckpoint()
    ranked = average_ranks(average_ranks(pairs, a, "ra", rows_per_slot), b, "rb", rows_per_slot)
    return ranked.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))
