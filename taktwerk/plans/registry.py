"""Every registered query with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taktwerk.plans import charts, decisions, evaluation, forecasts, layouts, monitor, states, tabled, tables, traces, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**charts.QUERIES, **tables.QUERIES, **forecasts.QUERIES, **layouts.QUERIES, **decisions.QUERIES, **traces.QUERIES, **states.QUERIES, **tabled.QUERIES, **twin.QUERIES, **evaluation.QUERIES, **monitor.QUERIES}
ORACLES: dict[str, str] = {**charts.ORACLES, **tables.ORACLES, **layouts.ORACLES, **decisions.ORACLES, **traces.ORACLES, **twin.ORACLES, **evaluation.ORACLES, **monitor.ORACLES, **tabled.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CUSUM charts in blocks of ten, of which the smallest data folder has enough for a baseline."""
    return charts.rounded(charts.charts(spark, sf_dir, "cusum", 10))
