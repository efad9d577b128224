"""What leaves the library: the alert ledger and the results as JSON, the envelope check, and the times of the stages."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """The rows with NaN and infinite numbers as nulls, which JSON has no other word for; within arrays, structs and map values, too."""

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _, v: clean(v, t.valueType))
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in t.fields)))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def write_ledger(alerts: DataFrame, path: str) -> None:
    """The ledger as JSON, a line an alert, nulls written; evidence may be a map of any keys."""
    plain(alerts).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A ledger that write_ledger wrote, with the types that it had."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """Each result as JSON in a folder of its name, nulls written; a result of any size stays on the executors."""
    for name, df in results.items():
        write_ledger(df, f"{path}/{name}")


def metric_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n, mean, sd, lo, hi) over the runs' rows that have a value; sd is the population's."""
    long = runs.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("r")).select("r.*")
    long = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def envelope(summary: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """(metric, mean, lo, hi, ok): whether the mean of each metric lies in its limits; a metric without runs fails."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for m, (a, b) in limits.items()))
    wanted = summary.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")
    out = wanted.join(summary.select("metric", "mean"), "metric", "left")
    return out.select("metric", "mean", "lo", "hi", F.coalesce(F.col("mean").between(F.col("lo"), F.col("hi")), F.lit(False)).alias("ok"))


@dataclass
class Stages:
    """Wall milliseconds of named stages, and the rows that passed a table while it was written or counted."""

    millis: dict[str, float] = field(default_factory=dict)
    seen: dict[str, Observation] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.millis[name] = self.millis.get(name, 0.0) + (time.perf_counter() - start) * 1000

    def counted(self, name: str, df: DataFrame) -> DataFrame:
        """df, whose rows are counted when an action runs over it: no job of its own."""
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("rows"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, wall_ms, rows) of the stages so far; rows is null where nothing was counted."""
        rows = [(n, ms, self.seen[n].get["rows"] if n in self.seen else None) for n, ms in self.millis.items()]
        return spark.createDataFrame(rows, "stage string, wall_ms double, rows long")
