"""What passes over lines that are data: visits are counted once by station and day, and the few rows of a line meet these counts.

A visit is (line, station_idx, day); rows with a null in any of them belong to no station and count nowhere. Stations are those of
`sources.lines`, at most some hundreds of rows, so the join with them and the windows over a line are small at any number of visits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.sources import lines

PLACE = ["line", "station_idx"]


def daily(visits: DataFrame) -> DataFrame:
    """(line, station_idx, day, n_visits): the only pass over the visits; counted before they are shuffled."""
    return visits.dropna(subset=[*PLACE, "day"]).groupBy(*PLACE, "day").agg(F.count("*").alias("n_visits"))


def loads(days: DataFrame, stations: DataFrame) -> DataFrame:
    """The stations with n_visits and n_days, the days with a visit; both 0 at a station that nothing passed."""
    each = days.groupBy(*PLACE).agg(F.sum("n_visits").alias("n_visits"), F.count("*").alias("n_days"))
    return stations.join(each, PLACE, "left").fillna(0, ["n_visits", "n_days"])


def seen_share(loaded: DataFrame) -> DataFrame:
    """What `lines.coverage` says of each line, and n_visits, n_seen (at stations with sensors) and seen_share (null without visits)."""
    seen = F.when(F.col("instrumented"), F.col("n_visits")).otherwise(0)
    passed = loaded.groupBy("line").agg(F.sum("n_visits").alias("n_visits"), F.sum(seen).alias("n_seen"))
    return lines.coverage(loaded).join(passed.withColumn("seen_share", F.try_divide("n_seen", "n_visits")), "line")


def busiest_dark(loaded: DataFrame, k: int) -> DataFrame:
    """(line, sid, n_visits, place): the k stations without sensors that most visits pass, a line; ties go to the earlier station."""
    order = Window.partitionBy("line").orderBy(F.col("n_visits").desc(), "station_idx")
    return loaded.filter("NOT instrumented").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("line", "sid", "n_visits", "place")


def fault_reach(days: DataFrame, stations: DataFrame, faults: DataFrame) -> DataFrame:
    """(line, fault_id, sid, n_visits, n_days): every station that a fault moves, with what passed it from its first day up to its last.

    A station that nothing passed on those days stays, with zeros.
    """
    touched = lines.affected(stations, faults).join(faults.select("fault_id", "start_day", "end_day"), "fault_id").join(stations.select("line", "sid", "station_idx"), ["line", "sid"])
    met = touched.join(days, PLACE, "left").withColumn("in", F.col("day").between(F.col("start_day"), F.col("end_day")))
    return met.groupBy("line", "fault_id", "sid").agg(F.coalesce(F.sum(F.when(F.col("in"), F.col("n_visits"))), F.lit(0)).alias("n_visits"), F.count_if("in").alias("n_days"))


def gate_loads(loaded: DataFrame) -> DataFrame:
    """`lines.gate_map` with n_gated, the visits at the gate, and n_before, those at all stations before it."""
    before = Window.partitionBy("line").orderBy("station_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = loaded.select("line", F.col("sid").alias("gate"), F.col("n_visits").alias("n_gated"), F.coalesce(F.sum("n_visits").over(before), F.lit(0)).alias("n_before"))
    return lines.gate_map(loaded).join(at, ["line", "gate"])
