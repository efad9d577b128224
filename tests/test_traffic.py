"""Counts of what passes a line, against a small line written out."""

from pyspark.sql import functions as F

from taktwerk.operators import thread, traffic
from taktwerk.sources import lines


def counted(spark, rows):
    days = traffic.daily(spark.createDataFrame(rows, "line string, station_idx int, day int"))
    return days, traffic.loads(days, lines.stations(spark, "beta"))


def test_nulls_strangers_and_repeats(spark):
    rows = [("beta", 2, 0), ("beta", 2, 0), ("beta", 2, 5), ("beta", 4, 1), ("beta", 1, 1), (None, 2, 0), ("beta", None, 0), ("beta", 2, None), ("gamma", 2, 0), ("beta", 99, 0)]
    _, loaded = counted(spark, rows)
    got = {r.sid: (r.n_visits, r.n_days) for r in loaded.collect()}
    assert len(got) == 28 and {k: v for k, v in got.items() if v != (0, 0)} == {"B01": (1, 1), "B02": (3, 2), "B04": (1, 1)}
    line = traffic.seen_share(loaded).first()
    assert (line.n_stations, line.n_visits, line.n_seen, line.seen_share) == (28, 5, 1, 0.2)
    dark = traffic.busiest_dark(loaded, 3).orderBy("place").collect()
    assert [(r.sid, r.n_visits) for r in dark] == [("B02", 3), ("B04", 1), ("B05", 0)]  # ties go to the earlier station
    gates = {r.defect_type: (r.gate, r.cutoff, r.n_gated, r.n_before) for r in traffic.gate_loads(loaded).collect()}
    assert gates["WELD_POROSITY"] == ("B10", 9, 0, 5) and gates["FIT_MISALIGN"] == ("B28", 27, 0, 5)


def test_a_line_without_visits(spark):
    days, loaded = counted(spark, [])
    line = traffic.seen_share(loaded).first()
    assert (line.n_visits, line.n_seen, line.seen_share) == (0, 0, None)
    reach = traffic.fault_reach(days, lines.stations(spark, "beta"), lines.faults(spark, "beta")).collect()
    assert reach and {(r.n_visits, r.n_days) for r in reach} == {(0, 0)}


def test_faults_reach_their_own_days_only(spark):
    days, _ = counted(spark, [("beta", 17, d) for d in (7, 8, 8, 20, 21)] + [("beta", 14, 4), ("beta", 3, 12)])
    got = {(r.fault_id, r.sid): (r.n_visits, r.n_days) for r in traffic.fault_reach(days, lines.stations(spark, "beta"), lines.faults(spark, "beta")).collect()}
    assert got["F1", "B17"] == (3, 2) and got["F2", "B14"] == (0, 0) and got["F5", "B03"] == (1, 1)
    assert {sid for fault, sid in got if fault == "F3"} == {"B12", "B15", "B20", "B24"}


def test_edges_of_empty_tables_and_null_ends(spark):
    units = spark.createDataFrame([(1, 3, None), (2, None, None)], "unit long, lot long, shift long")
    visits = spark.createDataFrame([], "unit long, sid string, operator string, n_signals int")
    found = spark.createDataFrame([(1, "G1", None)], "unit long, gate string, defect_type string")
    got = {(r.src, r.relation): r.n_edges for r in thread.edge_counts(units, visits, lines.stations(spark, "alpha"), found).collect()}
    assert len(got) == 11 and got["Unit", "IN_LOT"] == 1 and got["Unit", "IN_SHIFT"] == 0 and got["Visit", "MEASURED"] == 0
    assert got["Station", "IN_ZONE"] == 42 and got["Finding", "AT_GATE"] == 1 and got["Finding", "OF_DEFECT"] == 0


def test_visits_are_counted_before_they_are_shuffled(spark):
    plan = traffic.daily(spark.range(100).select(F.lit("beta").alias("line"), (F.col("id") % 28).cast("int").alias("station_idx"), F.lit(1).alias("day")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "partial_count" in text
