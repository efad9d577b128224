"""Sweeps of missed reads and clocks against the window operators, case by case, with stations that a unit skipped."""

import re

import pytest
from pyspark.sql import functions as F

from taktwerk.operators import feed, sweeps

STATIONS = [1, 2, 3, 4]


def scans(spark):
    rows = spark.range(900).select(F.col("id").alias("unit"), F.explode(F.array(*map(F.lit, STATIONS))).alias("j"))
    true = F.col("unit") * 30.0 + F.col("j") * 50 + (F.col("unit") * 7919 + F.col("j") * 331) % 97 / 8.0
    rows = rows.select("unit", "j", (F.col("unit") * 30.0).alias("release_s"), true.alias("true_s"))
    return rows.filter("NOT (j = 2 AND unit % 11 = 5)")


def missed(j):
    return (F.col("unit") * 37 + j * 53) % 100 < F.col("param")


def expected(clean, faulty, param, repaired):
    """The errors of one value, by a window a step and a join with the clean states."""
    rows = clean.withColumn("param", F.lit(float(param))).withColumn("x", faulty)
    if repaired:
        dup = feed.repair_duplicates(rows)
        rows = feed.interpolate(feed.repair_late(dup, feed.late_floors(dup))).withColumn("x", F.col("x_fill"))
    states, true = feed.reconstruct(rows, "x"), feed.reconstruct(clean, keep=("true_s",))
    both = states.alias("s").join(true.alias("t"), ["unit", "j"])
    depart = F.col("s.start_s") + F.col("s.dwell_s")
    gap = lambda c: F.avg(F.abs(F.col(f"s.{c}") - F.col(f"t.{c}")))
    return both.agg(F.count(depart), F.avg(F.abs(depart - F.col("t.true_s"))), gap("start_s"), gap("dwell_s"), F.avg((F.col("s.blocked") == F.col("t.blocked")).cast("double"))).first()


@pytest.mark.parametrize("rows_per_slot", [2_000_000, 700])
def test_sweeps_give_what_the_window_operators_give(spark, rows_per_slot):
    clean = scans(spark)
    found = {r.param: r[1:] for r in sweeps.sweep_read_rate(clean, [0, 30], missed, STATIONS, rows_per_slot).collect()}
    assert set(found) == {0.0, 30.0}
    for p, got in found.items():
        at = F.coalesce(*(F.when((F.col("j") == j) & ~missed(j), F.col("true_s")) for j in STATIONS))
        assert got == pytest.approx(tuple(expected(clean, at, p, True)), abs=1e-9)
    found = {r.param: r[1:] for r in sweeps.sweep_clock_sync(clean, [0.5, 8], lambda j: F.lit(j % 3 - 1.0), STATIONS, rows_per_slot).collect()}
    for p, got in found.items():
        assert got == pytest.approx(tuple(expected(clean, F.col("true_s") + p * (F.col("j") % 3 - 1.0), p, False)), abs=1e-9)


def test_a_sweep_moves_visits_twice(spark):
    out = sweeps.sweep_clock_sync(scans(spark), [0.5, 8], lambda j: F.lit(j % 3 - 1.0), STATIONS)
    moves = re.findall(r"Exchange hashpartitioning\((\w+)#", out._jdf.queryExecution().executedPlan().toString())
    assert sorted(moves) == ["j", "unit"]  # by station, and what is put together; the units of a range lie together as they are


def test_no_scans_give_no_errors(spark):
    assert sweeps.sweep_read_rate(scans(spark).limit(0), [0, 30], missed, STATIONS).collect() == []


def test_series_of_a_line_move_their_rows_once(spark):
    from taktwerk.operators import spc

    rows = spark.range(600).select(F.col("id").alias("unit"), F.explode(F.array(F.lit("S1"), F.lit("S2"))).alias("sid"))
    rows = rows.withColumn("v", (F.col("unit") * 7919 % 101).cast("double"))
    signals = rows.filter("sid = 'S1'").select("unit", "sid", F.lit("cycle_time_s").alias("signal"), "v")
    known = spark.createDataFrame([("S1",)], "sid string")
    one, many = (spc.line_series(signals, rows, known, 10, rows_per_slot=n) for n in (2_000_000, 100))
    assert "SortMergeJoin" not in many._jdf.queryExecution().executedPlan().toString()  # the counts of slots come to the rows
    assert {r.signal for r in one.collect()} == {"cycle_time_s", "stoppage_rate", "soft_dwell_s", "soft_stoppage_rate"}
    assert sorted(one.collect()) == sorted(many.collect()) and one.count() == 240


def test_a_sweep_in_slots_moves_a_row_a_unit_and_case(spark):
    """Not one a visit and case, twice; only what lies in several slots meets by unit and station."""
    out = sweeps.sweep_clock_sync(scans(spark), [0.5, 8], lambda j: F.lit(j % 3 - 1.0), STATIONS, 700)
    moves = re.findall(r"Exchange hashpartitioning\((\w+)#", out._jdf.queryExecution().executedPlan().toString())
    assert sorted(moves) == ["at", "part"]
    rows = sweeps.cases(scans(spark), [0.5, 8], lambda j: F.col("true_s") + F.col("param") * (j % 3 - 1.0), STATIONS)
    slots = sweeps.slots_of(scans(spark), "true_s", 700)
    served = sweeps.served_in_slots(rows, STATIONS, 3, slots).groupBy(F.col("part").isNull().alias("split")).count().collect()
    assert {r.split: r["count"] for r in served}[True] < 0.2 * 3 * scans(spark).count()


def test_units_without_reads_and_far_from_their_slot(spark):
    """Missing scans come first in the order, as in the windows; units whose clock is off by many slots meet their clean ones."""
    clean, values = scans(spark), [0, 90]
    gone = lambda j: (F.col("unit") % 5 == 2) & (F.col("param") > 0) if j < 4 else missed(j)
    one, many = (sweeps.sweep_read_rate(clean, values, gone, STATIONS, n).orderBy("param").collect() for n in (2_000_000, 500))
    assert len(one) == 2 and one[1].n < one[0].n
    for a, b in zip(one, many, strict=True):
        assert tuple(b) == pytest.approx(tuple(a), abs=1e-9)
    far = lambda j: F.lit(j - 2.0) * (F.col("unit") % 3)
    one, many = (sweeps.sweep_clock_sync(clean, [0.5, 4000], far, STATIONS, n).orderBy("param").collect() for n in (2_000_000, 500))
    for a, b in zip(one, many, strict=True):
        assert tuple(b) == pytest.approx(tuple(a), abs=1e-9)
