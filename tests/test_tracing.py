"""Tracing and risk operators on small inputs, with slots of a few rows, ties, nulls and empty tables."""

import re

import numpy as np
import pytest

from taktwerk.operators import risk, tracing
from taktwerk.plans import evaluation, traces

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("times", [1, 5000])  # few rows are all ordered, many only in brackets
def test_quantile_edges_equal_numpy(spark, times):
    x = [5.0, 1.0, 1.0, 9.5, 2.0, 7.0, 7.0, 30.0, 4.0, 6.0, 8.0] * times
    df = spark.createDataFrame([(v,) for v in [*x, None]], "t double")
    got = {r.k: r.edge for r in tracing.quantile_edges(df, "t", 6).collect()}
    assert [got[k] for k in range(7)] == pytest.approx(np.quantile(x, np.arange(7) / 6))
    assert tracing.quantile_edges(df.filter("t < 0"), "t", 6).count() == 0


def test_exposures(spark):
    scored = spark.createDataFrame([(1, "S1", "torque", 2.1), (2, "S1", "torque", -2.1), (3, "S1", "humidity", 3.0), (4, "S1", "torque", 2.0), (5, "S1", "x", None)], "unit long, sid string, signal string, z double")
    got = {tuple(r) for r in tracing.signal_exposures(scored).collect()}
    assert got == {("STATION_SIGNAL", "S1:torque_high", 1), ("STATION_SIGNAL", "S1:torque_low", 2), ("ENVIRONMENT", "S1:humidity_high", 3)}
    assert {r.unit for r in tracing.dwell_exposures(scored).collect()} == {1, 3}
    edges = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 20.0)], "k int, edge double")
    visits = spark.createDataFrame([(1, "S1", -0.1), (2, "S1", 0.0), (3, "S1", 10.0), (4, "S1", 19.9), (5, "S1", 20.0), (6, "S1", None)], "unit long, sid string, start_s double")
    assert {(r.label, r.unit) for r in tracing.window_exposures(visits, edges).collect()} == {("S1:window_0", 2), ("S1:window_1", 3), ("S1:window_1", 4)}
    units = spark.createDataFrame([(1, "L1", None), (2, None, "A")], "unit long, lot string, shift string")
    assert {tuple(r) for r in tracing.unit_exposures(units, {"LOT": "lot", "SHIFT": "shift"}).collect()} == {("LOT", "L1", 1), ("SHIFT", "A", 2)}


def test_conformal_levels_take_the_higher_neighbour_and_guard_small_classes(spark):
    s = [i / 100 for i in range(30)]
    rows = [(0, v) for v in s] + [(1, 0.5)] * 19
    got = {r.y: (r.n, r.q) for r in risk.conformal_levels(spark.createDataFrame(rows, "y int, score double"), rows_per_slot=7).collect()}
    level = min(1, np.ceil(31 * 0.9) / 30)
    assert got == {0: (30, pytest.approx(np.quantile(s, level, method="higher"))), 1: (19, 1.0)}


def test_models_by_type_are_fitted_only_with_positives_enough(spark):
    rows = [("a", "train" if i % 4 else "calib", int(i % 10 > 6), float(i % 10)) for i in range(400)] + [("b", "train", 1, 0.0)] * 5
    df = spark.createDataFrame(rows, "type string, part string, y int, x double")
    models = risk.fit_per_type(df, ["x"])
    assert models["a"] is not None and models["b"] is None
    scores = {r.x: r.score for r in risk.with_risk(df.filter("type = 'a'").select("x").distinct(), models["a"], ["x"]).collect()}
    assert min(scores[7.0], scores[9.0]) > 0.8 > 0.2 > max(scores[0.0], scores[6.0])
    assert risk.with_risk(df, models["b"], ["x"]).filter("score > 0").count() == 0


def test_units_meet_their_findings_before_they_are_spread_over_types(spark):
    """Repeats, null types and units without findings; no row for each unit and type is shuffled."""
    units = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "unit long, part string")
    findings = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, None), (9, 7)], "unit long, type int")
    types = spark.createDataFrame([(7,), (8,), (None,)], "type int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = risk.typed_labels(units, findings, types)
        assert not re.search(r"hashpartitioning\(unit#\d+L?, type#", plan(out))
        got = {(r.unit, r.type, r.part): r.y for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(u, t, p): int((u, t) in {(1, 7), (1, 8)}) for u, p in ((1, "x"), (2, "y"), (3, None)) for t in (7, 8, None)}


def test_seeded_signals_come_from_a_units_own_row(spark):
    for df in (evaluation.scored(spark, SF), traces.defects(spark, SF), traces.feature_rows(spark, SF)):
        assert "Exchange" not in plan(df)
    wide = {r.unit: (r.v1, r.v3, r.v5, r.v7) for r in traces.feature_rows(spark, SF).collect()}
    tall = {(r.unit, r.j): r.v for r in traces.torque(spark, SF).collect()}
    assert len(tall) == 4 * len(wide) and all(wide[u] == tuple(tall[u, j] for j in traces.SENSORS) for u in wide)


def test_exposures_of_asked_units_are_those_of_all(spark):
    """The bands and edges stay those of all units; what is kept of the visits doesn't grow with the units that aren't asked."""
    asked = spark.createDataFrame([(7,), (481,), (481,), (1499,), (-1,)], "unit long")
    some = traces.exposures(spark, SF, asked)
    every = traces.exposures(spark, SF).filter("unit IN (7, 481, 1499)")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect())) and some.count() > 20
