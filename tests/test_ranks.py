"""Positions, lags and metrics cut into slots against plain Python, and the chart, cause and budget operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from taktwerk.functions import metrics, ranks
from taktwerk.operators import causes, feed, investment, spc
from taktwerk.sources import plant


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    return [(random.choice("ab"), random.choice([None, *range(40)]), i) for i in range(300)]


@pytest.mark.parametrize("per_slot", [20, 10**6])
def test_positions_and_lags_equal_a_sort(spark, rows, per_slot):
    df = spark.createDataFrame(rows, "k string, t int, id long")
    got = {r.id: r.pos for r in ranks.positions(df, ["k"], ["t", "id"], "pos", per_slot).collect()}
    late = {r.id: r.before for r in ranks.lagged(df, ["k"], ["t", "id"], {"before": "id"}, 2, per_slot).collect()}
    assert len(got) == len(late) == len(rows)
    for k in "ab":
        order = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for place, r in enumerate(order):
            assert got[r[2]] == place
            assert late[r[2]] == (order[place - 2][2] if place >= 2 else None)


@pytest.mark.parametrize("per_slot", [7, 10**6])
def test_metrics_equal_their_definitions(spark, per_slot):
    random.seed(9)
    data = [(random.randrange(30) / 30, random.randrange(2)) for _ in range(120)]
    df = spark.createDataFrame(data, "score double, y int")
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(metrics.roc_auc(df, rows_per_slot=per_slot).first().auc, auc)
    ap = sum(sum(y for s, y in data if s == t) / len(pos) * sum(y for s, y in data if s >= t) / sum(s >= t for s, _ in data) for t in {s for s, _ in data})
    assert math.isclose(metrics.average_precision(df, rows_per_slot=per_slot).first().ap, ap)
    rank = ranks.average_ranks(df, "score", "r", per_slot).collect()
    assert all(math.isclose(r.r, sum(s < r.score for s, _ in data) + (sum(s == r.score for s, _ in data) + 1) / 2) for r in rank)


def test_metrics_of_one_class_and_of_no_rows(spark):
    df = spark.createDataFrame([(0.5, 1)], "score double, y int")
    assert metrics.roc_auc(df).first().auc is None
    assert metrics.average_precision(df.limit(0)).first().ap is None


@pytest.mark.parametrize("per_slot", [50, 10**6])
def test_spearman_keeps_rows_whose_values_change_when_computed_again(spark, per_slot):
    noisy = F.udf(lambda i: i + random.random() / 4, "double").asNondeterministic()
    df = spark.range(200).select(noisy("id").alias("a"), (-F.col("id")).cast("double").alias("b"))
    got = metrics.spearman(df, "a", "b", per_slot).first()
    assert got.n == 200 and math.isclose(got.rho, -1)


def test_states_do_not_depend_on_the_slots(spark):
    scans = plant.scans(spark, "/root/testdata/sf0.001").filter("unit < 200")
    whole, cut = (feed.reconstruct(scans, capacity=2, rows_per_slot=n).orderBy("unit", "j").collect() for n in (10**6, 100))
    assert whole == cut and len(whole) == 1400


def test_zone_family_merges_and_a_lone_hypothesis_stays(spark):
    row = lambda kind, label, zone, lift: (kind, label, zone, 100, 10, 0.1, 0.05, lift, 0.01, 0.02, 0.5)
    rows = [row("STATION_SIGNAL", f"S{i}:t_high", "BODY", 2.0 + i / 10) for i in range(3)]
    rows += [row("STATION_SIGNAL", "S9:t_high", "PAINT", 2.0), row("LOT", "LOT-1", None, 3.0)]
    rows += [row("STATION_WINDOW", f"S{i}:w1", "", 2.0 if i else 40.0) for i in range(6)]
    schema = "kind string, label string, zone string, ne long, a long, rate_exposed double, rate_unexposed double, lift double, p double, q double, confidence double"
    hyps = spark.createDataFrame(rows, schema)
    got = {(r.kind, r.label): r for r in causes.consolidate(hyps).collect()}
    assert got["ZONE_STATION_SIGNAL", "BODY:t_high"].n_stations == 3
    assert math.isclose(got["ZONE_STATION_SIGNAL", "BODY:t_high"].confidence, 0.56)
    assert ("STATION_SIGNAL", "S9:t_high") in got and ("LOT", "LOT-1") in got
    assert sum(k == "STATION_WINDOW" for k, _ in got) == 6 and len(got) == 9
    mem = {(r.hypothesis, r.label) for r in causes.members(causes.consolidate(hyps), hyps).collect()}
    assert {label for h, label in mem if h == "BODY:t_high"} == {"S0:t_high", "S1:t_high", "S2:t_high"}


def test_containment_counts_a_unit_once(spark):
    member = spark.createDataFrame([("H", "K", "a"), ("H", "K", "b")], "hypothesis string, kind string, label string")
    exposed = spark.createDataFrame([("K", "a", 1), ("K", "b", 1), ("K", "b", 2), ("K", "a", 3)], "kind string, label string, unit long")
    spans = spark.createDataFrame([(1, 0.0, 50.0), (2, 0.0, 5.0), (3, 30.0, 60.0)], "unit long, started_s double, gone_s double")
    r = causes.containment(member, exposed, spans, F.lit(10.0)).first()
    assert (r.n_exposed, r.n_in_line, r.n_shipped, r.n_not_started, r.units_in_line) == (3, 1, 1, 1, [1])


def test_budget_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("a", 60, 9.0), ("b", 50, 8.0), ("c", 40, 7.0), ("d", 1, 6.0)], "sid string, cost long, v double")
    assert [(r.sid, r.cost) for r in investment.plan_within_budget(df, 100, [-F.col("v")]).orderBy("place").collect()] == [("a", 60), ("c", 40)]
    assert investment.plan_within_budget(df.limit(0), 100, [-F.col("v")]).count() == 0


def test_score_takes_the_cusum_onset(spark):
    charts = spark.createDataFrame(
        [("S1", "EWMA", "t", 5.0, None), ("S1", "CUSUM", "t", 6.0, 4.0), ("S1", "EWMA", "u", 1.0, None), ("S2", "CUSUM", "t", None, None)],
        "station string, chart string, signal string, first_day double, onset_day double",
    )
    faults = spark.createDataFrame([("F1", "S1", 4.5), ("F2", "S2", 1.0)], "fault_id string, target string, start_day double")
    got = {r.fault_id: r for r in spc.score_against_faults(charts, faults).collect()}
    assert (got["F1"].chart, got["F1"].lag_days, got["F1"].onset_day, got["F1"].onset_error_days) == ("EWMA", 0.5, 4.0, -0.5)
    assert not got["F2"].detected and got["F2"].chart is None


def test_lags_in_slots_move_the_rows_once(spark):
    """A key that ends early, one of few rows, and nulls; the plan has no join but the broadcast of what leads a slot."""
    rng = random.Random(8)
    data = [("a", float(i) if i % 9 else None, i) for i in range(400)] + [("b", rng.random() * 40, 1000 + i) for i in range(90)] + [("c", 399.0, 2000), ("c", 1.0, 2001)]
    df = spark.createDataFrame(data, "k string, x double, id long")
    out = ranks.lagged(df, ["k"], ["x", "id"], {"e": "id"}, 5, 25)
    got = {r.id: r.e for r in out.collect()}
    assert len(got) == len(data)
    for k in "abc":
        own = sorted((r for r in data if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert all(got[r[2]] == (own[i - 5][2] if i >= 5 else None) for i, r in enumerate(own))
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_the_feed_is_the_table_of_its_text(spark):
    text = plant.sql(spark, "/root/testdata/sf0.001", f"WITH {plant.PLANT} SELECT * FROM scan")
    rows = plant.scans(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows.drop("before_s").collect(), key=str) == sorted(text.collect(), key=str) and rows.drop("before_s").dtypes == text.dtypes
    assert {r.before_s is None for r in rows.filter("j = 1").collect()} == {True}
