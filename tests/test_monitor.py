"""Sinks and stage times, the line scan, features, rolling decisions, sweeps and ablation on small inputs, against loops."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taktwerk.functions import metrics
from taktwerk.operators import ablation, decision, features, risk, spc, sweeps, tracing
from taktwerk.sources import sinks


def test_ledger_round_trip(spark, tmp_path):
    rows = [("A1", 0.5, math.nan, {"q": "0.01", "detail": None}, [1.0, math.inf], ("x", math.nan)), ("A2", None, 2.0, {}, None, None), ("Ä3", 1.0, -1.0, None, [], ("é", 1.0))]
    schema = "alert_id string, confidence double, impact double, evidence map<string,string>, xs array<double>, s struct<a:string,b:double>"
    df = spark.createDataFrame(rows, schema)
    sinks.write_ledger(df, f"{tmp_path}/ledger")
    text = "".join(p.read_text() for p in (tmp_path / "ledger").glob("*.json"))
    assert "NaN" not in text and "Infinity" not in text and '"impact":null' in text
    got = {r.alert_id: r for r in sinks.read_ledger(spark, f"{tmp_path}/ledger", df.schema).collect()}
    assert got["A1"].impact is None and got["A1"].xs == [1.0, None] and got["A1"].s.b is None and got["A1"].evidence == {"q": "0.01", "detail": None}
    assert got["A2"].confidence is None and got["A2"].evidence == {} and got["Ä3"].s == ("é", 1.0) and got["Ä3"].xs == []
    sinks.write_results({"one": df, "none": df.limit(0)}, f"{tmp_path}/results")
    assert sinks.read_ledger(spark, f"{tmp_path}/results/one", df.schema).count() == 3
    assert all(json.loads(line) for p in (tmp_path / "results" / "one").glob("*.json") for line in p.read_text().splitlines())
    assert sinks.read_ledger(spark, f"{tmp_path}/results/none", df.schema).count() == 0


def test_stages_and_metrics(spark):
    stages = sinks.Stages()
    with stages.stage("count"):
        assert stages.counted("count", spark.range(50)).count() == 50
    with stages.stage("idle"):
        pass
    got = {r.stage: r for r in stages.table(spark).collect()}
    assert got["count"].rows == 50 and got["count"].wall_ms > 0 and got["idle"].rows is None
    runs = spark.createDataFrame([(1.0, math.nan), (3.0, None), (2.0, 5.0)], "a double, b double")
    summary = sinks.metric_summary(runs, ["a", "b"])
    by = {r.metric: r for r in summary.collect()}
    assert (by["a"].n, by["a"].mean, by["b"].n, by["b"].sd) == (3, 2.0, 1, 0.0) and math.isclose(by["a"].sd, math.sqrt(2 / 3))
    ok = {r.metric: r.ok for r in sinks.envelope(summary, {"a": (2, 3), "b": (0, 4), "gone": (0, 1)}).collect()}
    assert ok == {"a": True, "b": False, "gone": False}


def test_line_scan_equals_the_loop(spark):
    rng = random.Random(9)
    shift = lambda u: 1.0 if u >= 130 else 0.0
    sig = [(u, "S1", "torque", rng.gauss(5 + 2 * shift(u), 1)) for u in range(205)] + [(u, "S1", "cycle_time_s", rng.gauss(50, 1) + (500 if u > 140 and u % 3 == 0 else 0)) for u in range(205)]
    dwell = [(u, s, rng.gauss(40, 2) + 9 * shift(u)) for u in range(205) for s in ("S1", "S2")]
    signals = spark.createDataFrame(sig, "unit long, sid string, signal string, v double")
    series = spc.line_series(signals, spark.createDataFrame(dwell, "unit long, sid string, v double"), spark.createDataFrame([("S1",)], "sid string"), 10).persist()
    got = {(r.station, r.signal, r.blk): r.m for r in series.collect()}
    assert {k[:2] for k in got} == {("S1", "torque"), ("S1", "cycle_time_s"), ("S1", "stoppage_rate"), ("S2", "soft_dwell_s"), ("S2", "soft_stoppage_rate")}
    cycle = [v for u, s, n, v in sig if n == "cycle_time_s"]
    bar = np.mean(cycle[:100]) + 4 * np.std(cycle[:100])
    assert len(got) == 5 * 20 and math.isclose(got["S1", "stoppage_rate", 14], np.mean([v > bar for v in cycle[140:150]]))
    found = {(r.station, r.signal, r.chart): r for r in spc.scan(spc.line_charts(series), 2.0).collect()}
    for station, signal in {k[:2] for k in got}:
        m = [got[station, signal, b] for b in range(20)]
        mu, sd = np.median(m[:10]), max(np.median(np.abs(np.diff(m[:10]))) / 0.954, 1e-9)
        hi = lo = z = 0.0
        start = [0, 0]
        flags, onsets = {"CUSUM": [], "EWMA": []}, []
        for i, x in enumerate(m):
            hi, lo, z = max(0.0, hi + (x - mu) / sd - 0.5), max(0.0, lo - (x - mu) / sd - 0.5), 0.78 * z + 0.22 * (x - mu)
            start = [i if hi == 0 else start[0], i if lo == 0 else start[1]]
            onsets.append(start[0] if hi >= lo else start[1])
            flags["CUSUM"].append(i >= 10 and max(hi, lo) > 9.35)
            flags["EWMA"].append(i >= 10 and abs(z) > 5.5 * sd * math.sqrt(0.22 / 1.78 * (1 - 0.78 ** (2 * i + 2))))
        for chart, f in flags.items():
            first = next((i for i in range(19) if f[i] and f[i + 1]), -1)
            r = found[station, signal, chart]
            assert (r.first_blk, r.n_signals, r.instrumented) == (first, sum(f), station == "S1")
            assert r.first_day == (None if first < 0 else first / 2) and r.onset_day == (onsets[first] / 2 if first >= 0 and chart == "CUSUM" else None)
    assert found["S1", "torque", "CUSUM"].first_blk >= 0 and found["S2", "soft_dwell_s", "EWMA"].first_blk >= 0
    rate = {r.chart: r for r in spc.false_alarm_rate(spc.scan(spc.line_charts(series), 2.0), spark.createDataFrame([("S1",)], "sid string")).collect()}
    assert rate["ALL"].n_charts == 4 and rate["ALL"].n_firing == sum(r.first_blk >= 0 for k, r in found.items() if k[0] == "S2")
    swept = spc.sweep(spc.line_charts(series)).collect()
    assert {(r.ewma_l, r.cusum_h) for r in swept} == {(3.0, 5.1), (3.5, 5.95), (4.1, 6.97), (4.6, 7.82), (5.2, 8.84)} and len(swept) == 50


def test_features_of_nulls_and_cutoffs(spark):
    units = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "unit long, op string")
    states = spark.createDataFrame([(u, j, float(u), 10.0 + u * j, u == 2) for u in range(4) for j in (1, 2, 3)], "unit long, j int, starved_s double, dwell_s double, blocked boolean")
    signals = spark.createDataFrame([(u, 1, "t", float(u)) for u in range(3)] + [(0, 3, "t", 99.0)], "unit long, j int, signal string, v double")
    stations = [{"j": j, "sid": f"S{j}", "type": "P", "instrumented": j != 2, "signals": ["t"] if j != 2 else []} for j in (1, 2, 3)]
    findings = spark.createDataFrame([(1, "G1", "x"), (1, "G1", "y"), (2, "G3", "x")], "unit long, gate string, defect_type string")
    got = {r.unit: r for r in features.build(units, states, signals, stations, findings, {"G1": 1, "G3": 3}, ["op"], 2).collect()}
    assert [got[u].op_code for u in range(4)] == [1, -1, 0, 1] and [got[u].gate_G1 for u in range(4)] == [0, 1, 0, 0]
    assert "gate_G3" not in got[0].asDict() and "z_S3_t" not in got[0].asDict() and got[3].z_S1_t is None
    assert math.isclose(got[2].z_S1_t, 1.0 / np.std([0, 1, 2]), rel_tol=1e-6) and got[2].blocked_frac == 1.0 and got[3].line_dwell_total_s == 29.0
    assert got[1].min_P__t == got[1].max_P__t == got[1].z_S1_t
    y = {r.unit: r.y for r in features.labels(units, findings, "G1", "x").collect()}
    assert y == {0: 0, 1: 1, 2: 0, 3: 0} and sum(r.y for r in features.labels(units, findings, "G3", "y").collect()) == 0


def test_features_of_states_are_one_aggregate(spark):
    rng = random.Random(5)
    dwell = {(u, j): rng.random() * 60 for u in range(40) for j in (1, 2, 3, 4) if (u, j) != (7, 2)}
    states = spark.createDataFrame([(u, j, 1.0, d, False) for (u, j), d in dwell.items()], "unit long, j int, starved_s double, dwell_s double, blocked boolean")
    units, signals = spark.createDataFrame([(u,) for u in range(41)], "unit long"), spark.createDataFrame([], "unit long, j int, signal string, v double")
    stations = [{"j": j, "sid": f"S{j}", "type": "P", "instrumented": j == 3, "signals": []} for j in (1, 2, 3, 4)]
    out = features.build(units, states, signals, stations, spark.createDataFrame([], "unit long, gate string"), {"G1": 1}, [], 3, 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(unit" in line for line in plan.splitlines()) == 4  # units twice, states and findings
    first = {j: [dwell[u, j] for u in range(20) if (u, j) in dwell] for j in (1, 2)}
    for r in out.collect():
        z = {j: (dwell[r.unit, j] - np.mean(v)) / np.std(v) for j, v in first.items() if (r.unit, j) in dwell}
        for got, want in ((r.zdwell_S1, z.get(1)), (r.zdwell_S2, z.get(2)), (r.dark_zdwell_max, max(z.values(), default=None)), (r.dark_zdwell_mean, np.mean(list(z.values())) if z else None)):
            assert got is None and want is None or math.isclose(got, want, rel_tol=1e-6, abs_tol=1e-9)
        assert r.starved_total_s == (sum((r.unit, j) in dwell for j in (1, 2, 3)) or None)


def test_rolling_decisions_equal_the_loop(spark):
    rng = random.Random(12)
    rows = [(u, round(rng.random() * (0.6 if rng.random() < 0.8 else 1.0), 3), int(rng.random() < 0.2)) for u in range(260)]
    got = {r.unit: r for r in risk.rolling(spark.createDataFrame(rows, "unit long, score double, y int"), 100, 40, 90, 0.1, 20).collect()}
    assert set(got) == set(range(100, 260))
    held = {0: 1.0, 1: 1.0}
    for start in range(100, 260, 40):
        for y in (0, 1):
            own = sorted(1 - s if y else s for u, s, k in rows if start - 90 <= u < start and k == y)
            if len(own) >= 20:
                level = min(1.0, math.ceil((len(own) + 1) * 0.9) / len(own))
                held[y] = own[min(math.ceil(level * (len(own) - 1)), len(own) - 1)]
        for u, s, _ in rows[start : start + 40]:
            in1, in0 = 1 - s <= held[1], s <= held[0]
            want = "abstain" if in1 and in0 else "pass" if in0 else "flag"
            c = {"flag": 1 - (1 - s) / max(held[1], 1e-6), "pass": 1 - s / max(held[0], 1e-6), "abstain": 0.0}[want]
            assert (got[u].block_start, got[u].decision) == (start, want) and math.isclose(got[u].confidence, min(max(c, 0.0), 1.0), abs_tol=1e-9)


def test_evaluation_by_key_and_of_one_class(spark):
    rows = [("a", 0.9, 1, True, False, "flag"), ("a", 0.2, 0, False, True, "pass"), ("a", 0.4, 1, True, True, "abstain"), ("b", 0.1, 0, False, True, "pass")]
    df = spark.createDataFrame(rows, "k string, score double, y int, in1 boolean, in0 boolean, decision string")
    got = {r.k: r for r in risk.prequential(df, "k").collect()}
    assert (got["a"].flag_precision, got["a"].flag_recall, got["a"].pass_miss_rate, got["a"].auc, got["a"].ap) == (1.0, 0.5, 0.0, 1.0, 1.0)
    assert got["b"].coverage_defect is None and got["b"].auc is None and got["b"].ap is None and got["b"].flag_recall == 0.0
    assert metrics.roc_auc(df, by=["k"], rows_per_slot=1).filter("k = 'a'").first().auc == 1.0


def test_sweep_carries_the_parameter_through_the_callers_functions(spark):
    clean = spark.createDataFrame([(u, j, u * 30.0, u * 30.0 + j * 50.0) for u in range(12) for j in (1, 2, 3)], "unit long, j int, release_s double, true_s double")
    seen = sweeps.sweep(clean, [0, 2, 5], lambda df: df.withColumn("x", F.col("true_s") + F.col("param")), sweeps.raw_states, lambda df: df.groupBy("param").agg(F.count("*").alias("n"), F.avg("dwell_s").alias("d")))
    got = {r.param: r for r in seen.collect()}
    assert {p: r.n for p, r in got.items()} == {0.0: 36, 2.0: 36, 5.0: 36}
    alone = sweeps.raw_states(clean.withColumn("param", F.lit(5.0)).withColumn("x", F.col("true_s") + 5.0)).agg(F.avg("dwell_s")).first()[0]
    assert math.isclose(got[5.0].d, alone)


def test_ablation_equals_separate_fits(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        a, b, c = rng.random(), rng.random(), rng.random()
        rows.append(("train" if i < 400 else "test", int(rng.random() < (0.9 if b > 0.8 else 0.05)), a, b, c))
    df = spark.createDataFrame(rows, "part string, y int, a double, b double, c double")
    fit = {"rounds": 3, "depth": 2}
    got = {r.candidate: r for r in ablation.gains(df, ["a"], {"B": ["b"], "C": ["c"]}, fit, 2).collect()}
    alone = lambda f: metrics.average_precision(risk.with_risk(df.filter("part = 'test'"), risk.fit_risk(df.filter("part = 'train'"), f, **fit), f)).first().ap
    assert got["B"].delta_ap > 0.3 > got["C"].delta_ap and math.isclose(got["B"].ap, alone(["a", "b"])) and math.isclose(got["C"].base_ap, alone(["a"]))
    stations = spark.createDataFrame([("B", 0.5, 4.0, 10, 100_000), ("C", 0.0, 0.0, 0, 50_000)], "candidate string, share double, ci double, hits long, cost long")
    best = ablation.retrofit_values(spark.createDataFrame([("B", 0.6, 0.2, 0.4), ("C", 0.1, 0.2, -0.1)], ablation.GAIN), stations).collect()
    assert [(r.candidate, r.r, round(r.value_per_lakh, 6)) for r in sorted(best, key=lambda r: r.r)] == [("B", 1, 1.325), ("C", 2, 0.0)]


def test_probe_statuses(spark):
    units = spark.range(200).withColumnRenamed("id", "unit")
    found = [(u, "G", "D") for u in range(40)] + [(u, "H", "D") for u in range(3)]
    findings = spark.createDataFrame(found, "unit long, gate string, defect_type string")
    exposed = spark.createDataFrame([("LOT", "L0" if u < 60 else "L1", u) for u in range(200)], "kind string, label string, unit long")
    rows = [("hit", "G", "D", 200, 200, ["L0"]), ("miss", "G", "D", 200, 200, ["L9"]), ("few", "H", "D", 200, 200, ["L0"]), ("clean", "X", "D", 200, 50, []), ("late", "G", "D", 0, 50, [])]
    probes = spark.createDataFrame(rows, "probe string, gate string, defect_type string, now_unit long, cohort_units long, expected array<string>")
    best, summary = tracing.trace_probes(exposed, tracing.cohorts(probes, units, findings))
    got = {r.probe: r for r in tracing.score_probes(probes, best, summary).collect()}
    assert {k: (r.status, r.correct) for k, r in got.items()} == {"hit": ("traced", True), "miss": ("traced", False), "few": ("insufficient_findings", False), "clean": ("insufficient_findings", True), "late": ("insufficient_findings", True)}
    assert (got["hit"].n_findings, got["hit"].rank1_label, got["few"].n_findings) == (40, "L0", 3)


@pytest.mark.parametrize("shadow", [0.0, 10.0])
def test_ledger_of_parts(spark, shadow):
    calls = spark.createDataFrame([(3600.0 * i, "S1", "S1" if i % 2 else "S2", 0.5, 3.0 * (i % 3)) for i in range(9)], "t_s double, predicted string, present string, confidence double, gap_s double")
    out = decision.ledger([decision.bottleneck_alerts(calls, 60.0, 8.0)], shadow, 2).orderBy("alert_id").collect()
    assert [r.alert_id for r in out] == [f"A{i:05d}" for i in range(1, 10)] and out[0].impact == 40_000.0 and out[2].impact > 500_000
    assert sum(r.surfaced for r in out) == (0 if shadow else 3) and [r.outcome for r in out[:2]] == ["incorrect", "correct"] and out[1].evidence == {"present": "S1"}
