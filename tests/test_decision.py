"""The alert ledger on small inputs: ties, shadow mode, late verdicts, empty tables, and the lines' rules."""

from taktwerk.operators import decision
from taktwerk.sources import lines

SCHEMA = "alert_id string, kind string, t_s double, confidence double, impact double, shadow boolean"


def ledger(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_budget_breaks_ties_by_id_and_skips_shadow(spark):
    rows = [(f"A{i:05d}", "k", 10.0, 0.5, 100.0, i == 0) for i in range(8)] + [("A9", "k", 30_000.0, None, None, False)]
    got = decision.apply_budget(ledger(spark, rows), per_shift=3)
    assert sorted(r.alert_id for r in got.filter("surfaced").collect()) == ["A00001", "A00002", "A00003", "A9"]
    assert got.count() == 9
    again = decision.apply_budget(ledger(spark, rows), per_shift=3, with_shadow=True, salts=2)
    assert sorted(r.alert_id for r in again.filter("surfaced").collect()) == ["A00000", "A00001", "A00002", "A9"]


def test_last_verdict_holds_and_unknown_alerts_are_listed(spark):
    alerts = ledger(spark, [("A1", "k", 1.0, 0.5, 1.0, False), ("A2", "k", 1.0, 0.5, 1.0, False)])
    said = spark.createDataFrame([("A1", "confirmed", 1), ("A1", "unsure", 2), ("A7", "rejected", 1)], "alert_id string, verdict string, seq int")
    got = {r.alert_id: (r.verdict, r.outcome) for r in decision.adjudicate(alerts, said).collect()}
    assert got == {"A1": ("unsure", None), "A2": (None, None)}
    assert [r.alert_id for r in decision.unknown(alerts, said).collect()] == ["A7"]


def test_empty_ledger(spark):
    none = decision.adjudicate(decision.apply_budget(ledger(spark, [])), spark.createDataFrame([], "alert_id string, verdict string, seq int"))
    assert decision.scorecard(none).count() == 0 and decision.calibration(none).count() == 0
    assert decision.feedback(none).first().confirm_rate is None


def test_bins_are_closed_on_the_right(spark):
    rows = [(f"A{i}", "k", 1.0, c, 1.0, False) for i, c in enumerate((0.0, 0.2, 0.2000001, 1.0))]
    said = spark.createDataFrame([(f"A{i}", "confirmed", 1) for i in range(4)], "alert_id string, verdict string, seq int")
    got = {r.bin: r.n for r in decision.calibration(decision.adjudicate(ledger(spark, rows), said)).collect()}
    assert got == {1: 2, 2: 1, 5: 1}


def test_lines_have_the_published_coverage(spark, tmp_path):
    alpha = lines.stations(spark, "alpha")
    assert (alpha.count(), lines.stations(spark, "beta").count()) == (42, 28)
    assert alpha.filter("NOT instrumented").count() == 13
    assert [r.sid for r in alpha.filter("parallel = 2").orderBy("sid").collect()] == ["S04", "S10"]
    beta = lines.coverage(lines.stations(spark, "beta")).first()
    assert round(100 * beta.coverage) == 57 and not beta.has_rework
    hit = {r.sid for r in lines.affected(lines.stations(spark, "beta"), lines.faults(spark, "beta")).collect()}
    assert {"B17", "B14", "B03", "B12", "B11"} <= hit and "B01" not in hit
    lines.write_config(alpha, lines.station_types(spark), str(tmp_path / "line"))
    back = spark.read.json(str(tmp_path / "line"))
    assert back.count() == 42 and back.filter("size(observed_signals) = 0").count() == 13
