"""The alert ledger: issue, attention budget, verdicts, scorecards and what an alert is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions.ranks import positions

SHIFT_S = 8 * 3600

# The cost model, in INR and hours.
ECONOMICS = {
    "contribution_margin_per_unit_inr": 62_000,
    "rework_cost_per_defect_inr": 4_800,
    "scrap_cost_per_defect_inr": 21_000,
    "warranty_cost_per_escape_inr": 34_000,
    "unplanned_downtime_cost_per_min_inr": 9_400,
    "engineer_hours_per_rca": 22,
    "engineer_cost_per_hour_inr": 1_450,
}

# Scenario, factor on recall, share of flags acted on, share of the cycle gap that is closed.
SCENARIOS = (("conservative", 0.5, 0.3, 0.35), ("base", 1.0, 0.5, 0.6), ("optimistic", 1.0, 0.7, 0.8))


def priority(confidence: str | Column = "confidence", impact: str | Column = "impact") -> Column:
    """Confidence times ln(1 + impact); a negative impact counts as none."""
    confidence, impact = (F.col(c) if isinstance(c, str) else c for c in (confidence, impact))
    return confidence * F.log1p(F.greatest(impact, F.lit(0.0)))


def issue(alerts: DataFrame, order: list[str], shadow_until_day: float = 0.0) -> DataFrame:
    """Adds alert_id (A and a number of at least five digits, by `order`), day and shadow to alerts with t_s.

    The order must end in a unique column and start with a number or a timestamp; it is cut into slots.
    """
    placed = positions(alerts, [], order, "__n")
    day = F.col("t_s") / 86400
    named = placed.withColumn("alert_id", F.format_string("A%05d", F.col("__n") + 1))
    return named.withColumns({"day": F.round(day, 3), "shadow": day < shadow_until_day}).drop("__n")


def apply_budget(alerts: DataFrame, per_shift: int = 5, shift_s: int = SHIFT_S, with_shadow: bool = False, salts: int = 64) -> DataFrame:
    """Adds shift_no and surfaced: the `per_shift` alerts of a shift with the highest priority; ties go by alert_id.

    Alerts in shadow mode take no place unless `with_shadow`. A busy shift is ranked in salted parts first; what remains is
    per_shift * salts rows, whose last chosen one is the bar that all rows of the shift are held against.
    """
    rows = alerts.withColumn("shift_no", F.floor(F.col("t_s") / shift_s)).withColumn("__prio", F.coalesce(priority(), F.lit(-1.0)))
    allowed = F.lit(True) if with_shadow else ~F.col("shadow")
    salted = rows.filter(allowed).select("shift_no", (-F.col("__prio")).alias("p"), "alert_id", F.pmod(F.xxhash64("alert_id"), F.lit(salts)).alias("salt"))
    best = salted.withColumn("r", F.row_number().over(Window.partitionBy("shift_no", "salt").orderBy("p", "alert_id"))).filter(F.col("r") <= per_shift)
    chosen = best.groupBy("shift_no").agg(F.array_max(F.slice(F.array_sort(F.collect_list(F.struct("p", "alert_id"))), 1, per_shift)).alias("__bar"))
    met = rows.join(chosen.withColumnRenamed("shift_no", "__shift"), F.col("shift_no").eqNullSafe(F.col("__shift")), "left")
    own = F.struct((-F.col("__prio")).alias("p"), F.col("alert_id"))
    return met.withColumn("surfaced", F.coalesce(allowed & (own <= F.col("__bar")), F.lit(False))).drop("__prio", "__bar", "__shift")


def adjudicate(alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds verdict and outcome from (alert_id, verdict, seq): the verdict with the greatest seq holds.

    confirmed is correct, rejected is incorrect; unsure leaves the outcome null, as no verdict does. Verdicts of unknown
    alerts change nothing; `unknown` lists them.
    """
    last = verdicts.groupBy("alert_id").agg(F.max_by("verdict", F.struct("seq", "verdict")).alias("verdict"))
    outcome = F.when(F.col("verdict") == "confirmed", "correct").when(F.col("verdict") == "rejected", "incorrect")
    return alerts.join(last, "alert_id", "left").withColumn("outcome", outcome)


def unknown(alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The verdicts that name no alert."""
    return verdicts.join(alerts.select("alert_id"), "alert_id", "left_anti")


def feedback(judged: DataFrame) -> DataFrame:
    """n_adjudicated, confirmed, rejected, unsure and confirm_rate (null without verdicts)."""
    n = F.count("verdict")
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("confirmed", "rejected", "unsure")]
    rate = F.count_if(F.col("verdict") == "confirmed") / F.nullif(n, F.lit(0))
    return judged.agg(n.alias("n_adjudicated"), *counts, F.round(rate, 4).alias("confirm_rate"))


def known() -> Column:
    return F.col("outcome").isin("correct", "incorrect")


def right() -> Column:
    return F.when(known(), (F.col("outcome") == "correct").cast("double"))


def scorecard(ledger: DataFrame) -> DataFrame:
    """Of each kind: issued, surfaced, suppressed, judged, hit_rate (null if none is judged), mean confidence, surfaced impact."""
    return ledger.groupBy("kind").agg(
        F.count("*").alias("issued"),
        F.count_if("surfaced").alias("surfaced"),
        F.count_if(~F.col("surfaced")).alias("suppressed"),
        F.count_if(known()).alias("judged"),
        F.avg(right()).alias("hit_rate"),
        F.avg("confidence").alias("confidence"),
        F.coalesce(F.sum(F.when(F.col("surfaced"), F.col("impact"))), F.lit(0.0)).alias("impact"),
    )


def calibration(ledger: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, n, mean_conf, hit_rate, gap) of judged alerts; bins are closed on the right, the first holds 0 too."""
    bin_no = F.greatest(F.ceil(F.col("confidence") * bins), F.lit(1)).cast("long")
    out = ledger.filter(known()).groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_conf"), F.avg(right()).alias("hit_rate"))
    return out.withColumn("gap", F.round(F.col("hit_rate") - F.col("mean_conf"), 3))


def bottleneck_impact(gap_s: Column, takt_s: Column, shift_hours: Column) -> Column:
    """The margin of the units that a shift loses when its slowest cycle is gap_s over takt."""
    seconds = shift_hours * 3600
    lost = seconds / takt_s - seconds / (takt_s + gap_s)
    return F.when(gap_s > 0, lost * ECONOMICS["contribution_margin_per_unit_inr"]).otherwise(0.0)


def defect_impact(n_units: Column, p_defect: Column, escape_rate: Column) -> Column:
    """Rework of the defects that a gate finds and warranty claims for those that escape."""
    each = (1 - escape_rate) * ECONOMICS["rework_cost_per_defect_inr"] + escape_rate * ECONOMICS["warranty_cost_per_escape_inr"]
    return n_units * p_defect * each


def rca_impact(hours: Column) -> Column:
    return hours * ECONOMICS["engineer_cost_per_hour_inr"]


def business_case(facts: DataFrame, escapes: float = 0.18, working_days: int = 250, causes_a_year: int = 26, hours_saved: float = 0.7) -> DataFrame:
    """One row a scenario: yearly throughput, quality, rca and total gains, from one row of facts.

    facts: gap_s (slowest cycle over takt), takt_s, shift_hours, shifts_per_day, units_per_day, defect_rate, recall.
    """
    spark = facts.sparkSession
    scenarios = spark.createDataFrame(SCENARIOS, "scenario string, recall_factor double, acted double, closed double")
    rows = facts.crossJoin(F.broadcast(scenarios))  # one row of facts against three
    c = F.col
    shifts = c("shifts_per_day") * working_days
    throughput = bottleneck_impact(c("gap_s") * c("closed"), c("takt_s"), c("shift_hours")) * shifts
    found = c("defect_rate") * c("recall") * c("recall_factor") * c("acted")
    quality = defect_impact(c("units_per_day") * working_days, found, F.lit(escapes))
    rca = rca_impact(F.lit(causes_a_year * hours_saved * ECONOMICS["engineer_hours_per_rca"]))
    out = rows.select("scenario", throughput.alias("throughput_inr"), quality.alias("quality_inr"), rca.alias("rca_inr"))
    return out.withColumn("total_inr", c("throughput_inr") + c("quality_inr") + c("rca_inr"))


def evidence(**pairs: Column) -> Column:
    """A map of strings; nulls are left out."""
    entries = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), c.cast("string").alias("value"))) for k, c in pairs.items())))
    return F.map_from_entries(entries)


ALERT = ("kind", "subject", "t_s", "confidence", "impact", "outcome", "evidence")


def bottleneck_alerts(calls: DataFrame, takt_s: float, shift_hours: float, least_impact: float = 40_000) -> DataFrame:
    """An alert a forecast (t_s, predicted, present, confidence, gap_s), worth what the gap costs a shift; correct if the station became the present one."""
    impact = F.greatest(bottleneck_impact(F.col("gap_s"), F.lit(takt_s), F.lit(shift_hours)), F.lit(float(least_impact)))
    outcome = F.when(F.col("predicted") == F.col("present"), "correct").otherwise("incorrect")
    return calls.select(
        F.lit("BOTTLENECK").alias("kind"), F.col("predicted").alias("subject"), "t_s", "confidence", impact.alias("impact"), outcome.alias("outcome"),
        evidence(present=F.col("present")).alias("evidence"),
    )


def risk_alerts(blocks: DataFrame, subject: str, escape_rate: float = 0.18) -> DataFrame:
    """An alert a block of decisions (t_s and what risk.evaluate gives) that flagged anything, correct if over a twentieth of it was defective."""
    flagged = F.col("flag_rate") * F.col("n")
    sound = blocks.filter(F.col("flag_precision").isNotNull() & (F.col("flag_rate") > 0))
    return sound.select(
        F.lit("DEFECT_RISK").alias("kind"), F.lit(subject).alias("subject"), "t_s", F.least(F.greatest(F.col("flag_precision") * 3, F.lit(0.0)), F.lit(0.95)).alias("confidence"),
        defect_impact(flagged, F.col("flag_precision"), F.lit(escape_rate)).alias("impact"), F.when(F.col("flag_precision") > 0.05, "correct").otherwise("incorrect").alias("outcome"),
        evidence(precision=F.round("flag_precision", 3), recall=F.round("flag_recall", 3)).alias("evidence"),
    )


def trace_alerts(scored: DataFrame, hours_saved: float = 0.7) -> DataFrame:
    """An alert a trace (t_s and what tracing.score_probes gives), as the engineer who reviewed it found it."""
    return scored.select(
        F.lit("ROOT_CAUSE").alias("kind"), F.coalesce("rank1_label", F.lit("none")).alias("subject"), "t_s", F.coalesce("rank1_confidence", F.lit(0.0)).alias("confidence"),
        rca_impact(F.lit(ECONOMICS["engineer_hours_per_rca"] * hours_saved)).alias("impact"), F.when(F.col("correct"), "correct").otherwise("incorrect").alias("outcome"),
        evidence(probe=F.col("probe"), status=F.col("status"), lift=F.round("rank1_lift", 2)).alias("evidence"),
    )


def ledger(parts: list[DataFrame], shadow_until_day: float = 0.0, per_shift: int = 5) -> DataFrame:
    """All alerts of the parts, numbered by time, then kind, subject and evidence, with the attention budget of each shift applied."""
    rows = parts[0].select(*ALERT)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*ALERT))
    rows = rows.withColumn("__text", F.to_json("evidence")).persist()  # alerts are few beside what they come from, and read several times
    return apply_budget(issue(rows, ["t_s", "kind", "subject", "__text"], shadow_until_day).drop("__text"), per_shift)
