"""Registered queries of the alert ledger. Each event is an alert; verdicts come from event ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.operators import decision
from taktwerk.plans.charts import rounded
from taktwerk.plans import layouts
from taktwerk.sources import dashboard, plant

SHADOW_UNTIL = 19_400.0


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return decision.issue(
        events.select(
            "event_id",
            F.col("event_type").alias("kind"),
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t_s"),
            F.least(F.col("value") / 200, F.lit(1.0)).alias("confidence"),
            (F.col("value") * 1000).alias("impact"),
        ),
        ["t_s", "event_id"],
        SHADOW_UNTIL,
    )


def verdicts(issued: DataFrame) -> DataFrame:
    """Two rounds of verdicts: the second overrides the first."""
    words = F.array(F.lit("confirmed"), F.lit("rejected"), F.lit("unsure"))
    first = issued.filter("event_id % 2 = 0").select("alert_id", words[(F.col("event_id") % 3).cast("int")].alias("verdict"), F.lit(1).alias("seq"))
    second = issued.filter("event_id % 6 = 4").select("alert_id", F.lit("confirmed").alias("verdict"), F.lit(2).alias("seq"))
    return first.union(second)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued = alerts(spark, sf_dir)
    return decision.adjudicate(decision.apply_budget(issued, with_shadow=True), verdicts(issued))


def q_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each station of the feed costs a shift, by how far its mean cycle in that shift lies over 50 s."""
    cycles = plant.scans(spark, sf_dir).groupBy("j", F.floor(F.col("release_s") / 28800).alias("shift_no")).agg((F.avg("proc_s") - 50).alias("gap_s"))
    return cycles.select("j", "shift_no", F.round(decision.bottleneck_impact(F.col("gap_s"), F.lit(50.0), F.lit(8.0)), 2).alias("per_shift_inr"))


def q_business_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as units: returns are defects, a tenth of the mean quantity is the gap."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    facts = items.agg(
        (F.avg("l_quantity") / 10).alias("gap_s"), F.lit(60.0).alias("takt_s"), F.lit(8.0).alias("shift_hours"), F.lit(2).alias("shifts_per_day"),
        F.lit(960).alias("units_per_day"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("defect_rate"), F.lit(0.7).alias("recall"),
    )
    out = decision.business_case(facts)
    return out.select("scenario", *(F.round(c, 2).alias(c) for c in out.columns if c != "scenario"))


def tabs(spark: SparkSession, sf_dir: str) -> dict[str, tuple[list[str], DataFrame]]:
    """The dashboard's four tabs: alerts that took a place, worth most; the score of each kind; how sure alerts were; the stations of the lines."""
    judged = ledger(spark, sf_dir)
    worth = [F.col("impact").desc(), F.col("alert_id")]
    shown = {
        "Alerts": (judged.filter("surfaced"), {"alert_id": "text", "kind": "text", "confidence": "share", "impact": "money", "verdict": "text"}, worth),
        "Scorecard": (decision.scorecard(judged), {"kind": "text", "issued": "count", "judged": "count", "hit_rate": "share", "impact": "money"}, [F.col("kind")]),
        "Calibration": (decision.calibration(judged), {"bin": "count", "n": "count", "mean_conf": "share", "hit_rate": "share"}, [F.col("bin")]),
        "Stations": (layouts.loaded(spark, sf_dir), {"sid": "text", "type_name": "text", "n_visits": "count", "instrumented": "text"}, [F.col("n_visits").desc(), F.col("sid")]),
    }
    return {name: (list(columns), dashboard.tab(df, columns, order)) for name, (df, columns, order) in shown.items()}


def q_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the page's tables, the 200 first of each tab, as they are marked up."""
    parts = [rows.select(F.lit(name).alias("tab"), "place", "html") for name, (_, rows) in tabs(spark, sf_dir).items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


QUERIES = {
    "q_dashboard": q_dashboard,
    "q_alert_log": lambda s, d: alerts(s, d).select("alert_id", "kind", "day", "shadow"),
    "q_alert_budget": lambda s, d: decision.apply_budget(alerts(s, d)).filter("surfaced").select("alert_id", "shift_no"),
    "q_adjudicate": lambda s, d: ledger(s, d).select("alert_id", "verdict", "outcome"),
    "q_feedback": lambda s, d: decision.feedback(ledger(s, d)),
    "q_scorecard": lambda s, d: rounded(decision.scorecard(ledger(s, d))).withColumn("impact", F.round("impact", 2)),
    "q_calibration": lambda s, d: rounded(decision.calibration(ledger(s, d))),
    "q_impact": q_impact,
    "q_business_case": q_business_case,
}

LEDGER = f"""
alert AS (SELECT event_id, event_type AS kind, epoch_us(ts) / 1e6 AS t_s, least(value / 200, 1) AS confidence, value * 1000 AS impact,
    epoch_us(ts) / 1e6 / 86400 < {SHADOW_UNTIL} AS shadow, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
named AS (SELECT *, 'A' || CASE WHEN n < 100000 THEN lpad(n::VARCHAR, 5, '0') ELSE n::VARCHAR END AS alert_id,
    floor(t_s / 28800)::BIGINT AS shift_no, confidence * ln(1 + impact) AS prio FROM alert),
ledger AS (SELECT *, row_number() OVER (PARTITION BY shift_no ORDER BY prio DESC, alert_id) <= 5 AS surfaced,
    CASE WHEN event_id % 6 = 4 THEN 'confirmed' WHEN event_id % 2 = 0 THEN ['confirmed', 'rejected', 'unsure'][event_id % 3 + 1] END AS verdict FROM named),
judged AS (SELECT *, CASE verdict WHEN 'confirmed' THEN 'correct' WHEN 'rejected' THEN 'incorrect' END AS outcome FROM ledger)"""
BAR = "coalesce('<i style=\"width:' || round({0} * 100)::BIGINT || 'px\"></i> ' || round({0} * 100, 1)::VARCHAR || ' %', '')"
WORTH = "CASE WHEN abs({0}) >= 1e7 THEN round({0} / 1e7, 2)::VARCHAR || ' cr' WHEN abs({0}) >= 1e5 THEN round({0} / 1e5, 2)::VARCHAR || ' L' ELSE 'Rs ' || round({0})::BIGINT END"
ORACLES = {
    "q_dashboard": f"""WITH {LEDGER}, {layouts.PLACES}, {layouts.VISITS},
      score AS (SELECT kind, count(*) AS issued, count(outcome) AS judged, avg((outcome = 'correct')::INT) AS hit_rate, coalesce(sum(impact) FILTER (WHERE surfaced), 0) AS impact FROM judged GROUP BY kind),
      sure AS (SELECT greatest(ceil(confidence * 5), 1)::BIGINT AS bin, count(*) AS n, avg(confidence) AS mean_conf, avg((outcome = 'correct')::INT) AS hit_rate FROM judged WHERE outcome IS NOT NULL GROUP BY 1),
      told AS (
        SELECT 'Alerts' AS tab, row_number() OVER (ORDER BY impact DESC, alert_id) AS place, [alert_id, kind, {BAR.format("confidence")}, {WORTH.format("impact")}, coalesce(verdict, '')] AS cells FROM judged WHERE surfaced
        UNION ALL SELECT 'Scorecard', row_number() OVER (ORDER BY kind), [kind, issued::VARCHAR, judged::VARCHAR, {BAR.format("hit_rate")}, {WORTH.format("impact")}] FROM score
        UNION ALL SELECT 'Calibration', row_number() OVER (ORDER BY bin), [bin::VARCHAR, n::VARCHAR, {BAR.format("mean_conf")}, {BAR.format("hit_rate")}] FROM sure
        UNION ALL SELECT 'Stations', row_number() OVER (ORDER BY n_visits DESC, sid), [sid, type_name, n_visits::VARCHAR, instrumented::VARCHAR] FROM passed)
      SELECT tab, place, '<tr><td>' || array_to_string(cells, '</td><td>') || '</td></tr>' AS html FROM told WHERE place <= 200""",
    "q_alert_log": f"WITH {LEDGER} SELECT alert_id, kind, round(t_s / 86400, 3) AS day, shadow FROM named",
    "q_alert_budget": f"""WITH {LEDGER} SELECT alert_id, shift_no FROM named WHERE NOT shadow
      QUALIFY row_number() OVER (PARTITION BY shift_no ORDER BY prio DESC, alert_id) <= 5""",
    "q_adjudicate": f"WITH {LEDGER} SELECT alert_id, verdict, outcome FROM judged",
    "q_feedback": f"""WITH {LEDGER} SELECT count(verdict) AS n_adjudicated, count(*) FILTER (WHERE verdict = 'confirmed') AS confirmed, count(*) FILTER (WHERE verdict = 'rejected') AS rejected,
      count(*) FILTER (WHERE verdict = 'unsure') AS unsure, round(avg((verdict = 'confirmed')::INT), 4) AS confirm_rate FROM judged""",
    "q_scorecard": f"""WITH {LEDGER} SELECT kind, count(*) AS issued, count(*) FILTER (WHERE surfaced) AS surfaced, count(*) FILTER (WHERE NOT surfaced) AS suppressed, count(outcome) AS judged,
      round(avg((outcome = 'correct')::INT), 6) AS hit_rate, round(avg(confidence), 6) AS confidence, round(coalesce(sum(impact) FILTER (WHERE surfaced), 0), 2) AS impact FROM judged GROUP BY kind""",
    "q_calibration": f"""WITH {LEDGER}, b AS (SELECT CASE WHEN confidence <= 0.2 THEN 1 WHEN confidence <= 0.4 THEN 2 WHEN confidence <= 0.6 THEN 3 WHEN confidence <= 0.8 THEN 4 ELSE 5 END::BIGINT AS bin,
      confidence, (outcome = 'correct')::INT AS hit FROM judged WHERE outcome IS NOT NULL)
      SELECT bin, count(*) AS n, round(avg(confidence), 6) AS mean_conf, round(avg(hit), 6) AS hit_rate, round(avg(hit) - avg(confidence), 3) AS gap FROM b GROUP BY bin""",
    "q_impact": """WITH v AS (SELECT j, o_orderkey * 30 // 28800 AS shift_no, 40 + (o_orderkey * 7919 + j * 104729) % 20001 / 1000 AS cycle FROM orders, (SELECT unnest(range(1, 8))::INT AS j)),
      m AS (SELECT j, shift_no, avg(cycle) AS cycle FROM v GROUP BY ALL) SELECT j, shift_no, round(62000 * greatest(576 - 28800 / cycle, 0), 2) AS per_shift_inr FROM m""",
    "q_business_case": """WITH f AS (SELECT avg(l_quantity) / 10 AS gap, avg((l_returnflag = 'R')::INT) AS rate FROM lineitem),
      g AS (SELECT col0 AS scenario, (480 - 28800 / (60 + gap * col3)) * 62000 * 500 AS t, 240000 * rate * 0.7e0 * col1 * col2 * (0.82e0 * 4800 + 0.18e0 * 34000) AS q,
        26 * 0.7e0 * 22 * 1450 AS r FROM f, (VALUES ('conservative', 0.5e0, 0.3e0, 0.35e0), ('base', 1e0, 0.5e0, 0.6e0), ('optimistic', 1e0, 0.7e0, 0.8e0)))
      SELECT scenario, round(t, 2) AS throughput_inr, round(q, 2) AS quality_inr, round(r, 2) AS rca_inr, round(t + q + r, 2) AS total_inr FROM g""",
}
