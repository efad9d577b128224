"""Registered queries over the whole line: every chart, the feature table, the ledger from live results, and the envelope of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.operators import decision, features, risk, spc, tracing
from taktwerk.plans import charts, evaluation, traces, twin
from taktwerk.plans.charts import rounded
from taktwerk.sources import sinks

SIZE = 100  # units of a block
PER_DAY = 28.8  # blocks of a day, with a unit every 30 s


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    sid = F.concat(F.lit("S"), F.col("j").cast("string")).alias("sid")
    signals = traces.torque(spark, sf_dir).select("unit", sid, F.lit("torque").alias("signal"), "v")
    dwells = twin.feed_states(spark, sf_dir).select("unit", sid, F.col("dwell_s").alias("v"))
    sensors = spark.range(1).select(F.explode(F.array(*(F.lit(f"S{j}") for j in traces.SENSORS))).alias("sid"))
    return spc.line_series(signals, dwells, sensors, SIZE).persist()  # block means, read by both charts


def line_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spc.line_charts(series(spark, sf_dir))


def q_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spc.scan(line_charts(spark, sf_dir), PER_DAY)
    return rounded(found.withColumn("peak", F.round("peak", 3)))


def q_line_false_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the charts of stations that no fault touches: two and six have one."""
    touched = spark.range(1).select(F.explode(F.array(F.lit("S2"), F.lit("S6"))).alias("sid"))
    return rounded(spc.false_alarm_rate(spc.scan(line_charts(spark, sf_dir), PER_DAY), touched))


def q_line_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spc.sweep(line_charts(spark, sf_dir)))


BLOCKS = f"""
ser AS (
  SELECT 'S' || j AS sid, 'torque' AS signal, true AS inst, unit, v FROM torque
  UNION ALL SELECT 'S' || j, 'stoppage_rate', true, unit, dwell_s FROM state WHERE j % 2 = 1
  UNION ALL SELECT 'S' || j, s.name, false, unit, dwell_s FROM state, (VALUES ('soft_dwell_s'), ('soft_stoppage_rate')) AS s(name) WHERE j % 2 = 0),
num AS (SELECT *, row_number() OVER (PARTITION BY sid, signal ORDER BY unit) - 1 AS rn FROM ser),
bar AS (SELECT sid, signal, avg(v) FILTER (WHERE rn < {10 * SIZE}) + 4 * stddev_pop(v) FILTER (WHERE rn < {10 * SIZE}) AS bar FROM num GROUP BY sid, signal),
means AS (SELECT sid || '|' || signal AS series, inst, (rn // {SIZE})::BIGINT AS blk, avg(CASE WHEN signal LIKE '%stoppage_rate' THEN (v > bar)::INT ELSE v END) AS m
          FROM num JOIN bar USING (sid, signal) GROUP BY ALL HAVING count(*) = {SIZE}),
moved AS (SELECT *, abs(m - lag(m) OVER (PARTITION BY series ORDER BY blk)) AS mr FROM means),
base AS (SELECT series, median(m) FILTER (WHERE blk < 10) AS mu, greatest(median(mr) FILTER (WHERE blk < 10) / 0.954, 1e-9) AS sd, any_value(inst) AS inst
         FROM moved GROUP BY series HAVING count(*) >= 13)"""
SCAN = f"""{traces.EXPOSURES},{charts.CUSUM.replace(charts.BLOCKS, BLOCKS)},{charts.EWMA.replace(charts.BLOCKS + ",", "")},
pooled AS (SELECT series, 'CUSUM' AS chart, blk, stat, 9.35::DOUBLE AS lim, onset, flag FROM cusum UNION ALL SELECT series, 'EWMA', blk, stat, lim, NULL, flag FROM flagged),
held AS (SELECT *, sum(flag::INT) OVER (PARTITION BY series, chart ORDER BY blk ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) = 2 AS b FROM pooled),
told AS (SELECT series, chart, min(blk) FILTER (WHERE b) AS first, arg_min(onset, blk) FILTER (WHERE b) AS onset, sum(flag::INT)::BIGINT AS n_signals, max(abs(stat)) AS peak, arg_max(lim, blk) AS lim
         FROM held GROUP BY series, chart),
found AS (SELECT split_part(series, '|', 1) AS station, split_part(series, '|', 2) AS signal, inst AS instrumented, chart, mu, sd, coalesce(first, -1) AS first_blk,
          round(first / {PER_DAY}, 2) AS first_day, CASE WHEN first IS NOT NULL THEN round(onset / {PER_DAY}, 2) END AS onset_day, n_signals, peak, lim FROM told JOIN base USING (series))"""


# The stations of the derived feed as the feature table wants them.
STATIONS = [{"j": j, "sid": f"S{j}", "type": "PRESS" if j < 5 else "WELD", "instrumented": j in traces.SENSORS, "signals": ["torque"] if j in traces.SENSORS else []} for j in range(1, 8)]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, gate, defect_type): returned lines, at gates behind the second, fourth and last station."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_returnflag = 'R' AND l_linenumber IN (2, 4, 7)")
    kind = F.when(F.col("l_quantity") > 25, "HEAVY").otherwise("LIGHT")
    return lines.select(F.col("l_orderkey").alias("unit"), F.concat(F.lit("G"), F.col("l_linenumber").cast("string")).alias("gate"), kind.alias("defect_type"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("operator"), F.col("o_orderstatus").alias("variant"))


def q_features(spark: SparkSession, sf_dir: str, upto: int = 5) -> DataFrame:
    signals = traces.torque(spark, sf_dir).select("unit", "j", F.lit("torque").alias("signal"), "v")
    out = features.build(units(spark, sf_dir), twin.feed_states(spark, sf_dir, upto), signals, STATIONS, findings(spark, sf_dir), {"G2": 2, "G4": 4, "G7": 7}, ["operator", "variant"], upto)
    return rounded(out)


def q_typed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = units(spark, sf_dir).select("unit")
    for kind, name in ((None, "y"), ("HEAVY", "y_heavy"), ("LIGHT", "y_light")):
        out = out.join(features.labels(units(spark, sf_dir), findings(spark, sf_dir), "G7", kind).withColumnRenamed("y", name), "unit")
    return out


FEATURES = f"""WITH {traces.EXPOSURES},
  tz AS (SELECT unit, j, (v - mu) / sd AS z FROM torque JOIN norm USING (j)), dz AS (SELECT unit, j, (dwell_s - mu) / sd AS z FROM state JOIN slow USING (j)),
  seen AS (SELECT DISTINCT l_orderkey AS unit, l_linenumber AS j FROM lineitem WHERE l_returnflag = 'R'),
  op AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)), va AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT o_orderstatus AS v FROM orders))
  SELECT o_orderkey AS unit,
    (SELECT round(z, 6) FROM tz WHERE tz.unit = o_orderkey AND j = 1) AS z_S1_torque, (SELECT round(z, 6) FROM tz WHERE tz.unit = o_orderkey AND j = 3) AS z_S3_torque, (SELECT round(z, 6) FROM tz WHERE tz.unit = o_orderkey AND j = 5) AS z_S5_torque,
    p.lo AS min_PRESS__torque, p.hi AS max_PRESS__torque, w.lo AS min_WELD__torque, w.hi AS max_WELD__torque, d2 AS zdwell_S2, d4 AS zdwell_S4, dmax AS dark_zdwell_max, dmean AS dark_zdwell_mean,
    c.starved_total_s, c.blocked_frac, c.line_dwell_total_s, op.c::INT AS operator_code, va.c::INT AS variant_code,
    EXISTS (SELECT 1 FROM seen WHERE seen.unit = o_orderkey AND j = 2)::INT AS "gate_G2", EXISTS (SELECT 1 FROM seen WHERE seen.unit = o_orderkey AND j = 4)::INT AS "gate_G4"
  FROM orders JOIN op ON op.v = o_orderpriority JOIN va ON va.v = o_orderstatus
  JOIN (SELECT unit, round(min(z), 6) AS lo, round(max(z), 6) AS hi FROM tz WHERE j < 5 GROUP BY unit) p ON p.unit = o_orderkey
  JOIN (SELECT unit, round(min(z), 6) AS lo, round(max(z), 6) AS hi FROM tz WHERE j = 5 GROUP BY unit) w ON w.unit = o_orderkey
  JOIN (SELECT unit, round(max(z) FILTER (WHERE j = 2), 6) AS d2, round(max(z) FILTER (WHERE j = 4), 6) AS d4, round(max(z), 6) AS dmax, round(avg(z), 6) AS dmean FROM dz WHERE j IN (2, 4) GROUP BY unit) d ON d.unit = o_orderkey
  JOIN (SELECT unit, round(sum(starved_s), 6) AS starved_total_s, round(avg(coalesce(dwell_s - theta_s < 1.5, false)::INT), 6) AS blocked_frac, round(sum(dwell_s), 6) AS line_dwell_total_s FROM state WHERE j <= 5 GROUP BY unit) c ON c.unit = o_orderkey"""


def live_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts from the hourly calls, the rolling blocks of the risk and the probes, as they come out of their operators."""
    calls = twin.calls(spark, sf_dir).withColumn("t_s", F.col("hour") * 3600.0).withColumn("gap_s", F.col("confidence") * 3)
    blocks = risk.evaluate(evaluation.decided(spark, sf_dir), ("block_start",)).withColumn("t_s", F.col("block_start") * 30.0)
    probes = evaluation.probes(spark)
    told = tracing.score_probes(probes, *evaluation.probe_traces(spark, sf_dir)).join(probes.select("probe", (F.col("now_unit") * 30.0).alias("t_s")), "probe")
    return decision.ledger([decision.bottleneck_alerts(calls, 60.0, 8.0), decision.risk_alerts(blocks, "BAD"), decision.trace_alerts(told)])


def q_live_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(live_ledger(spark, sf_dir).select("kind", "subject", "t_s", "confidence", "impact", "outcome", "surfaced", F.map_keys("evidence").getItem(0).alias("first_evidence")))


def q_live_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(decision.scorecard(live_ledger(spark, sf_dir)))


LEDGER = f"""hourly AS (WITH {twin.SHARE}, per AS (SELECT floor(t / 60)::BIGINT AS h, sid, count(*) AS n FROM best GROUP BY ALL),
    lead AS (SELECT h, first(sid ORDER BY n DESC, sid) AS sid, max(n) AS n FROM per GROUP BY h)
    SELECT a.h, b.sid AS predicted, a.sid AS present, b.n / 60 AS confidence FROM lead a JOIN lead b ON b.h = a.h - 1),
  risky AS (WITH {evaluation.ROLLING} SELECT * FROM block),
  traced AS (WITH {evaluation.PROBED}, best_of AS (SELECT * FROM top WHERE r = 1)
    SELECT probe, now_unit * 30e0 AS t_s, label, confidence, CASE WHEN len(expected) = 0 THEN label IS NULL ELSE coalesce(len(list_filter(expected, lambda e: contains(label, e))) > 0, false) END AS correct
    FROM probe LEFT JOIN best_of USING (probe)),
  alert AS (
    SELECT 'BOTTLENECK' AS kind, predicted AS subject, h * 3600e0 AS t_s, confidence, greatest((480 - 28800 / (60 + 3 * confidence)) * 62000, 40000) AS impact,
      CASE WHEN predicted = present THEN 'correct' ELSE 'incorrect' END AS outcome, 'present' AS first_evidence, '' AS tie FROM hourly
    UNION ALL SELECT 'DEFECT_RISK', 'BAD', block_start * 30e0, least(flag_precision * 3, 0.95), flag_rate * n * flag_precision * 10056, CASE WHEN flag_precision > 0.05 THEN 'correct' ELSE 'incorrect' END, 'precision', ''
      FROM risky WHERE flag_precision IS NOT NULL AND flag_rate > 0
    UNION ALL SELECT 'ROOT_CAUSE', coalesce(label, 'none'), t_s, coalesce(confidence, 0), 22 * 0.7 * 1450, CASE WHEN correct THEN 'correct' ELSE 'incorrect' END, 'probe', probe FROM traced),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY floor(t_s / 28800) ORDER BY confidence * ln(1 + impact) DESC, t_s, kind, subject, tie) <= 5 AS surfaced FROM alert)"""


def q_block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and range of each metric over the rolling blocks."""
    return rounded(sinks.metric_summary(risk.evaluate(evaluation.decided(spark, sf_dir), ("block_start",)), list(evaluation.MEASURES)))


LIMITS = {"coverage_ok": (0.85, 1.0), "coverage_defect": (0.85, 1.0), "flag_rate": (0.0, 0.05), "lead_h": (0.0, 9.0)}


def q_block_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = sinks.metric_summary(risk.evaluate(evaluation.decided(spark, sf_dir), ("block_start",)), list(evaluation.MEASURES))
    return rounded(sinks.envelope(summary, LIMITS))


METRICS = f"""WITH {evaluation.ROLLING}, long AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM block WHERE {m} IS NOT NULL" for m in evaluation.MEASURES)}),
  summary AS (SELECT metric, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM long GROUP BY metric)"""

QUERIES = {
    "q_line_scan": q_line_scan,
    "q_line_false_alarm": q_line_false_alarm,
    "q_line_sweep": q_line_sweep,
    "q_features": q_features,
    "q_typed_labels": q_typed_labels,
    "q_live_ledger": q_live_ledger,
    "q_live_scorecard": q_live_scorecard,
    "q_block_metrics": q_block_metrics,
    "q_block_envelope": q_block_envelope,
}
ORACLES = {
    "q_line_scan": f"WITH {SCAN} SELECT station, signal, instrumented, chart, round(mu, 6) AS mu, round(sd, 6) AS sd, first_blk, first_day, onset_day, n_signals, round(peak, 3) AS peak, round(lim, 6) AS lim FROM found",
    "q_line_false_alarm": f"""WITH {SCAN}, calm AS (SELECT chart, (first_blk >= 0)::BIGINT AS f FROM found WHERE station NOT IN ('S2', 'S6')), every AS (SELECT * FROM calm UNION ALL SELECT 'ALL', f FROM calm)
      SELECT chart, count(*) AS n_charts, sum(f)::BIGINT AS n_firing, round(avg(f), 6) AS rate FROM every GROUP BY chart""",
    "q_line_sweep": f"""WITH {SCAN}, point AS (SELECT l, round(l * 1.7, 6) AS h FROM (VALUES (3.0::DOUBLE), (3.5), (4.1), (4.6), (5.2)) AS v(l)),
      tried AS (SELECT l, h, series, chart, blk, blk >= 10 AND CASE chart WHEN 'EWMA' THEN abs(stat) > lim / 5.5 * l ELSE stat > h END AS flag FROM pooled, point),
      two AS (SELECT *, sum(flag::INT) OVER (PARTITION BY l, series, chart ORDER BY blk ROWS 1 PRECEDING) = 2 AS b FROM tried)
      SELECT l AS ewma_l, h AS cusum_h, split_part(series, '|', 1) AS station, split_part(series, '|', 2) AS signal, chart, coalesce(min(blk - 1) FILTER (WHERE b), -1) AS first_blk, sum(flag::INT)::BIGINT AS n_signals FROM two GROUP BY ALL""",
    "q_features": FEATURES,
    "q_typed_labels": """WITH f AS (SELECT l_orderkey AS unit, bool_or(l_quantity > 25) AS heavy, bool_or(l_quantity <= 25) AS light FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7 GROUP BY 1)
      SELECT o_orderkey AS unit, (f.unit IS NOT NULL)::INT AS y, coalesce(heavy, false)::INT AS y_heavy, coalesce(light, false)::INT AS y_light FROM orders LEFT JOIN f ON f.unit = o_orderkey""",
    "q_live_ledger": f"WITH {LEDGER} SELECT kind, subject, t_s, round(confidence, 6) AS confidence, round(impact, 6) AS impact, outcome, surfaced, first_evidence FROM ranked",
    "q_live_scorecard": f"""WITH {LEDGER} SELECT kind, count(*) AS issued, count(*) FILTER (WHERE surfaced) AS surfaced, count(*) FILTER (WHERE NOT surfaced) AS suppressed, count(*) AS judged,
      round(avg((outcome = 'correct')::INT), 6) AS hit_rate, round(avg(confidence), 6) AS confidence, round(coalesce(sum(impact) FILTER (WHERE surfaced), 0), 6) AS impact FROM ranked GROUP BY kind""",
    "q_block_metrics": f"{METRICS} SELECT metric, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(lo, 6) AS lo, round(hi, 6) AS hi FROM summary",
    "q_block_envelope": f"""{METRICS}, lim(metric, lo, hi) AS (VALUES {", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, (a, b) in LIMITS.items())})
      SELECT metric, round(mean, 6) AS mean, lim.lo, lim.hi, coalesce(mean >= lim.lo AND mean <= lim.hi, false) AS ok FROM lim LEFT JOIN (SELECT metric, mean FROM summary) USING (metric)""",
}
