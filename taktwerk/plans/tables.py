"""Registered queries that are one SQL text for both engines; `spark_text` and `duck_text` settle the dialects.

Texts use e0 for doubles, `EPOCH_US(ts)` for microseconds, `DIV(a, b)` for whole quotients, and `PCTL(x, p)` for
linear quantiles, and
`SEQ(lo, hi)` for a row a whole number.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.functions import metrics
from taktwerk.sources import plant


def spark_text(text: str) -> str:
    text = re.sub(r"EPOCH_US\((\w+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", text)
    text = text.replace("PCTL(", "percentile(").replace("SEQ(lo, hi)", "explode(sequence(lo, hi))")
    return re.sub(r"DIV\(([^,()]*(?:\([^()]*\)[^,()]*)*), ([^()]*)\)", r"CAST(floor((\1) / (\2)) AS BIGINT)", text)


def counted(text: str) -> str:
    """count_if(x) as count(*) FILTER (WHERE x), which is a BIGINT in DuckDB too."""
    while (at := text.find("count_if(")) >= 0:
        end = start = at + len("count_if(")
        depth = 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}count(*) FILTER (WHERE {text[start : end - 1]}){text[end:]}"
    return text


def duck_text(text: str) -> str:
    text = counted(text)
    text = text.replace("EPOCH_US(", "epoch_us(").replace("PCTL(", "quantile_cont(")
    text = text.replace("SEQ(lo, hi)", "unnest(range(lo, hi + 1))")
    return re.sub(r"DIV\(([^,()]*(?:\([^()]*\)[^,()]*)*), ([^()]*)\)", r"CAST(floor((\1) / (\2)) AS BIGINT)", text)


STATION = """
station AS (SELECT * FROM (VALUES
  ('S1', 'BODY', 1, true, 60e0, 52000), ('S2', 'BODY', 2, false, 55e0, 61000), ('S3', 'PAINT', 3, true, 58e0, 47000),
  ('S4', 'PAINT', 4, false, 62e0, 83000), ('S5', 'FINAL', 5, true, 57e0, 39000), ('S6', 'FINAL', 6, false, 61e0, 56000),
  ('S7', 'FINAL', 7, true, 59e0, 71000)) AS t(sid, zone, station_idx, instrumented, nominal_s, cost_inr))"""
FAULT = """
fault AS (SELECT * FROM (VALUES ('F1', 'CYCLE_DEGRADE', 'S2', 3e0), ('F2', 'OPERATOR_VAR', 'FINAL', 5e0), ('F3', 'STEP', 'S3', 8e0),
  ('F4', 'ELECTRICAL', 'ALL', 2e0)) AS t(fault_id, kind, target, start_day))"""
STATES = plant.PLANT + """,
arrived AS (SELECT unit, j, true_s, proc_s, release_s, coalesce(lag(true_s) OVER (PARTITION BY unit ORDER BY j) + 4.5e0, release_s) AS arrive_s,
            lag(true_s) OVER (PARTITION BY j ORDER BY true_s, unit) AS prev_s FROM scan),
state AS (SELECT *, greatest(arrive_s, prev_s) AS start_s, true_s - greatest(arrive_s, prev_s) AS dwell_s,
          coalesce(greatest(greatest(arrive_s, prev_s) - prev_s, 0e0), 0e0) AS starved_s FROM arrived)"""
ALERT = """
alert AS (SELECT event_id, 'A' || lpad(CAST(event_id AS STRING), 7, '0') AS alert_id, event_type AS kind, EPOCH_US(ts) / 1e6 AS t_s,
          least(value / 200, 1e0) AS confidence, value * 1000 AS impact, event_id % 3 AS outcome,
          least(value / 200, 1e0) * ln(1 + greatest(value * 1000, 0e0)) AS priority FROM events),
budget AS (SELECT *, DIV(t_s, 28800) AS shift_no, row_number() OVER (PARTITION BY DIV(t_s, 28800) ORDER BY priority DESC, event_id) AS place FROM alert)"""
PERIOD = """
act AS (SELECT event_type AS sid, event_id, EPOCH_US(ts) AS s, EPOCH_US(ts) + CAST(round(value * 10000000) AS BIGINT) AS e FROM events),
runs AS (SELECT *, max(e) OVER (PARTITION BY sid ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM act),
marked AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top + 2000000 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY s, event_id) AS p FROM runs),
period AS (SELECT sid, p, min(s) AS s, max(e) AS e FROM marked GROUP BY sid, p)"""
SHARE = PERIOD + """,
ticks AS (SELECT sid, e - s AS dur, CAST(ceil(s / 6e7) AS BIGINT) AS lo, CAST(floor(e / 6e7) AS BIGINT) AS hi FROM period),
cover AS (SELECT sid, dur, SEQ(lo, hi) AS t FROM ticks WHERE hi >= lo),
led AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY dur DESC, sid) AS r FROM cover),
best AS (SELECT t, max(CASE WHEN r = 1 THEN sid END) AS sid, max(CASE WHEN r = 2 THEN dur ELSE 0 END) >= 0.85e0 * max(CASE WHEN r = 1 THEN dur END) AS shifting
         FROM led GROUP BY t),
grid AS (SELECT max(hi) - min(lo) + 1 AS n FROM ticks)"""
RISK = """
risk AS (SELECT d.doc_id AS unit, least(n_chars / 20000e0, 1e0) AS score, toxic AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
calib AS (SELECT y, CASE WHEN y = 1 THEN 1 - score ELSE score END AS s FROM risk WHERE unit % 2 = 0),
placed AS (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY s) AS r, count(*) OVER (PARTITION BY y) AS n FROM calib),
quant AS (SELECT y, max(CASE WHEN r = least(n, CAST(ceil(least(1e0, ceil((n + 1) * 0.9e0) / n) * (n - 1)) AS BIGINT) + 1) THEN s END) AS q, max(n) AS n
          FROM placed GROUP BY y),
level AS (SELECT max(CASE WHEN y = 1 THEN CASE WHEN n < 20 THEN 1e0 ELSE q END END) AS q1, max(CASE WHEN y = 0 THEN CASE WHEN n < 20 THEN 1e0 ELSE q END END) AS q0 FROM quant),
decided AS (SELECT unit, score, y, 1 - score <= q1 AS in1, score <= q0 AS in0 FROM risk, level WHERE unit % 2 = 1),
decision AS (SELECT *, CASE WHEN in1 AND in0 THEN 'abstain' WHEN in0 THEN 'pass' ELSE 'flag' END AS decision FROM decided)"""
SIGNAL = """
signal AS (SELECT l_orderkey AS unit, l_linenumber AS j, avg(l_quantity) AS v, avg(l_extendedprice) AS w FROM lineitem GROUP BY l_orderkey, l_linenumber),
band AS (SELECT j, avg(CASE WHEN unit < 2400 THEN v END) AS mu, stddev_pop(CASE WHEN unit < 2400 THEN v END) + 1e-9 AS sd FROM signal GROUP BY j),
zed AS (SELECT unit, signal.j, (v - mu) / sd AS z FROM signal JOIN band ON signal.j = band.j)"""
INVEST = """
cand AS (SELECT s_suppkey AS sid, s_nationkey AS zone, 100000 + abs(s_acctbal) * 10 AS cost, avg(l_quantity) AS mean_q,
         count(*) AS hits, avg(l_discount) AS disc, avg(l_tax) AS tax FROM supplier JOIN lineitem ON l_suppkey = s_suppkey
         GROUP BY s_suppkey, s_nationkey, s_acctbal),
scored AS (SELECT *, least(greatest(40 * disc / mean_q + (1 - tax * 10), 0e0), 2e0) / 2 AS uncertainty,
           least(greatest(disc + least(greatest(mean_q - 25, 0e0) / 5, 1e0), 0e0), 2e0) / 2 AS exposure,
           least(greatest(hits / 5000e0 + tax, 0e0), 1e0) AS ambiguity FROM cand),
evi AS (SELECT *, 0.4e0 * uncertainty + 0.4e0 * exposure + 0.2e0 * ambiguity AS evi FROM scored),
ranked AS (SELECT *, evi / (cost / 100000e0) AS evi_per_lakh FROM evi)"""
RANKS = """
r AS (SELECT sid, evi, evi_per_lakh, cost FROM ranked),
rk AS (SELECT sid, (rank() OVER (ORDER BY evi) + (count(*) OVER (PARTITION BY evi) - 1) / 2e0) AS ra,
       (rank() OVER (ORDER BY cost) + (count(*) OVER (PARTITION BY cost) - 1) / 2e0) AS rb FROM r)"""

TEXTS = {
    # lines, faults, knowledge graph
    "q_observable_view": f"WITH {STATION} SELECT l_orderkey AS unit, l_linenumber AS j, count(*) AS n, round(sum(l_quantity), 6) AS v FROM lineitem JOIN station ON station_idx = l_linenumber WHERE instrumented GROUP BY l_orderkey, l_linenumber",
    "q_kg_neighbourhood": """SELECT 'Unit' AS src, 'IN_LOT' AS relation, 'LOT-' || CAST(DIV(o_orderkey, 480) AS STRING) AS dst FROM orders WHERE o_orderkey = 7
      UNION ALL SELECT 'Unit', 'BY', o_orderpriority FROM orders WHERE o_orderkey = 7
      UNION ALL SELECT 'Visit', 'AT', 'S' || CAST(l_linenumber AS STRING) FROM lineitem WHERE l_orderkey = 7""",
    # scan feed and states
    "q_corrupt_scans": f"WITH {plant.PLANT} SELECT unit, j, round(x, 6) AS x FROM scan",
    "q_starved_naive": f"WITH {STATES} SELECT unit, j, round(greatest(start_s - lag(true_s) OVER (PARTITION BY j ORDER BY unit), 0e0), 6) AS starved_s FROM state WHERE unit > 0",
    "q_arrivals": f"WITH {STATES} SELECT unit, j, round(arrive_s, 6) AS arrive_s FROM state",
    "q_proc_order": f"WITH {plant.PLANT} SELECT unit, j, row_number() OVER (PARTITION BY j ORDER BY true_s, unit) AS place FROM scan",
    "q_clock_drift": f"""WITH {plant.PLANT}, gap AS (SELECT j, unit, true_s - lag(true_s) OVER (PARTITION BY unit ORDER BY j) AS gap, (SELECT max(unit) FROM scan) / 2 AS half FROM scan),
      half AS (SELECT j, PCTL(CASE WHEN unit >= half THEN gap END, 0.01) - PCTL(CASE WHEN unit < half THEN gap END, 0.01) AS drift_s,
        count_if(unit >= half) AS n2, count_if(unit < half) AS n1 FROM gap WHERE gap IS NOT NULL GROUP BY j)
      SELECT j, round(drift_s, 6) AS drift_s, abs(drift_s) > 3 AS drifted FROM half WHERE n1 >= 100 AND n2 >= 100""",
    "q_feed_quality": f"""WITH {plant.PLANT} SELECT j, round(avg(CASE WHEN x IS NULL THEN 1e0 ELSE 0e0 END), 6) AS missing_rate,
      round(least(greatest(1 - 6 * avg(CASE WHEN x IS NULL THEN 1e0 ELSE 0e0 END), 0e0), 1e0), 6) AS quality FROM scan GROUP BY j""",
    "q_repair_score": f"""WITH {plant.PLANT} SELECT count_if(x IS NULL) AS n_missing, count_if(x < true_s) AS n_duplicate, count_if(x > true_s) AS n_late, count(*) AS n FROM scan""",
    "q_confidence_adjust": f"""WITH {STATION}, quality AS (SELECT 'S' || CAST(l_linenumber AS STRING) AS sid, 1 - avg(l_discount) AS quality FROM lineitem WHERE l_linenumber < 5 GROUP BY l_linenumber)
      SELECT station.sid AS sid, round(0.9e0 * coalesce(quality, 1e0), 6) AS confidence, 0.9e0 AS raw FROM station LEFT JOIN quality ON station.sid = quality.sid""",
    "q_sweep_missed": f"""WITH {plant.PLANT}, dose AS (SELECT * FROM (VALUES (0), (1), (3), (6), (12)) AS t(rate))
      SELECT rate, j, count_if((unit * 37 + j * 53) % 100 < rate) AS n_missed, round(avg(CASE WHEN (unit * 37 + j * 53) % 100 >= rate THEN proc_s END), 6) AS mean_s FROM scan, dose GROUP BY rate, j""",
    "q_soft_sensor_direct": f"""WITH {STATES}, est AS (SELECT j, count(*) AS n, avg(dwell_s) AS mean_s, stddev_samp(dwell_s) AS sd FROM state GROUP BY j)
      SELECT j, n, round(mean_s, 6) AS mean_s, round(sd, 6) AS sd, round(mean_s - 1.96e0 * sd / sqrt(n), 6) AS lo95, round(mean_s + 1.96e0 * sd / sqrt(n), 6) AS hi95,
      round(least(greatest(least(1e0, n / 120e0), 0.05e0), 0.99e0), 6) AS confidence, 'direct' AS method FROM est WHERE n >= 30""",
    "q_score_soft": f"""WITH {STATES}, est AS (SELECT j, avg(proc_s) AS truth, avg(dwell_s) AS mean_s, stddev_samp(dwell_s) / sqrt(count(*)) AS se FROM state GROUP BY j)
      SELECT j, round(abs(mean_s - truth), 6) AS abs_err, round(100 * abs(mean_s - truth) / truth, 6) AS pct_err, abs(mean_s - truth) <= 1.96e0 * se AS in_ci FROM est""",
    "q_exposed_units": f"WITH {STATES} SELECT unit, j FROM state WHERE j = 3 AND true_s > 20000 AND start_s < 30000",
    "q_unit_thread": f"WITH {STATES}, {SIGNAL} SELECT state.j AS j, round(start_s, 6) AS start_s, round(true_s, 6) AS depart_s, round(v, 6) AS quantity, round(w, 6) AS price FROM state LEFT JOIN signal ON signal.unit = state.unit AND signal.j = state.j WHERE state.unit = 42",
    "q_suspect_population": f"""WITH {STATES}, ex AS (SELECT DISTINCT unit FROM state WHERE j = 3 AND true_s > 20000 AND start_s < 30000),
      last AS (SELECT unit, max(true_s) AS gone_s FROM state GROUP BY unit)
      SELECT count(*) AS n_exposed, count_if(gone_s > 30200) AS n_in_line, count_if(gone_s <= 30200) AS n_shipped FROM ex JOIN last ON ex.unit = last.unit""",
    "q_drift_slope": f"""WITH {STATES}, fit AS (SELECT j, count(*) AS n, regr_slope(dwell_s, unit) AS slope, regr_sxx(dwell_s, unit) AS sxx, regr_syy(dwell_s, unit) AS syy FROM state GROUP BY j)
      SELECT j, n, round(slope, 6) AS slope, round(sqrt((syy - slope * slope * sxx) / (n - 2) / sxx), 6) AS se, abs(slope) > 2 * sqrt((syy - slope * slope * sxx) / (n - 2) / sxx) AS kept FROM fit WHERE n >= 240""",
    "q_drift_slope_triggers": f"""WITH {STATES}, fit AS (SELECT DIV(unit, 480) * 480 + 480 AS trigger_unit, j, count(*) AS n, regr_slope(dwell_s, unit) AS slope, regr_sxx(dwell_s, unit) AS sxx, regr_syy(dwell_s, unit) AS syy FROM state GROUP BY DIV(unit, 480) * 480 + 480, j),
      err AS (SELECT *, sqrt(greatest(syy - slope * slope * sxx, 0e0) / (n - 2) / sxx) AS se FROM fit WHERE n >= 240)
      SELECT trigger_unit, j, n, round(slope, 6) AS slope, round(se, 6) AS se, abs(slope) > 2 * se AS kept FROM err""",
    # bottleneck
    "q_active_periods": f"WITH {PERIOD} SELECT sid, CAST(p AS BIGINT) AS p, s, e FROM period",
    "q_bottleneck_share": f"""WITH {SHARE} SELECT sid, round(count_if(NOT shifting) / (max(n) * 1e0), 6) AS sole_share, round(count_if(shifting) / (max(n) * 1e0), 6) AS shifting_share,
      round(count(*) / (max(n) * 1e0), 6) AS total_share FROM best, grid GROUP BY sid""",
    "q_bn_timeline": f"""WITH {SHARE}, per AS (SELECT DIV(t, 2880) AS blk, sid, count(*) AS n FROM best GROUP BY DIV(t, 2880), sid),
      rk AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY n DESC, sid) AS r FROM per) SELECT blk, r, sid, n FROM rk WHERE r <= 4""",
    "q_impute_proc": f"""WITH {STATES}, gated AS (SELECT *, lag(start_s) OVER (PARTITION BY j ORDER BY true_s, unit) AS earlier_s FROM state),
      theta AS (SELECT *, lead(earlier_s) OVER (PARTITION BY unit ORDER BY j) - start_s AS theta_s FROM gated)
      SELECT unit, j, round(greatest(CASE WHEN dwell_s - theta_s < 1.5e0 THEN least(dwell_s, theta_s) ELSE dwell_s END, 0.1e0), 6) AS proc_s FROM theta""",
    "q_regime_lead": """WITH day AS (SELECT DIV(EPOCH_US(ts), 86400000000) AS d, event_type, count(*) AS n FROM events GROUP BY DIV(EPOCH_US(ts), 86400000000), event_type),
      top AS (SELECT d, event_type, row_number() OVER (PARTITION BY d ORDER BY n DESC, event_type) AS r FROM day),
      run AS (SELECT d, event_type, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hot FROM top WHERE r = 1)
      SELECT coalesce(min(CASE WHEN hot = 3 THEN d - 2 END), -1) AS first_day, count(*) AS n_days FROM run""",
    # features, conformal sets, metrics
    "q_zscores": f"WITH {SIGNAL} SELECT unit, j, round(z, 6) AS z FROM zed",
    "q_type_extremes": f"WITH {SIGNAL} SELECT unit, j % 3 AS kind, round(min(z), 6) AS lo, round(max(z), 6) AS hi FROM zed GROUP BY unit, j % 3",
    "q_dark_z": f"WITH {SIGNAL} SELECT unit, round(max(z), 6) AS top, round(avg(z), 6) AS mean_z FROM zed WHERE j % 2 = 0 GROUP BY unit",
    "q_context_feats": f"WITH {STATES} SELECT unit, round(sum(starved_s), 6) AS starved_s, round(sum(dwell_s), 6) AS dwell_s FROM state WHERE j <= 5 GROUP BY unit",
    "q_category_codes": """WITH p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders) a),
      s AS (SELECT o_orderstatus AS v, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code FROM (SELECT DISTINCT o_orderstatus FROM orders) b)
      SELECT o_orderkey AS unit, p.code AS priority_code, s.code AS status_code FROM orders JOIN p ON p.v = o_orderpriority JOIN s ON s.v = o_orderstatus""",
    "q_gate_flags": "SELECT o_orderkey AS unit, max(CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 1 ELSE 0 END) AS gate2, max(CASE WHEN l_returnflag = 'R' AND l_linenumber = 4 THEN 1 ELSE 0 END) AS gate4 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "q_feature_matrix": f"""WITH {SIGNAL} SELECT unit, {', '.join(f"round(max(CASE WHEN j = {k} THEN z END), 6) AS z_s{k}" for k in range(1, 6))} FROM zed WHERE j <= 5 GROUP BY unit""",
    "q_labels": "SELECT o_orderkey AS unit, CASE WHEN bad.k IS NULL THEN 0 ELSE 1 END AS y FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7) bad ON bad.k = o_orderkey",
    "q_time_split": "SELECT o_orderkey AS unit, CASE WHEN o_orderkey % 100 < 65 THEN 'train' WHEN o_orderkey % 100 < 80 THEN 'calib' ELSE 'test' END AS part FROM orders",
    "q_type_status": "SELECT l_linenumber AS defect_type, count_if(l_returnflag = 'R') AS n_pos, CASE WHEN count_if(l_returnflag = 'R' AND l_orderkey % 100 < 65) < 60 THEN 'unmodelled: train' WHEN count_if(l_returnflag = 'R' AND l_orderkey % 100 BETWEEN 65 AND 79) < 20 THEN 'unmodelled: calib' ELSE 'fitted' END AS status FROM lineitem GROUP BY l_linenumber",
    "q_conformal_q": f"WITH {RISK} SELECT y, n, round(CASE WHEN n < 20 THEN 1e0 ELSE q END, 6) AS q FROM quant",
    "q_conformal_decision": f"WITH {RISK} SELECT unit, round(score, 6) AS score, in1, in0, decision FROM decision",
    "q_conformal_eval": f"""WITH {RISK} SELECT count(*) AS n, round(avg(CASE WHEN y = 1 THEN CASE WHEN in1 THEN 1e0 ELSE 0e0 END END), 6) AS coverage1, round(avg(CASE WHEN y = 0 THEN CASE WHEN in0 THEN 1e0 ELSE 0e0 END END), 6) AS coverage0,
      round(avg(CASE WHEN decision = 'flag' THEN 1e0 ELSE 0e0 END), 6) AS flag_rate, round(avg(CASE WHEN decision = 'abstain' THEN 1e0 ELSE 0e0 END), 6) AS abstain_rate FROM decision""",
    "q_roc_auc": f"""WITH {RISK}, rk AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM risk)
      SELECT count(*) AS n, round((sum(CASE WHEN y = 1 THEN r ELSE 0e0 END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2e0) / (count_if(y = 1) * count_if(y = 0)), 6) AS auc FROM rk""",
    "q_avg_precision": f"""WITH {RISK}, tie AS (SELECT score, sum(CAST(y AS DOUBLE)) AS tp, count(*) AS n FROM risk GROUP BY score),
      cum AS (SELECT tp, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(tp) OVER () AS total FROM tie)
      SELECT round(sum(ctp / cn * tp / total), 6) AS ap FROM cum""",
    "q_rolling_conformal": f"""WITH {RISK}, blk AS (SELECT unit, y, CASE WHEN y = 1 THEN 1 - score ELSE score END AS s, DIV(unit, 250) AS b FROM risk),
      win AS (SELECT blk.b + step.k AS b, y, s FROM blk CROSS JOIN (VALUES (1), (2), (3), (4)) AS step(k)),
      pl AS (SELECT win.b AS b, y, s, row_number() OVER (PARTITION BY win.b, y ORDER BY s) AS r, count(*) OVER (PARTITION BY win.b, y) AS n FROM win JOIN (SELECT DISTINCT b FROM blk) t ON t.b = win.b)
      SELECT b, y, max(n) AS n, round(max(CASE WHEN r = least(n, CAST(ceil(least(1e0, ceil((n + 1) * 0.9e0) / n) * (n - 1)) AS BIGINT) + 1) THEN s END), 6) AS q FROM pl GROUP BY b, y""",
    "q_top_evidence": f"""WITH {SIGNAL}, med AS (SELECT j, median(v) AS med FROM signal GROUP BY j), dev AS (SELECT signal.unit AS unit, signal.j AS j, v - med AS d FROM signal JOIN med ON med.j = signal.j),
      mad AS (SELECT j, median(abs(d)) AS mad FROM dev GROUP BY j), sc AS (SELECT unit, dev.j AS j, abs(d) / (mad + 1e-9) AS e FROM dev JOIN mad ON mad.j = dev.j),
      top AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY e DESC, j) AS r FROM sc) SELECT unit, j, round(e, 6) AS e, r FROM top WHERE r <= 3""",
    "q_top_evidence_all": f"""WITH {SIGNAL}, med AS (SELECT j, median(v) AS med FROM signal GROUP BY j), dev AS (SELECT signal.unit AS unit, signal.j AS j, v - med AS d FROM signal JOIN med ON med.j = signal.j),
      mad AS (SELECT j, median(abs(d)) AS mad FROM dev GROUP BY j), sc AS (SELECT unit, dev.j AS j, abs(d) / (mad + 1e-9) AS e FROM dev JOIN mad ON mad.j = dev.j),
      top AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY e DESC, j) AS r FROM sc) SELECT unit, j, round(e, 6) AS e, r FROM top WHERE r <= 3""",
    # investment
    "q_value_score": f"WITH {INVEST} SELECT sid, round((0.5e0 * disc + 0.35e0 * exposure * least(uncertainty / 2, 1e0) + 0.15e0 * least(hits / 5e0, 1e0)) / (cost / 100000e0), 6) AS value_per_lakh FROM ranked",
    "q_evi_rank": f"WITH {INVEST} SELECT sid, round(uncertainty, 6) AS uncertainty, round(exposure, 6) AS exposure, round(ambiguity, 6) AS ambiguity, round(evi, 6) AS evi, round(evi_per_lakh, 6) AS evi_per_lakh FROM ranked",
    "q_rationale": f"WITH {INVEST} SELECT sid, CASE WHEN uncertainty > 0.3e0 THEN 'wide interval' ELSE 'narrow interval' END || CASE WHEN exposure > 0.3e0 THEN '; limits the line' ELSE '' END AS rationale FROM ranked",
    "q_spearman": f"WITH {INVEST}, {RANKS} SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM rk",
    # alerts
    "q_ledger_build": f"""WITH {ALERT} SELECT 'bottleneck' AS source, count(*) AS n, round(sum(impact), 2) AS impact FROM alert WHERE kind = 'click'
      UNION ALL SELECT 'defect', count(*), round(sum(impact), 2) FROM alert WHERE kind = 'error' UNION ALL SELECT 'trace', count(*), round(sum(impact), 2) FROM alert WHERE kind = 'view'""",
    "q_envelope": """WITH env AS (SELECT * FROM (VALUES ('mean_quantity', 20e0, 30e0), ('mean_discount', 0e0, 0.02e0), ('mean_tax', 0e0, 0.1e0)) AS t(metric, lo, hi)),
      m AS (SELECT 'mean_quantity' AS metric, avg(l_quantity) AS v FROM lineitem UNION ALL SELECT 'mean_discount', avg(l_discount) FROM lineitem UNION ALL SELECT 'mean_tax', avg(l_tax) FROM lineitem)
      SELECT env.metric AS metric, round(v, 6) AS v, v >= lo AND v <= hi AS ok FROM env JOIN m ON m.metric = env.metric""",
    "q_metric_summary": """SELECT l_returnflag AS metric, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS sd, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY l_returnflag""",
    "q_probe_score": "SELECT count_if(instr(p_type, 'STEEL') > 0 OR instr(p_name, 'a') > 0) AS hits, count(*) AS n FROM part",
    "q_false_alarm": f"""WITH {STATION}, {FAULT}, touched AS (SELECT DISTINCT sid FROM fault JOIN station ON target = sid OR target = zone),
      fired AS (SELECT 'S' || CAST(l_linenumber AS STRING) AS sid, l_linestatus AS chart, CASE WHEN avg(l_quantity) > 25.5e0 THEN 1e0 ELSE 0e0 END AS fires FROM lineitem GROUP BY l_linenumber, l_linestatus)
      SELECT chart, count(*) AS n, round(avg(fires), 6) AS rate FROM fired LEFT ANTI JOIN touched ON touched.sid = fired.sid GROUP BY chart""",
}


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plant.sql(spark, sf_dir, spark_text(text))


def ranked(measure: Callable[..., DataFrame], text: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """A metric over a whole order: cut into slots on Spark, one window in the oracle."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = measure(plant.sql(spark, sf_dir, spark_text(text)), *columns)
        return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))

    return call


QUERIES = {name: query(text) for name, text in TEXTS.items()} | {
    "q_roc_auc": ranked(metrics.roc_auc, f"WITH {RISK} SELECT score, y FROM risk", "score", "y"),
    "q_avg_precision": ranked(metrics.average_precision, f"WITH {RISK} SELECT score, y FROM risk", "score", "y"),
    "q_spearman": ranked(metrics.spearman, f"WITH {INVEST} SELECT evi, cost FROM ranked", "evi", "cost"),
}
ORACLES = {
    name: duck_text(text).replace("LEFT ANTI JOIN", "ANTI JOIN").replace("AS STRING)", "AS VARCHAR)") for name, text in TEXTS.items()
}
