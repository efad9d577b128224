"""Registered queries over what passes the lines that are data. The oracles get the fixed values as rows and apply the rules in SQL, a row a visit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.operators import thread, traffic
from taktwerk.plans.charts import rounded
from taktwerk.sources import lines


def both(spark: SparkSession) -> DataFrame:
    return lines.stations(spark, "alpha").union(lines.stations(spark, "beta"))


# What the oracles say of the lines in their own words: where each type stands, cycle scales in order, stations without sensors, ends of zones.
PLACES = """
place(line, i, scale) AS (
  SELECT 'alpha', generate_subscripts(s, 1), unnest(s) FROM (SELECT [1.00, 1.05, 0.98, 1.02, 1.00, 1.00, 1.10, 0.97, 1.01, 1.03, 1.00, 1.04, 1.02, 1.00, 1.00, 1.00, 1.03, 0.95, 1.00, 1.01, 1.00, 0.99, 1.00, 1.00, 1.00, 1.00, 1.01, 1.04, 0.98, 1.03, 0.98, 1.02, 1.05, 0.99, 1.03, 1.00, 1.02, 0.96, 1.01, 1.03, 1.00, 1.15] AS s)
  UNION ALL
  SELECT 'beta', generate_subscripts(s, 1), unnest(s) FROM (SELECT [1.00, 1.04, 1.06, 1.02, 1.00, 1.02, 1.08, 1.01, 1.00, 1.00, 1.03, 1.02, 1.00, 1.10, 0.99, 1.01, 1.05, 1.02, 1.00, 1.07, 1.01, 0.98, 1.00, 1.03, 1.02, 0.99, 1.05, 1.12] AS s)),
kind(line, type_name, spots) AS (VALUES
  ('alpha', 'weld_robot', [1, 2, 4, 7, 10]),
  ('alpha', 'manual_fit', [3, 6, 9, 13, 18, 21, 25, 28, 31, 35, 38, 41]),
  ('alpha', 'sealer', [5, 11, 32, 39]),
  ('alpha', 'torque_station', [8, 12, 27, 30, 34, 37]),
  ('alpha', 'inspection_gate', [14, 24, 42]),
  ('alpha', 'paint_booth', [15, 16, 19, 22]),
  ('alpha', 'oven', [17, 20, 23]),
  ('alpha', 'electrical_fit', [26, 29, 33, 36, 40]),
  ('beta', 'weld_robot', [1, 3, 8]),
  ('beta', 'manual_fit', [2, 4, 7, 9, 11, 14, 16, 19, 22, 25, 27]),
  ('beta', 'sealer', [5, 18, 23]),
  ('beta', 'torque_station', [6, 13, 17, 21, 26]),
  ('beta', 'inspection_gate', [10, 28]),
  ('beta', 'electrical_fit', [12, 15, 20, 24])),
unlit(line, spots) AS (VALUES ('alpha', [3, 6, 9, 11, 13, 18, 21, 25, 28, 31, 35, 38, 41]), ('beta', [2, 4, 5, 7, 9, 11, 14, 16, 19, 22, 25, 27])),
station AS (
  SELECT place.line, CASE place.line WHEN 'alpha' THEN 'S' ELSE 'B' END || lpad(i::VARCHAR, 2, '0') AS sid, type_name,
    CASE WHEN i <= CASE place.line WHEN 'alpha' THEN 14 ELSE 10 END THEN 'BODY' WHEN place.line = 'alpha' AND i <= 24 THEN 'PAINT' ELSE 'FINAL' END AS zone, i::INT AS station_idx,
    (CASE WHEN type_name = 'oven' THEN 5 WHEN i <= CASE place.line WHEN 'alpha' THEN 24 ELSE 10 END THEN 3 WHEN place.line = 'alpha' THEN 1 ELSE 2 END)::INT AS buffer_capacity,
    NOT list_contains(unlit.spots, i) AS instrumented, scale::DOUBLE AS cycle_scale,
    CASE place.line WHEN 'alpha' THEN (320 + 26 * (i * 37 % 11)) / 100 ELSE (360 + 22 * (i * 29 % 9)) / 100 END AS transport_s
  FROM place JOIN kind ON kind.line = place.line AND list_contains(kind.spots, i) JOIN unlit ON unlit.line = place.line)"""
TOUCHED = """
fault(of, fault_id, kind, target, lo, hi) AS (VALUES ('alpha', 'F1', 'PARAM_DRIFT', 'S12', 9.0, 20.0), ('alpha', 'F2', 'CYCLE_DEGRADE', 'S28', 6.0, 20.0), ('alpha', 'F3', 'LOT_CONTAM', 'LOT-425', 0.0, 99.0),
  ('alpha', 'F4', 'ENV_EXCURSION', 'PAINT', 15.0, 16.6), ('alpha', 'F6', 'OPERATOR_VAR', 'FINAL-OP2', 0.0, 99.0), ('alpha', 'F5', 'MICROSTOP', 'S07', 3.0, 20.0),
  ('beta', 'F1', 'PARAM_DRIFT', 'B17', 8.0, 20.0), ('beta', 'F2', 'CYCLE_DEGRADE', 'B14', 5.0, 20.0), ('beta', 'F3', 'LOT_CONTAM', 'LOT-418', 0.0, 99.0),
  ('beta', 'F6', 'OPERATOR_VAR', 'FINAL-OP2', 0.0, 99.0), ('beta', 'F5', 'MICROSTOP', 'B03', 3.0, 20.0)),
touched AS (SELECT line, fault_id, sid, station_idx, lo, hi FROM station JOIN fault ON of = line WHERE CASE
  WHEN target IN (SELECT sid FROM station) THEN sid = target WHEN kind = 'ENV_EXCURSION' THEN zone = target
  WHEN kind = 'OPERATOR_VAR' THEN zone = split_part(target, '-', 1) AND type_name = 'manual_fit' WHEN kind = 'LOT_CONTAM' THEN type_name = 'electrical_fit' ELSE false END)"""
VISITS = """
visit AS (SELECT CASE WHEN l_orderkey % 3 = 2 THEN 'beta' ELSE 'alpha' END AS line, (l_partkey % CASE WHEN l_orderkey % 3 = 2 THEN 28 ELSE 42 END + 1)::INT AS station_idx,
  (date_diff('day', DATE '1992-01-01', l_shipdate::DATE) % 20 + 20) % 20 AS day FROM lineitem),
passed AS (SELECT s.*, (SELECT count(*) FROM visit v WHERE v.line = s.line AND v.station_idx = s.station_idx AND day IS NOT NULL) AS n_visits,
  (SELECT count(DISTINCT day) FROM visit v WHERE v.line = s.line AND v.station_idx = s.station_idx) AS n_days FROM station s)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, station_idx, day): line items as visits; two orders of three run on the large line, a part's key is its station, a shipping date one of 20 days."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    large = F.col("l_orderkey") % 3 < 2
    idx = F.col("l_partkey") % F.when(large, len(lines.ALPHA_STATIONS)).otherwise(len(lines.BETA_STATIONS)) + 1
    day = F.pmod(F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")), F.lit(20))
    return items.select(F.when(large, "alpha").otherwise("beta").alias("line"), idx.cast("int").alias("station_idx"), day.alias("day"))


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.loads(traffic.daily(visits(spark, sf_dir)), both(spark))


def q_line_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["line", "sid", "type_name", "zone", "station_idx", "buffer_capacity", "instrumented", "cycle_scale", "transport_s", "n_visits", "n_days"]
    return loaded(spark, sf_dir).select(*columns)


def q_line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(traffic.seen_share(loaded(spark, sf_dir)))


def q_coverage_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once the three busiest dark stations of each line have sensors."""
    found = loaded(spark, sf_dir)
    return rounded(lines.coverage_after(found, traffic.busiest_dark(found, 3)))


def q_affected_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of both lines, each with its own faults."""
    days = traffic.daily(visits(spark, sf_dir))
    parts = [traffic.fault_reach(days, lines.stations(spark, line), lines.faults(spark, line)) for line in ("alpha", "beta")]
    return parts[0].union(parts[1])


def q_gate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.gate_loads(loaded(spark, sf_dir)).select("line", "defect_type", "gate", "cutoff", "n_gated", "n_before")


def q_kg_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of edge of the thread's graph, with the edges that the tables hold."""
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    shift = F.floor(F.col("o_orderkey") * 30 / 28800)
    units = orders.select(F.col("o_orderkey").alias("unit"), F.floor(F.col("o_orderkey") / 480).alias("lot"), shift.alias("shift"))
    signals = F.array_compact(F.array("l_quantity", "l_extendedprice"))
    passed = items.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("sid"), F.col("l_suppkey").alias("operator"), F.size(signals).alias("n_signals"))
    found = items.filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("unit"), F.when(F.col("l_linenumber") > 4, "G7").otherwise("G4").alias("gate"), F.when(F.col("l_quantity") > 25, "HEAVY").alias("defect_type")
    )
    return thread.edge_counts(units, passed, both(spark), found)


def q_inr_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return suppliers.select(F.col("s_suppkey").alias("id"), lines.inr(F.col("s_acctbal") * 10).alias("inr"))


QUERIES = {
    "q_line_layout": q_line_layout,
    "q_line_coverage": q_line_coverage,
    "q_coverage_after": q_coverage_after,
    "q_affected_stations": q_affected_stations,
    "q_gate_map": q_gate_map,
    "q_kg_schema": q_kg_schema,
    "q_inr_format": q_inr_format,
}
ORACLES = {
    "q_line_layout": f"WITH {PLACES}, {VISITS} SELECT * FROM passed",
    "q_line_coverage": f"""WITH {PLACES}, {VISITS} SELECT line, count(*) AS n_stations, count(*) FILTER (WHERE NOT instrumented) AS n_dark,
      round(avg(instrumented::INT), 6) AS coverage, line = 'alpha' AS has_rework, line = 'alpha' AS has_parallel,
      sum(n_visits)::BIGINT AS n_visits, (sum(n_visits * instrumented::INT))::BIGINT AS n_seen, round(sum(n_visits * instrumented::INT) / sum(n_visits), 6) AS seen_share FROM passed GROUP BY line""",
    "q_coverage_after": f"""WITH {PLACES}, {VISITS}, dark AS (SELECT line, list(sid ORDER BY n_visits DESC, station_idx)[:3] AS chosen FROM passed WHERE NOT instrumented GROUP BY line)
      SELECT line, round(avg((instrumented OR list_contains(chosen, sid))::INT), 6) AS coverage FROM station JOIN dark USING (line) GROUP BY line""",
    "q_affected_stations": f"""WITH {PLACES}, {TOUCHED}, {VISITS} SELECT t.line, fault_id, sid, count(day) AS n_visits, count(DISTINCT day) AS n_days
      FROM touched t LEFT JOIN visit v ON v.line = t.line AND v.station_idx = t.station_idx AND day >= lo AND day <= hi GROUP BY ALL""",
    "q_gate_map": f"""WITH {PLACES}, {VISITS}, gate(line, defect_type, gate, cutoff) AS (VALUES ('alpha', 'WELD_POROSITY', 'S14', 13), ('alpha', 'SEALANT_VOID', 'S14', 13), ('alpha', 'PAINT_FINISH', 'S24', 23), ('alpha', 'LOOSE_FASTENER', 'S42', 41),
      ('alpha', 'ELECTRICAL_FAULT', 'S42', 41), ('alpha', 'FIT_MISALIGN', 'S42', 41), ('beta', 'WELD_POROSITY', 'B10', 9), ('beta', 'SEALANT_VOID', 'B10', 9), ('beta', 'LOOSE_FASTENER', 'B28', 27),
      ('beta', 'ELECTRICAL_FAULT', 'B28', 27), ('beta', 'FIT_MISALIGN', 'B28', 27))
      SELECT gate.*, count(*) FILTER (WHERE station_idx = cutoff + 1) AS n_gated, count(*) FILTER (WHERE station_idx <= cutoff) AS n_before FROM gate JOIN visit USING (line) WHERE day IS NOT NULL GROUP BY ALL""",
    "q_kg_schema": """SELECT 'Unit' AS src, 'HAS_VISIT' AS relation, 'Visit' AS dst, count(*) AS n_edges FROM lineitem UNION ALL SELECT 'Visit', 'AT', 'Station', count(l_linenumber) FROM lineitem
      UNION ALL SELECT 'Unit', 'IN_LOT', 'Lot', count(*) FROM orders UNION ALL SELECT 'Unit', 'IN_SHIFT', 'Shift', count(*) FROM orders UNION ALL SELECT 'Visit', 'BY', 'Operator', count(l_suppkey) FROM lineitem
      UNION ALL SELECT 'Station', 'IN_ZONE', 'Zone', 70 UNION ALL SELECT 'Station', 'OF_TYPE', 'StationType', 70 UNION ALL SELECT 'Visit', 'MEASURED', 'Signal', count(l_quantity) + count(l_extendedprice) FROM lineitem
      UNION ALL SELECT 'Unit', 'HAS_FINDING', 'Finding', count(*) FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'Finding', 'AT_GATE', 'Gate', count(*) FROM lineitem WHERE l_returnflag = 'R'
      UNION ALL SELECT 'Finding', 'OF_DEFECT', 'DefectType', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25""",
    "q_inr_format": """SELECT s_suppkey AS id, CASE WHEN abs(v) >= 1e7 THEN round(v / 1e7, 2)::VARCHAR || ' cr' WHEN abs(v) >= 1e5 THEN round(v / 1e5, 2)::VARCHAR || ' L'
      ELSE 'Rs ' || round(v)::BIGINT::VARCHAR END AS inr FROM (SELECT s_suppkey, s_acctbal * 10 AS v FROM supplier)""",
}
